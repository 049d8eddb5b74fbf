"""Short forms of given names and of words in organisations' names: an optional prior.

Operators learn both from the corpus; these common English forms only count as a few observations more.
"""

from __future__ import annotations

# Given name, then its usual short forms.
SHORT_FORMS = """
Abigail Abby
Abraham Abe
Adam
Adrian Ade
Agnes Aggie
Albert Al Bert
Alexander Alex Lex Sasha
Alexandra Alex Sandra
Alice
Amanda Mandy
Andrea
Andrew Andy Drew
Angela Angie
Anna Annie
Anne Nan
Anthony Tony
Arthur Art
Barbara Babs Barb
Beatrice Bea
Benjamin Ben Benny
Bernard Bernie
Brian
Caroline Carrie
Carol
Catherine Cat Cathy Kate
Charles Charlie Chuck
Charlotte Lottie
Christina Tina
Christopher Chris Kit
Claire
Daniel Dan Danny
David Dave
Deborah Deb Debbie
Dennis Den
Diana Di
Donald Don Donny
Dorothy Dot Dottie
Edith Edie
Edward Ed Ned Ted
Eleanor Nell Nora
Elizabeth Beth Betty Liz
Emily Em
Emma
Eric Rick
Ernest Ernie
Eugene Gene
Frances Fran Francie
Francis Frank
Frederick Fred Freddy
Gabriel Gabe
Geoffrey Geoff
George
Gerald Gerry
Gregory Greg
Hannah
Harold Hal Harry
Helen Nell
Henry Hank
Herbert Herb
Hugh
Ian
Isabella Bella Izzy
Jacob Jake
James Jim Jimmy
Jane Janie
Janet Jan
Jason
Jennifer Jen Jenny
Jessica Jess
Joan
John Jack Johnny
Jonathan Jon
Joseph Joe Joey
Joshua Josh
Judith Judy
Julia
Karen
Katherine Kate Katie Kathy
Kenneth Ken Kenny
Kevin Kev
Kimberly Kim Kimmy
Laura
Lawrence Larry
Leonard Len Lenny
Lillian Lily
Linda
Louis Lou
Lucy
Madeline Maddie
Margaret Maggie Meg Peg
Maria
Mark
Martha
Martin Marty
Mary Molly Polly
Matthew Matt
Maximilian Max
Michael Mick Mike
Nancy
Nathaniel Nat Nate
Nicholas Nick
Nicole Nikki
Oliver Ollie
Pamela Pam
Patricia Pat Trish
Patrick Paddy
Paul
Peter Pete
Philip Phil
Rachel
Raymond Ray
Rebecca Becky
Richard Dick Rick
Robert Bob Bobby Rob
Roger
Ronald Ron
Ruth
Samantha Sam
Samuel Sam Sammy
Sarah Sally
Simon
Sophia Sophie
Stephen Steve
Susan Sue Susie
Theodore Teddy Theo
Theresa Terry Tess
Thomas Tom Tommy
Timothy Tim
Victoria Tori Vicky
Vincent Vince
Walter Walt
William Bill Billy Will
Zachary Zach
"""

# Abbreviation and given name.
OLD_ABBREVIATIONS = "Alexr Alexander, Chas Charles, Danl Daniel, Edw Edward, Eliz Elizabeth, Fredk Frederick, Geo George, Jas James, Jno John, Jos Joseph, Richd Richard, Robt Robert, Saml Samuel, Thos Thomas, Wm William"

# Line of business, then its usual abbreviations.
BUSINESS_WORDS = """
academy
agency
airlines
associates assoc
association assoc assn
bakery
bank
beverages bev
brewery
brothers bros
capital
center
centre
chemicals chem
clinic
college
communications comms
construction constr
consulting cons
cooperative coop
department dept
design
development dev
distribution dist
electric elec
electronics
energy
engineering engrg eng
enterprises
entertainment
equipment
farms
finance fin
foods
foundation fdn
group grp
healthcare
holdings hldgs
hospital hosp
hotels
industries ind
institute inst
insurance ins
international intl
investments
laboratories labs
logistics log
management mgmt
manufacturing mfg
marketing mktg
materials
media
mining
motors
museum
networks
partners
pharmaceuticals pharma
photography
press
products prods
properties
publishing publ
realty
records
research
resources
restaurant
robotics
school
security
services svcs
shipping
society
software
solutions
steel
stores
studios
supplies
systems sys
technologies tech
telecommunications telecom
textiles
tools
trading
transport transp
university univ
ventures
works
"""


def _table(lines: str) -> dict[str, list[str]]:
    return {line.split()[0].lower(): [short.lower() for short in line.split()[1:]] for line in lines.split("\n") if line}


FULL = _table(SHORT_FORMS)
BUSINESS = _table(BUSINESS_WORDS)
ABBREVIATED = {pair.split()[0].lower(): pair.split()[1].lower() for pair in OLD_ABBREVIATIONS.split(", ")}
KNOWN = frozenset(FULL) | {short for shorts in FULL.values() for short in shorts}
KNOWN_BUSINESS = frozenset(BUSINESS) | {short for shorts in BUSINESS.values() for short in shorts}
