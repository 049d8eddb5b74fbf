"""Training of the personal-information model on invented sentences.

Sentences are made from carriers with slots; what fills a slot is generated, so its place and type are known.
Weights maximise the likelihood of the right segmentation (forward-backward over the candidate lattice, AdaGrad,
L2). ``python -m chronoweave.llm.pii_training`` trains, reports accuracy on newly made sentences, and writes the
weights.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

from chronoweave.llm.given_names import ABBREVIATED, FULL
from chronoweave.llm.pii import PARTICLES, START, STATES, TYPES, WEIGHTS, Line, Model, candidates

_SYLLABLES = "an bel cor da dor el fen gor hal il jun kel lor mar nel or pim ro sal tul ur ven wes yor zel ši ře lö ña çu dé mø".split()
_COMMON = "the a of to in is it for on with at by from we you they was will be has have not this that please today tomorrow".split()
_INDUSTRIES = "Transport and Logistics|Foods and Beverages|Department Stores|Pharmaceuticals|Associates|University|Holdings|Technologies|Services|Brothers|Publishing|Laboratories|Foundation|Consulting|Insurance|Systems|Manufacturing|Institute|Engineering|Communications|Bank|Group|Partners|Motors|Energy".split("|")
_LEGAL = "Ltd|LLC|PLC|Inc.|Corp.|GmbH|AG|S.A.|Co.|Inc|Corp".split("|")
_TOPICS = "the budget|onboarding|the garden plan|night shifts|pricing|data retention|winter stock|the glass roof|bee boxes|the choir trip|seat maps|the tram strike|the new oven|battery recycling|the harbour lease|the launch|hiring|travel".split("|")
_STATES = "on track|paused|launched|late again|in planning|under review|half done|cancelled|done".split("|")

CARRIERS = """
Please remind me that {name} prefers tea.
I met {name} today and we talked about {topic}.
Spoke with {name} about Project {word}. It is still {state}.
Hi {given}, thanks for the update on {topic}!
Hello {given}, can you look at {topic}?
Dear {given}, the {w} is ready.
Thanks {given}!
According to {name}, {org} is {state}; {name} disagrees.
{name} told me the role at {org} starts next month.
Noted: Dr. {name} moved to {org}.
Noted: Prof. {name} moved to {org}.
Mr {name} and Mrs. {name} will join.
Ms. {name} called about {topic}.
{name} and {name} will run Project {word} together.
who is {name} again?? the one from {org}
J'ai vu {name} hier, on a parlé de Project {word}.
J'ai vu {name} hier, on a parlé de {topic}.
Ayer hablé con {name} sobre {topic}.
Gestern habe ich mit {name} über {topic} gesprochen.
Emergency contact 🚑 {name}, {phone}.
You can reach {name} at {email} or {phone}.
{name} has {idcue}{id}, please keep it private.
the courier asked for {idcue}{id} at {address} :(
For the form: {idcue}{id}, born in Port {word}.
For the form: {ssn}, born in Port {word}.
{name} has {ssn}, please keep it private.
the courier asked for {ssn} at {address} :(
New phone: {phone}. Old one ({phone}) is off.
My number is {phone} - call after six.
My mobile is {phone}.
call {phone} or write to {email}
tel {phone}
fax {phone}
mail {email}
Mon adresse : {address}. Mon courriel : {email}.
Mi dirección es {address} y mi correo {email}.
Bitte an {address} schicken, Rückfragen unter {phone}.
Ship the samples to {address} please, attention {name}.
We moved, the address is now {address}; mail goes to {email}
Send it to {email}, cc {email}.
I wrote to {email} twice (order {code}) but no answer 😕
Contact card -> {name} | {phone} | {email} | {address}
{address}
She lives at {address}.
The meeting with {name} is at {address}.
Signed, {name}
From: {name}
cc {name}, {name} and {name}
{given} said {topic} is {state}.
I asked {given} about {topic}.
Is {name} coming on {date}?
{name}: {topic} is {state}
Main Street traffic was bad, the demo started late.
The shop on Station Road opens late.
Our Avenue campaign and the Lane project are {state}.
Ping @{w}bot or use #{w} if Project {word} is {state}.
Order {code} left the depot in Port {word} on {date}.
See room 4.12, shelf {code}.
Could you check ticket {code} again?
The invoice total was {money}, batch {code}.
We agreed on {money} per unit for {topic}.
Serial {serial} was replaced in Port {word}.
The build hash is {hash}, the node answered on port 8080.
The release {version} of Project {word} is {state}.
The score was {n3}-{n3} in the end.
Meter reading {big} units; last time it was {big}.
The {topic} file has {n3} rows and 0147 columns.
Grace period ends on {date}, mark the calendar.
No idea, ask again on {date}…
Will this work before {date}?
Will you send the {w} on {date}?
La réunion sur {topic} est prévue le {date}.
Das Treffen zu {topic} ist am {date}.
What do we know about {topic}?
Remember: {topic} first, then Project {word}.
I think {org} will decide on {topic} by {date}.
{org} is {state} and hires in Port {word}.
I noted it. Anything else about Project {word}?
Sure, I saved that for later.
Line 1
Line 2: {topic}
done
Okay 👍
The {w} in Upper {word} is {state}, the {w} in Old {word} is not.
We visited {word} and {word} last {w}.
The {w} {w} was {w} by the {w}.
Max speed is {n3}, the bill is {money}, mark it with a dot.
{org} and {org} merged on {date}.
Version {version} and build {hash} are {state}.
Invoice {code}, order {code}, part number {serial}.
"""

#: Sentences of everyday and business writing, made without regard to any table.
GENERAL = """
{name} emailed the board about the merger.
{name} emailed us last night.
We hired {name} as lead engineer last week.
We interviewed {name} for the analyst position.
Yesterday {name} presented the quarterly figures to the committee.
Have you seen {name} this morning?
My neighbour {name} grows tomatoes.
My colleague {name} will cover for me while I am away.
Our accountant, {name}, found two errors in the report.
The author of the study, {name}, declined to comment.
The package was signed for by {name} at noon.
She introduced me to {name} and {name} during lunch.
He married {name} in June.
Ask {name} whether the keys were returned.
I forwarded your question to {name} because she knows the details.
Could {name} please sign the contract before Friday?
{name}'s laptop needs a new battery.
I borrowed {given}'s umbrella.
I had dinner with {given} and {given} on Saturday.
{given} forgot the tickets again.
{given}, are you free on Monday?
Tell {given} that the train leaves at nine.
Thank you {given}, that was very helpful.
Good morning {given}, here is the agenda.
Best regards, {name}
Kind regards
Written by {name}, edited by {name}.
Attendees: {name}, {name}, {name}
Patient: {name}
Name: {name}
Employee {name} reported the incident.
Customer {name} asked for a refund.
The witness identified {name} as the driver.
Professor {name} teaches chemistry.
Captain {name} and Nurse {name} were present.
Mr. {name} lives next door.
This is {name} from the support team.
My name is {name} and I would like to cancel my order.
I'm {given}, nice to meet you.
Is this {name}?
he said {name} would call back
i think {name} left already
The prize went to {name} of {org}.
{name} joined {org} as a director.
{name} from {org} confirmed the appointment.
{org} announced that {name} will step down.
{org} sued {org} over a patent.
I work for {org} in {place}.
{org} opened an office in {place}.
The {org} factory in {place} closed last year.
Shares of {org} fell by three percent.
She moved from {place} to {place} in {month}.
The weather in {place} was lovely.
{place} is famous for its cathedral.
Flights to {place} are cheap in {month}.
Trains between {place} and {place} run every hour.
The {place} conference starts on {day}.
The River {word} flows through {place}.
Lake {word} is frozen until {month}.
The new {word} phone has a better camera.
We tested the {word} engine under load.
{word} is a programming language.
The movie {word} was boring.
Install {word} and restart the server.
Our product {word} ships in {month}.
On {day} we went hiking near Mount {word}.
The school is closed on {day} and {day}.
In {month} the garden is full of roses.
His SSN is {ssn}.
Her social security number is {ssn}, do not share it.
SSN: {ssn}
My {idcue}{id} expires in {month}.
Please verify {idcue}{id} before the flight.
The bank needs {idcue}{id} and my address {address}.
National insurance: {id2}
IBAN {iban}
The number on the card is {card}.
Please call me back at {phone} tomorrow.
Call {phone}.
{phone}
Phone: {phone}
Text {phone} for details, or email {email}.
The hotline {phone} is open all day.
Her new number is {phone} and her old number was {phone}.
Reach the office under {phone} or {phone}.
WhatsApp {phone} works best
Write to {email} for a copy.
{email}
Email: {email}
My email is {email}, thanks.
The invitation went to {email} and {email}.
Contact {name} <{email}>
You can find us at {address}.
{address}
Our office is located at {address}, right next to the station.
He grew up at {address}.
Deliver the sofa to {address} on {day}.
Address: {address}
Meet me in front of {address} at eight.
The house at {address} was sold for {money}.
The dentist moved to {address} in {month}.
Turn left on {street} and walk two blocks.
{street} is closed for repairs.
{street} traffic was slow on {date}.
{street} has {n3} trees and {n3} lamps.
The bakery on {street} sells fresh bread.
There were {n3} guests and only {n3} chairs.
The serial number is {serial}.
Tracking code {code} does not work.
The meeting at 10:30 was moved to 14:00.
Chapter 12 starts on page {n3}.
The bill came to {money} including tax.
Temperatures reached 31 degrees on {date}.
Version {version} fixes the memory leak.
The flight left at 6:45 and landed at 11:20.
Read section 4.2.1 of the manual.
Population grew to {big} people.
Mark the date in your calendar.
May I open the window?
Will you be there on time?
Dear Sir or Madam, please find the invoice attached.
To whom it may concern
Traffic stalled near the bridge.
Everything works again after the restart.
Bring your own cup, please.
Nobody answered the door, so we left.
The Art Museum and the City Library are free on {day}.
English, French and German are spoken here.
The Board of Directors approved the Annual Report.
Happy Birthday to you!
The Department of Finance published new rules.
Terms and Conditions apply.
I bought a Toyota and an old piano.
Lunch with {name} was pleasant.
The interview with {name} is on {day}.
I had coffee with {given} before work.
I'm {name} from {org}.
I am {given} and I sell bicycles.
Worker {name} was promoted.
Judge {name} postponed the trial.
{given} said hello.
{given} thinks that {topic} is {state}.
{name} won the race.
Das ist {name} aus {place}.
Bitte rufen Sie {name} unter {phone} an.
Wir wohnen in {place}, Antwort bitte an {email}.
Ich habe {given} im Zug getroffen.
Der Bericht zu {topic} kommt am {date}.
Die Adresse ist {address}, der Schlüssel liegt bei {name}.
Je m'appelle {name} et j'habite {address}.
Le rapport de {name} sera prêt le {date}.
Me llamo {name} y vivo en {place}.
La tienda de {place} abre el {day}.
El informe de {name} llega el {date}.
Pages {n3}-{n3} are missing.
Rooms {n3}-{n3} are booked until {day}.
The final result was {n3}-{n3} after extra time.
The game {word} was released in {month}.
The book {word} and the film {word} tell the same story.
Dear Customer, your Order has been shipped.
Dear Team, the Office Party is on {day}.
Your Parcel {code} is in {place} now.
{org} is a Member of the Trade Association.
Visitors from {place} and {place} like the Old Town.
"""

_SLOT = re.compile(r"\{(\w+)\}")


_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_MONTHS = "January February March April May June July August September October November December".split()
_ENDS = "ton son field man ley ford berg stein well wood more worth by dale ski enko ez ini off ander ega ara ura iak iu".split()
_STEMS = "Harr Wil Hart Jack Sten Brad Ell Mor Ort Vald Kow Petr Ross Mend Gar Silv Nak Tan Yam Hoff Lind Ander Step Thorn Ash Black Green Whit Hol Nor Wes Pres Clay Dar Fair Gil Hal Ken Lang Mal Pem Quin Rad Sel Tur Und Vern War Yor Zim".split()
_GIVEN_ENDS = "an a en ine iel ina ius ette on elle ario ita ulio ian ia ael o us ika".split()
#: Fillers kept for evaluation only: every second stem and given name.
TRAINED, HELD_OUT = 0, 1


class Maker:
    """Random fillings, all invented. With ``part`` 0 or 1 the names come from one half of all stems and lists."""

    def __init__(self, seed: int, part: int | None = None):
        self.random = random.Random(seed)
        half = lambda of: list(of) if part is None else list(of)[part::2]
        self.stems, self.syllables, self.full = half(_STEMS), half(_SYLLABLES), half(FULL)

    def one(self, *options: str) -> str:
        return self.random.choice(options)

    def digits(self, n: int) -> str:
        return "".join(self.random.choices("0123456789", k=n))

    def raw(self) -> str:
        return "".join(self.random.choices(self.syllables, k=self.random.randint(2, 4)))

    def word(self) -> str:
        return self.raw().capitalize()

    def w(self) -> str:
        return self.raw() if self.random.random() < 0.6 else self.random.choice(_COMMON)

    def topic(self) -> str:
        return self.random.choice(_TOPICS)

    def state(self) -> str:
        return self.random.choice(_STATES)

    def org(self) -> str:
        core, industry, legal = self.word(), self.random.choice(_INDUSTRIES), self.random.choice(_LEGAL)
        return self.one(f"{core} {industry} {legal}", f"{core} {industry} {legal}", f"{core} {industry}", f"The {core} {industry}")

    def unlisted(self) -> str:
        """A given name that no list holds."""
        return self.random.choice(self.stems)[:3].capitalize() + self.random.choice(_GIVEN_ENDS)

    def family(self) -> str:
        stem = self.random.choice(self.stems) + self.one("", "", "ing", "er", "o", "en", "a") + self.random.choice(_ENDS)
        return self.one(self.word(), self.word(), stem, stem, f"{self.one('Mc', 'O’', 'Mac')}{stem}", f"{self.one('van', 'de', 'von')} {stem}") if self.random.random() < 0.6 else self.word()

    def place(self) -> str:
        return self.one(self.word(), f"{self.one('Port', 'New', 'Upper', 'Old', 'San', 'Saint')} {self.word()}", self.random.choice(self.stems) + self.one("ville", "burg", "stad", "pool", "haven", "chester"))

    def day(self) -> str:
        return self.random.choice(_DAYS)

    def month(self) -> str:
        return self.random.choice(_MONTHS)

    def street(self) -> str:
        return f"{self.word()} {self.one('Street', 'Road', 'Avenue', 'Lane', 'Drive', 'Crescent', 'Boulevard')}"

    def iban(self) -> str:
        return f"{self.one('DE', 'GB', 'FR', 'ES', 'PL')}{self.digits(2)} " + " ".join(self.digits(4) for _ in range(self.random.randint(4, 5))) + f" {self.digits(2)}"

    def id2(self) -> str:
        return f"{self.one('QQ', 'AB', 'JC')} {self.digits(2)} {self.digits(2)} {self.digits(2)} {self.one('A', 'B', 'C')}"

    def card(self) -> str:
        return self.one(" ", "-").join(self.digits(4) for _ in range(4))

    def given(self) -> str:
        if self.random.random() < 0.25:
            return self.unlisted()
        full = self.random.choice(self.full)
        return self.random.choice([full, *FULL[full]]).capitalize()

    def name(self) -> str:
        full = self.random.choice(self.full)
        given, family, initial = full.capitalize(), self.family(), self.random.choice("ABCDEFGHJKLMNPRSTW")
        if self.random.random() < 0.25:
            given = self.unlisted()
            if self.random.random() < 0.8:
                return self.one(f"{given} {family}", f"{given} {family}", f"{given} {family}", f"{given} {initial}. {family}", f"{given} {self.unlisted()} {family}")
        if self.random.random() < 0.3 and FULL[full]:
            given = self.random.choice(FULL[full]).capitalize()
        if self.random.random() < 0.08:
            given = self.typo(given)
        plain = f"{given} {family}"
        r = self.random.random()
        if r < 0.45:
            return plain
        if r < 0.55:
            return f"{full[0].upper()}. {family}"
        if r < 0.63:
            return f"{family}, {given}"
        if r < 0.67:
            return f"{family}, {full[0].upper()}."
        if r < 0.73:
            return f"{given} {initial}. {family}"
        if r < 0.79:
            return plain.lower()
        if r < 0.85:
            return plain.upper()
        if r < 0.88:
            return f"{family} {given}"
        if r < 0.91 and FULL[full]:
            return f'{full.capitalize()} "{FULL[full][0].capitalize()}" {family}'
        if r < 0.93:
            return f"{self.one(*[a.capitalize() for a in ABBREVIATED], full[:4].capitalize())}. {family}"
        if r < 0.97:
            return given
        return family

    def typo(self, word: str) -> str:
        k = self.random.randrange(1, len(word)) if len(word) > 1 else 0
        return word[:k] + word[k + 1 :] if self.random.random() < 0.5 else word[:k] + word[k - 1] + word[k:]

    def email(self) -> str:
        given, family = self.random.choice(self.full), re.sub(r"[^a-z]", "x", self.raw())
        local = self.one(f"{given}.{family}", f"{family}_{given}", f"{given}{self.digits(2)}", f"{given[0]}{family}", f"{family}-{self.digits(3)}", f"{given}.{family}+{self.one('news', 'shop', 'list')}")
        domain = self.one("example.com", "example.org", "example.net", "mail.example", "office.test", "desk.invalid", "post.example", "uni.example.org")
        r = self.random.random()
        if r < 0.7:
            address = f"{local}@{domain}"
        elif r < 0.78:
            address = f"{local} @ {domain}"
        elif r < 0.86:
            address = f"{local} (at) {domain}"
        elif r < 0.94:
            address = f"{local} [at] {domain.replace('.', ' [dot] ')}"
        elif r < 0.97:
            address = f"{local}＠{domain}"
        else:
            address = f"{local} at {domain.replace('.', ' dot ')}"
        return address.upper() if self.random.random() < 0.05 else address

    def phone(self) -> str:
        d = self.digits
        area = self.one("212", "312", "415", "617", "713", "808", str(self.random.randint(201, 989)))
        a, b = self.one("555", d(3)), d(4)
        return self.one(
            f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+1 {area} {a} {b}", f"+1-{area}-{a}-{b}", f"1 ({area}) {a} {b} x{d(3)}", f"{area}{a}{b}", " ".join(area + a + b), f"1 ({area}) {a} {b}",
            f"+44 20 7946 {d(4)}", f"020 7946 {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"01 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 30 23125 {d(3)}", f"030/23125-{d(3)}", f"+34 6{d(2)} {d(3)} {d(3)}",
            f"+1 ({area}) {a}-{b}", f"+1 ({area}) {a}-{b} ext {d(self.random.randint(1, 4))}", f"({area}) {a}-{b} ext. {d(3)}", f"+{self.random.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"07{d(3)} {d(6)}",
        )

    def ssn(self) -> str:
        return f"{self.one('9', '9', self.digits(1))}{self.digits(2)}-{self.digits(2)}-{self.digits(4)}"

    def idcue(self) -> str:
        d, letter = self.digits, self.random.choice("ABCDEFGHJKLMNPRSTVXYZ")
        cue, number = self.random.choice(
            [
                ("SSN ", f"9{d(2)} {d(2)} {d(4)}"), ("social security number: ", f"9{d(8)}"), ("passport no. ", f"{letter}{d(8)}"), ("tax number ", f"{d(2)}/{d(3)}/{d(5)}"), ("ID card ", f"AX-{d(4)}-{d(3)}"),
                ("DNI ", f"{d(8)}{letter}"), ("insurance number ", f"QQ {d(2)} {d(2)} {d(2)} {self.one('A', 'B', 'C', 'D')}"), ("PESEL ", d(11)), ("passport ", f"{letter}{letter}{d(7)}"), ("tax id ", f"{d(2)} {d(3)} {d(3)} {d(3)}"),
            ]
        )
        self.number = number
        return cue

    def id(self) -> str:
        return self.number

    def address(self) -> str:
        n, name, city = str(self.random.randint(1, 240)), self.word(), self.word()
        zip_code = self.digits(5)
        address = self.one(
            f"{n} {name} Street", f"{n} {name} Street", f"{n} {name} Avenue, {city} {zip_code}", f"{n} {name} Rd., Apt {self.digits(1)}", f"{n} {name} Rd., Apt {self.random.randint(10, 40)}", f"{n}B {name} Blvd, Port {city}", f"{n} {name.lower()} lane",
            f"{name}straße {n}, {zip_code} {city}", f"{name}weg {n}", f"{name}strasse {n}", f"Calle {name} {n}, {city}", f"{n}, rue {name}, {zip_code} {city}", f"{n} avenue de {name}", f"{n} rue de {name}", f"{n} {name} Road, {city}",
            f"{n} {name} {self.one('Crescent', 'Close', 'Court', 'Lane', 'Row', 'Drive', 'Parkway', 'Trail', 'Circle', 'Walk', 'Grove', 'Way', 'Place', 'Terrace', 'Square')}, {city}",
            f"{n} {self.one('Oak', 'Maple', 'Church', 'Mill', 'Park', 'Station', 'High', 'Green', name)} {self.one('Crescent', 'Street', 'Road', 'Close', 'Lane', 'Drive', 'Avenue', 'Court')}", f"{n} {name} {self.word()} {self.one('Street', 'Avenue', 'Road')}",
            f"{n} {name} {self.word()} {self.word()} Street, {city}", f"Flat {self.random.randint(1, 30)}, {n} {name} Road",
        )
        return address

    def code(self) -> str:
        d = self.digits
        return self.one(f"#{d(6)}", d(5), f"A{d(5)}", f"{d(4)}-{d(2)}", f"{d(3)}-{d(6)}-{d(1)}")

    def serial(self) -> str:
        d = self.digits
        return self.one(f"SN{d(3)}-{d(3)}-{d(4)}", f"{d(2)}/{d(2)}/X{d(3)}")

    def hash(self) -> str:
        return "".join(self.random.choices("0123456789abcdef", k=10))

    def version(self) -> str:
        return ".".join(str(self.random.randint(0, 300) if k == 3 else self.random.randint(0, 20)) for k in range(4))

    def money(self) -> str:
        return self.one(f"${self.digits(2)},{self.digits(3)}", f"{self.digits(3)}.50 EUR", f"{self.digits(4)} zł", f"€{self.digits(3)}")

    def big(self) -> str:
        return f"{self.digits(2)},{self.digits(3)}.{self.digits(2)}"

    def n3(self) -> str:
        return str(self.random.randint(100, 999))

    def date(self) -> str:
        y, m, d = self.random.randint(2022, 2026), self.random.randint(1, 12), self.random.randint(1, 28)
        return self.one(f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}")

    def sentence(self, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
        parts, at, items = [], 0, []
        length = 0
        for match in _SLOT.finditer(carrier):
            fixed, slot = carrier[at : match.start()], match.group(1)
            filling = getattr(self, slot)()
            parts += [fixed, filling]
            length += len(fixed)
            kind = {"given": "name", "id": "id_number", "ssn": "id_number", "id2": "id_number", "iban": "id_number", "card": "id_number"}.get(slot, slot)
            if kind in TYPES:
                # the mark that ends an abbreviation ends the item too
                items.append((length, length + len(filling), kind))
            length += len(filling)
            at = match.end()
        return "".join([*parts, carrier[at:]]), items

    def line(self, carriers: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        text, items = "", []
        for k in range(self.one(1, 1, 2, 2)):
            more, found = self.sentence(self.random.choice(carriers))
            text += " " if k else ""
            items += [(a + len(text), b + len(text), kind) for a, b, kind in found]
            text += more
        return text, items


# Common English words, and words of titles, places, organisations and numbers.
_ENGLISH = """
about above after again all also always am among an and any are around as ask asked at away back be became because been before began behind being below between both bring but buy by call called came can
come could day days did different do does done down during each early email emailed enough even every few find first five followed for found four from full gave get give go goes going gone good got great
had half hand has have he head hear heard held help her here him his home hour house how however if in into is it its join joined just keep kept knew know known last late later learn least leave left less
let like little live long look made make making man many me mean meet meeting met might month more morning most move moved much must my near need never new next night no not nothing now of off often on once
one only open or order other our out over own part people place plan please point present put read really report right room run said same saw say says school see seems seen sent set several she should show
sign since small so some soon spoke start started still stop such take taken talk team tell than that the their them then there these they thing think this those three through time to today together told
tomorrow too took town turn two under until up us use used very visit wait walk want wants was water way we week weeks well went were what when where which while who why with without work worked works write am an auf aus bei bitte das der die ein eine es für habe hat ich im ist kommt mit nach sie und unter von wir zu zum avec de des du elle en est et il je la le les pour sur une con del el en es ha los mi para por que se su un una y
wrote year years yes yesterday yet you your
"""
_FIRM = "Port Project Upper Old New San Saint Mount Lake River apt suite floor flat SSN DNI PESEL passport no tax number insurance ID card social security EUR zł SN dr prof mr mrs ms miss captain professor nurse doctor sir madam Bros Labs Pharma Tech Mfg Univ Inst Svcs Hldgs"


def _words(*texts: str) -> set[str]:
    return {w.lower() for t in texts for w in re.findall(r"[^\W\d_]{2,}", t)}


def _firm() -> frozenset[str]:
    """Words that are known in any text."""
    return frozenset(_words(_ENGLISH, _FIRM, *_INDUSTRIES, *_LEGAL, *_COMMON, *_DAYS, *_MONTHS) - PARTICLES)


def _known(carriers: list[str]) -> frozenset[str]:
    return _firm() | _words(*(_SLOT.sub(" ", c) for c in carriers), *_TOPICS, *_STATES) - PARTICLES


def _lattice(line: Line, gold: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str, list[str]]], set[int]] | None:
    """Candidates, and which of them are right; None if a right one is no candidate."""
    places = {(line.at.get(a), line.at.get(b), kind) for a, b, kind in gold}
    own, right, seen = [], set(), set()
    for i, j, kind, features in candidates(line):
        if (i, j, kind) in seen:
            continue
        seen.add((i, j, kind))
        if (i, j, kind) in places:
            right.add(len(own))
        own.append((i, j, kind, ["bias", *features, *line.left(i), *line.right(j)]))
    return (own, right) if len(right) == len(places) else None


def carrier_lines() -> list[str]:
    return [line for line in (CARRIERS + GENERAL).split("\n") if line]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _slopes(n: int, own: list, right: set[int], scores: list[float], steps: dict[tuple[str, str], float]) -> tuple[float, list[tuple[int, str, float]]]:
    """Negative log-likelihood of the right segmentation, and (candidate, last type before it, probability)."""
    begins: dict[int, list[int]] = {}
    for c, (i, *_) in enumerate(own):
        begins.setdefault(i, []).append(c)
    forward: list[dict[str, float]] = [{} for _ in range(n + 1)]
    forward[0][START] = 0.0
    for i in range(n):
        for last, value in forward[i].items():
            forward[i + 1][last] = _add(forward[i + 1].get(last, -math.inf), value)
            for c in begins.get(i, ()):
                _, j, kind, _ = own[c]
                forward[j][kind] = _add(forward[j].get(kind, -math.inf), value + scores[c] + steps[last, kind])
    backward: list[dict[str, float]] = [dict.fromkeys(states, -math.inf) for states in forward]
    backward[n] = dict.fromkeys(forward[n], 0.0)
    for i in range(n - 1, -1, -1):
        for last in forward[i]:
            value = backward[i + 1][last]
            for c in begins.get(i, ()):
                _, j, kind, _ = own[c]
                value = _add(value, scores[c] + steps[last, kind] + backward[j][kind])
            backward[i][last] = value
    total = backward[0][START]
    told = []
    for c, (i, j, kind, _) in enumerate(own):
        for last, value in forward[i].items():
            probability = math.exp(min(0.0, value + scores[c] + steps[last, kind] + backward[j][kind] - total))
            if probability > 1e-5:
                told.append((c, last, probability))
    gold, last = 0.0, START
    for c in sorted(right, key=lambda c: own[c][0]):
        gold += scores[c] + steps[last, own[c][2]]
        last = own[c][2]
    return total - gold, told


def train(sentences: int = 6000, epochs: int = 6, seed: int = 1, rate: float = 0.2, decay: float = 2e-5, carriers: list[str] | None = None, part: int | None = None) -> Model:
    carriers = carrier_lines() if carriers is None else carriers
    known, firm = _known(carriers), _firm()
    maker = Maker(seed, part)
    data = []
    for k in range(sentences):
        text, gold = maker.line(carriers)
        # words of the carriers are hidden, so that unknown surroundings are learnt from too
        share = (0.05, 0.5, 0.9)[k % 3]
        told = firm | {w for w in known if maker.random.random() >= share}
        line = Line(text, told, known)
        if found := _lattice(line, gold):
            data.append((len(line.tokens), *found))
    print(f"{len(data)} of {sentences} lines have all items as candidates", flush=True)
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}

    def learn(name: str, slope: float) -> None:
        g = slope - decay * weights.get(name, 0.0)
        squares[name] = squares.get(name, 1e-6) + g * g
        weights[name] = weights.get(name, 0.0) + rate * g / math.sqrt(squares[name])

    for epoch in range(epochs):
        maker.random.shuffle(data)
        loss = 0.0
        for n, own, right in data:
            scores = [sum(weights.get(f"{kind}|{f}", 0.0) for f in features) for _, _, kind, features in own]
            steps = {(a, b): weights.get(f"{b}|after={a}", 0.0) for a in STATES for b in TYPES}
            lost, told = _slopes(n, own, right, scores, steps)
            loss += lost
            expected = [0.0] * len(own)
            moves: Counter[tuple[str, str]] = Counter()
            for c, last, probability in told:
                expected[c] += probability
                moves[last, own[c][2]] -= probability
            last = START
            for c in sorted(right, key=lambda c: own[c][0]):
                moves[last, own[c][2]] += 1.0
                last = own[c][2]
            for c, (_, _, kind, features) in enumerate(own):
                slope = (c in right) - expected[c]
                if abs(slope) >= 1e-4:
                    for f in features:
                        learn(f"{kind}|{f}", slope)
            for (before, kind), slope in moves.items():
                if abs(slope) >= 1e-4:
                    learn(f"{kind}|after={before}", slope)
        print(f"epoch {epoch}: loss {loss / len(data):.4f}", flush=True)
    by_type: dict[str, dict[str, float]] = {kind: {} for kind in TYPES}
    for name, value in weights.items():
        kind, _, feature = name.partition("|")
        if abs(value) > 0.05:
            by_type[kind][feature] = round(value, 2)
    return Model(by_type, known)


def evaluate(model: Model, lines: int = 1500, seed: int = 99, carriers: list[str] | None = None, part: int | None = None, show: int = 0) -> dict[str, tuple[float, float]]:
    """Precision and recall by type on newly made sentences."""
    carriers = carrier_lines() if carriers is None else carriers
    maker, right, found, wanted = Maker(seed, part), Counter(), Counter(), Counter()
    for _ in range(lines):
        text, gold = maker.line(carriers)
        got = {(a, k) for a, _, k in model.find(text)}
        true = {(a, k) for a, _, k in gold}
        if got != true and show:
            show -= 1
            print(repr(text), sorted(got - true), sorted(true - got))
        found.update(k for _, k in got)
        wanted.update(k for _, k in true)
        right.update(k for _, k in got & true)
    return {k: (round(right[k] / max(1, found[k]), 4), round(right[k] / max(1, wanted[k]), 4)) for k in TYPES}


if __name__ == "__main__":
    trained = train(sentences=14_000, epochs=5)
    print(evaluate(trained))
    WEIGHTS.write_text(json.dumps({"weights": trained.weights, "known": sorted(trained.known)}, ensure_ascii=False, indent=0, sort_keys=True), encoding="utf-8")
