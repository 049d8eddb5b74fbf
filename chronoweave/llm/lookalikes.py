"""Visually identical text with different characters: script-aware repair, and a key that compares looks.

Three steps. Folding brings width forms, ligatures, kinds of blank, invisible characters and composed or
combining accents to one form. Repair looks at tokens that mix scripts: their look-alike letters are replaced by
those of the script most of the token's letters have (or of another one), but only if the result occurs in the
corpus as a token of one script. The key then maps the look-alikes that are left, in whole tokens of one script
too, to one letter each, so that texts have equal keys exactly if they look the same; texts of one key get one form.

Letter case, accents, digits, order and the number of visible characters make a difference; so do tabs and line
breaks, and compatibility forms that look different (superscripts, circled numbers). A zero-width joiner between
two pictographs changes the picture and is kept.

Defined cases: a document id in several rows is one document (the largest of its texts); null texts stay null
and texts without visible characters are equal to none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from chronoweave.operators.skew import largest_by_key, parallel, salted_lookup
from chronoweave.sources.tables import cut

HOT_ROWS = 100_000
SALTS = 32

# Letters of the same shape, Latin, Cyrillic, Greek, Armenian; - where a script has none.
LETTERS = """
A А Α -
B В Β -
C С Ϲ -
E Е Ε -
H Н Η -
I І Ι -
J Ј Ϳ -
K К Κ -
M М Μ -
N - Ν -
O О Ο Օ
P Р Ρ -
S Ѕ - Տ
T Т Τ -
X Х Χ -
Y У Υ -
Z - Ζ -
a а - -
c с ϲ -
d ԁ - -
e е - -
h һ - հ
i і - -
j ј ϳ -
l ӏ - -
o о ο օ
p р - -
q ԛ - -
s ѕ - -
v ѵ ν -
w ԝ - -
x х - -
y у - -
G Ԍ - -
L - - Լ
Q Ԛ - -
U - - Ս
V Ѵ - -
W Ԝ - -
g - - ց
n - - ո
u - - ս
Æ Ӕ - -
æ ӕ - -
Ə Ә - -
ə ә - -
"""

_NAMES = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_ROWS = [dict(zip(_NAMES, line.split(), strict=True)) for line in LETTERS.split("\n") if line]
_TO = {script: {ord(letter): row[script] for row in _ROWS if row[script] != "-" for letter in row.values() if letter not in ("-", row[script])} for script in _NAMES}
_TO_LATIN = _TO["LATIN"]
_SCRIPTS = {"LATIN": r"\p{Latin}", "CYRILLIC": r"\p{Cyrillic}", "GREEK": r"\p{Greek}", "ARMENIAN": r"\p{Armenian}"}
_SCRIPT = {name: regex.compile(pattern) for name, pattern in _SCRIPTS.items()}
#: Width forms, presentation ligatures and the Dutch digraph: characters whose compatibility form looks the same.
_SAME_LOOK = regex.compile("[！-～｡-ﾟ￠-￦ﬀ-ﬆĲĳ]+")
_BLANK = regex.compile(r"\p{Zs}")
_JOINED = r"(?<=\p{Extended_Pictographic}️?)‍(?=\p{Extended_Pictographic})"
_INVISIBLE = regex.compile(rf"(?!{_JOINED})(?![؀-؅۝܏࢐࢑࣢\U000110bd\U000110cd])[\p{{Cf}}͏ᅟᅠ឴឵᠋-᠍︀-️\U000e0100-\U000e01ef]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_VISIBLE = regex.compile(r"[^\s\p{C}\p{Z}\p{M}]")


def fold(text: str) -> str:
    """One form for width, ligatures, blanks, invisible characters and accents."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", _BLANK.sub(" ", text))
    return unicodedata.normalize("NFC", _SAME_LOOK.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text))


def scripts(token: str) -> list[str]:
    """The scripts of a token, the one of most letters first."""
    counts = {name: len(pattern.findall(token)) for name, pattern in _SCRIPT.items()}
    return sorted((name for name, n in counts.items() if n), key=lambda name: -counts[name])


def substitutes(token: str) -> list[str]:
    """A mixed-script token in each script that all its letters have a look-alike in, dominant script first."""
    plain = unicodedata.normalize("NFD", token)
    own, found = scripts(token), []
    for script in [*own, *(s for s in _SCRIPT if s not in own)]:
        changed = "".join(c if _SCRIPT[script].match(c) else _TO[script].get(ord(c), c) for c in plain)
        if len(scripts(changed)) == 1:
            found.append(unicodedata.normalize("NFC", changed))
    return found


def look(text: str) -> str | None:
    """The key of a folded text; None if nothing in it can be seen."""
    if not _VISIBLE.search(text):
        return None
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TO_LATIN))


@F.pandas_udf(StringType())
def _fold_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(StringType())
def _look_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else look(t))


_MIXED = StructType([StructField("token", StringType()), StructField("options", ArrayType(StringType()))])


@F.pandas_udf(ArrayType(_MIXED))
def _mixed_batch(texts: pd.Series) -> pd.Series:
    def mixed(text: str | None) -> list[dict]:
        tokens = set() if not text or text.isascii() else set(_TOKEN.findall(text))
        return [{"token": t, "options": substitutes(t)} for t in sorted(tokens) if len(scripts(t)) > 1]

    return texts.map(mixed)


@F.pandas_udf(ArrayType(StringType()))
def _words_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [] if not t else sorted({w for w in _TOKEN.findall(t) if w.isascii() or len(scripts(w)) < 2}))


@F.pandas_udf(StringType())
def _replace_batch(texts: pd.Series, repairs: pd.Series) -> pd.Series:
    def replace(text: str, pairs: object) -> str:
        if text is None or pairs is None:
            return text
        to = {p["token"]: p["word"] for p in pairs}
        return _TOKEN.sub(lambda m: to.get(m.group(), m.group()), text)

    return pd.Series([replace(t, p) for t, p in zip(texts, repairs, strict=True)])


def _repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, text, same_form): every document folded and its mixed-script tokens repaired."""
    rows = parallel(largest_by_key(documents, "doc_id", "text"))
    ascii_only = F.col("text").rlike(r"^[\x00-\x7F]*$")
    folded = cut(rows.withColumn("folded", F.when(ascii_only, F.col("text")).otherwise(_fold_batch(F.when(~ascii_only, F.col("text"))))))
    # mixed-script tokens of each document, with what they could be
    mixed = folded.where(~F.col("folded").rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.explode(_mixed_batch("folded")).alias("m"))
    mixed = cut(mixed.select("doc_id", "m.token", "m.options"))
    wanted = mixed.select("token", F.posexplode("options").alias("rank", "word")).distinct()
    words = folded.select(F.explode(_words_batch("folded")).alias("word")).distinct()
    known = wanted.join(words, "word").groupBy("token").agg(F.min_by("word", "rank").alias("word"))
    chosen = salted_lookup(mixed.select("doc_id", "token"), known, "token", HOT_ROWS, SALTS)
    repairs = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("token", "word")).alias("repairs"))
    joined = folded.join(repairs, "doc_id", "left")
    same_form = F.when(F.col("repairs").isNull(), F.col("folded")).otherwise(_replace_batch(F.when(F.col("repairs").isNotNull(), F.col("folded")), "repairs"))
    return joined.select("doc_id", "text", same_form.alias("same_form"))


def _look_key(column: str) -> F.Column:
    ascii_seen = F.col(column).rlike(r"^[\x21-\x7E][\x20-\x7E]*$")
    return F.md5(F.when(ascii_seen, F.col(column)).otherwise(_look_batch(F.when(~ascii_seen, F.col(column)))))


def repair_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, same_form): every document with its text in one form, equal for all texts that look the same.

    Where repair leaves several forms of one look, all get the form of most documents (the smallest on a tie).
    """
    repaired = cut(_repaired(documents).withColumn("look", _look_key("same_form")))
    seen = repaired.where("look is not null")
    several = seen.groupBy("look").agg(F.min(F.md5("same_form")).alias("lo"), F.max(F.md5("same_form")).alias("hi")).where("lo < hi").select("look")
    unequal = cut(salted_lookup(seen.select("doc_id", "look", "same_form"), several, "look", HOT_ROWS, SALTS))
    counts = unequal.groupBy("look", "same_form").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("look").agg(F.min_by("same_form", F.struct(-F.col("n"), F.col("same_form"))).alias("_best"))
    changed = salted_lookup(unequal.select("doc_id", "look"), best, "look", HOT_ROWS, SALTS).select("doc_id", "_best")
    return repaired.join(changed, "doc_id", "left").select("doc_id", "text", F.coalesce("_best", "same_form").alias("same_form"))


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents of different characters and the same look, doc_id_a < doc_id_b."""
    repaired = _repaired(documents)
    keyed = cut(repaired.select("doc_id", F.md5("text").alias("t"), _look_key("same_form").alias("look")).where("look is not null"))
    # copies collapse to one class a text before texts of one look are paired
    several = keyed.groupBy("look").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("look")
    shared = cut(salted_lookup(keyed, several, "look", HOT_ROWS, SALTS))
    classes = shared.select("look", "t").distinct()
    pairs = salted_lookup(classes, classes.withColumnRenamed("t", "other"), "look", HOT_ROWS, SALTS).where("t < other").select("t", "other")
    members = shared.select("doc_id", "t")
    one = salted_lookup(members, pairs, "t", HOT_ROWS, SALTS).select(F.col("doc_id").alias("one"), F.col("other").alias("t"))
    both = salted_lookup(one, members, "t", HOT_ROWS, SALTS)
    return both.select(F.least("one", "doc_id").alias("doc_id_a"), F.greatest("one", "doc_id").alias("doc_id_b"))
