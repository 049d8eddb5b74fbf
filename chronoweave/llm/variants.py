"""Variant spellings of persons and organisations by noisy-channel attribution.

A spelling is read into a main part (family name, or the distinctive words of an organisation) and a side part
(given name, or line of business). What is regular is undone: letter case, accents, titles, joined words, legal
forms. Everything else is learnt from counts over the whole corpus:

* Which word plays which part: a given name or a line of business goes with many different partners, a family
  name or a distinctive word with few. So reordered, split and hyphenated names read alike.
* Misspelt side words: a word is a typing error of one at least ``RARER`` times as widespread for each error.
* Short forms and abbreviations: side words that the spellings of one record exchange for one another, counted
  over different main parts, give the likelihood of a short form; common English ones are an optional prior.
* Canonical forms: a frequent (main, side) is a candidate, its count the prior. A rarer main or side part within
  two typing errors (found by deletion neighbourhoods, never by pairs of a group) is explained either as a name
  of its own or as a typing error of a candidate; initials and cut names (``Nath.``) go to the side part that the
  main part has most often. Each variant is attached to its maximum posterior, chains are followed to their end.

Every spelling of a record counts: a record whose alias is a full name of another form is that person or
organisation. Records whose forms are linked are one person or organisation.

Defined cases: repeated rows are one record; null, blank and meaningless names or aliases say nothing; a bare
given or family name says nothing of its own (many share it), nor does an acronym that several names share; two
attested names a typing error apart stay apart, also if an alias of one spells the other; a record without a
readable spelling stands alone; ties go to the form first in the order of letters; words of more than 64 letters
count as written; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from chronoweave.llm.components import seed_tree_components
from chronoweave.llm.given_names import ABBREVIATED, BUSINESS, FULL, KNOWN, KNOWN_BUSINESS
from chronoweave.operators.skew import salted_lookup, small
from chronoweave.sources.tables import cut, spread

HOT_ROWS = 100_000
SALTS = 32
#: Log-probability of one typing error at one place.
TYPO = math.log(0.02)
#: A word is a misspelling of another only if that one is this many times as widespread, for each error; among
#: the side parts of one main part, where the context speaks too, NEAR_RARER times are enough.
RARER, NEAR_RARER = 50.0, 8.0
#: Odds that a swapped order must have over the usual one.
SWAP = math.log(6.0)
#: A word is a line of business if in half of its names it has this many times the partners of the word with fewest.
WIDER = 4.0
#: Partners that a word of the prior lists counts as having, and observations a listed short form counts for.
PRIOR_PARTNERS, PRIOR_SHORT = 50.0, 2.0
#: Least share of its spellings in which a side word stands for another to count as a short form of it.
SHORT_SHARE = 0.1
#: Share that the most likely reading needs among all readings of a short form or of an initial.
MOST_LIKELY = 0.5
#: Letters a word needs for each typing error; with more errors it is another word.
LETTERS_AN_ERROR = 3
LONGEST = 64

# Titles, legal forms, and words that join others.
TITLES = frozenset("dr prof mr mrs ms miss sir madam herr frau mme rev hon jr sr phd md".split())
LEGAL = frozenset("ltd limited llc plc inc incorporated corp corporation gmbh ag sa co company bv nv kg oy ab spa srl pty".split())
JOINING = frozenset("and of the for de y et und".split())

_SPECIAL = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_QUOTED = re.compile(r'["“”«»(](.*?)["“”«»)]')


def squash(text: str) -> str:
    """Letters and digits only, accents removed."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL))
    return "".join(c for c in text if c.isalnum() and not unicodedata.combining(c))


def typing_errors(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        older, before = before, row
    return before[-1]


Word = tuple[str, str]  # squashed word; 'h' before a comma, 'r' after it, '.' cut with a full stop, '' otherwise
Known = dict[str, tuple[float, str | None]]  # word: how widespread it is in the side part, and the word it misspells
Reading = tuple[str, str, str]  # main part, side part ('' if unknown), start of the side part if only that is given


def words_of(kind: str, text: str | None) -> list[Word]:
    """The words of a spelling that matter."""
    if not text:
        return []
    if kind == "person":
        text = _QUOTED.sub(" ", text)
        text = regex.sub(r"(?<=\p{Ll})(?=\p{Lu})", " ", text)  # JoinedWords
        head, comma, rest = text.partition(",")
        words = []
        for mark, part in (("h", head), ("r", rest)) if comma else (("", text),):
            for match in re.finditer(r"([^\W\d_][^\W\d_'’-]*)(\.?)", part.replace("_", " ")):
                word = squash(match.group(1))
                if word and word not in TITLES:
                    words.append((word, mark + ("." if match.group(2) else "")))
        return words
    words = [squash(w) for w in re.findall(r"[^\W_]+(?:\.[^\W_]+)*", text)]
    words = [w for w in words if w]
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    return [(w, "") for w in words]


def nickname(text: str | None) -> str:
    """The word in quotation marks or brackets, if it is one word."""
    found = _QUOTED.search(text or "")
    word = squash(found.group(1)) if found and len(found.group(1).split()) == 1 else ""
    return word if len(word) > 1 else ""


def usual_parts(kind: str, words: list[Word]) -> list[tuple[str, str, bool]]:
    """(word, partner, usual place of a side word) from which it is counted how widespread words are."""
    if kind == "person":
        long = [w for w in words if len(w[0]) > 1]
        if len(long) < 2:
            return []
        family, given = ([w for w in long if (w[1][:1] == "h") is side] for side in (True, False))
        if family and given and any(w[1][:1] == "h" for w in long):
            pair = (given[0][0], family[-1][0])
        elif any(w[1][:1] in ("h", "r") for w in long):
            return []
        else:
            pair = (long[0][0], long[-1][0])
        return [(pair[0], pair[1], True), (pair[1], pair[0], False)]
    plain = [w for w, _ in words]
    found = set()
    for k, word in enumerate(plain):
        for other in (plain[0], plain[-1], *plain[max(0, k - 1) : k], *plain[k + 1 : k + 2]):
            if other != word:
                found.add((word, other, True))
    return sorted(found)


def read_words(kind: str, words: list[Word], known: Known) -> Reading | None:
    return _read_person(words, known) if kind == "person" else _read_organisation(words, known)


def _read_person(words: list[Word], known: Known) -> Reading | None:
    def odds(word: str) -> float:
        own, meant = known.get(word, (0.0, None))
        return own if meant is None else max(own, known.get(meant, (0.0, None))[0] - 1.0)

    long = [w for w in words if len(w[0]) > 1]
    if len(words) == 1 and len(words[0][0]) > 1 and regex.fullmatch(r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]+", words[0][0]):
        return words[0][0], words[0][0], ""  # names written without spaces are whole names
    if len(words) < 2 or not long:
        return None
    if any(w[1][:1] == "h" for w in words):
        family = [w for w in words if w[1][:1] == "h"]
        given = [w for w in words if w[1][:1] != "h"]
    elif len(long) == 1:
        family, given = long, [w for w in words if len(w[0]) == 1]
    elif odds(long[-1][0]) - odds(long[0][0]) > SWAP:
        family, given = long[:-1], [long[-1]]
    else:
        family, given = long[1:], [long[0]]
    if len(family) > 1:  # given names between the first and the family name
        family = [w for k, w in enumerate(family) if k == len(family) - 1 or (len(w[0]) > 1 and odds(w[0]) <= SWAP)]
    if not family or not given:
        return None
    main, (word, mark) = "".join(w[0] for w in family), given[0]
    if len(word) == 1:
        return main, "", word
    meant = known.get(word, (0.0, None))[1]
    if mark.endswith(".") and meant is None:
        return main, "", word
    return main, meant or word, ""


def _read_organisation(words: list[Word], known: Known) -> Reading | None:
    meant = [known.get(w, (0.0, None))[1] or w for w, _ in words]
    plain = [w for w in meant if w not in JOINING] or meant
    if not plain:
        return None
    side = [w for w in plain if known.get(w, (0.0, None))[0] >= 0.5]
    main = [w for w in plain if known.get(w, (0.0, None))[0] < 0.5]
    return ("".join(main), " ".join(side), "") if main else ("".join(plain), "", "")


@lru_cache(maxsize=1)
def _shorts() -> dict[tuple[str, str], str]:
    """(type, short form): what it stands for, of those the prior lists know only one full form for."""
    found: dict[tuple[str, str], set[str]] = {}
    for kind, lines in (("person", FULL), ("organization", BUSINESS)):
        for full, shorts in lines.items():
            for short in shorts:
                found.setdefault((kind, short), set()).add(full)
    found |= {("person", short): {full} for short, full in ABBREVIATED.items()}
    return {key: next(iter(full)) for key, full in found.items() if len(full) == 1}


def read_spelling(kind: str, text: str | None) -> Reading | None:
    """The reading of one spelling by the prior lists alone, without a corpus."""
    words, known = words_of(kind, text), {}
    listed = KNOWN | frozenset(ABBREVIATED) if kind == "person" else KNOWN_BUSINESS
    for word, _ in words:
        near = [] if word in listed or len(word) < 4 else [k for k in sorted(listed) if len(k) > 3 and typing_errors(word, k, 1) == 1]
        known[word] = (PRIOR_PARTNERS if word in listed else 0.0, near[0] if near else None)
        known |= {k: (PRIOR_PARTNERS, None) for k in near[:1]}
    reading = read_words(kind, words, known)
    if reading is None:
        return None
    main, side, start = reading
    if start in ABBREVIATED and kind == "person":
        side, start = start, ""
    return main, " ".join(_shorts().get((kind, w), w) for w in side.split()), start


_WORDS = ArrayType(StructType([StructField("word", StringType()), StructField("mark", StringType())]))
_PARTS = ArrayType(StructType([StructField("word", StringType()), StructField("partner", StringType()), StructField("as_side", BooleanType())]))
_SPLIT = StructType([StructField("words", _WORDS), StructField("parts", _PARTS), StructField("nick", StringType())])
_READING = StructType([StructField("main", StringType()), StructField("side", StringType()), StructField("start", StringType())])


@F.pandas_udf(_SPLIT)
def _split_batch(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
    words = [words_of(k, t) for k, t in zip(kinds, texts, strict=True)]
    return pd.DataFrame(
        {
            "words": [[{"word": w, "mark": m} for w, m in found] for found in words],
            "parts": [[{"word": w, "partner": p, "as_side": s} for w, p, s in usual_parts(k, found)] for k, found in zip(kinds, words, strict=True)],
            "nick": [nickname(t) if k == "person" else "" for k, t in zip(kinds, texts, strict=True)],
        }
    )


@F.pandas_udf(_READING)
def _read_batch(kinds: pd.Series, words: pd.Series, places: pd.Series) -> pd.DataFrame:
    found = []
    for kind, written, told in zip(kinds, words, places, strict=True):
        known: Known = {}
        for t in told:
            known[t["word"]] = (t["wide"], t["meant"])
            if t["meant"] is not None:
                known[t["meant"]] = (t["meant_wide"], None)
        found.append(read_words(kind, [(w["word"], w["mark"]) for w in written], known) or (None, None, None))
    return pd.DataFrame(found, columns=["main", "side", "start"])


@F.pandas_udf(IntegerType())
def _errors_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([typing_errors(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def within_two_errors(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with ``errors`` between two columns, at most 2 and one in LETTERS_AN_ERROR letters. A swap counts two for the built-in distance, which
    therefore rules out most rows at a bound of 4 before any leaves the JVM."""
    near = df.where(F.levenshtein(F.col(a), F.col(b), 4) >= 0)
    return near.withColumn("errors", _errors_batch(a, b)).where((F.col("errors") <= 2) & (F.col("errors") * LETTERS_AN_ERROR <= F.least(F.length(a), F.length(b))))


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(LONGEST))))


def deletion_keys(word: Column, most: int, *scope: Column) -> Column:
    """Hashes of the word and of what is left of it without up to ``most`` letters, two letters at least. Words
    at most ``most`` typing errors apart share one."""
    found = F.array(word)
    if most >= 1:
        one = _without_one(word)
        found = F.concat(found, F.when(F.length(word) > 2, one).otherwise(F.array()))
        if most >= 2:
            two = F.flatten(F.transform(F.array_distinct(one), _without_one))
            found = F.concat(found, F.when(F.length(word) > 3, two).otherwise(F.array()))
    found = F.when(F.length(word) <= LONGEST, F.array_distinct(found)).otherwise(F.array(word))
    return F.transform(found, lambda w: F.xxhash64(*scope, w))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on deletion keys. A merge join always: the planner sizes a side as before its keys were exploded (up to two
    thousand a word), so it would send the keys of a small-looking side through the driver to broadcast them."""
    return left.join(right.hint("merge"), "key")


def _listed(df: DataFrame, kinds: dict[str, frozenset[str]]) -> DataFrame:
    rows = [(kind, word) for kind, words in kinds.items() for word in sorted(words)]
    return df.sparkSession.createDataFrame(rows, "type string, word string").withColumn("listed", F.lit(True))


def _spellings(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, type, active, is_name, text): every spelling of every record."""
    records = entities.where("type in ('person', 'organization') and id is not null").groupBy("id").agg(
        F.min("type").alias("type"), F.min("name").alias("name"), F.max(F.coalesce("archived", F.lit(False)) | (F.trim(F.coalesce("merged_into", F.lit(""))) != "")).alias("gone")
    )
    named = records.select("id", "type", ~F.col("gone"), F.lit(True), "name").toDF("id", "type", "active", "is_name", "text")
    other = aliases.select(F.col("entity_id").alias("id"), "alias").distinct()
    also = other.join(records, "id").select("id", "type", ~F.col("gone"), F.lit(False), "alias").toDF("id", "type", "active", "is_name", "text")
    return named.unionByName(also).where("text is not null")


def _misspelt(words: DataFrame) -> DataFrame:
    """(type, word, meant) of words (type, word, wide, listed) that are typing errors of far more widespread ones."""
    strong = words.where(F.col("wide") >= RARER).select("type", F.col("word").alias("meant"), F.col("wide").alias("meant_wide"))
    weak = spread(words.where("not listed").select("type", "word", "wide"), "word")
    strong_keys = strong.select("meant", "type", "meant_wide", F.explode(deletion_keys(F.col("meant"), 2, F.col("type"))).alias("key"))
    weak_keys = weak.where(F.length("word") > 2).select("word", "wide", F.explode(deletion_keys(F.col("word"), 2, F.col("type"))).alias("key"))
    met = _meet(weak_keys, strong_keys).where("word <> meant").select("type", "word", "wide", "meant", "meant_wide").distinct()
    close = within_two_errors(met, "word", "meant").where(F.col("meant_wide") >= F.col("wide") * F.pow(F.lit(RARER), F.col("errors")))
    best = F.max_by(F.struct("meant", "meant_wide"), F.struct(F.log("meant_wide") + F.col("errors") * TYPO, "meant")).alias("best")
    return close.groupBy("type", "word").agg(best).select("type", "word", "best.meant", "best.meant_wide")


def _places(texts: DataFrame) -> DataFrame:
    """(type, word, wide, meant, meant_wide): how widespread a word is as a side word, and what it misspells.

    For persons ``wide`` is the log odds of a given name, for organisations the share of its names in which a
    word has many times the partners that another word has.
    """
    parts = texts.select("type", F.explode("split.parts").alias("p")).select("type", "p.word", "p.partner", "p.as_side").distinct()
    counted = parts.groupBy("type", "word").agg(F.sum(F.col("as_side").cast("double")).alias("sides"), F.sum((~F.col("as_side")).cast("double")).alias("mains"))
    listed = _listed(texts, {"person": KNOWN | frozenset(ABBREVIATED), "organization": KNOWN_BUSINESS})
    counted = counted.join(F.broadcast(listed), ["type", "word"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))  # fixed lists
    counted = cut(counted.withColumn("wide", F.col("sides") + F.when(F.col("listed"), PRIOR_PARTNERS).otherwise(0.0)))
    meant = cut(_misspelt(counted))
    odds = F.log((F.col("wide") + 0.5) / (F.col("mains") + 0.5))
    person = counted.where("type = 'person'").select("type", "word", odds.alias("place"))
    # organisations: the words of each name compared
    named = texts.where("type = 'organization' and size(split.words) > 1").select("text", F.explode("split.words.word").alias("word")).distinct()
    own = counted.where("type = 'organization'").join(meant.select("type", "word", "meant_wide"), ["type", "word"], "left")
    partners = own.select("word", F.coalesce("meant_wide", "wide").alias("wide"))
    compared = cut(salted_lookup(named, partners, "word", HOT_ROWS, SALTS))
    least = compared.groupBy("text").agg(F.min("wide").alias("least"))
    wins = compared.join(least, "text").groupBy("word").agg(F.avg((F.col("wide") >= WIDER * F.greatest("least", F.lit(1.0))).cast("double")).alias("place"))
    places = cut(person.unionByName(wins.select(F.lit("organization").alias("type"), "word", "place")))
    told = meant.drop("meant_wide").join(places.select("type", F.col("word").alias("meant"), F.col("place").alias("meant_wide")), ["type", "meant"])
    return places.withColumnRenamed("place", "wide").join(told, ["type", "word"], "left")


def _read(spellings: DataFrame) -> DataFrame:
    """(id, type, active, is_name, word, nick, main, side, start): spellings with their readings; ``word`` is a bare word."""
    texts = cut(spread(spellings.select("type", "text"), "type", "text").distinct().withColumn("split", _split_batch("type", "text")))
    places = cut(_places(texts).withColumn("at", F.concat_ws("|", "type", "word")).drop("type", "word"))
    words = texts.select("type", "text", F.explode(F.array_distinct("split.words.word")).alias("word")).withColumn("at", F.concat_ws("|", "type", "word"))
    told = salted_lookup(words, places, "at", HOT_ROWS, SALTS).groupBy("type", "text").agg(F.collect_list(F.struct("word", "wide", "meant", "meant_wide")).alias("places"))
    read = spread(texts.join(told, ["type", "text"], "left"), "type", "text").withColumn("places", F.coalesce("places", F.array()))
    read = read.withColumn("r", _read_batch("type", "split.words", "places"))
    bare = F.when((F.size("split.words") == 1) & (F.length(F.element_at("split.words.word", 1)) > 1), F.element_at("split.words.word", 1)).otherwise("")
    bare = F.when(F.size("split.words") > 0, bare).otherwise("")
    read = read.select("type", "text", bare.alias("word"), F.col("split.nick").alias("nick"), "r.main", "r.side", "r.start")
    return spellings.join(read, ["type", "text"])


def _short_forms(read: DataFrame) -> DataFrame:
    """(type, short, full, share, sole): how often a side word stands for another; ``sole`` among those it stands for.

    Of each record the side word of the name is held against those of its aliases with the same main part,
    against bare aliases and against the nickname in a name; different main parts are counted.
    """
    names = read.where("is_name and side <> ''").select("id", "type", "main", "side", "nick")
    others = read.where("not is_name").select("id", F.col("main").alias("other_main"), F.when(F.col("side") != "", F.col("side")).when(F.length("start") > 1, F.col("start")).alias("other_side"), "word")
    met = names.join(others, "id").where("other_main = main or (type = 'person' and word <> '')")
    other = F.when(F.col("type") == "organization", F.col("other_side")).otherwise(F.coalesce(F.when(F.col("other_main") == F.col("main"), F.col("other_side")), F.col("word")))
    held = met.select("type", "main", "side", other.alias("other"))
    quoted = read.where("nick <> '' and side <> ''").select("type", "main", "side", F.col("nick").alias("other"))
    held = held.unionByName(quoted).where("other <> ''")
    pairs = held.select("type", "main", F.split("side", " ").alias("a"), F.split("other", " ").alias("b")).where("size(a) = size(b)")
    pairs = pairs.select("type", "main", F.explode(F.arrays_zip("a", "b")).alias("p")).select("type", "main", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    both = pairs.unionByName(pairs.where("a <> b").select("type", "main", F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.groupBy("type", "a", "b").agg(F.count_distinct("main").cast("double").alias("n"))
    lists = [("person", FULL), ("organization", BUSINESS), ("person", {full: [] for full in ABBREVIATED.values()})]
    prior = [(kind, short, full) for kind, table in lists for full, shorts in table.items() for short in shorts] + [("person", short, full) for short, full in ABBREVIATED.items()]
    listed = read.sparkSession.createDataFrame(sorted(set(prior)), "type string, a string, b string").withColumn("n", F.lit(PRIOR_SHORT))
    seen = seen.withColumn("listed", F.lit(False)).unionByName(listed.withColumn("listed", F.lit(True)))
    seen = cut(seen.groupBy("type", "a", "b").agg(F.sum("n").alias("n"), F.max("listed").alias("listed")))
    borne = seen.groupBy("type", "a").agg(F.sum("n").alias("borne"))
    # of two words the one that more main parts are written with is the full form, unless the prior lists know better
    written = read.where("side <> ''").select("type", "main", F.explode(F.split("side", " ")).alias("w")).groupBy("type", "w").agg(F.approx_count_distinct("main", 0.02).alias("wide"))
    written = cut(written)
    strength = written.select("type", F.col("w").alias("b"), F.col("wide").alias("b_wide"))
    weakness = written.select("type", F.col("w").alias("a"), F.col("wide").alias("a_wide"))
    known_full = listed.select("type", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("is_full"))
    found = seen.where("a <> b and n >= 2").join(borne, ["type", "a"]).join(strength, ["type", "b"], "left").join(weakness, ["type", "a"], "left").na.fill(0, ["a_wide", "b_wide"]).join(known_full, ["type", "a", "b"], "left")
    found = found.where(F.col("is_full").isNull() & (F.col("listed") | (F.col("b_wide") > F.col("a_wide")) | ((F.col("b_wide") == F.col("a_wide")) & (F.col("b") < F.col("a")))))
    found = found.withColumn("share", F.col("n") / F.col("borne")).where(F.col("share") >= SHORT_SHARE)
    total = F.sum("n").over(Window.partitionBy("type", "a"))
    return found.select("type", F.col("a").alias("short"), F.col("b").alias("full"), "share", (F.col("n") / total).alias("sole"))


def _full_sides(read: DataFrame, shorts: DataFrame) -> DataFrame:
    """``read`` with side words written in full where a short form stands for one word only."""
    sure = shorts.where("sole >= 0.8").select("type", F.col("short").alias("w"), "full")
    sides = read.where("side <> ''").select("type", "side").distinct()
    for _ in range(2):  # an abbreviation of a short form
        split = sides.select("type", "side", F.posexplode(F.split(F.coalesce("meant", "side") if "meant" in sides.columns else F.col("side"), " ")).alias("k", "w"))
        split = split.join(sure, ["type", "w"], "left").withColumn("w", F.coalesce("full", "w"))
        sides = split.groupBy("type", "side").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("ws")).select("type", "side", F.concat_ws(" ", "ws.w").alias("meant"))
    changed = cut(sides.where("meant <> side").select(F.concat_ws("|", "type", "side").alias("at"), "meant"))
    known = read.withColumn("at", F.concat_ws("|", "type", "side"))
    known = salted_lookup(known, changed, "at", HOT_ROWS, SALTS, "left").withColumn("side", F.coalesce("meant", "side")).drop("at", "meant")
    # a cut word that is a usual abbreviation
    cut_off = sure.select(F.concat_ws("|", "type", "w").alias("at"), "full")
    known = salted_lookup(known.withColumn("at", F.concat_ws("|", "type", F.when(F.length("start") > 1, F.col("start")))), cut_off, "at", HOT_ROWS, SALTS, "left")
    return known.withColumn("side", F.coalesce("full", "side")).withColumn("start", F.when(F.col("full").isNull(), F.col("start")).otherwise("")).drop("at", "full")


def _node(*parts: str) -> Column:
    return F.concat_ws("|", *parts)


def _forms(read: DataFrame) -> DataFrame:
    """(type, main, side, form, n, borne, others, wide): canonical candidates with their counts."""
    whole = read.where("side <> '' or (type = 'organization' and main is not null)")
    forms = whole.groupBy("type", "main", "side").agg(F.count_distinct("id").alias("n"))
    mains = forms.groupBy("type", "main").agg((F.count(F.lit(1)) - 1).alias("others"), F.sum("n").alias("borne"))
    sides = forms.groupBy("type", "side").agg(F.count(F.lit(1)).alias("wide")).select(F.concat_ws("|", "type", "side").alias("at"), "wide")
    forms = forms.join(mains, ["type", "main"]).withColumn("at", F.concat_ws("|", "type", "side"))
    return salted_lookup(forms, sides, "at", HOT_ROWS, SALTS).drop("at").withColumn("form", _node("type", "main", "side"))


def _typo_links(forms: DataFrame) -> DataFrame:
    """(form, canonical): a form explained as a typing error of a more frequent one, in its main or in its side part."""
    by_side = F.when((F.col("side") == "") & (F.length("main") < 8), F.array()).otherwise(deletion_keys(F.col("main"), 2, F.lit("side"), F.col("type"), F.col("side")))
    by_main = F.when((F.length("side") > 3) & (F.col("type") == "person"), deletion_keys(F.col("side"), 2, F.lit("main"), F.col("type"), F.col("main"))).otherwise(F.array())
    keys = cut(spread(forms, "form").select("form", F.explode(F.concat(by_side, by_main)).alias("key")))
    # only the keys of two forms or more meet anything; a hot key is split by the planner's skew join
    met = _meet(keys.withColumnRenamed("form", "typo"), keys).where("typo <> form").select("typo", "form").distinct()
    known = forms.select("form", "type", "main", "side", "n", "borne", "others", "wide")
    left = known.select(*(F.col(c).alias("typo" if c == "form" else f"typo_{c}") for c in known.columns))
    met = cut(met.join(left, "typo").join(known, "form"))
    # typing errors of the main part, by side part: other side parts speak for a name of its own, unless the candidate
    # has them too: then they are typos as well; counts speak by their ratio only, so that records all repeated k
    # times are attributed as before
    stronger = F.struct("borne", "n", "main") > F.struct(F.col("typo_borne").alias("borne"), F.col("typo_n").alias("n"), F.col("typo_main").alias("main"))
    mains = within_two_errors(met.where((F.col("side") == F.col("typo_side")) & (F.col("main") != F.col("typo_main")) & stronger), "typo_main", "main")
    shared = mains.groupBy("type", "typo_main", "main").agg(F.count(F.lit(1)).alias("shared"))
    own = F.log("typo_n") + F.when(F.col("typo_others") + 1 > F.col("shared"), 0.0).otherwise(3 * TYPO)
    mains = mains.join(shared, ["type", "typo_main", "main"]).withColumn("score", F.log("n") + F.col("errors") * TYPO - own).where("score > 0")
    # typing errors of the side part, by main part: a side part that many main parts have is no typing error
    listed = F.broadcast(_listed(forms, {"person": KNOWN}).select("type", F.col("word").alias("typo_side"), "listed"))  # fixed list
    sides = met.where((F.col("main") == F.col("typo_main")) & (F.col("side") != F.col("typo_side"))).join(listed, ["type", "typo_side"], "left").where("listed is null")
    rarer = F.col("wide") >= F.col("typo_wide") * F.pow(F.lit(NEAR_RARER), F.col("errors"))
    sides = within_two_errors(sides, "typo_side", "side").where(rarer).withColumn("score", F.log("n") + F.log("wide") - F.log("typo_wide") + F.col("errors") * TYPO)
    scored = mains.select("typo", "form", "score", "borne").unionByName(sides.select("typo", "form", "score", "borne"))
    best = F.max_by("form", F.struct("score", "borne", F.hash("form"), "form")).alias("canonical")
    return scored.groupBy("typo").agg(best).select(F.col("typo").alias("form"), "canonical")


def _short_links(forms: DataFrame, shorts: DataFrame) -> DataFrame:
    """(form, canonical): a form with a short form of several full ones goes to the one most likely under its main part."""
    wanted = shorts.where("sole < 0.8").select(F.concat_ws("|", "type", "short").alias("at"), "full", "share")
    asked = forms.select(F.concat_ws("|", "type", "side").alias("at"), "type", "main", "form")
    asked = salted_lookup(asked, wanted, "at", HOT_ROWS, SALTS).drop("at")
    there = forms.select("type", "main", F.col("side").alias("full"), F.col("form").alias("canonical"), "n")
    found = asked.join(there, ["type", "main", "full"]).withColumn("weight", F.col("n") * F.col("share"))
    return _most_likely(found, "form")


def _most_likely(found: DataFrame, *key: str) -> DataFrame:
    best = found.groupBy(*key).agg(F.max_by("canonical", F.struct("weight", "canonical")).alias("canonical"), F.max("weight").alias("most"), F.sum("weight").alias("all"))
    return best.where(F.col("most") > MOST_LIKELY * F.col("all")).select(*key, "canonical")


def _start_links(read: DataFrame, forms: DataFrame, typos: DataFrame) -> DataFrame:
    """(type, main, start, canonical): what an initial or the start of a side part means under a main part.

    Counts are summed over forms of one canonical form first. A main part that nobody writes in full is read as
    the most frequent one a typing error away that has such a side part.
    """
    starts = cut(read.where("start <> ''").select("type", "main", "start").distinct())
    meant = forms.join(typos, "form", "left").select("type", "main", "side", "n", F.coalesce("canonical", "form").alias("canonical")).where("type = 'person'")
    begun = meant.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("side"), F.lit(LONGEST))), lambda i: F.substring("side", F.lit(1), i))))
    asked = cut(starts.select("type", "start").distinct())
    begun = begun.join(small(asked, asked.count()), ["type", "start"], "left_semi")
    begun = cut(begun.groupBy("type", "main", "start", "canonical").agg(F.sum("n").cast("double").alias("weight")))
    exact = _most_likely(starts.join(begun, ["type", "main", "start"]), "type", "main", "start")
    lost = starts.join(begun.select("type", "main", "start").distinct(), ["type", "main", "start"], "left_anti")
    lost = lost.select("type", F.col("main").alias("typo"), "start", F.explode(deletion_keys(F.col("main"), 1, F.col("type"), F.col("start"))).alias("key"))
    near = begun.withColumn("key", F.explode(deletion_keys(F.col("main"), 1, F.col("type"), F.col("start")))).select("main", "canonical", "weight", "key")
    close = within_two_errors(_meet(lost, near).drop("key").distinct(), "typo", "main").where("errors = 1")
    return exact.unionByName(_most_likely(close.groupBy("type", "typo", "start", "canonical").agg(F.sum("weight").alias("weight")), "type", "typo", "start").withColumnRenamed("typo", "main"))


def _alias_links(borne: DataFrame) -> DataFrame:
    """(form, canonical): the forms of one record mean the same. ``borne`` has (id, is_name, form, type, main, side).

    A form without a side part (an acronym, one word) links only if all records that have it as an alias have one
    form of name. Two forms a typing error apart in one part are left to the counts of both.
    """
    names = borne.where("is_name").select("id", F.col("form").alias("named"), F.col("main").alias("named_main"), F.col("side").alias("named_side"))
    met = names.join(borne.where("not is_name").select("id", "form", "main", "side"), "id").where("form <> named")
    met = met.groupBy("named", "named_main", "named_side", "form", "main", "side").agg(F.count(F.lit(1)).alias("n"))
    sole = met.where("side = ''").groupBy("form").agg(F.count(F.lit(1)).alias("names")).where("names = 1").select("form", F.lit(True).alias("sole"))
    met = met.join(sole, "form", "left").where("side <> '' or sole")
    one = (F.col("main") == F.col("named_main")) & (F.levenshtein("side", "named_side", 4) >= 0)
    other = (F.col("side") == F.col("named_side")) & (F.levenshtein("main", "named_main", 4) >= 0)
    doubtful = met.where(one | other)
    errors = F.least(F.lit(3), _errors_batch("main", "named_main") + _errors_batch("side", "named_side"))
    apart = met.where(~(one | other)).unionByName(doubtful.withColumn("errors", errors).where("errors > 2").drop("errors"))
    return apart.select("form", F.col("named").alias("canonical"))


def canonical_forms(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, type, active, main, side): the canonical form each readable record is attributed to."""
    read = cut(_read(_spellings(entities, aliases)))
    shorts = cut(_short_forms(read))
    read = cut(_full_sides(read.where("main is not null"), shorts))
    forms = cut(_forms(read))
    typos = cut(_typo_links(forms))
    starts = cut(_start_links(read, forms, typos))
    whole = read.where("start = ''").select("id", "type", "active", "is_name", _node("type", "main", "side").alias("form"))
    begun = read.where("start <> ''").join(starts, ["type", "main", "start"]).select("id", "type", "active", "is_name", F.col("canonical").alias("form"))
    known = forms.select("form", "main", "side", "n")
    borne = cut(whole.unionByName(begun).distinct().join(known.drop("n"), "form"))
    links = reduce(DataFrame.unionByName, (typos, cut(_short_links(forms, shorts)), cut(_alias_links(borne))))
    groups = cut(seed_tree_components(cut(links.select("form", "canonical").distinct())))
    grouped = known.join(groups, known.form == groups.node, "left").select("form", "main", "side", "n", F.coalesce("component", "form").alias("component"))
    best = grouped.groupBy("component").agg(F.min_by(F.struct("main", "side"), F.struct(-F.col("n"), "main", "side")).alias("best"))
    meant = grouped.join(best, "component").select("form", "best")
    # a name counts before the aliases; a record without a readable name is its alias of the most frequent form
    own = borne.join(known.select("form", "n"), "form").groupBy("id", "type", "active").agg(F.max_by("form", F.struct("is_name", "n", "form")).alias("form"))
    return own.join(meant, "form").select("id", "type", "active", "best.main", "best.side")


def variant_pairs(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b) of active records attributed to one canonical form, entity_id_a < entity_id_b."""
    members = cut(canonical_forms(entities, aliases).where("active").select("id", F.concat_ws("|", "type", "main", "side").alias("form")))
    other = members.select("form", F.col("id").alias("entity_id_b"))
    pairs = salted_lookup(members.withColumnRenamed("id", "entity_id_a"), other, "form", HOT_ROWS, SALTS)
    return pairs.where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
