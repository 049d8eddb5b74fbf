"""Personal information in free text, found by a semi-Markov conditional random field.

A line of text is a row of tokens. Candidate segments of a type (email, phone, id_number, address, name) are
scored by features of the whole span and its surroundings; every other token is a segment of its own. A transition
weight belongs to each pair of a segment's type and the type of the last item before it. Dynamic programming over
token borders and last types, with a bound on the length of a segment, chooses borders and types together. Weights
are learnt by ``pii_training`` and kept beside this file.

Bounds of a segment: NAME_WORDS words of a name, NUMBER_GROUPS groups and 5 to MOST_DIGITS digits of a number,
BEFORE_STREET and AFTER_STREET tokens (words, blanks and marks) around the street word of an address.

Defined cases: null text stays null and holds no items, and so do empty and blank texts; rows with the same id
are one record (the largest of its texts); texts are read whole, however long, line by line, so that time grows
with their length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chronoweave.llm.given_names import ABBREVIATED, KNOWN
from chronoweave.operators.skew import largest_by_key, parallel

TYPES = ("email", "phone", "id_number", "address", "name")
WEIGHTS = Path(__file__).with_name("pii_weights.json")
#: Bounds of a segment: words of a name, groups of a number, tokens before and after the street word of an address.
NAME_WORDS = 5
NUMBER_GROUPS = 34
MOST_DIGITS = 34
BEFORE_STREET, AFTER_STREET = 10, 18

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.DOTALL)
_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+%-]*(?:@|＠| @ | ?[\[(]at[\])] ?)[\w-]+(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]+)+", re.IGNORECASE)
_SPOKEN_EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+%-]* at [\w-]+(?: dot [\w-]+)+", re.IGNORECASE)
# Words that make a street name, alone or at its end.
STREET_WORDS = frozenset("street st avenue ave road rd blvd boulevard lane ln drive way court square terrace place rue calle via avenida ulica ul plaza allee platz strasse straße crescent close court row parkway pkwy trail circle walk grove gardens hill quay highway mews".split())
STREET_ENDS = ("straße", "strasse", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer")
# Words written small inside names.
PARTICLES = frozenset("van von der den de del della di da dos la le ten ter bin ibn al el".split())
_LETTER_GROUP = re.compile(r"[A-Z]{1,2}$")
_JOINERS = frozenset((" ", ", ", ". ", ".", "_", ' "', '" ', "  "))


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c))


class Line:
    """A line as tokens with their places and classes."""

    def __init__(self, text: str, known: frozenset[str], common: frozenset[str] | None = None):
        common = known if common is None else common
        self.text = text
        self.tokens, self.starts = [], []
        for match in _TOKEN.finditer(text):
            self.tokens.append(match.group())
            self.starts.append(match.start())
        self.starts.append(len(text))
        self.at = {start: k for k, start in enumerate(self.starts)}
        self.lower = [token.lower() for token in self.tokens]
        self.kinds = [self._kind(token, lower, known, common) for token, lower in zip(self.tokens, self.lower, strict=True)]
        self.words = [k for k, kind in enumerate(self.kinds) if kind not in ("_", ".")]
        self.seen_before: dict[int, tuple[str, str, str, str, str]] = {}
        self.seen_after: dict[int, tuple[str, str, str, str]] = {}

    @staticmethod
    @lru_cache(maxsize=200_000)
    def _kind(token: str, lower: str, known: frozenset[str], common: frozenset[str]) -> str:
        if token.isspace():
            return "_"
        if token.isdigit():
            return "N"
        if not token.isalpha():
            return "."
        case = "U" if token.isupper() and len(token) > 1 else "C" if token[0].isupper() else "l"
        if lower in STREET_WORDS:
            return case + "s"
        if len(lower) > 6 and lower.endswith(STREET_ENDS):
            return case + "S"
        if len(token) == 1:
            return case + "i"
        if plain(token) in KNOWN:
            return case + ("h" if lower in common else "g")  # h: a given name that is a common word too
        if lower in ABBREVIATED:
            return case + "a"
        if lower in PARTICLES:
            return case + "p"
        return case + ("v" if lower in known else "x")

    def word(self, k: int, step: int) -> tuple[str, str]:
        """The next word or number from token k on in one direction, and what marks stand between."""
        marks = ""
        while 0 <= k < len(self.tokens):
            if self.kinds[k] not in ("_", "."):
                return ("#" if self.kinds[k] == "N" else self.lower[k] if self.kinds[k][1] in "vhps" else self.kinds[k]), marks
            if self.kinds[k] == ".":
                marks = marks + self.tokens[k] if step > 0 else self.tokens[k] + marks
            k += step
        return "^" if step < 0 else "$", marks

    def before(self, i: int) -> tuple[str, str, str, str, str]:
        """What stands before token i: word, marks, class, the word before that, and what is glued to it."""
        if i not in self.seen_before:
            word, marks = self.word(i - 1, -1)
            k = i - 1
            while k >= 0 and self.kinds[k] in ("_", "."):
                k -= 1
            second = self.word(k - 1, -1)[0] if k >= 0 else "^^"
            kind = word if word in ("^", "#") else self.kinds[k][0] if k >= 0 else "^"
            glued = i > 0 and self.kinds[i - 1] != "_"
            self.seen_before[i] = word, marks, kind, second, str(self.tokens[i - 1] if glued and self.kinds[i - 1] == "." else glued)
        return self.seen_before[i]

    def after(self, j: int) -> tuple[str, str, str, str]:
        """What stands from token j on: word, marks, class, and whether it is glued."""
        if j not in self.seen_after:
            word, marks = self.word(j, 1)
            m = j
            while m < len(self.tokens) and self.kinds[m] in ("_", "."):
                m += 1
            kind = word if word in ("$", "#") else self.kinds[m][0] if m < len(self.tokens) else "$"
            self.seen_after[j] = word, marks, kind, str(j < len(self.tokens) and self.kinds[j] not in ("_", "."))
        return self.seen_after[j]

    def between(self, i: int, j: int) -> str:
        """The classes on both sides together."""
        _, marks_before, kind_before, *_ = self.before(i)
        _, marks_after, kind_after, _ = self.after(j)
        return f"c={kind_before}{marks_before[-1:]} {marks_after[:1]}{kind_after}"

    def left(self, i: int) -> list[str]:
        """Features of what stands before token i, the same for all segments that begin there."""
        before, marks, _, second, glued = self.before(i)
        return [f"p={before}", f"pp={second} {before}", f"pm={marks[-2:]}", f"p={before}{marks[-2:]}", f"gb={glued}"]

    def right(self, j: int) -> list[str]:
        """Features of what stands from token j on, the same for all segments that end there."""
        after, marks, _, glued = self.after(j)
        return [f"n={after}", f"nm={marks[:2]}", f"n={marks[:2]}{after}", f"ga={glued}"]


Candidate = tuple[int, int, str, list[str]]


def _emails(line: Line) -> Iterator[Candidate]:
    for form, pattern in (("written", _EMAIL), ("spoken", _SPOKEN_EMAIL)):
        for match in pattern.finditer(line.text):
            i, j = line.at.get(match.start()), line.at.get(match.end())
            if i is not None and j is not None:
                yield i, j, "email", [f"form={form}", line.between(i, j)]


def _after_extension(tokens: list[str], kinds: list[str], m: int) -> int:
    """The token after the number of an extension (``x12``, ``ext 12``, ``ext. 12``), 0 if there is none."""
    for mark in (".", " "):
        m += m < len(tokens) and tokens[m] == mark
    return m + 1 if m < len(tokens) and kinds[m] == "N" else 0


def _number_runs(line: Line) -> Iterator[list[tuple[int, int]]]:
    """Maximal runs of groups (first token, token after) of digits and short capital letters."""
    kinds, tokens, n = line.kinds, line.tokens, len(line.tokens)
    is_group = [kinds[k] == "N" or bool(_LETTER_GROUP.match(tokens[k])) for k in range(n)]
    k = 0
    while k < n:
        if not is_group[k]:
            k += 1
            continue
        run, j = [(k, k + 1)], k + 1
        while True:
            m = j
            while m < n and m - j < 3 and tokens[m] in (" ", "-", ".", "/", "(", ")", " "):
                m += 1
            gap = "".join(tokens[j:m])
            if m < n and gap in ("", " ", "-", ".", "/", " (", ") ", ")", "-(", ")-", " ") and is_group[m]:
                run.append((m, m + 1))
            elif m < n and gap == " " and line.lower[m] in ("x", "ext") and (after := _after_extension(tokens, kinds, m + 1)):
                run.append((m, after))
                m = after - 1
            else:
                break
            j = m + 1
        if any(kinds[a] == "N" for a, _ in run):
            yield run
        k = j


def _numbers(line: Line) -> Iterator[Candidate]:
    tokens, kinds = line.tokens, line.kinds
    for run in _number_runs(line):
        breaks = [0, *(g for g in range(1, len(run)) if tokens[run[g][0] - 1] == " "), len(run)]
        for x, a in enumerate(breaks[:-1]):
            for b in breaks[x + 1 :]:
                if b - a > NUMBER_GROUPS:
                    break
                i, j = run[a][0], run[b - 1][1]
                unopened = tokens[i:j].count(")") - tokens[i:j].count("(")
                while i > 0 and (tokens[i - 1] == "+" or (tokens[i - 1] == "(" and unopened > 0)):
                    i -= 1
                    unopened -= tokens[i] == "("
                digits = sum(len(tokens[k]) for k in range(i, j) if kinds[k] == "N")
                if not 5 <= digits <= MOST_DIGITS:
                    continue
                shape = "".join(str(len(t)) if kinds[k] == "N" else t if kinds[k] in "._" else "x" if t in ("x", "ext") else "A" * len(t) for k, t in enumerate(tokens[i:j], i))
                spread = re.sub(r"^(1 )+1$", "1 1*", shape)
                first = tokens[i : i + 2]
                features = [
                    f"shape={spread}", f"digits={digits}", f"groups={min(b - a, 6)}", f"whole={b - a == len(run)}", f"start={''.join(first)[:2] if first[0] in '+(0' else first[0][:1].isdigit()}",
                    f"letters={'A' in shape}", f"marks={''.join(sorted(set(re.findall(r'[^0-9A]', shape))))}", line.between(i, j),
                ]
                for kind in ("phone", "id_number"):
                    yield i, j, kind, features


def _addresses(line: Line) -> Iterator[Candidate]:
    kinds, tokens, n = line.kinds, line.tokens, len(line.tokens)
    for k in (k for k in line.words if kinds[k][-1] in "sS" and kinds[k] != "N"):
        # an address begins with a number, a capital or the street word, and ends with anything but a small common word
        starts = [k] + [i for i in range(max(0, k - BEFORE_STREET), k) if kinds[i][0] in "NCU"]
        ends = [j for j in range(k + 1, min(n, k + AFTER_STREET) + 1) if kinds[j - 1] not in ("_", "lv", "lp") and (kinds[j - 1] != "." or tokens[j - 1] == ".")]
        for i in starts:
            for j in ends:
                inside = "".join(
                    "N" if kinds[m] == "N" else tokens[m] if kinds[m] == "." else " " if kinds[m] == "_" else line.lower[m] if kinds[m][1] == "v" else kinds[m] for m in range(i, j)
                )
                if "N" not in inside.replace("Nl", ""):
                    numbered = False
                else:
                    numbered = True
                street = inside if len(inside) <= 60 else "long"
                head = "".join(kinds[m] if kinds[m] not in ("_", ".") else tokens[m] for m in range(i, min(k + 1, i + 6)))
                tail = "".join(kinds[m] if kinds[m] not in ("_", ".") else tokens[m] for m in range(max(k, j - 4), j))
                yield i, j, "address", [
                    f"form={street}", f"head={head}", f"tail={tail}", f"numbered={numbered}", f"length={min(j - i, 14)}", f"before={sum(kinds[m] not in ('_', '.') for m in range(i, k))}",
                    f"marks={''.join(sorted({tokens[m] for m in range(i, k) if kinds[m] == '.'}))}", f"small={sum(kinds[m] == 'lv' for m in range(i, j))}",
                    f"stop={any(tokens[m] in '.?!' and kinds[m + 1] == '_' for m in range(i, k))}", line.between(i, j),
                ]


def _names(line: Line) -> Iterator[Candidate]:
    kinds, tokens = line.kinds, line.tokens
    for x, i in enumerate(line.words):
        if kinds[i] == "N" or kinds[i] in ("lv", "ls", "lS", "lp"):
            continue
        form, bare, j = kinds[i], kinds[i][1], i + 1
        for step in range(NAME_WORDS):
            if step:
                if x + step >= len(line.words):
                    break
                m = line.words[x + step]
                gap = "".join(tokens[j:m])
                if gap not in _JOINERS or kinds[m] == "N" or kinds[m] in ("lv", "ls", "lS"):
                    break
                form, bare, j = f"{form}{gap}{kinds[m]}", f"{bare}{gap}{kinds[m][1]}", m + 1
            end = j
            if kinds[j - 1][1] in "ia" and end < len(tokens) and tokens[end] == "." and ("," in form or kinds[j - 1][1] == "a"):
                end += 1
            around, p, n = line.between(i, end), line.before(i)[0], line.after(end)[0]
            longer = line.words[x + step + 1] if x + step + 1 < len(line.words) else None
            follows = kinds[longer] if longer is not None and "".join(tokens[j:longer]) == " " else "-"
            yield i, end, "name", [f"form={form}", f"bare={bare}", f"one={step == 0} {kinds[i]}", f"words={step}", f"follows={follows}", around, f"bare={bare} {around}", f"form={form} {around}", f"bare={bare} p={p}", f"bare={bare} n={n}"]


def candidates(line: Line) -> Iterator[Candidate]:
    """Candidate segments with their own features; ``Line.left`` and ``Line.right`` give those of their surroundings."""
    yield from _emails(line)
    yield from _numbers(line)
    yield from _addresses(line)
    yield from _names(line)


START = "none"  # the state before the first item of a line
STATES = (START, *TYPES)


class Model:
    """Weights of features by type and of transitions, and the words known from training."""

    def __init__(self, weights: dict[str, dict[str, float]], known: frozenset[str]):
        self.weights, self.known = weights, known
        self.steps = {(a, b): weights.get(b, {}).get(f"after={a}", 0.0) for a in STATES for b in TYPES}
        # a segment can be part of the best only if its score, the best step to it and the best change of the next
        # step are positive together
        self.bound = {b: max(self.steps[a, b] for a in STATES) + max(0.0, *(self.steps[b, c] - min(self.steps[a, c] for a in STATES) for c in TYPES)) for b in TYPES}
        self.items = lru_cache(maxsize=100_000)(self._items)

    @classmethod
    def load(cls, path: Path = WEIGHTS) -> Model:
        stored = json.loads(path.read_text(encoding="utf-8"))
        return cls(stored["weights"], frozenset(stored["known"]))

    def sum(self, kind: str, features: list[str]) -> float:
        own = self.weights.get(kind, {})
        return sum([own.get(feature, 0.0) for feature in features])

    def _items(self, text: str) -> tuple[tuple[int, int, str], ...]:
        """(start, end, type) of the best segmentation of a line."""
        line = Line(text, self.known)
        starting: dict[int, list[tuple[int, str, float]]] = {}
        lefts: dict[tuple[str, int], float] = {}
        rights: dict[tuple[str, int], float] = {}
        for i, j, kind, features in candidates(line):
            if (left := lefts.get((kind, i))) is None:
                left = lefts[kind, i] = self.sum(kind, line.left(i)) + self.weights.get(kind, {}).get("bias", 0.0)
            if (right := rights.get((kind, j))) is None:
                right = rights[kind, j] = self.sum(kind, line.right(j))
            if (score := left + right + self.sum(kind, features)) + self.bound[kind] > 0.0:
                starting.setdefault(i, []).append((j, kind, score))
        if not starting:
            return ()
        n = len(line.tokens)
        # by border and type of the last item: score, border and type before, type of the segment that ends here
        best: list[dict[str, tuple[float, int, str, str]]] = [{} for _ in range(n + 1)]
        best[0][START] = (0.0, 0, START, "")
        for i in range(n):
            onward = best[i + 1]
            for last, (score, *_) in best[i].items():
                if last not in onward or onward[last][0] < score:
                    onward[last] = (score, i, last, "")
                for j, kind, own in starting.get(i, ()):
                    reached = score + own + self.steps[last, kind]
                    if kind not in best[j] or best[j][kind][0] < reached:
                        best[j][kind] = (reached, i, last, kind)
        at, found = n, []
        last = max(best[n], key=lambda state: best[n][state][0])
        while at > 0:
            _, began, before, kind = best[at][last]
            if kind:
                found.append((line.starts[began], line.starts[at], kind))
            at, last = began, before
        return tuple(reversed(found))

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Items of a whole text; its lines are looked at one by one."""
        found, offset = [], 0
        for part in text.split("\n"):
            found += [(start + offset, end + offset, kind) for start, end, kind in self.items(part)]
            offset += len(part) + 1
        return found

    def replace(self, text: str, items: list[tuple[int, int, str]] | None = None) -> str:
        """The text with a typed placeholder for each item."""
        parts, at = [], 0
        for start, end, kind in self.find(text) if items is None else items:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*parts, text[at:]])


@lru_cache(maxsize=1)
def default_model() -> Model:
    return Model.load()


_ITEM = StructType([StructField("start_char", IntegerType()), StructField("end_char", IntegerType()), StructField("pii_type", StringType())])
_READ = StructType([StructField("items", ArrayType(_ITEM)), StructField("clean", StringType())])


@F.pandas_udf(_READ)
def _read_batch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    model = default_model()
    for texts in batches:
        found = [[] if text is None else model.find(text) for text in texts]
        clean = [None if text is None else model.replace(text, items) for text, items in zip(texts, found, strict=True)]
        yield pd.DataFrame({"items": [[{"start_char": s, "end_char": e, "pii_type": k} for s, e, k in items] for items in found], "clean": clean})


def read_texts(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, text, items, clean) with one row a record."""
    once = largest_by_key(records.select(F.col(record_id).alias("record_id"), F.col(text).alias("text")), "record_id", "text")
    return parallel(once).withColumn("read", _read_batch("text")).select("record_id", "text", "read.items", "read.clean")


def personal_items(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, pii_type, start_char, end_char) of every item."""
    return read_texts(records, record_id, text).select("record_id", F.explode("items").alias("i")).select("record_id", "i.pii_type", "i.start_char", "i.end_char")


def without_personal_items(records: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, text) with every item replaced by [TYPE]."""
    return read_texts(records, record_id, text).select("record_id", F.col("clean").alias("text"))
