"""Personal data: base patterns, and further spans chosen by gradient boosting.

Generators with high recall propose overlapping spans in looser formats; boosted trees judge them by format and
context, and per kind a threshold calibrated on held-out examples selects what is added to the base spans.

The trees learn from the corpus itself: base spans in their context, rewritten in looser formats, are examples of
personal data; the same with broken checks (digit sums, ranges, lengths), in a wrong kind, and other numbers are not. Of the
corpus's other candidates only those are examples that fail a hard check of their kind; the others may be personal data
and have no label. At most SAMPLE spans are used of each kind, and SAMPLE failing ones, those of the smallest hash; everything else covers all text.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewaylens.llm import boosting
from gatewaylens.llm.common import slices, texts_of
from gatewaylens.session import written

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000  # spans to learn from, of each kind and label
CONTEXT = 30  # characters on either side
PRECISION = 0.98  # on held-out examples, for the thresholds

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the local part, `@` and the domain: each `@` has one run of characters before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; matches that fail their check are dropped."""
    found = [(a, b, "email") for a, b in _emails(text)]
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _digits(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_AT = r"(?: ?[\[({] ?at ?[\])}] ?| at (?=[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot| dot ))|@)"
_DOT = r"(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)"
_LOOSE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?|\.)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{1,2}[0-9]{2,6}){1,5}(?![0-9])|(?<![0-9])[0-9]{12,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00 ?[0-9]{1,3}[ ./-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9])"),
}
_HINT = re.compile(r"[0-9]|[\[({] ?at|@| dot ")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the loose patterns propose, one pattern at a time: they may overlap each other and base spans."""
    if not _HINT.search(text):
        return []
    return [(m.start(), m.end(), kind) for kind in KINDS for m in _LOOSE[kind].finditer(text)]


_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])([-./ ])(?:0?[1-9]|[12][0-9]|3[01])\2(?:1[89]|20)[0-9]{2}")


def fails(kind: str, span: str, before: str, after: str) -> bool:
    """Whether a candidate cannot be of its kind: digit sum, ranges, number of digits, dates and amounts."""
    digits = _digits(span)
    if kind == "email":
        return not span[:1].isalnum() and not any(ch.isalnum() for ch in re.split(r"[@\[({ ]", span)[0])
    if kind == "ip":
        groups = re.findall(r"[0-9]+", span)
        return len(groups) != 4 or not all(map(_octet, groups))
    if kind == "card":
        return not 12 <= len(digits) <= 19 or not luhn(digits)
    amount = before.rstrip()[-1:] in ("$", "€", "£") or after.lstrip()[:1] in ("$", "€", "£", "%")
    return not 7 <= len(digits) <= 15 or amount or _DATE.fullmatch(span) is not None


#: Words that stand near personal data, by kind.
CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "appel"),
}


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format of the span and what stands around it."""
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    marks = [ch for ch in span if not ch.isalnum()]
    near = (before + " " + after).lower()
    last, next_ = before[-1:], after[:1]
    return [
        KINDS.index(kind), len(digits), len(groups), len(span), float(12 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(map(_octet, groups))), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(set(marks)), float(span.count(".")), float("(" in span or "[" in span), float("@" in span),
        float(bool(re.search(r"\bat\b", span))), float(bool(re.search(r"\bdot\b|\.", span))),
        float(last.isalnum()), float(next_.isalnum()), float(last in "$#.,/-:=€"), float(next_ in "%/-.:"),
        float(any(cue in near for cue in CUES[kind])), float(sum(ch.isdigit() for ch in near)), float("\n" in near),
        float(9 <= len(digits) <= 15), float(digits[:1] == "0"),
    ]


@dataclass(frozen=True)
class Model:
    trees: boosting.Trees | None
    thresholds: dict[str, float]


def _samples(docs: DataFrame, text: str) -> list[tuple[str, str, str, str]]:
    """(kind or `other-` and kind, span, before, after): the spans of the smallest hashes, at most SAMPLE of each label."""
    labels = (*KINDS, *(f"other-{k}" for k in KINDS))
    limit = SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in slices(batch, "t"):
                for value in texts_of(part, "t"):
                    found = base_spans(value)
                    taken = {(a, b) for a, b, _ in found}
                    loose = [(a, b, k) for a, b, k in candidates(value) if (a, b) not in taken and not _meets(a, b, taken)]
                    around = [(k, value[a:b], value[max(0, a - CONTEXT):a], value[b:b + CONTEXT]) for a, b, k in found + loose]
                    rows += around[:len(found)]
                    rows += [(f"other-{r[0]}", *r[1:]) for r in around[len(found):] if fails(*r)]
            # Of each label only what can be among the smallest of all goes on.
            for label in labels:
                own = sorted({(_hash(r), *r) for r in rows if r[0] == label and len(r[1]) <= 200})[:limit]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*own)], names=["h", "kind", "span", "before", "after"])

    found = docs.select(F.col(text).alias("t")).mapInArrow(run, "h bigint, kind string, span string, before string, after string")
    ranked = written(found.distinct(), "pii-samples")
    rows = []
    for label in labels:
        rows += ranked.where(F.col("kind") == label).orderBy("h", "span", "before", "after").limit(SAMPLE).collect()
    return [(r["kind"], r["span"], r["before"], r["after"]) for r in sorted(rows)]


def _hash(row: tuple) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(row).encode(), digest_size=7).digest(), "big")


def _meets(a: int, b: int, spans) -> bool:
    return any(a < y and x < b for x, y in spans)


def _loosened(kind: str, span: str, draw: random.Random) -> str:
    """The same data in another format."""
    if kind == "email":
        if draw.random() < 0.5:  # names without numbers are names too
            span = re.sub(r"[0-9]", "", span).replace(".@", "@").replace("@.", "@")
        name, _, host = span.partition("@")
        at, dot = draw.choice([(" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("[at]", "."), (" (at) ", " (dot) ")])
        return (name or "a") + at + host.replace(".", dot)
    if kind == "ip":
        return span.replace(".", draw.choice(["[.]", " [.] ", "(dot)"]))
    digits = _digits(span)
    if kind == "card":
        mark = draw.choice([".", "_", "/", "  "])
        return mark.join(digits[n:n + 4] for n in range(0, len(digits), 4))
    rest = digits[-10:] if len(digits) > 10 else digits
    mark = draw.choice(["-", ".", " "])
    front = draw.choice([f"({rest[:3]}) ", rest[:3] + mark, f"00{digits[:-len(rest)] or '1'} {rest[:3]}{mark}"])
    return f"{front}{rest[3:6]}{mark}{rest[6:]}"


def _broken(kind: str, span: str, draw: random.Random) -> str:
    """Looks alike, but fails the check of its kind or lacks a part."""
    if kind == "email":
        return span.split("@")[0] + draw.choice([" at ", "[at]", "@"]) + "".join(draw.choices("abcdefgh", k=5))
    groups = re.findall(r"[0-9]+", span) or ["0"]
    if kind == "ip":
        groups[draw.randrange(len(groups))] = str(draw.randint(256, 999))
        return draw.choice(["[.]", "."]).join(groups)
    digits = _digits(span)
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + draw.randint(1, 9)) % 10)
        mark = draw.choice([".", "-", "/", " "])
        return mark.join(wrong[n:n + 4] for n in range(0, len(wrong), 4))
    cut = digits[: draw.choice([5, 6, 7])]
    return draw.choice([".", "/", "-"]).join([cut[:2], cut[2:4], cut[4:]])


def _number(draw: random.Random) -> str:
    """A number that is nobody's: a date, a version, an amount, a book number."""
    year, month, day = draw.randint(1900, 2099), draw.randint(1, 12), draw.randint(1, 28)
    mark = draw.choice("-./ ")
    thousands = [str(draw.randint(1, 999)), *(f"{draw.randint(0, 999):03}" for _ in range(draw.randint(1, 3)))]
    return draw.choice([
        f"{year}{mark}{month:02}{mark}{day:02}", f"{day:02}{mark}{month:02}{mark}{year}",
        ".".join(str(draw.randint(0, 30)) for _ in range(draw.randint(2, 4))), mark.join(thousands),
        "978" + "".join(f"{mark}{draw.randint(0, 9999)}" for _ in range(3)), str(draw.randint(10 ** 4, 10 ** 11)),
        ".".join(str(draw.randint(256, 999)) for _ in range(4)), f"{draw.randint(1, 99)}-{draw.randint(100, 999)}-{draw.randint(10, 99)}",
    ])


def train(docs: DataFrame, text: str = "text", seed: int = 7) -> Model:
    """Trees and thresholds from the corpus; without any base span nothing is added.

    Each base span is put back into its context in a looser format, broken, and as a plain number. What the
    generators propose there are the examples: personal if it is the whole span in its own kind.
    """
    draw = random.Random(seed)
    rows, target, kinds = [], [], []

    def learn(kind: str, span: str, before: str, after: str, label: int) -> None:
        rows.append(features(kind, span, before, after))
        target.append(label)
        kinds.append(kind)

    for kind, span, before, after in _samples(docs, text):
        if kind.startswith("other-"):
            learn(kind[6:], span, before, after, 0)
            continue
        for form, good in ((_loosened(kind, span, draw), True), (_broken(kind, span, draw), False), (_number(draw), False)):
            whole, first, last = before + form + after, len(before), len(before) + len(form)
            for a, b, own in candidates(whole):
                if a < last and b > first:
                    learn(own, whole[a:b], whole[max(0, a - CONTEXT):a], whole[b:b + CONTEXT],
                          int(good and own == kind and a <= first and b >= last))
    if not any(target):
        return Model(None, {})
    x, y, k = np.array(rows, float), np.array(target, float), np.array(kinds)
    held = np.arange(len(y)) % 4 == 0
    trees = boosting.fit(x[~held], y[~held])
    p = trees.probability(x[held])
    thresholds = {kind: _calibrated(p[k[held] == kind], y[held][k[held] == kind]) for kind in KINDS}
    return Model(trees, thresholds)


def _calibrated(p: np.ndarray, y: np.ndarray) -> float:
    """The lowest threshold, one half at least, from which held-out examples have the precision; above 1 if none has."""
    for limit in np.unique(np.concatenate([[0.5], p[p > 0.5]])):
        chosen = p >= limit
        if chosen.any() and y[chosen].mean() >= PRECISION:
            return float(limit)
    return 2.0


def added_spans(text: str, base: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int, str]]:
    """Candidates apart from all base spans that reach their threshold; of overlapping ones the most probable."""
    if model.trees is None:
        return []
    taken = [(a, b) for a, b, _ in base]
    open_ = [c for c in candidates(text) if not _meets(c[0], c[1], _close(taken, c))]
    if not open_:
        return []
    rows = [features(k, text[a:b], text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]) for a, b, k in open_]
    p = model.trees.probability(np.array(rows, float))
    chosen: list[tuple[int, int, str]] = []
    blocked: set[int] = set()
    for at in sorted(range(len(open_)), key=lambda n: (-p[n], open_[n][0], KINDS.index(open_[n][2]))):
        a, b, kind = open_[at]
        if p[at] >= model.thresholds.get(kind, 2.0) and blocked.isdisjoint(range(a, b)):
            chosen.append(open_[at])
            blocked.update(range(a, b))
    return chosen


def _close(taken: list[tuple[int, int]], candidate: tuple[int, int, str]) -> list[tuple[int, int]]:
    """Base spans that begin before the candidate's end and so may overlap it (they are sorted by start)."""
    from bisect import bisect_left

    stop = bisect_left(taken, (candidate[1], 0))
    return taken[max(0, stop - 2 * len(KINDS)):stop]


def find(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) for each row, in code points, by start and then kind.

    Null and empty texts have no spans. Repeated rows stay, a null id stays null; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                made = []
                for value in texts_of(part, "t"):
                    base = base_spans(value)
                    spans = [(a, KINDS.index(k), b, k, True) for a, b, k in base]
                    spans += [(a, KINDS.index(k), b, k, False) for a, b, k in added_spans(value, base, model)]
                    made.append([{"kind": k, "start": a, "end": b, "base": own} for a, _, b, k, own in sorted(spans)])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, one)], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema)


def redact(text, spans, mark: str = "*"):
    """Column: the text with every character of the spans replaced by the mark; a null text stays null."""
    return F.aggregate(
        spans, text, lambda done, s: F.overlay(done, F.repeat(F.lit(mark), s["end"] - s["start"]), s["start"] + 1))
