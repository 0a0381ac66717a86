"""Personal data, plain and disguised, at offsets of the source text.

Plain identifiers are found in the text as it is. A transducer then rewrites disguises and remembers for every character
it writes which source characters it stands for: look-alike letters, digits of any script, wide forms and invisible
characters; spelled digits in runs; `at` and `dot` in brackets or as words of an address. The word `at` before a domain whose
dots are plain ones counts if the local part has `dot` as a word, or else if the domain's last label is one of LAST_LABELS, its
first is not www, no path follows and the word before is not one of NOT_LOCAL; so `jane at example.com` counts, and
`look at example.com` or `noon at home.so` does not. Identifiers found in the
rewritten text that hold a rewritten character are mapped back to source offsets and added, unless they lie in a plain one of
their kind.

Offsets are code points, end exclusive. Nulls and empty texts have no spans. Every pattern is scanned in time linear in the
text. Repeated rows give equal spans; empty tables give empty results; columns of the output's names are replaced.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.llm.common import fresh, quoted

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones, marks that look like ASCII ones, spelled digits.
LOOKALIKES = dict(zip("авекмнорстухіѕјԁԛԝһАВЕКМНОРСТУХІЅЈαορνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxisjdqwhABEKMHOPCTYXISJaopviktuxABEZHIKMNOPTYX", strict=True))
MARKS = dict(zip("․。｡·‐‑‒–−﹫   　", "....-----@    ", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile(f"[{''.join(LOOKALIKES)}{''.join(MARKS)}{INVISIBLE}！-～]|[^\\D0-9]")
_SPELLED = "|".join(DIGIT_WORDS)
_SPELLED_RUN = re.compile(rf"\b(?:plus[ -])?(?:{_SPELLED})(?:[ ,-]{{1,2}}(?:(?:dot|point)[ -])?(?:{_SPELLED}|[0-9]{{1,4}}))+\b", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"(plus[ -])|([ ,-]{{1,2}}(?:dot|point)[ -])|\b({_SPELLED})\b|([ ,-]+)", re.IGNORECASE)
_BRACKETED = re.compile(r"[ ]?[\[({<][ ]?(at|dot|@|\.)[ ]?[\])}>][ ]?", re.IGNORECASE)
# A chain of words with " dot " between them starts at its first word only, so that it is read once.
_NAME = r"(?<![A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-] dot )([A-Za-z0-9._%+-]++(?: dot [A-Za-z0-9._%+-]++)*+)"
_WORDED = re.compile(_NAME + r"( at )(?!(?:the|an?|this|that) )[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*((?: dot [A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*)+)", re.IGNORECASE)
_WORDED_AT = re.compile(_NAME + r"( at )(?!(?:the|an?|this|that) )([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)(?![\w@/%+])", re.IGNORECASE)
_BEFORE_AT = re.compile(_NAME + r"@[A-Za-z0-9-]", re.IGNORECASE)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]++((?: dot [A-Za-z0-9-]++)+)", re.IGNORECASE)
_DOT = re.compile(r" dot ", re.IGNORECASE)
#: Last labels that are no words of prose, and words that stand before a web address rather than in an email address.
LAST_LABELS = frozenset("com org net edu gov mil info biz io ai app dev uk de fr nl es eu ch se pl cz jp cn kr ru br au ca nz pt fi dk gr ie".split())
NOT_LOCAL = frozenset(
    "us me we you him her it them this that these those here there now today online is are was were be been look looking looked see seen "
    "visit visiting available accessible found find located hosted published posted listed sold bought shop read more out up live based "
    "work works worked working and or but not only also again arrive arrives arrived download downloaded documentation documented".split()
)
#: Digits that a run of spelled ones needs to be rewritten.
_LEAST_SPELLED = 4

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            after = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))] if _DOTTED.search(text) else []


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []


def detect(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers: (kind, start, end), by kind."""
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for a, b in find(text)]


def plain(char: str) -> str:
    """What one odd character stands for."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in MARKS:
        return MARKS[char]
    if "！" <= char <= "～":
        return chr(ord(char) - 0xFEE0)
    return str(unicodedata.decimal(char))


class Rewritten:
    """A rewritten text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.end, self.changed = text, None, None, None

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Put strings in place of pieces (start, end, string) of the present text; of overlapping ones the first counts."""
        if not pieces:
            return
        n = len(self.text)
        if self.begin is None:
            self.begin, self.end, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n
        text, begin, end, changed, at = [], [], [], [], 0
        for a, b, new in sorted(pieces):
            if a < at:
                continue
            text.append(self.text[at:a])
            begin += self.begin[at:a]
            end += self.end[at:a]
            changed += self.changed[at:a]
            text.append(new)
            begin += [self.begin[a]] * len(new)
            end += [self.end[b - 1]] * len(new)
            changed += [True] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.begin, self.end, self.changed = begin + self.begin[at:], end + self.end[at:], changed + self.changed[at:]

    def rewritten(self, char: str, a: int, b: int) -> bool:
        """Whether one of these characters in text[a:b] stands for something else."""
        return self.changed is not None and any(c == char and done for c, done in zip(self.text[a:b], self.changed[a:b], strict=True))


def normalise(text: str) -> Rewritten:
    """Undo look-alikes, then spelled digits, then disguised at and dot."""
    out = Rewritten(text)
    if not text.isascii():
        out.rewrite([(m.start(), m.end(), plain(m[0])) for m in _ODD.finditer(text)])
    pieces = []
    for run in _SPELLED_RUN.finditer(out.text):
        parts = list(_SPELLED_PART.finditer(out.text, *run.span()))
        if sum(p[3] is not None for p in parts) + sum(c.isdigit() for c in run[0]) >= _LEAST_SPELLED:
            for p in parts:
                pieces.append((p.start(), p.end(), "+" if p[1] else "." if p[2] else DIGIT_WORDS[p[3].lower()] if p[3] else ""))
    out.rewrite(pieces)
    low = out.text.lower()
    if "at" in low or "dot" in low or "@" in low:
        out.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(out.text)])
    if " dot " in low:
        pieces = []
        for m in _WORDED.finditer(out.text):
            pieces.append((*m.span(2), "@"))
            pieces += [(d.start(), d.end(), ".") for g in (1, 3) for d in _DOT.finditer(out.text, *m.span(g))]
        out.rewrite(pieces)
        out.rewrite([(d.start(), d.end(), ".") for m in _AFTER_AT.finditer(out.text) for d in _DOT.finditer(out.text, *m.span(1))])
    if " at " in low:
        pieces = []
        for m in _WORDED_AT.finditer(out.text):
            dots = [(d.start(), d.end(), ".") for d in _DOT.finditer(out.text, *m.span(1))]
            if dots or out.rewritten(".", *m.span(3)) or _addressed(m[1], m[3]):
                pieces += [*dots, (*m.span(2), "@")]
        out.rewrite(pieces)
    if " dot " in low and out.changed is not None:
        out.rewrite([(d.start(), d.end(), ".") for m in _BEFORE_AT.finditer(out.text) if out.changed[m.end() - 2] for d in _DOT.finditer(out.text, *m.span(1))])
    return out


def _addressed(name: str, domain: str) -> bool:
    """Whether `name at domain` reads as an address, not as prose about a web address."""
    labels = domain.lower().split(".")
    return labels[-1] in LAST_LABELS and labels[0] != "www" and name.lower() not in NOT_LOCAL


def disguised(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that show only in the rewritten text, at source offsets; none lies in a plain one of its kind."""
    seen = normalise(text)
    if seen.begin is None:
        return []
    out = []
    for kind, a, b in detect(seen.text):
        begin, end = seen.begin[a], seen.end[b - 1]
        if any(seen.changed[a:b]) or end - begin != b - a:
            if not any(k == kind and x <= begin and end <= y for k, x, y in found):
                out.append((kind, begin, end))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with `base` and `spans`: arrays of (kind, start, end), plain ones and all, in order."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("base", "spans")]
    text_at, = fresh(docs, "pii_text")
    rows = docs.select(*[quoted(c) for c in keep], F.col("text").alias(text_at))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def read(batches):
        for batch in batches:
            base, spans = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = detect(text) if text else []
                more = disguised(text, found) if text else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order(found)])
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in in_order([*found, *more])] if more else base[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, kind), pa.array(spans, kind)], [*batch.schema.names[:-1], "base", "spans"])

    return rows.mapInArrow(read, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema][:-1] + [T.StructField("base", span), T.StructField("spans", span)]))
