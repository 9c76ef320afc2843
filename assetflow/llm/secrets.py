"""Operator 6: secret scans with a guess-cost model.

Three plain patterns give the base spans: assignments to credential names (value of six characters or more),
cloud access keys, and long runs of hexadecimal digits. The method adds values in a wider credential context
whose guess cost is high: dynamic programming finds the cheapest segmentation of the value into common words,
dates, repeats, keyboard walks and brute-force spans, in decimal logarithms of guesses. Values that a base span
covers are not reported twice.

A quoted value goes up to its closing quote, with spaces and line ends, but not over an empty line; a single quote
that a letter, digit or underscore follows closes nothing. Any other value, also one whose quote is not closed, goes
up to white space, without closing punctuation; brackets that the value opens stay. The cost alone decides, whatever
the length. A value within another one is as cheap as that one, and not judged again.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Whole texts are read, whatever their
length. Repeated rows are scanned each for itself; other columns are left as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind: string, start: int, end: int>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What comes before a value in a credential context.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*""",
    re.ASCII | re.IGNORECASE,
)
#: Ends of quoted values, and empty lines, over which none goes; a backslash takes the next character with it.
QUOTES = {
    q: re.compile(rf"""\\[\s\S]|(?P<close>{end})|(?P<open>\n[^\S\n]*\n)""")
    for q, end in (('"', '"'), ("'", r"'(?!\w)"), ('"""', '"""'), ("'''", "'''"))
}
SPACE = re.compile(r"\s")
CLOSING = {")": "(", "]": "[", "}": "{", ">": "<"} | dict.fromkeys(".,;:'\"", "")
#: A text without any of these, in lower case, has no credential context.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential")

#: Common passwords and their parts, most common first.
WORDS = (
    "password admin welcome login letmein secret master dragon monkey shadow sunshine princess football baseball "
    "superman batman iloveyou trustno michael jordan hunter ranger soccer killer pepper ginger thomas robert daniel "
    "charlie jessica ashley andrew joshua summer winter spring autumn flower cookie orange purple silver golden "
    "computer internet server system default guest user root test demo example sample change changeme temp public "
    "private access account token database oracle mysql postgres manager service support company office house home "
    "mother father sister brother friend family love hello world money happy smile angel tiger eagle falcon lion "
    "apple banana cherry chocolate coffee water fire earth music guitar piano dance star moon light night monday "
    "friday sunday january march april august october december london paris berlin madrid america the and for you "
    "my me is in of to a on"
).split()
RANK = {w: math.log10(k + 1) for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
NEXT_KEYS = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))}
DATES = re.compile(r"(?=((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d))|(?=((?:19|20)\d\d))", re.ASCII)
DATE_COST, YEAR_COST = math.log10(366 * 120), math.log10(120)
#: What each further segment costs: the guesser also tries where segments end.
JOINT = math.log10(2)


def _alphabet(c: str) -> float:
    if c.isascii():
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return math.log10(100)


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few characters change length in lower case
        low = value
    single = [_alphabet(c) for c in value]
    found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for size in range(1, min(LONGEST, n - i) + 1):
            if (rank := RANK.get(low[i : i + size])) is not None:
                word = value[i : i + size]
                case = 0.0 if word.islower() else math.log10(2) if word.isupper() or word.istitle() else size * math.log10(2)
                found[i].append((i + size, rank + case + JOINT))
    for m in DATES.finditer(value):
        date = m[1] or m[2]
        found[m.start()].append((m.start() + len(date), (DATE_COST if m[1] else YEAR_COST) + JOINT))
    i = 0
    while i < n:  # keyboard and alphabet walks of four keys or more, from each of their places
        j, turns = i + 1, 0
        while j < n and (low[j - 1], low[j]) in NEXT_KEYS:
            turns += j - i >= 2 and low[j] == low[j - 2]
            j += 1
        for start in range(i, j - 3):
            found[start].append((j, math.log10(47 * (j - start)) + turns * math.log10(4) + JOINT))
        i = max(j - 1, i + 1) if j - i >= 2 else i + 1
    for unit in range(1, 9):  # repeats of a unit, cost of the unit and of the count
        i = 0
        while i + 2 * unit <= n:
            j = i
            while j + unit < n and value[j] == value[j + unit]:
                j += 1
            times = (j - i) // unit + 1
            if times >= 2 and times * unit >= 3:
                end = i + times * unit
                found[i].append((end, sum(single[i : i + unit]) + math.log10(times) + JOINT))
                i = max(i + 1, end - unit)
            else:
                i = max(i + 1, j)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + single[i])
        for j, cost in found[i]:
            if here + cost < best[j]:
                best[j] = here + cost
    return best[n]


def _values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential contexts that lie in no earlier one."""
    ends: dict[str, list[tuple[int, bool]]] = {}
    reached = space = 0
    for m in CONTEXT.finditer(text):
        start = at = m.end()
        end = None
        if (quote := text[at : at + 1]) in QUOTES:
            quote = quote * 3 if text.startswith(quote * 3, at) else quote
            start = at + len(quote)
            if quote not in ends:
                ends[quote] = [(x.start(), x["close"] is not None) for x in QUOTES[quote].finditer(text) if x.lastgroup]
            k = bisect_left(ends[quote], (start, False))
            if k < len(ends[quote]) and ends[quote][k][1]:
                end = ends[quote][k][0]
        if end is None:
            if start < space:
                continue  # in a value up to the same space
            end = space = found.start() if (found := SPACE.search(text, start)) else len(text)
            opened = {c: text.count(o, start, end) - text.count(c, start, end) for c, o in CLOSING.items() if o}
            while end > start and (c := text[end - 1]) in CLOSING and opened.get(c, -1) < 0:
                if c in opened:
                    opened[c] += 1
                end -= 1
        if end > max(start, reached):
            yield start, end
            reached = end


def find_spans(text: str | None, min_cost: float) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), in order."""
    if not text:
        return []
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        base = sorted((start, end) for start, _, end in spans)
        for start, end in _values(text):
            if any(a <= start and end <= b for a, b in base):
                continue
            if guess_cost(text[start:end]) >= min_cost:
                spans.append((start, 3, end))
    return sorted(spans)


def find_secrets(docs: DataFrame, column: str = "secrets", min_cost: float = 8.0) -> DataFrame:
    """``docs`` with an array of spans of its ``text``, by start and then kind.

    ``min_cost``: decimal logarithm of guesses from which a value in a credential context counts as a secret.
    """

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t, min_cost)] for t in texts], dtype=object)

    return docs.withColumn(column, spans(F.col("text")))


def redact(docs: DataFrame, mark: str = "[secret]", min_cost: float = 8.0) -> DataFrame:
    """``docs`` with ``mark`` in place of each secret, overlapping ones together; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            spans = find_spans(text, min_cost)
            if spans:
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", clean(F.col("text")))


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end, comma-joined, of the spans of these kinds."""
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
