"""Secret scans with a guess-cost dynamic program.

Three fixed patterns find assignments, access keys and long hex runs. Besides, the
value in every credential context (a named assignment of any form, a bearer token, or
the password of a URL) is priced: the number of guesses that the cheapest split into words, dates,
repeats, keyboard walks and brute-force spans needs. Values that cost enough are
secrets whatever their alphabet; `password: aaaaaaaa` is not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.llm.shared import col, text_of

# The patterns of the base kinds and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

#: Names that announce a credential, a bearer token, and the password of a URL; the last group
#: is the value. A quoted value goes to its closing quote on the line, if there is one.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|auth|client)[_-]?(?:key|secret|token)|credentials?|bearer)"""
    r"""["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:"((?:[^"\\\r\n]|\\.)*+)"|'((?:[^'\\\r\n]|\\.)*+)'|["']?(?:bearer[\x20\t]+)?([^\s"'`,;<>]{6,}))"""
    r"""|bearer[\x20\t]+["']?([^\s"'`,;<>]{6,})"""
    r"""|://[^\s/:@]*:([^\s/@]{6,})@""",
    re.ASCII | re.IGNORECASE,
)
CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"key", b"credential", b"bearer", b"://")
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: A value that takes 10 to this power guesses or more is a secret.
LEAST_COST = 8.0

# Frequent parts of passwords, most frequent first.
WORDS = (
    "password pass admin welcome letmein login secret master dragon monkey shadow sunshine princess football baseball superman batman "
    "iloveyou love hello freedom whatever trustno test guest user root changeme default example sample demo token access private public "
    "key server database mysql oracle postgres system service account computer internet network security company office summer winter "
    "spring autumn january february march april june july august september october november december monday tuesday wednesday thursday "
    "friday saturday sunday money mother father family friend forever flower purple orange yellow green blue red black white silver "
    "golden tiger lion eagle horse rabbit pepper ginger cookie chocolate cheese coffee starwars pokemon matrix soccer hockey tennis "
    "michael jennifer jordan michelle daniel thomas robert andrew joshua charlie george hunter killer ranger harley mustang corvette"
).split()
LEET = str.maketrans("@4301!$57", "aaeoiisst")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
DATE = re.compile(r"(?=((?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))")
YEAR = re.compile(r"(?=((?:19|20)\d\d))")

RANKS = {w: n for n, w in enumerate(WORDS, 1)}
LENGTHS = sorted({len(w) for w in WORDS})
PLACES = {key: (x, y) for y, row in enumerate(KEYBOARD) for x, key in enumerate(row)}
SPAN = log10(2)  # for every further span: where it begins
REPEAT_UNIT = 4


def char_cost(c: str) -> float:
    return log10(10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000)


def guessable_spans(value: str) -> dict[int, list[tuple[int, float]]]:
    """By end: (start, log10 of guesses) of words, dates, repeats and keyboard walks."""
    found: dict[int, list[tuple[int, float]]] = {}
    lower = "".join(c.lower() if c < "\x80" else c for c in value)
    plain = lower.translate(LEET)
    for at in range(len(value)):
        for n in LENGTHS:
            if rank := RANKS.get(plain[at:at + n]):
                changed = (value[at:at + n] != lower[at:at + n]) + (plain[at:at + n] != lower[at:at + n])
                found.setdefault(at + n, []).append((at, log10(rank) + changed * log10(2)))
    for m in DATE.finditer(value):
        found.setdefault(m.end(1), []).append((m.start(), log10(365 * 200)))
    for m in YEAR.finditer(value):
        found.setdefault(m.end(1), []).append((m.start(), log10(200)))
    for unit in range(1, REPEAT_UNIT + 1):
        same = 0
        for end in range(unit + 1, len(value) + 1):
            same = same + 1 if value[end - 1] == value[end - 1 - unit] else 0
            if same >= unit and same + unit >= 3:
                start = end - same - unit
                found.setdefault(end, []).append((start, sum(map(char_cost, value[start:start + unit])) + log10((same + unit) / unit)))
    keys = [PLACES.get(c) for c in lower.translate(SHIFTED)]
    start, turns, way = 0, 0, None
    for at in range(1, len(value)):
        a, b = keys[at - 1], keys[at]
        step = (b[0] - a[0], b[1] - a[1]) if a and b else (9, 9)
        if max(map(abs, step)) > 1 or step == (0, 0):
            start, turns, way = at, 0, None
            continue
        turns += way is not None and step != way
        way = step
        if at - start >= 2:
            found.setdefault(at + 1, []).append((start, log10(len(PLACES)) + (turns + 1) * log10(8) + log10(at + 1 - start)))
    return found


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest split of the whole value needs."""
    spans = guessable_spans(value)
    best, brute = [0.0] + [0.0] * len(value), [float("inf")] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        brute[end] = min(brute[end - 1], best[end - 1] + SPAN) + char_cost(value[end - 1])
        best[end] = min([brute[end], *(best[start] + SPAN + cost for start, cost in spans.get(end, ()))])
    return best[-1]


_NOT_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    raw, found = text.encode(), []
    low = raw.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"h" * LEAST_HEX in raw.translate(_NOT_HEX):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def priced_values(text: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of every value in a credential context."""
    low = text.encode().lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    at = [m.span(m.lastindex) for m in CONTEXT.finditer(text)]
    return [(a, b, guess_cost(text[a:b])) for a, b in at if b - a >= LEAST_VALUE]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least_cost: float = LEAST_COST) -> DataFrame:
    """One row per input row: key, n_assign, n_access, n_hex, base_sha256, spans, n_guess,
    highest_cost (log10 of guesses over all credential contexts; null if there are none).

    Spans are code points, end exclusive, ordered by start and kind. Whole texts are
    scanned in place; nothing is shuffled.

    Defined cases: a null text is the empty text and has no spans; rows that repeat and
    rows with a null key are scanned one by one; an empty table gives no rows; other
    columns are ignored.
    """
    number = ("n_assign", "n_access", "n_hex")
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), *[T.StructField(c, T.LongType()) for c in number],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        T.StructField("n_guess", T.LongType()), T.StructField("highest_cost", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def row(t: str):
        base, priced = base_spans(t), priced_values(t)
        guess = [(a, 3, b) for a, b, c in priced if c >= least_cost]
        digest = hashlib.sha256(written(base).encode()).hexdigest()
        return (*[sum(s[1] == k for s in base) for k in range(3)], digest, written(sorted(base + guess)), len(guess), max((c for *_, c in priced), default=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(row(t.as_py()) for t in b.column(1)))) or [[]] * 7
            yield pa.record_batch([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)

    return docs.select(col(key).alias(key), text_of(text).alias("_text")).mapInArrow(run, schema)
