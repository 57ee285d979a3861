"""Secret scans: fixed patterns, and password guess costs for values in a credential context.

The guess cost of a value is the least number of guesses over all its segmentations into dictionary
words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming: a segment
costs its own guesses, segments multiply, and ``k`` segments can be arranged in ``k!`` ways.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visitline.llm import words as word_arrays
from visitline.session import ship_package

# Fixed values of the contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the same as all runs with the short ones dropped
KINDS = ("assign", "access", "hex", "context")

# Further contexts in which a value is taken as a credential.
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|login|credentials?|secret|token|auth|api[_ -]?key|access[_ -]?key|private[_ -]?key)\b"""
    r"""["']?\x20*(?:(?:is|was)\x20+|[:=]+>?\x20*)["']?([^\x00-\x20"'<>,;]{6,})""",
    re.A | re.I,
)
CONTEXT_HINTS = ("pass", "pwd", "pin", "login", "credential", "secret", "token", "auth", "key")

# Common password words, most frequent first (fixed values).
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login princess abc123 sunshine iloveyou football shadow "
    "superman michael jordan hunter secret trustno1 baseball starwars hello freedom whatever charlie summer winter spring autumn "
    "test guest root user changeme default pass love money computer internet server access key token system hello world office "
    "company example sample demo temp temporary public private mypassword none null true false undefined redacted xxxx required"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
_NEXT = {}
for _r, _row in enumerate(ROWS):
    for _c, _key in enumerate(_row):
        _NEXT[_key] = {ROWS[r][c] for r in (_r - 1, _r, _r + 1) if 0 <= r < len(ROWS) for c in (_c - 1, _c, _c + 1) if 0 <= c < len(ROWS[r])} - {_key}
_LEET = str.maketrans("4@301!$57", "aaeoiisst")
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)")


def _alphabet(text: str) -> int:
    size = sum(n for n, found in ((10, re.search(r"\d", text)), (26, re.search("[a-z]", text)), (26, re.search("[A-Z]", text)), (33, re.search(r"[^0-9A-Za-z]", text))) if found)
    return max(size, 1)


EXACT, STRETCH = 256, 64  # a longer value is segmented in stretches
_LONG_REPEAT = re.compile(r"(.{1,8}?)\1{15,}", re.S)


def guess_log10(value: str, ranks: dict[str, int], longest: int) -> float:
    """log10 of the least guesses that reveal ``value``; beyond ``EXACT`` characters a sum over stretches.

    There, units repeated 16 times and more are taken as one segment each, and what lies between is cut into
    stretches whose costs add up, so that time grows with the length only.
    """
    brute = math.log10(_alphabet(value))
    if len(value) <= EXACT:
        return _segmented(value, ranks, longest, brute)
    total, at = 0.0, 0
    for m in [*_LONG_REPEAT.finditer(value), None]:
        end = m.start() if m else len(value)
        total += sum(_segmented(value[i : min(i + STRETCH, end)], ranks, longest, brute) for i in range(at, end, STRETCH))
        if m:
            unit = m[1]
            total += (len(unit) * brute if len(unit) > 1 else math.log10(_alphabet(unit))) + math.log10(len(m[0]) // len(unit))
            at = m.end()
    return total


def _segmented(value: str, ranks: dict[str, int], longest: int, brute: float) -> float:
    """log10 of the least guesses that reveal ``value``.

    Word: its rank, doubled for capitals and for digits written as letters. Date: 365 days of 120 years.
    Repeat: the unit's own cost times the count. Keyboard walk of 3 keys and more: 47 first keys, 8 ways per
    change of direction, times its length. Anything else: the alphabet of the value to the span's length.
    One more segment multiplies by the number of segments (their order isn't known). Empty: 0.
    """
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET)
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            if rank is None and (rank := ranks.get(plain[i:j])) is not None:
                rank *= 2
            if rank is not None:
                ending[j].append((i, math.log10(rank * (1 if value[i:j] == low[i:j] else 2))))
        for m in (m for m in (_DATE.match(value, i),) if m):
            ending[m.end()].append((i, math.log10(365 * 120 if m.end() - i > 4 else 120)))
        j, turns, step = i + 1, 0, None
        while j < n and low[j] in _NEXT.get(low[j - 1], ()):
            (r, c), (s, d) = _PLACE[low[j - 1]], _PLACE[low[j]]
            new = (s - r, d - c)
            turns, step, j = turns + (new != step), new, j + 1
            if j - i >= 3:
                ending[j].append((i, math.log10(47) + turns * math.log10(8) + math.log10(j - i)))
        for unit in range(1, min(8, (n - i) // 2) + 1):
            times = 1
            while value.startswith(value[i : i + unit], i + times * unit):
                times += 1
                if times * unit >= 3:
                    cost = unit * brute if unit > 1 else math.log10(_alphabet(value[i]))
                    ending[i + times * unit].append((i, cost + math.log10(times)))
    # best[k][j]: cheapest cost of the first j characters in k segments; adjacent brute spans are one
    best = [0.0] + [math.inf] * n
    total = math.inf
    for k in range(1, n + 1):
        orders = math.lgamma(k + 1) / math.log(10)
        if orders >= total:  # segments cost nothing less than 0
            break
        new = [math.inf] * (n + 1)
        run = math.inf  # cheapest "brute span still open" cost, shifted by one character each step
        for j in range(1, n + 1):
            run = min(run, best[j - 1]) + brute
            cost = min([run, *(best[i] + c for i, c in ending[j])])
            new[j] = cost
        best = new
        total = min(total, best[n] + orders)
    return total


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the three fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_text(text: str, ranks: dict[str, int], longest: int, strong: float) -> dict:
    spans = base_spans(text)
    costs = [guess_log10(ASSIGN.match(text, a)[2], ranks, longest) for a, b, k in spans if k == "assign"]
    taken = {(a, b) for a, b, _ in spans}
    low = text.lower()
    extra = []
    if any(hint in low for hint in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            while b > a and text[b - 1] in ".!?)":
                b -= 1
            cost = guess_log10(text[a:b], ranks, longest)
            inside = any(x <= a and b <= y for x, y in taken)
            if cost >= strong and b - a >= 6 and not inside and re.search(r"[^a-z]", text[a:b]):
                extra.append((a, b, "context"))
                costs.append(cost)
    count = {k: sum(1 for s in spans if s[2] == k) for k in KINDS[:3]}
    return {
        "n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
        "base_sha256": hashlib.sha256(_joined(spans).encode()).hexdigest(), "spans": _joined(spans + extra),
        "n_context": len(extra), "max_guess_log10": max(costs, default=0.0),
    }


def scan_secrets(docs: DataFrame, *, dictionary: Sequence[str] = COMMON, strong: float = 8.0) -> DataFrame:
    """Secrets in every whole text: counts, spans and the highest guess cost of a credential value.

    ``dictionary`` lists words from the most to the least common; it goes to every task, so it should be
    a list of bounded size. A context value whose guess cost is at least ``10 ** strong`` adds a
    ``context`` span, unless a pattern's span already covers it or it is all small letters. Spans are
    ``kind:start:end`` in code points, end exclusive, by start, then kind. Null or empty text: zero
    counts, empty ``spans``. Rows are returned one for one.
    """
    ship_package(docs.sparkSession)
    ranks: dict[str, int] = {}
    for word in dictionary:
        ranks.setdefault(word.lower(), len(ranks) + 1)
    longest = max(map(len, ranks), default=0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in word_arrays.pieces(batch):
                found = [scan_text(t or "", ranks, longest, strong) for t in piece.column("text").to_pylist()]
                columns = {name: pa.array([f[name] for f in found], kind) for name, kind in _OUT.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), **columns})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        scan,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_context bigint, max_guess_log10 double",
    )


_OUT = {
    "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(),
    "n_context": pa.int64(), "max_guess_log10": pa.float64(),
}
