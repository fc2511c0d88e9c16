"""Secrets: base patterns, and credential-context values whose guess cost is high by dynamic programming."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from loomframe.llm.common import free_of, light, small, with_fields
from loomframe.llm.pieces import default_model
from loomframe.llm.spans import Span, accesses, assigns, hexes

KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]
#: A value counts as a secret if guessing it takes 10**THRESHOLD tries or more.
THRESHOLD = 8.0
CONTEXT_WORDS = ("pass", "pwd", "secret", "credential", "auth", "token", "key", "login", "bearer", "basic")
_VALUE = r"""["']?([^\x20\x09-\x0D"'<>,;]{4,})"""
CONTEXT = re.compile(
    r"""(?ai:(?:pass(?:phrase|code|word|wd)?|pwd|secret|credentials?|auth(?:orization)?|token|key|login))["']?[\x20\t]*(?:[:=]>?|->|\bis\b)[\x20\t]*["']?(?:(?ai:basic|bearer)\x20)?""" + _VALUE
    + r"""|(?ai:basic|bearer)\x20""" + _VALUE
)
#: Words that guessers try first, by rank.
COMMON_WORDS = (
    "password pass admin root user login welcome letmein secret master dragon monkey shadow sunshine princess football baseball "
    "superman batman trustno iloveyou love hello freedom whatever qwerty abc test guest default changeme summer winter spring autumn "
    "company server database token example sample demo public private key access system manager service"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")  # fixed values: rows of a keyboard
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)?\d\d", re.ASCII)
LEET = str.maketrans("@4310$5!7", "aaeiossit")
_KEYS = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
#: Longest dictionary word that is looked for.
LONGEST = 24


def dictionary(path: str | None = None) -> dict[str, int]:
    """Words by rank: those that guessers try first, then the letters-only entries of a public vocabulary in its order, which is about that
    of their frequency in several languages (its file is a parameter; some ten thousand entries)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    entries = (sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()))
    out: dict[str, int] = {}
    for word in (*COMMON_WORDS, *(w for w in entries if 3 <= len(w) <= LONGEST and w.isalpha())):
        out.setdefault(word, len(out) + 1)
    return out


def _adjacent(a: str, b: str) -> bool:
    p, q = _KEYS.get(a), _KEYS.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def guess_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """log10 of the tries to guess a value: the cheapest split into words, dates, repeats, keyboard walks and brute force.

    A word costs its rank (and variants of case and of look-alike characters), a date the days of a century, a walk, which may stop
    anywhere, its start, length and turns, and any other character its alphabet. A repeat of a unit as often as it goes on costs its unit's
    alphabets and the times; units that cost more by themselves than limit, or than a split that is known, are not tried: no split with one is
    the cheapest. Each part after the first doubles the tries. With a limit, time grows with the value's length, and from the place on from which no split
    stays below limit the value is not looked at, and the result is limit; without one it may grow with the square.
    """
    n, low = len(value), value.lower() if value.isascii() else value.translate({c: c + 32 for c in range(65, 91)})
    plain, double, eight, near = low.translate(LEET), math.log10(2), math.log10(8), 0
    cost = [0.0] + [math.inf] * n
    brute = math.inf  # cheapest split that ends in a brute-force part here
    same, walk, turns = [0], 0, [0]
    walks: list[tuple[float, int]] = []  # (cost but for length and later turns, start) of walks that may still be the cheapest, for the stretch up to walk

    def offer(end: int, price: float) -> None:
        nonlocal near
        if price < cost[end]:
            cost[end] = price
            if price < limit and end > near:
                near = end

    for i in range(n):
        start = cost[i] + (double if i else 0)
        brute = min(start, brute) + _alphabet(value[i])
        offer(i + 1, brute)
        if start < limit:
            for end in range(i + 3, min(n, i + LONGEST) + 1):
                rank = ranks.get(plain[i:end])
                if rank:
                    own = value[i:end]
                    variants = 1 + 2 * (own != own.lower()) + 2 * (low[i:end] != plain[i:end])
                    offer(end, start + math.log10(rank * variants + 1))
            if value[i].isdigit() and (m := DATE.match(value, i)):
                offer(m.end(), start + (math.log10(365 * 119) if m.end() - i > 4 else math.log10(119)))
            unit_cost = 0.0
            for unit in range(1, (n - i) // 2 + 1):
                unit_cost += _alphabet(value[i + unit - 1])
                if start + unit_cost >= min(limit, cost[n]):
                    break
                if unit == len(same):
                    same.append(0)
                at = max(same[unit], i)  # up to here each character equals the one a unit later
                while at + unit < n and value[at] == value[at + unit]:
                    at += 1
                same[unit] = at
                times = (at - i) // unit + 1
                if times >= (3 if unit == 1 else 2):
                    offer(i + unit * times, start + unit_cost + math.log10(times))
        if i > walk or not i:
            walk, walks = i, []
            while walk + 1 < n and _adjacent(low[walk], low[walk + 1]):
                walk += 1
                while len(turns) < walk:  # turns[k]: turns up to the step that ends at k
                    turns.append(turns[-1])
                turns.append(turns[-1] + (walk >= 2 and _step(low, walk) != _step(low, walk - 1)))
        if start < limit and walk >= i + 2:
            own = start - turns[i + 1] * eight
            # A walk that began before, and is cheaper at this one's first end, stays cheaper: the longer both go on, the less their lengths differ.
            if not any(c + math.log10(i + 3 - b) <= own + math.log10(3) for c, b in walks):
                walks = [(c, b) for c, b in walks if c < own] + [(own, i)]
                near = max(near, walk + 1)
        if walk >= i and i + 1 - (walks[0][1] if walks else i) >= 3:
            # Walks that end behind this character.
            offer(i + 1, min((c + math.log10(47 * (i + 1 - b)) + turns[i] * eight for c, b in walks if i + 1 - b >= 3), default=math.inf))
        if i >= near and brute >= limit:
            return limit
    return cost[n]


def _step(low: str, at: int) -> tuple[int, int] | None:
    """Direction of the step on the keyboard that ends at a place."""
    p, q = _KEYS.get(low[at - 1]), _KEYS.get(low[at])
    return (q[0] - p[0], q[1] - p[1]) if p and q else None


def guessed(text: str, base: list[Span], threshold: float, ranks: dict[str, int]) -> list[Span]:
    """Values in a credential context that are costly to guess: what base spans leave of each."""
    low = text.lower() if text.isascii() else text.translate({c: c + 32 for c in range(65, 91)})
    starts = set()
    for word in CONTEXT_WORDS:
        at = low.find(word)
        while at >= 0:
            starts.add(at)
            at = low.find(word, at + 1)
    out, taken, known = [], 0, sorted((s, e) for s, e, _ in base)
    reach = list(accumulate((e for _, e in known), max))
    for at in sorted(starts):
        if at >= taken and (m := CONTEXT.match(text, at)):
            a, b = m.span(1) if m[1] is not None else m.span(2)
            b -= b - a - len(text[a:b].rstrip(".!?:)"))
            taken = max(b, at + 1)
            if b - a >= 6 and guess_cost(text[a:b], ranks, threshold) >= threshold:
                i = bisect_right(reach, a)  # the first base span that ends after the value begins
                while a < b:
                    s, e = known[i] if i < len(known) else (b, b)
                    if a < min(s, b):
                        out.append((a, min(s, b), "guess"))
                    a, i = max(a, e), i + 1
    return out


def find(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with secret_spans, an array of (start, end, kind).

    Offsets are code points, ends exclusive. A null or empty text has none; ids are not looked at, so null and repeated ones are like any
    other; equal rows give equal spans, and an empty table an empty one. Added spans never touch base spans: of a value that a
    base span covers in part, the rest is added. Time grows with a text's length. Columns of docs with the name of the added
    one are replaced.
    """
    docs = free_of(docs, "secret_spans")
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    shared = light(docs.sparkSession).sparkContext.broadcast(dictionary() if ranks is None else ranks)  # some ten thousand words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = []
            for text in batch.column(at).to_pylist():
                base = assigns(text) + accesses(text) + hexes(text) if text else []
                spans = base + guessed(text, base, threshold, shared.value) if text else []
                found.append(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "secret_spans"])

    return docs.mapInArrow(run, with_fields(docs, secret_spans="array<struct<start:long,end:long,kind:string>>"))
