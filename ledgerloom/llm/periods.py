"""Periodic runs of words: all maximal repetitions of a text, by its longest previous factors.

A run is a stretch of words with smallest period q, at least twice as long as q, that no neighbouring word extends.  The
steps, each linear or nearly so in the words:

1. Suffix array of a batch of texts by prefix doubling in numpy.  Words of different texts are different symbols, so that
   texts never mix; only suffixes that aren't told apart yet take part in the next round.
2. Where neighbours in it share enough words for a run of the length asked for: their common prefixes (LCP), and from both
   the longest previous factor of each place (LPF) and where it was.  A run of length l has a previous factor of l - q
   words; a text without one has no run.
3. Blocks: the LPF from 0, from its end, and so on (Lempel-Ziv).
4. Runs that touch a block's begin, by Main's extensions: for each period p, how far the texts on both sides agree with
   themselves moved by p.  If a run ends in a block of c words after one of a words, its part in the first is shorter
   than its period, so p < a + c and windows of that size are enough.
5. Runs inside a block are copies of those where the block's words were before: buckets by begin, filled from left to
   right, give them.

Null and empty texts have no words and no runs.  Repeated rows are treated alike; ties between runs are settled by begin
and period.  A text is one task's work and takes about 200 bytes of memory a word; batches are worked off in groups of at
most ``GROUP`` words, or one longer text.  Other columns are left alone; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_workers

#: Words of texts whose suffixes are sorted together.
GROUP = 1 << 18
SHORTEST = 12


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of each suffix among all, which end at ``ends`` of their text; no symbol occurs in two texts."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    value = symbols[order]
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(np.diff(value, prepend=-1) != 0, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    reach = 1
    open_ = order[_shared(first)]
    while len(open_):
        ahead = open_ + reach
        follow = np.where(ahead < ends[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old, place = rank[open_], np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.diff(old, prepend=-1) != 0, place, 0))
        first = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        rank[open_] = old + first - group
        open_ = open_[_shared(first)]
        reach *= 2
    return rank


def _shared(first: np.ndarray) -> np.ndarray:
    """Which entries share their value, the place of its first entry, with a neighbour."""
    same = np.diff(first, prepend=-1) == 0
    return same | np.append(same[1:], False)


def alike(symbols: np.ndarray, order: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Which neighbours in the suffix array agree in so many words: places k of ``order`` that do with k - 1."""
    k = np.flatnonzero(symbols[order[1:]] == symbols[order[:-1]]) + 1
    for by in range(1, words):
        a, b = order[k] + by, order[k - 1] + by
        fits = (a < ends[order[k]]) & (b < ends[order[k - 1]])
        k, a, b = k[fits], a[fits], b[fits]
        k = k[symbols[a] == symbols[b]]
    return k


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """LCP of each suffix in ``order`` with the one before it."""
    n = len(s)
    previous = [-1] * n
    for a, b in zip(order, order[1:], strict=False):
        previous[b] = a
    lcp, h = [0] * n, 0
    for i in range(n):
        j = previous[i]
        if j < 0:
            h = 0
            continue
        most = n - max(i, j)
        while h < most and s[i + h] == s[j + h]:
            h += 1
        lcp[i] = h
        if h:
            h -= 1
    return [lcp[i] for i in order]


def previous_factors(order: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """LPF of each place and where it was before (-1 for none): the nearest suffixes on both sides that begin earlier."""
    n = len(order)
    longest, source = [0] * n, [-1] * n
    stack: list[tuple[int, int]] = []  # begin and what it has in common with the one below it
    for i, common in chain(zip(order, lcp, strict=True), ((-1, 0),)):
        # Suffixes that begin later than i are done: below them lies one nearest neighbour, i is the other.
        while stack and stack[-1][0] > i:
            j, below = stack.pop()
            if below >= common:
                longest[j], source[j] = below, stack[-1][0] if below else -1
            else:
                longest[j], source[j] = common, i
            common = min(common, below)
        stack.append((i, common))
    return longest, source


def blocks(longest: list[int]) -> list[int]:
    """Begins of the blocks, and the end of the text."""
    out, at = [0], 0
    while at < len(longest):
        at += max(longest[at], 1)
        out.append(at)
    return out


def overlaps(s: list[int]) -> list[int]:
    """For each place, how many words from there agree with those from 0."""
    n = len(s)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def beside(s: list[int], at: int, before: int, end: int, shortest: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs that touch ``at`` and end at ``end`` or before; ``before`` is the begin of the block that ends at ``at``.

    What the windows cut off ends later or begins in an earlier block, and another block has it.
    """
    n, most = len(s), end - before - 1
    low, high = max(before - most, 0), min(end + 1, n)
    right, left = s[at:high], s[low:at]
    left.reverse()
    # How far the words from ``at`` go on like those from ``at`` - p and ``at`` + p, and the same towards the left.
    whole = s[low:high]
    own = overlaps(right) if right else []
    back = overlaps([*right, -1, *whole])[len(right) + 1 :] if right else []
    mine = overlaps(left) if left else []
    whole.reverse()
    forth = overlaps([*left, -1, *whole])[len(left) + 1 :] if left else []
    a, c = at - low, high - at
    for p in range(1, most + 1):
        spans = []
        if p <= c:  # a period to the right of ``at``
            spans.append((at - (forth[c - p] if left else 0), at + p + (own[p] if p < c else 0)))
        if p <= a:  # a period to the left of it
            spans.append((at - p - (mine[p] if p < a else 0), at + (back[a - p] if right else 0)))
        for i, e in spans:
            if e - i < shortest or e - i < 2 * p or e > end or (i <= low and i > 0):
                continue
            if found.get((i, e), p + 1) > p:
                found[i, e] = p


def runs(s: list[int], order: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``shortest`` words, by start and period."""
    need = (shortest + 1) // 2
    lcp = common_prefixes(s, order)
    longest, source = previous_factors(order, lcp)
    if max(longest, default=0) < need:
        return []
    begins = blocks(longest)
    found: dict[tuple[int, int], int] = {}
    for before, at, end in zip(begins, begins[1:], [*begins[2:], begins[-1]], strict=False):
        if end - before > need:
            beside(s, at, before, end, shortest, found)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (i, e), p in found.items():
        buckets.setdefault(i, []).append((e - i, p))
    for at, end in zip(begins, begins[1:], strict=False):
        if end - at < shortest + 2:
            continue
        moved = at - source[at]
        for i in range(at + 1, end - shortest):
            for length, p in buckets.get(i - moved, ()):
                if i + length < end:
                    buckets.setdefault(i, []).append((length, p))
    return sorted((i, length, p) for i, those in buckets.items() for length, p in set(those))


def runs_of_texts(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not edges[-1]:
        return out
    symbols, used = np.empty(edges[-1], np.int64), 0
    for k, words in enumerate(texts):
        own: dict[bytes, int] = {}
        symbols[edges[k] : edges[k + 1]] = [own.setdefault(w, len(own)) for w in words]
        symbols[edges[k] : edges[k + 1]] += used
        used += len(own)
    ends = np.repeat(edges[1:], sizes)
    rank = suffix_ranks(symbols, ends)
    order = np.empty_like(rank)
    order[rank] = np.arange(len(rank))
    # Texts are intervals of the suffix array too, as their words are numbered one text after the other.
    near = alike(symbols, order, ends, (shortest + 1) // 2)
    for k in np.unique(np.searchsorted(edges, near, "right") - 1).tolist():
        a, b = int(edges[k]), int(edges[k + 1])
        out[k] = runs(symbols[a:b].tolist(), (order[a:b] - a).tolist(), shortest)
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without what any run repeats: each run keeps its first period."""
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def groups(texts: Iterator[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts, in lists of at most ``GROUP`` words or one text."""
    held, n = [], 0
    for text in texts:
        words = (text or b"").split()  # of bytes: at space and 9 to 13 only
        if held and n + len(words) > GROUP:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and the text without what its runs repeat, for every row."""
    for_workers(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column("text").cast(pa.large_binary()), 0
            for texts in groups(column[k].as_py() for k in range(len(column))):
                found = runs_of_texts(texts, shortest)
                arrays = [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"start": a, "length": b, "period": p} for a, b, p in those] for those in found], pa.list_(RUN)),
                    pa.array([collapsed(t, those) for t, those in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """Texts of which every tenth, by a hash of its id, goes on from some word in a cycle; a row without an id keeps its own."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g, words = F.floor(h / 10), words_of(F.col("text"))
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), changed).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns for texts with repeated tails."""
    out = periodic_runs(with_repeated_tails(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("m.start"), F.col("m.length"), -F.col("m.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
