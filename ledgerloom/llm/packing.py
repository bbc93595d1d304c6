"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens, its documents one after the other.  Every window of ``width`` tokens takes from each
queue what its target share has earned; what a queue has earned but not been given in whole tokens - its deficit -
carries to the next window.  As the credit of a queue after t windows is known without running the first t, a task
places the documents it has without looking at others: the deficits carry across windows and across partitions.  When
a queue runs dry, its share goes to the others in proportion; the schedule is then a list of segments, each with fixed
shares and a window of its own where queues end.

Steps: tokenise once into a table (ids in 16 bits, with a running count per source within the task's rows); add up the
counts per task and source with windows over those few sums; plan the segments from the totals per queue; cut each
document at its windows.  Sources with less than one token a window share one queue, so there are never more than
``width`` queues whatever the number of sources, and what the driver sees is bounded by that.  In the shared queue the
documents take turns by the same principle, in closed form as well: each stands where its source has delivered as large a
part of its tokens as all the others, so that any stretch of the queue holds these sources by their shares, up to a
document.  Parts of that queue are ranges of these fractions, which are spread evenly whatever the sources' sizes.

Null or empty texts have one token, the end mark 0.  Null sources form a source.  Repeated rows are packed as often as
they occur.  Other columns are left alone.  Nothing is dropped; only the last windows can be short.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytepairs import byte_pairs
from .common import for_workers, materialise, small_side

WIDTH = 1024
SCALE = 1 << 30
END = 0
#: Shares of sources in production: tokens to this power.
TEMPER = 0.7


@dataclass
class Segment:
    """Windows ``first`` to ``first + count``: of t windows, queues up to k together take t * width * share[k] / SCALE."""

    first: int
    count: int
    shares: list[int]  # running sums over all queues, in SCALE parts
    given: list[int]  # tokens of each queue before this segment
    exact: list[int] | None = None  # tokens of each queue in a segment of one window

    def upto(self, t: np.ndarray, queue: int, width: int) -> np.ndarray:
        """Tokens of the queues up to ``queue`` in the first t windows of the segment."""
        if queue < 0:
            return np.zeros_like(t)
        if self.exact is not None:
            return t * sum(self.exact[: queue + 1])
        high, low = t >> 30, (t & (SCALE - 1)) * self.shares[queue]  # so that products fit for any number of windows
        return (high * self.shares[queue] + (low >> 30)) * width + ((low & (SCALE - 1)) * width >> 30)


def plan(totals: list[int], targets: list[float], width: int = WIDTH) -> list[Segment]:
    """The segments that serve ``totals`` tokens per queue at ``targets`` shares until all queues are dry."""
    left, first, segments = list(totals), 0, []
    while any(left):
        live = [max(t, 1e-12) if n else 0.0 for n, t in zip(left, targets, strict=True)]
        running = np.cumsum(live)
        shares = [int(x) for x in np.floor(running / running[-1] * SCALE)]
        if sum(left) <= width:
            segments.append(Segment(first, 1, shares, [a - b for a, b in zip(totals, left, strict=True)], list(left)))
            break
        own = [b - a for a, b in zip([0, *shares], shares, strict=False)]
        # A queue gets at most a token more than its share of t windows; so many windows leave none of them short.
        count = min(((n - 2) * SCALE) // (w * width) if w else (n - 2) * SCALE for n, w in zip(left, own, strict=True) if n)
        given = [a - b for a, b in zip(totals, left, strict=True)]
        if count > 0:
            s = Segment(first, count, shares, given)
            t = np.array([count])
            ends = [0, *(int(s.upto(t, k, width)[0]) for k in range(len(left)))]
            left = [n - (b - a) for n, a, b in zip(left, ends, ends[1:], strict=False)]
        else:  # some queue ends within this window: it gives what it has, the others fill up
            want = np.array(own, dtype=float) * width / SCALE
            exact = [min(n, int(w)) for n, w in zip(left, want, strict=True)]
            for k in sorted(range(len(left)), key=lambda k: left[k]):
                more = min(left[k] - exact[k], width - sum(exact))
                exact[k] += more
            s = Segment(first, 1, shares, given, exact)
            left = [n - x for n, x in zip(left, exact, strict=True)]
        segments.append(s)
        first += s.count
    return segments


def served(segments: list[Segment], queue: int, width: int = WIDTH) -> tuple[list[int], list[int]]:
    """Of each segment, the tokens of a queue before it and in it."""
    last = segments[-1]
    end = np.array([last.count])
    given = [s.given[queue] for s in segments]
    total = given[-1] + int((last.upto(end, queue, width) - last.upto(end, queue - 1, width))[0])
    return given, [b - a for a, b in zip(given, [*given[1:], total], strict=True)]


def place(segments: list[Segment], queue: int, start: int, length: int, width: int = WIDTH, spans: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens [start, start + length) of a queue go: begin of each piece from start, its window, its offset there.

    ``spans``: what ``served`` gives for the queue, where many documents are placed.
    """
    begins, windows, offsets = [], [], []
    given, wholes = spans or served(segments, queue, width)
    # Sources of other sizes than their shares run dry at different times: only the segments in question are looked at.
    for k in range(max(bisect_right(given, start) - 1, 0), bisect_left(given, start + length)):
        s, whole = segments[k], wholes[k]
        low, high = max(start - s.given[queue], 0), min(start + length - s.given[queue], whole)
        if low >= high:
            continue
        per = whole / s.count
        if per >= 1:  # the windows around both ends, one more on either side for rounding, and all between
            t = np.arange(max(int((low - 2) / per) - 1, 0), min(int((high + 2) / per) + 2, s.count))
        else:  # many windows have no token of the queue: those of each token, by halving
            token = np.arange(low, high)
            t, end = np.zeros_like(token), np.full_like(token, s.count)
            while (t + 1 < end).any():
                middle = (t + end) >> 1
                later = s.upto(middle, queue, width) - s.upto(middle, queue - 1, width) <= token
                t, end = np.where(later, middle, t), np.where(later, end, middle)
            t = np.unique(t)
        before, after = s.upto(t, queue - 1, width), s.upto(t + 1, queue - 1, width)
        own, until = s.upto(t, queue, width) - before, s.upto(t + 1, queue, width) - after
        a, b = np.maximum(own, low), np.minimum(until, high)
        use = np.flatnonzero(a < b)
        begins.append(a[use] + s.given[queue] - start)
        windows.append(s.first + t[use])
        offsets.append((after - before)[use] + a[use] - own[use])
    if len(begins) == 1:
        return begins[0], windows[0], offsets[0]
    return np.concatenate(begins), np.concatenate(windows), np.concatenate(offsets)


def tokenised(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Columns id, source, ids (16 bit each, with the end mark), n, task and before: tokens of the source ahead in the task."""
    for_workers(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(tokenizer_file)
        ahead: dict[str, int] = {}
        for batch in batches:
            sources = batch.column("source").to_pylist()
            ids = [x + b"\0\0" for x in own.encode_batch([t or "" for t in batch.column("text").to_pylist()])]
            sizes, before = [len(x) >> 1 for x in ids], []
            for s, n in zip(sources, sizes, strict=True):
                before.append(ahead.get(s, 0))
                ahead[s] = before[-1] + n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("task"), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(before, pa.int64())], names=["doc_id", "source", "task", "ids", "n", "before"])

    return rows.mapInArrow(run, "doc_id bigint, source string, task int, ids binary, n bigint, before bigint")


def in_turn(tokens: DataFrame, begins: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    """Rows of the sources in ``begins`` with their ``start`` in a queue that serves all these sources by their shares.

    A document stands at the fraction of its source's tokens that a point inside it has; the point is drawn by the source,
    so that sources of a single document are spread out too.
    """
    point = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)
    own = begins.join(totals, "source").select("source", "task", "begin", "total", point.alias("point"))
    at = (F.col("begin") + F.col("before") + F.col("n") * F.col("point")) / F.col("total")
    places = tokens.select("source", "task", "before", "n").join(small_side(own), ["source", "task"])
    places = materialise(places.select("source", "task", "before", "n", at.alias("at")).withColumn("part", F.floor(F.col("at") * parts)), "turns")
    ahead = places.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("at", "source", "task", "before").rowsBetween(Window.unboundedPreceding, -1))
    starts = places.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(ahead), "part")
    starts = materialise(starts.select("source", "task", "before", (F.col("ahead") + F.col("within")).alias("start")), "starts")
    return tokens.join(small_side(starts), ["source", "task", "before"]).select("doc_id", "ids", "n", "start")


def pack(docs: DataFrame, tokenizer_file: str, targets: dict[str, float] | None = None, width: int = WIDTH, temper: float = 1.0) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    ``targets``: shares of sources that each window aims at.  Sources that it doesn't name share what is left, their part
    of all tokens at least, by their tokens to the power of ``temper``: 1 gives natural shares, less lets small sources
    come earlier.
    """
    tokens = materialise(tokenised(docs, tokenizer_file), "tokens")
    sums = tokens.groupBy("source", "task").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    grand = totals.agg(F.sum("total").alias("t")).first()["t"] or 0
    named = dict(targets or {})
    # Only sources with a token in every window have a queue of their own: at most ``width`` of them.
    # Shares that the caller names are the caller's list.
    large = {r["source"]: r["total"] for r in totals.filter((F.col("total") * width >= grand) | F.col("source").isin([*named])).collect()}
    names = sorted(large)
    rest = grand - sum(large.values())
    weight = lambda n: (n / grand) ** temper if n else 0.0
    open_ = sum(weight(n) for s, n in large.items() if s not in named) + weight(rest)
    left = max(1.0 - sum(named.get(s, 0.0) for s in large), (grand - sum(n for s, n in large.items() if s in named)) / max(grand, 1))
    share = lambda n: left * weight(n) / open_ if n else 0.0
    queue_totals = [large[s] for s in names] + [rest]
    queue_targets = [named[s] if s in named else share(large[s]) for s in names] + [share(rest)]
    segments = plan(queue_totals, queue_targets, width)
    spark = docs.sparkSession
    numbered = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)) or [("", 0)], "source string, queue int")
    # Where each task's share of a source starts: what the source has in tasks before it.
    sums = sums.withColumn("begin", F.sum("n").over(Window.partitionBy("source").orderBy("task")) - F.col("n")).drop("n")
    begins = materialise(sums, "begins")
    ordered = begins.join(F.broadcast(numbered), "source")
    rows = tokens.join(small_side(ordered), ["source", "task"]).select("doc_id", "ids", "n", "queue", (F.col("begin") + F.col("before")).alias("start"))
    if rest:
        shared = in_turn(tokens, begins.join(F.broadcast(numbered), "source", "left_anti"), totals, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.unionByName(shared.withColumn("queue", F.lit(len(names))).select(*rows.columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = lru_cache(None)(lambda queue: served(segments, queue, width))
        for batch in batches:
            which, starts, lengths, sums_, windows, offsets = [], [], [], [], [], []
            for k, (ids, n, queue, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "n", "queue", "start")), strict=True)):
                begin, window, offset = place(segments, queue, start, n, width, spans(queue))
                wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4")).cast("B")
                edges = (np.append(begin, n) * 4).tolist()
                which.append(np.full(len(begin), k))
                starts.append(begin)
                lengths.append(np.diff(np.append(begin, n)))
                windows.append(window)
                offsets.append(offset)
                sums_ += [zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            if not which:
                continue
            of = pa.array(np.concatenate(which))
            columns = [batch.column("doc_id").take(of), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (starts, lengths)), pa.array(sums_, pa.int64()), batch.column("n").take(of), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (windows, offsets))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
