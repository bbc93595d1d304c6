"""Fill-in-middle: texts cut between units (lines) into prefix, middle and suffix, and put in another order between marks.

One scan of a byte automaton reads whole Arrow batches.  Its table, built from the marks, knows three things at once: how
many continuation bytes a character still has, whether the next byte begins a unit, and how much of a mark was read.  Each
transition carries what it counts: a character, a unit, a mark.  The scan needs no step for each byte: a byte that leads to
the same state from everywhere settles its place at once, and in the short stretches of other bytes the transitions are
composed by doubling.  It goes over blocks of ``BLOCK`` bytes and hands its state on, so that a text may be of any length.
The counts of each block are kept; the second pass looks the cuts up there and reads only the blocks that hold one.

Null and empty texts have no unit and stay plain, as do texts that hold a mark.  Repeated rows are cut alike, as their ids
are; a null id counts as an empty one.  Bytes that are no UTF-8 count as characters of their own.  Other columns are left
alone.  Nothing is dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_workers

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes that are scanned at once.
BLOCK = 1 << 14
#: What a transition counts.
CHARACTER, UNIT, MARK = 1, 2, 4


class Automaton:
    """``next[state, byte]`` and ``emits[state, byte]`` for the given marks; state 0 is that before a text."""

    def __init__(self, marks: tuple[str, ...]):
        words = [m.encode() for m in marks]
        if not all(words):
            raise ValueError("marks can't be empty")
        # A state: the longest end of what was read that begins a mark, a unit begins next, continuation bytes to come.
        first = (b"", True, 0)
        number, rows, emits, open_ = {first: 0}, [], [], [first]
        for read, fresh, more in open_:
            row, out = [], []
            for byte in range(256):
                goes_on = more > 0 and byte & 0xC0 == 0x80
                tail = read + bytes([byte])
                whole = any(tail.endswith(w) for w in words)
                while tail and not any(w.startswith(tail) for w in words):
                    tail = tail[1:]
                left = more - 1 if goes_on else 1 if byte >> 5 == 6 else 2 if byte >> 4 == 14 else 3 if byte >> 3 == 30 else 0
                state = (tail, byte == 10, left)
                if state not in number:
                    number[state] = len(number)
                    open_.append(state)
                row.append(number[state])
                out.append((0 if goes_on else CHARACTER) | (UNIT if fresh else 0) | (MARK if whole else 0))
            rows.append(row)
            emits.append(out)
        self.next, self.emits = np.array(rows, np.uint8 if len(rows) < 256 else np.int32), np.array(emits, np.uint8)
        #: Whether a byte leads to one state from all states.
        self.settles = (self.next == self.next[0]).all(axis=0)

    def scan(self, data: np.ndarray, starts: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """What each byte counts, and the state after the last; at ``starts`` a text begins."""
        after, known = self.next[0, data], self.settles[data]
        known[starts] = True  # ``after`` has the step from state 0
        rest = np.flatnonzero(~known)
        if len(rest):
            step = self.next[:, data[rest]]  # the transition of each such byte, as a map of states
            alone = np.diff(rest, prepend=-2) != 1
            head = np.maximum.accumulate(np.where(alone, np.arange(len(rest)), 0))
            reach, longest = 1, int((np.arange(len(rest)) - head).max()) + 1
            while reach < longest:  # compose the maps of neighbours, then of pairs, of fours and so on
                later = np.flatnonzero(np.arange(len(rest)) - head >= reach)
                step[:, later] = np.take_along_axis(step[:, later], step[:, later - reach].astype(np.intp), axis=0)
                reach *= 2
            before = rest[head] - 1
            entry = np.where(before >= 0, after[before], state)
            after[rest] = step[entry, np.arange(len(rest))]
        ahead = np.empty_like(after)
        ahead[1:], ahead[0] = after[:-1], state
        ahead[starts] = 0
        return self.emits[ahead, data], int(after[-1])


@lru_cache
def automaton(marks: tuple[str, ...]) -> Automaton:
    return Automaton(marks)


class Scanned:
    """Counted transitions of texts that lie one after the other: before each block, and for each byte."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, marks: tuple[str, ...]):
        """``edges``: begin of each text and the end of the last; empty texts have equal ones."""
        own, state = automaton(marks), 0
        self.edges, self.emitted = edges, np.empty(len(data), np.uint8)
        begins = np.unique(edges[:-1][np.diff(edges) > 0])
        counts = [(0, 0, 0)]
        for at in range(0, len(data), BLOCK):
            end = min(at + BLOCK, len(data))
            a, b = np.searchsorted(begins, (at, end))
            out, state = own.scan(data[at:end], begins[a:b] - at, state)
            self.emitted[at:end] = out
            counts.append(tuple(np.count_nonzero(out & kind) for kind in (CHARACTER, UNIT, MARK)))
        self.counts = np.cumsum(np.array(counts, np.int64), axis=0)

    def before(self, place: int, kind: int) -> int:
        """How many transitions of a kind come before a byte."""
        block = place // BLOCK
        return int(self.counts[block, kind.bit_length() - 1]) + int(np.count_nonzero(self.emitted[block * BLOCK : place] & kind))

    def unit(self, number: int) -> int:
        """The byte at which a unit begins, all texts' units counted from 0; the end of all beyond the last."""
        column = self.counts[:, 1]
        block = int(np.searchsorted(column, number, "right")) - 1
        if block == len(column) - 1:
            return len(self.emitted)
        return block * BLOCK + int(np.flatnonzero(self.emitted[block * BLOCK : (block + 1) * BLOCK] & UNIT)[number - column[block]])


def cut(data: bytes, scanned: Scanned, k: int, numbers: tuple[int, ...], rate: int, spm: int, marks: tuple[str, ...]) -> tuple:
    """n, form, prefix_chars, middle_chars and output of text ``k``."""
    start, end = int(scanned.edges[k]), int(scanned.edges[k + 1])
    units, held = scanned.before(start, UNIT), scanned.before(end, MARK) - scanned.before(start, MARK)
    n = scanned.before(end, UNIT) - units
    h1, h2, h3, h4 = numbers
    if start == end or held or h3 % 100 >= rate:
        return n, "plain", None, None, data[start:end]
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    places = [end if x == n else scanned.unit(units + x) for x in (low, high)]
    chars = [scanned.before(x, CHARACTER) for x in (start, *places)]
    prefix, middle, suffix = data[start : places[0]], data[places[0] : places[1]], data[places[1] : end]
    p, s, m = (x.encode() for x in marks)
    form = "spm" if h4 % 100 < spm else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return n, form, chars[1] - chars[0], chars[2] - chars[1], b"".join(parts)


SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def infilled(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """doc_id, n units, form (plain, psm or spm), characters of prefix and middle, and the output of every text.

    The cuts and the form are drawn by a hash of ``seed`` and the id; ``rate`` per cent are cut, ``spm`` per cent of them
    begin with the suffix.  Mask and order depend on the row alone, so that reruns agree.
    """
    for_workers(docs.sparkSession)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.unhex(F.sha2(key, 256)).alias("drawn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string())
            _, offsets, content = texts.buffers()
            edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(content or b"")[int(edges[0]) : int(edges[-1])]
            edges = edges - edges[0]
            scanned = Scanned(np.frombuffer(data, np.uint8), edges, marks)
            made = [cut(data, scanned, k, struct.unpack(">4I", d[:16]), rate, spm, marks) for k, d in enumerate(batch.column("drawn").to_pylist())]
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
            columns[-1] = columns[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(part.split()[0] for part in SCHEMA.split(", "))])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that an output was made of.  No part of it holds a mark, so that the marks split it."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: hashes of the outputs and of the texts rebuilt from them."""
    out = infilled(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
