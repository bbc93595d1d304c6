"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A tree's leaves are blocks of up to ``LEAF`` pre-tokens with their characters and tokens; inner nodes hold sums.  An
edit descends to the leaves it touches, re-encodes them with their boundary context and updates the sums on the paths
to the root; the rest of the text isn't looked at.  Two rules give the context:

* a pre-token depends on at most two characters after its end, so encoding starts at the leaf that holds the second
  character before the edit;
* what follows a pre-token boundary doesn't depend on what is before it, so encoding ends at the first old leaf boundary
  after the edit at which the new text has a boundary as well.

Trees are a column (two arrays of leaf sizes), so that a later batch of edits starts from the stored table.  Counts are
those of the whole text encoded anew.  Special tokens' strings are ordinary text.

Null texts are empty and have no tokens; edits beyond the end are cut to the text; edits of one document apply in order
of ``seq``, ties by place, then by what they insert.  Edits of unknown documents are left out.  A document's edits change one text
and so meet in one task; repeated rows of a document each get all edits.  Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepairs import BytePairs, byte_pairs
from .common import for_workers

LEAF = 32
EDIT = "struct<seq:bigint,start:bigint,removed:bigint,inserted:string>"
COUNTED = "n_tokens bigint, n_pieces bigint, leaf_chars array<int>, leaf_tokens array<int>"


class SumTree:
    """Sums of characters and tokens over leaves; an implicit binary tree in two arrays."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.base = 1 << max(len(chars) - 1, 0).bit_length()
        self.leaves = len(chars)
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(chars)] = chars
        self.tokens[self.base : self.base + len(tokens)] = tokens
        for k in range(self.base - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, the last leaf for the end, and where it begins."""
        k, before = 1, 0
        if position >= self.chars[1]:
            return self.leaves - 1, self.chars[1] - self.chars[self.base + self.leaves - 1]
        while k < self.base:
            k *= 2
            if position - before >= self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.base, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.base
        more, extra = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += more
            self.tokens[k] += extra
            k //= 2

    def size(self, leaf: int) -> int:
        return self.chars[self.base + leaf]

    def lists(self) -> tuple[list[int], list[int]]:
        """Sizes of the leaves that hold something."""
        span = slice(self.base, self.base + self.leaves)
        kept = [(c, t) for c, t in zip(self.chars[span], self.tokens[span], strict=True) if c]
        return [c for c, _ in kept], [t for _, t in kept]


class CountedText:
    """A text with its tree.  ``encoded`` counts the pre-tokens that edits made it encode."""

    def __init__(self, pairs: BytePairs, text: str, leaves: tuple[list[int], list[int]] | None = None):
        self.pairs, self.text, self.encoded = pairs, text, 0
        if leaves is None:
            sizes, counts = self._pieces(text)
            self.n_pieces = len(sizes)
            leaves = self._blocks(sizes, counts)
        self.tree = SumTree(*leaves)

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    def _pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the text's pre-tokens."""
        if not text:
            return [], []
        found, counts = self.pairs.counted_pieces(text)
        return list(map(len, found)), counts

    @staticmethod
    def _blocks(sizes: list[int], counts: list[int]) -> tuple[list[int], list[int]]:
        if not sizes:
            return [0], [0]
        starts = np.arange(0, len(sizes), LEAF)
        return np.add.reduceat(sizes, starts).tolist(), np.add.reduceat(counts, starts).tolist()

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` by ``inserted``."""
        start = min(max(start, 0), len(self.text))
        end = min(start + max(removed, 0), len(self.text))
        tree, grown = self.tree, len(inserted) - (end - start)
        first, begin = tree.leaf_at(max(start - 2, 0))
        last, last_begin = tree.leaf_at(max(end - 1, 0))
        last, last_begin = (last, last_begin) if last >= first else (first, begin)
        old_end = last_begin + tree.size(last)
        self.text = self.text[:start] + inserted + self.text[end:]
        while True:
            # One leaf more is read: it shows whether the new text has a boundary where the old leaf ended.
            after, look = last + 1, old_end
            while after < tree.leaves and look < old_end + 2:
                look += tree.size(after)
                after += 1
            sizes, counts = self._pieces(self.text[begin : look + grown])
            self.encoded += len(sizes)
            ends = np.cumsum(sizes)
            cut = int(np.searchsorted(ends, old_end + grown - begin))
            if old_end == look or old_end + grown == begin or (cut < len(ends) and ends[cut] == old_end + grown - begin):
                break
            last, old_end = after - 1, look
        cut = 0 if old_end + grown == begin else len(sizes) if old_end == look else cut + 1
        if cut > 4 * LEAF * (last - first + 1):  # leaves would grow: the tree is built anew from leaf sizes, not from text
            a, b = [tree.size(k) for k in range(first)], [tree.tokens[tree.base + k] for k in range(first)]
            c, d = self._blocks(sizes[:cut], counts[:cut])
            rest = range(last + 1, tree.leaves)
            self.tree = SumTree(a + c + [tree.size(k) for k in rest], b + d + [tree.tokens[tree.base + k] for k in rest])
            return
        room = last - first + 1
        for k in range(room):
            part = slice(cut * k // room, cut * (k + 1) // room)
            tree.put(first + k, sum(sizes[part]), sum(counts[part]))


def counted(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, text, n_tokens, n_pieces and the leaves of each document's tree.  No shuffle."""
    for_workers(docs.sparkSession)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer_file)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                one = CountedText(pairs, text or "")
                out.append((one.tokens, one.n_pieces, *one.tree.lists()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "text", "n_tokens", "n_pieces", "leaf_chars", "leaf_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, {COUNTED}")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with the edits (doc_id, seq, start, removed, inserted) of each document, in order, as a column."""
    mine = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("removed").cast("long").alias("removed"), F.col("inserted").cast("string").alias("inserted")))).alias("edits"))
    return trees.join(mine, "doc_id", "left")


def recounted(trees: DataFrame, tokenizer_file: str) -> DataFrame:
    """Applies the column ``edits`` to ``counted`` documents: the new text, its counts and leaves, and ``n_encoded``."""
    for_workers(trees.sparkSession)
    rows = trees.select("doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", F.col("edits").cast(f"array<{EDIT}>").alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer_file)
        for batch in batches:
            out = []
            for text, chars, tokens, edits in zip(*(batch.column(c).to_pylist() for c in ("text", "leaf_chars", "leaf_tokens", "edits")), strict=True):
                one = CountedText(pairs, text or "", (chars, tokens) if chars else ([0], [0]))
                for e in edits or []:
                    one.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                out.append((one.text, one.tokens, one.encoded, *one.tree.lists()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_tokens", "text", "edited_tokens", "n_encoded", "leaf_chars", "leaf_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, text string, edited_tokens bigint, n_encoded bigint, leaf_chars array<int>, leaf_tokens array<int>")


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each that follow from the text's length: one in the middle, a line break, a new start."""
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda seq, start, removed, inserted: F.struct(F.lit(seq).cast("long").alias("seq"), F.floor(start).alias("start"), F.lit(removed).cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return docs.withColumn("edits", F.array(edit(1, n / 3, 4, " edited"), edit(2, n * 2 / 3, 0, "\n\n"), edit(3, n * 0, 0, "Note: ")))
