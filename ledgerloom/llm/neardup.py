"""Near-duplicate documents: MinHash bands propose, odd sketches pre-select, full shingle sets confirm.

A document's set are its distinct word shingles.  Documents are linked if the Jaccard similarity of their sets is at
least ``SIMILARITY``; components of links are classes.

1.  One pass over the texts gives each set a fingerprint, ``BANDS`` band keys of ``ROWS`` MinHash values each, and an
    odd sketch: the pairs (function, minimum) of all MinHash functions are folded into a parity bitmap.  The
    population count of the XOR of two bitmaps counts the functions on which two sets differ, less what collides, and
    so estimates high similarities closely (Mitzenmacher, Pagh and Pham, 2014).
2.  Documents with equal sets are one class; only one of each goes on.
3.  Members of a bucket are compared with a pivot of the bucket.  Pairs whose set sizes differ too much or whose
    sketches are too far apart go; the full sets decide on the others; components of the links are contracted.  Such
    rounds, each with other pivots, join most of each group.
4.  Buckets that still hold several components are cut into tiles.  Members of two tiles meet in one task: those of
    different components by sizes, by sketch and then by full sets, in numpy over an index of one tile's shingles.  A
    task gives the links that join its components, so that the pairs of a group of copies are never listed.  No bucket
    is capped.

A pair at the threshold shares no bucket with probability (1 - s^ROWS)^BANDS = 3e-6, and its sketches are beyond the
bound with about as much; such a link only matters if no other path joins the two.

Null texts and texts without words have an empty set, are linked with nothing and are their own class.  With fewer
words than a shingle has, the words are one shingle.  Repeated rows of a document each get a row with equal values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_workers, materialise, small_side

SIMILARITY = 0.8
ROWS, BANDS = 5, 32
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
#: Rounds that check members against a pivot of their bucket, at most, and how many pivots of those, the closest by
#: sketch.
LINEAR_ROUNDS, FIRST_PIVOTS = 3, 2
#: Members of a bucket that one task compares with as many others.
TILE = 256


def sketch_limit(similarity: float, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS, sigmas: float = 4.5) -> int:
    """Bits in which the sketches of sets of this similarity differ at most, but for less than one pair in a million."""
    differing = samples * (1 - similarity) + sigmas * np.sqrt(samples * similarity * (1 - similarity))
    mean = bits / 2 * (1 - np.exp(-4 * differing / bits))
    return int(mean + 3 * np.sqrt(mean / 4))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased, words parted by ASCII white space."""
    import xxhash

    if not text:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    found = [digest(w) for w in text.encode().lower().split()]
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(found, dtype=np.uint64)
    n = max(len(h) - size + 1, 1)
    out = np.full(n, len(h) if len(h) < size else size, dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_K = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)
_FACTOR = (_mixed(_K) | np.uint64(1)).astype(np.uint32)
_ADDEND = _mixed(_K << np.uint64(20)).astype(np.uint32)


def minima(found: np.ndarray) -> np.ndarray:
    """The MinHash values of a set: minima of affine functions of its folded hashes."""
    h = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (h[at : at + 2048, None] * _FACTOR + _ADDEND).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def odd_sketches(low: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the pairs (function, minimum), as 64-bit words."""
    bit = (_mixed((_K << np.uint64(32)) | low.astype(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((np.arange(len(low))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(low) * SKETCH_BITS)
    return np.packbits((flat & 1).astype(np.uint8)).view(np.int64).reshape(len(low), SKETCH_WORDS)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint, bands and sketch of each document; the last two null for an empty set."""
    for_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            low = np.array([minima(s) for s in sets], dtype=np.uint32).reshape(-1, ROWS * BANDS)
            empty = np.array([not len(s) for s in sets], dtype=bool)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]

            def lists(rows: np.ndarray, empty=empty) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()), mask=pa.array(empty))

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists(band_keys(low)), lists(odd_sketches(low))], names=["doc_id", "n_shingles", "print", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, print binary, bands array<bigint>, sketch array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    for_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "found"])

    return docs.mapInArrow(run, "doc_id bigint, found array<bigint>")


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for k in range(1, SKETCH_WORDS):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id and the full shingle set of the documents with these ids, one row of each, as a table."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(ids), "doc_id", "left_semi")
    return materialise(full_sets(texts, size).dropDuplicates(["doc_id"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough, compared in Arrow batches."""
    pairs = materialise(pairs, "pairs")
    sets = sets_of(materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids"), docs, size)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y")), "b")
    least = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, first), (y, second) = flat(batch.column("x")), flat(batch.column("y"))
            keep = []
            for a, b, c, d in zip(first, first[1:], second, second[1:], strict=False):
                z = np.sort(np.concatenate((x[a:b], y[c:d])))
                shared = int((z[1:] == z[:-1]).sum())
                keep.append(100 * shared >= least * (len(z) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def flat(lists: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The values of an array of lists, one after the other, and where each list begins and the last one ends."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], (offsets - offsets[0]).tolist()


def linked(table: pa.Table, similarity: float, limit: int | None) -> Iterator[tuple[int, int]]:
    """Links that join all components of a unit which its buckets' members connect; see ``unit_rows``."""
    least = round(100 * similarity)
    names = ("key", "side", "rep", "component")
    key, side, rep, component = (table.column(c).to_numpy() for c in names)
    words, at = flat(table.column("sketch"))
    sketch = words.reshape(len(key), -1).view(np.uint64)
    values, begins = flat(table.column("found"))
    sizes = np.diff(begins)
    order = np.lexsort((side, key))
    for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        b = rows[side[rows] == 1]
        a, b = (rows, rows) if not len(b) else (rows[side[rows] == 0], b)
        label = dict(zip(rows.tolist(), component[rows].tolist(), strict=True))
        of_b = component[b]
        small, large = np.minimum(sizes[a][:, None], sizes[b]), np.maximum(sizes[a][:, None], sizes[b])
        close = (component[a][:, None] != of_b) & (100 * small >= least * large)
        if limit is not None:
            close &= np.bitwise_count(sketch[a][:, None, :] ^ sketch[b]).sum(axis=2, dtype=np.int32) <= limit
        if a is b:
            close = np.triu(close, 1)
        index = owner = None
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            own = label[int(a[i])]
            open_ = np.flatnonzero(close[i] & (of_b != own))
            if not len(open_):
                continue
            if index is None:  # all shingles of the one side in order, with the members that hold them
                index = np.concatenate([values[begins[k] : begins[k + 1]] for k in b.tolist()])
                owner = np.repeat(np.arange(len(b)), sizes[b])
                sorted_ = np.argsort(index, kind="stable")
                index, owner = index[sorted_], owner[sorted_]
            x = values[begins[a[i]] : begins[a[i] + 1]]
            low = np.searchsorted(index, x)
            runs = np.searchsorted(index, x, side="right") - low
            spots = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
            shared = np.bincount(owner[spots], minlength=len(b))[open_]
            hits = open_[100 * shared >= least * (len(x) + sizes[b][open_] - shared)]
            for j in hits.tolist():
                other = int(of_b[j])
                if other != own:  # two components of the unit become one
                    yield int(rep[a[i]]), int(rep[b[j]])
                    of_b = np.where(of_b == other, own, of_b)
                    label = {k: own if c == other else c for k, c in label.items()}


def unit_rows(rows: DataFrame) -> DataFrame:
    """unit, key, side, rep and component: the members of buckets, dealt out so that a unit's comparisons fit one task.

    ``rows``: key, rep, n and component.  A bucket's members are cut into tiles of about ``TILE`` members or of that many
    thousand shingles: a large component of a bucket has tiles of its own, the small ones share theirs.  Each pair of
    tiles that can hold different components is a unit, in which side 0 meets side 1; a tile by itself meets its own
    members.  Buckets of one tile share units, some ``TILE`` members to each.  So a bucket of any size fills as many
    tasks as it has pairs of tiles.
    """
    load = F.sum(1 + F.col("n") / 1024)
    counts = rows.groupBy("key", "component").agg(load.alias("load"))
    counts = counts.withColumn("alone", F.when(F.col("load") >= TILE / 2, F.col("component")))
    per = materialise(counts.groupBy("key", "alone").agg(F.ceil(F.sum("load") / TILE).alias("parts")), "tiles")
    own = per.filter("alone is not null").withColumnRenamed("alone", "component")
    rest = per.filter("alone is null").select("key", F.col("parts").alias("common"))
    placed = rows.join(own, ["key", "component"], "left").join(rest, "key", "left")
    part = F.pmod(F.xxhash64("rep", F.lit("tile")), F.coalesce("parts", "common"))
    placed = placed.select("key", "rep", "component", F.when(F.col("parts").isNotNull(), F.col("component")).alias("alone"), part.alias("part"))
    tile = F.struct(F.col("alone").isNotNull().alias("pure"), F.coalesce("alone", F.lit(0)).alias("of"), "part")
    tiles = per.select("key", "alone", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("key", tile.alias("tile"))
    several = tiles.groupBy("key").count().filter("count > 1").select("key")
    tiles = tiles.join(several, "key")
    two = tiles.select("key", F.col("tile").alias("s")).join(tiles.select("key", F.col("tile").alias("t")), "key")
    meet = (F.col("s") < F.col("t")) & ~(F.col("s.pure") & F.col("t.pure") & (F.col("s.of") == F.col("t.of"))) | ((F.col("s") == F.col("t")) & ~F.col("s.pure"))
    two = two.filter(meet).withColumn("unit", F.xxhash64("key", "s", "t"))
    ends = two.select("key", F.col("s").alias("tile"), F.lit(0).alias("side"), "unit").union(two.filter("s != t").select("key", F.col("t").alias("tile"), F.lit(1).alias("side"), "unit"))
    placed = placed.select("key", "rep", "component", tile.alias("tile"))
    large = placed.join(ends, ["key", "tile"]).select("unit", "key", "side", "rep", "component")
    pools = max(rows.count() // TILE, 1)
    small = placed.join(several, "key", "left_anti").select(F.pmod(F.xxhash64("key"), F.lit(pools)).alias("unit"), "key", F.lit(0).alias("side"), "rep", "component")
    return large.union(small)


def meetings(rows: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: float, limit: int | None) -> DataFrame:
    """Links (a, b) that join what the buckets' members connect: by sizes and sketches, then by full sets."""
    units = materialise(unit_rows(rows), "units")
    ids = materialise(units.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    sets = sets_of(ids, docs, size).withColumnRenamed("doc_id", "rep")
    each = materialise(sets.join(classes.select("rep", "sketch"), "rep"), "sides")

    def run(table: pa.Table) -> pa.Table:
        a, b = zip(*found, strict=True) if (found := list(linked(table, similarity, limit))) else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return units.join(each, "rep").groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, of all nodes of the edges (a, b): large-star and small-star in turn.

    Each round links every neighbour of a node to its smallest neighbour.  The edges never grow in number and end as
    stars; rounds grow with the logarithm of a path's length.  Each round's edges are a table in the shared folder.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    # Stars: every node has one edge to a smaller one or is the end of such edges, never both.
    ends = lambda e: e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    while not ends(edges).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up + down > 1").isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def fits(a: str, b: str, similarity: float, limit: int | None) -> Column:
    """Whether two classes can be similar: their set sizes allow it and their sketches are close enough."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    alike = 100 * small >= round(100 * similarity) * large
    return alike if limit is None else alike & (differing(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) <= limit)


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id is that) of each document.

    ``exact``: members of buckets are proposed by their rarest shingles (``rare_shingles``) and no sketch rejects any, so
    that no link is lost; it explodes every set and is the slow way.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the bands propose pairs of similarity 0.8 or more")
    signed = materialise(signatures(docs, size), "signatures")
    # One of each class of equal sets stands for it: the smallest id.
    found = signed.filter("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = materialise(found.filter("rep is not null"), "classes")
    buckets = rare_shingles(classes, docs, size, similarity) if exact else classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = materialise(buckets.join(shared, "key").select("key", "rep", "n"), "members")
    sketches = classes.select("rep", "n", "sketch")
    limit = None if exact else sketch_limit(similarity)
    components_of = None

    def contracted(links: DataFrame) -> DataFrame:
        edges = links if components_of is None else components_of.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)
        return materialise(components(edges), "components")

    # Linear rounds: members against one pivot of their bucket.  The pivot goes by a hash of the id, so that buckets of
    # the same group have few pivots among them; each round has another hash.  A round more pays while pairs of tiles
    # would repeat the members; it can't change the result.
    rows = members.withColumn("component", F.col("rep"))
    for turn in range(LINEAR_ROUNDS):
        head = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("h"), "rep", "component"))
        pivots = rows.groupBy("key").agg(head.alias("p")).select("key", F.col("p.rep").alias("pivot"), F.col("p.component").alias("own"))
        pairs = rows.join(pivots, "key").filter("component != own").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        a = sketches.select(F.col("rep").alias("a"), F.struct("n", "sketch").alias("x"))
        b = sketches.select(F.col("rep").alias("b"), F.struct("n", "sketch").alias("y"))
        near = pairs.join(a, "a").join(b, "b").filter(fits("x", "y", similarity, limit)).withColumn("far", differing(F.col("x.sketch"), F.col("y.sketch")))
        closest = Window.partitionBy("a").orderBy("far", "b")
        chosen = near.select("a", "b", "far").withColumn("k", F.row_number().over(closest)).filter(F.col("k") <= FIRST_PIVOTS).select("a", "b")
        components_of = contracted(materialise(confirmed(chosen, docs, size, similarity), "links"))
        named = members.join(components_of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        per = named.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
        mixed = materialise(per.agg(F.count("*").alias("kinds"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("square")).filter("kinds > 1").select("key", "n", ((F.col("n") * F.col("n") - F.col("square")) / 2).alias("pairs")), "mixed")
        rows = materialise(named.join(mixed.select("key"), "key"), "rows")
        cost = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if (cost["pairs"] or 0) <= TILE * (cost["n"] or 0):
            break

    merged = contracted(materialise(meetings(rows, classes, docs, size, similarity, limit), "links"))
    top = classes.select("print", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "print").join(top, "print", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def rare_shingles(classes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """rep, n and key: of n shingles, the n - ceil(similarity * n) + 1 that the fewest classes have, ties by hash.

    Two sets that share none of these can't reach the similarity (the prefix filter of set joins), so that keys propose
    every link.
    """
    sets = sets_of(materialise(classes.select(F.col("rep").alias("doc_id")), "ids"), docs, size)
    each = sets.select(F.col("doc_id").alias("rep"), F.size("found").cast("long").alias("n"), F.explode("found").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("often", F.lit(1)), "key"))
    least = F.ceil(F.col("n") * round(100 * similarity) / 100)
    return each.join(often, "key", "left").withColumn("k", rank).filter(F.col("k") <= F.col("n") - least + 1).select("rep", "n", "key")


def first_of_each(docs: DataFrame, size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that a document with a smaller id stands for, and without repeated rows of an id.

    Rows without an id can't be addressed and stay.
    """
    judged = materialise(near_duplicates(docs, size, similarity).filter("doc_id is not null"), "judged")
    gone = judged.filter("not kept").select("doc_id").distinct()
    left = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    twice = materialise(judged.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return left
    once = left.join(small_side(twice), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return left.join(small_side(twice), "doc_id", "left_anti").select(docs.columns).unionByName(once)
