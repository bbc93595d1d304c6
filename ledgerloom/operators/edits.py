"""Pairs of texts with few edits between them: exact for any threshold, length and script, without meeting all pairs.

The longer text of a pair, of L characters, allows d edits.  It is cut into m segments.  With d + 1 segments one stays
whole.  With d // 2 + 1 one has at most one edit, and these are more than twice as long.  The first are taken where they
have at least ``WHOLE`` characters, the second otherwise: at a threshold of 0.6 or 0.75 names would else be cut into pieces
of two or three letters that most names hold.

A segment with one edit is found by what is left of it without one character: if the edit puts another character in its
place, the part of the shorter text is as long and leaves the same without its character at that place; if it takes a
character away, the part is what is left; if it adds one, the part without one of its inner characters is the segment.
The shorter text offers this for the widths that texts from its length up to the longest similar one are cut into.  Pairs
meet on width, kind of edit and what is left.  They then must fit in their lengths and places: a part that stands D
characters later than the segment, in a text that is G shorter, takes |D| edits before it and |G + D| after it.  Only then
are the edits counted, no further than d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edit_similarity
from ..sources.shared import written

#: Segments of at least so many characters are looked for whole.
WHOLE = 4
#: Texts of at most so many characters that allow one edit are met by what is left of them without one character.
SPELT = 40


def allowed(size: Column, threshold: float) -> Column:
    """Edits between a text of this length and a shorter one."""
    return F.floor(size * (1 - threshold) + 1e-9).cast("int")


def layout(size: Column, threshold: float) -> Column:
    """Of a longer text: ``slack``, the edits that a segment may have (0 or 1), and the number of ``parts``."""
    most = allowed(size, threshold)
    exact = (most == 0) | ((F.floor(size / (most + 1)) >= WHOLE) & ~((most == 1) & (size <= SPELT)))
    return F.struct(F.when(exact, 0).otherwise(1).alias("slack"), F.when(exact, most + 1).otherwise(F.floor(most / 2).cast("int") + 1).alias("parts"))


def left_of(part: Column, first: int, last: Column, length: Column) -> Column:
    """(at, rest) for each place from ``first`` to ``last``: a part of this length without the character there."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i >= first) & (i <= last))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.concat(F.left(part, i - 1), F.substring(part, i + 1, length)).alias("rest")))


#: Kinds of edit, and what the place of a missing character is for those that don't fix it.
SAME, OTHER, LESS, MORE = 0, 1, 2, 3
ANY = 0


def keyed(kind: int, found: Column) -> Column:
    """(kind, at, rest) of (at, rest) or of plain rests."""
    return F.transform(found, lambda r: F.struct(F.lit(kind).alias("kind"), r["at"].alias("at"), r["rest"].alias("rest")))


def anywhere(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda r: F.struct(F.lit(ANY).alias("at"), r["rest"].alias("rest"))))


def whole(part: Column) -> Column:
    return F.array(F.struct(F.lit(ANY).alias("at"), part.alias("rest")))


def segments(texts: DataFrame, threshold: float, *within: str) -> DataFrame:
    """Keys of texts ``t`` as the longer ones: width, kind, at and rest, and where the segment begins."""
    size = F.length("t")
    rows = texts.select(*within, F.col("t"), size.alias("size"), layout(size, threshold).alias("cut"))
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("cut.parts") - 1)))
    edge = lambda k: F.floor(k * F.col("size") / F.col("cut.parts")).cast("int")
    rows = rows.select(*within, "t", "size", F.col("cut.slack").alias("slack"), edge(F.col("place")).alias("start"), (edge(F.col("place") + 1) - edge(F.col("place"))).alias("width"))
    part, w = F.substring("t", F.col("start") + 1, F.col("width")), F.col("width")
    one = left_of(part, 1, w, w)
    near = F.when(F.col("slack") == 0, keyed(SAME, whole(part))).otherwise(F.concat(keyed(OTHER, one), keyed(LESS, anywhere(one)), keyed(MORE, whole(part))))
    return rows.withColumn("key", F.explode(near)).select(*within, "t", "size", "start", "width", "key.*")


def offers(texts: DataFrame, threshold: float, *within: str) -> DataFrame:
    """Keys of texts ``t`` as the shorter ones, for all lengths of the longer; the same columns as ``segments``."""
    own = F.length("t")

    def widths(size: Column) -> Column:
        cut = layout(size, threshold)
        low = F.floor(size / cut["parts"]).cast("int")
        one = lambda w: F.struct(cut["slack"].alias("slack"), w.alias("width"))
        return F.when(size % cut["parts"] == 0, F.array(one(low))).otherwise(F.array(one(low), one(low + 1)))

    longest = F.floor(own / threshold + 1e-9).cast("int")
    shapes = F.array_distinct(F.flatten(F.transform(F.sequence(own, longest), widths)))
    rows = texts.select(*within, "t", own.alias("size"), F.explode(shapes).alias("shape")).select(*within, "t", "size", "shape.*")
    # With an edit, parts may be a character shorter.
    last = F.col("size") - F.col("width") + F.col("slack")
    rows = rows.filter(last >= 0).withColumn("start", F.explode(F.sequence(F.lit(0), last)))
    part = lambda n: F.substring("t", F.col("start") + 1, n)
    w, fits = F.col("width"), lambda n: F.col("start") + n <= F.col("size")
    # A character more at the segment's ends lies outside it, so that only inner ones are left out.
    other = F.when(fits(w), keyed(OTHER, left_of(part(w), 1, w, w)))
    more = F.when(fits(w + 1), keyed(MORE, anywhere(left_of(part(w + 1), 2, w, w + 1))))
    none = F.array().cast("array<struct<kind:int,at:int,rest:string>>")
    near = F.concat(F.coalesce(other, none), keyed(LESS, whole(part(w - 1))), F.coalesce(more, none))
    rows = rows.withColumn("key", F.explode(F.when(F.col("slack") == 0, keyed(SAME, whole(part(w)))).otherwise(near)))
    return rows.select(*within, "t", "size", "start", "width", "key.*")


def met(longer: DataFrame, shorter: DataFrame, threshold: float, *within: str, equal: bool = True) -> DataFrame:
    """x, the longer, y, and ``most`` edits, of keys that agree in lengths and places; pairs as often as they meet."""
    a, b = longer.alias("a"), shorter.alias("b")
    gap, moved, most = F.col("a.size") - F.col("b.size"), F.col("b.start") - F.col("a.start"), allowed(F.col("a.size"), threshold)
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("width", "kind", "at", "rest", *within)]
    fits = (gap >= 0 if equal else gap > 0) & (F.abs(moved) + F.abs(gap + moved) <= most)
    # Where segment and part are equal, they meet without their first character only.
    missing = lambda side: F.substring(F.col(f"{side}.t"), F.col(f"{side}.start") + F.col(f"{side}.at"), F.lit(1))
    once = (F.col("a.at") <= 1) | (missing("a") != missing("b"))
    joined = a.join(b.hint("merge"), on).filter(fits & once)
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in within], F.col("a.t").alias("x"), F.col("b.t").alias("y"), most.alias("most"))


def close_texts(left: DataFrame, right: DataFrame | None, threshold: float, *within: str) -> DataFrame:
    """(within, x, y, similarity) of distinct texts ``t`` with at least so much edit similarity, above zero.

    x is of ``left``, y of ``right`` with the same values of ``within``; without ``right`` both are of ``left`` and x <= y.
    Null and empty texts have no pairs but that of two empty ones.
    """

    def texts(df: DataFrame) -> DataFrame:
        # The files are few and small, what is made of their rows is not.
        made = written(df.select(*within, "t").filter("t is not null").distinct(), "texts")
        return made.repartition(2 * made.sparkSession.sparkContext.defaultParallelism)

    mine = texts(left)
    theirs = mine if right is None else texts(right)
    pairs = met(segments(mine, threshold, *within), offers(theirs, threshold, *within), threshold, *within)
    if right is not None:
        other = met(segments(theirs, threshold, *within), offers(mine, threshold, *within), threshold, *within, equal=False)
        pairs = pairs.union(other.select(*within, "y", "x", "most"))
    pairs = pairs.filter(F.expr("levenshtein(x, y, most) >= 0"))
    if right is None:
        pairs = pairs.select(*within, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = pairs.select(*within, "x", "y").distinct()
    return pairs.withColumn("similarity", edit_similarity(F.col("x"), F.col("y"))).filter(F.col("similarity") >= threshold)
