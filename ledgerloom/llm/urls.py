"""URL filter, in DataFrame functions only: host rules first, then a ratio of two character language models.

Rules are a short list the caller keeps; a rule fits its host and all subdomains where the path starts with its path,
and the longest rule that fits decides.

Other URLs are judged by two variable-order Markov models over the characters of host and path, one of accepted and
one of rejected URLs, up to ``ORDER`` characters long, each order smoothed into the next shorter one (Witten and Bell,
1991).  The logarithm of the ratio of both likelihoods is a sum of weights of substrings: a substring seen in training
adds the change of the ratio against its suffix, a context adds what backing off from it costs.  So a URL's score is a
sum over a join of its substrings with one table of weights.  It is divided by the length and compared with a cutoff
that a labelled holdout sets.

Labels: a caller's table of URLs, or by default weak ones: a URL is rejected if a part of its host is one of a few words,
and taken as accepted if its host holds none of them anywhere.  Of these, some are as bad as the rejected ones, only by
other words.  So hosts are dealt into two folds, and each fold is scored by the models of the other one, which have not seen
its hosts.  On these scores the cutoff is calibrated (``calibrated``); accepted URLs below it leave the training
set, and the models that judge are fitted on what is left of both folds.  Every labelled URL is counted, once for each
host and path that differ in more than digits.  Digits count as one character.  Weights are whole millionths, so that sums
don't depend on the order of rows.

Null URLs and those without ``://`` have an empty host and path and are judged by the models like any other text.
Without URLs of both labels everything is allowed that no rule blocks.  Repeated rows get equal values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_side

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Parts of host names, between dots and hyphens, that label a URL as rejected where the caller has no labels: seeds, from
#: which the models learn what else such hosts look like.
REJECTED_WORDS = ("adult", "casino", "escort", "lottery", "pharmacy", "pills", "poker", "porn", "viagra", "xxx")

ORDER = 4
#: Hosts are numbered in the order of their hashes, within so many bits of them at once.
HASH_BITS = 12
SCALE = 1_000_000
#: The share of accepted labels that the cutoff may reject: some of them are as bad as the rejected ones.
MOST_LOST = 0.1
#: Characters a model gives the same chance before it has seen any.
ALPHABET = 64
BEGIN, END = "\x02", "\x03"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    rule = reduce(lambda acc, x: acc.when(x[0], F.lit(x[1][1] + x[1][2])), list(zip(fits, ordered, strict=True))[1:], F.when(fits[0], F.lit(ordered[0][1] + ordered[0][2])))
    verdict = reduce(lambda acc, x: acc.when(x[0], F.lit(x[1][0])), list(zip(fits, ordered, strict=True))[1:], F.when(fits[0], F.lit(ordered[0][0])))
    return rule, verdict


def shape(host: Column, path: Column) -> Column:
    """What the models read: host and path in lower case, digits alike."""
    return F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0")


def substrings(shaped: Column, order: int) -> Column:
    """All substrings of up to ``order`` characters, with marks around the text."""
    text = F.concat(F.lit(BEGIN), shaped, F.lit(END))
    # Each match looks ahead over k characters and moves on by one, so that the work is linear in the text.
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1)) for k in range(1, order + 1)])


def side(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if its rows are few; else merged, as Spark goes by the size of files, which may be far smaller."""
    found = small_side(df)
    return df.hint("merge") if found is df else found


def folded(shapes: DataFrame) -> DataFrame:
    """id, shape, host, rejected and fold of all labelled shapes.

    The hosts of a label alternate between the folds, in the order of their hashes.  They are numbered within the first
    bits of their hashes, of which each takes the count of those before, so that no task holds all hosts.
    """
    labelled = shapes.filter("rejected is not null")
    hosts = labelled.groupBy("host").agg(F.max("rejected").alias("bad")).withColumn("hash", F.xxhash64("host"))
    hosts = materialise(hosts.withColumn("part", F.shiftright("hash", 64 - HASH_BITS)), "hosts")
    counts = hosts.groupBy("bad", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bad").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("before") + F.row_number().over(Window.partitionBy("bad", "part").orderBy("hash", "host"))
    dealt = hosts.join(F.broadcast(counts.select("bad", "part", before.alias("before"))), ["bad", "part"]).select("host", (number % 2).alias("fold"))
    return labelled.join(side(materialise(dealt, "folds")), "host").select("id", "shape", "host", "rejected", "fold")


def fitted(train: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and weight (whole millionths) of both models' ratio; the empty gram has the weight of each character.

    Chances are worked out from the shortest grams to the longest, each from its suffix.
    """
    grams = train.select("rejected", F.explode(substrings(F.col("shape"), order)).alias("gram"))
    counts = materialise(grams.groupBy("gram").agg(F.count_if(~F.col("rejected")).alias("n0"), F.count_if("rejected").alias("n1")), "counts")
    predicted = counts.filter(F.col("gram") != BEGIN).withColumn("size", F.char_length("gram")).withColumn("context", F.expr("left(gram, length(gram) - 1)")).withColumn("suffix", F.expr("substring(gram, 2)"))
    contexts = predicted.groupBy("context").agg(*[f for k in "01" for f in (F.sum(f"n{k}").alias(f"all{k}"), F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}"))])

    def back(k: str) -> Column:  # what is left for the shorter context; all of it where this one was never seen
        return F.when(F.coalesce(f"all{k}", F.lit(0)) > 0, F.col(f"kinds{k}") / (F.col(f"all{k}") + F.col(f"kinds{k}"))).otherwise(F.lit(1.0))

    contexts = materialise(contexts.withColumns({"back0": back("0"), "back1": back("1")}).withColumn("bow", F.log("back0") - F.log("back1")), "contexts")
    predicted = materialise(predicted.join(side(contexts), "context"), "predicted")
    done = None
    for size in range(1, order + 1):
        level = predicted.filter(F.col("size") == size)
        if done is None:
            level = level.withColumns({"s0": F.lit(1 / ALPHABET), "s1": F.lit(1 / ALPHABET)})
        else:
            level = level.join(done.select(F.col("gram").alias("suffix"), F.col("p0").alias("s0"), F.col("p1").alias("s1")).hint("merge"), "suffix")

        def chance(k: str) -> Column:
            return F.when(F.col(f"all{k}") > 0, F.col(f"n{k}") / (F.col(f"all{k}") + F.col(f"kinds{k}"))).otherwise(0.0) + F.col(f"back{k}") * F.col(f"s{k}")

        now = level.withColumns({"p0": chance("0"), "p1": chance("1")})
        part = materialise(now.select("gram", "p0", "p1", (F.log("p0") - F.log("p1") - F.log("s0") + F.log("s1") - F.col("bow")).alias("part")), "level")
        done = part
        every = part.select("gram", "part") if size == 1 else every.union(part.select("gram", "part"))  # noqa: F821
    costs = contexts.select(F.col("context").alias("gram"), F.col("bow").alias("part"))
    return every.union(costs).groupBy("gram").agg(F.round(F.sum("part") * SCALE).cast("long").alias("weight"))


def scored(shapes: DataFrame, weights: DataFrame, order: int = ORDER) -> DataFrame:
    """id and score by character, in millionths, of ``shapes`` (id and shape)."""
    length = (F.char_length("shape") + 1).cast("long")
    grams = shapes.select("id", length.alias("length"), F.explode(substrings(F.col("shape"), order)).alias("gram"))
    each = F.coalesce(F.max(F.when(F.col("gram") == "", F.col("weight"))), F.lit(0))
    step = weights.agg(each.alias("w")).first()["w"]
    sums = grams.join(side(weights), "gram").groupBy("id").agg(F.sum("weight").alias("total"), F.first("length").alias("length"))
    length = F.col("length")
    return sums.select("id", ((F.col("total") + F.lit(step) * length) / length).alias("score"))


def calibrated(marked: DataFrame) -> float | None:
    """The cutoff: the highest that isn't over 0, where both models give the same chance, and under which at most
    ``MOST_LOST`` of the accepted lie, by scores of models that have not seen their hosts.

    Scores are counted in steps of a hundredth, so that only a few sums reach the driver.  None without both labels.
    """
    step = SCALE // 100
    bins = marked.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.count_if(~F.col("rejected")).alias("good"), F.count_if("rejected").alias("bad")).orderBy("bin").collect()
    good, bad = sum(b["good"] for b in bins), sum(b["bad"] for b in bins)
    if not good or not bad:
        return None
    lost = 0
    for b in bins:
        lost += b["good"]
        if b["bin"] >= 0 or lost > MOST_LOST * good:
            return min(b["bin"], 0) * float(step)
    return 0.0


def learnt(labelled: DataFrame, order: int) -> tuple[DataFrame, float | None]:
    """The weights of the models that judge, and the cutoff; None without labels of both kinds in both folds."""
    folds = []
    for fold in (0, 1):
        weights = materialise(fitted(labelled.filter(F.col("fold") != fold), order), "weights")
        folds.append(scored(labelled.filter(F.col("fold") == fold), weights, order))
    marked = materialise(labelled.join(side(materialise(folds[0].union(folds[1]), "scores")), "id"), "marked")
    cutoff = calibrated(marked)
    left = marked if cutoff is None else marked.filter(F.col("rejected") | (F.col("score") >= cutoff))
    return materialise(fitted(left, order), "weights"), cutoff


def judged(pages: DataFrame, rules=RULES, rejected_words=REJECTED_WORDS, order: int = ORDER, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (by character; null where a rule decided) of every row of ``pages``.

    ``labels``: url and rejected (boolean), instead of those by ``rejected_words``.
    """
    host, path = parsed(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "shape": shape(F.col("host"), F.col("path"))})
    shapes = rows.groupBy("shape").agg(F.min("host").alias("host"))
    if labels is None:
        parts = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in rejected_words]))
        shapes = shapes.withColumn("rejected", F.when(parts, True).when(~F.col("host").rlike("|".join(rejected_words)), False))
    else:
        given = labels.select(parsed(F.col("url"))[0].alias("host"), shape(*parsed(F.col("url"))).alias("shape"), "rejected")
        given = given.groupBy("shape").agg(F.min("host").alias("host"), F.max("rejected").alias("rejected"))
        shapes = shapes.withColumn("rejected", F.lit(None).cast("boolean")).unionByName(given).groupBy("shape").agg(F.min("host").alias("host"), F.max("rejected").alias("rejected"))
    shapes = materialise(shapes.withColumn("id", F.monotonically_increasing_id()), "shapes")
    labelled = materialise(folded(shapes.filter(F.col("shape") != "")), "labelled")
    weights, cutoff = learnt(labelled, order)
    scores = materialise(scored(shapes, weights, order).join(shapes.select("id", "shape").hint("merge"), "id").select("shape", "score"), "scores")
    out = rows.join(side(scores), "shape", "left")
    verdict = F.lit("allow") if cutoff is None else F.when(F.col("score") < cutoff, "block").otherwise("allow")
    score = F.when(F.col("ruled").isNull(), F.col("score") / SCALE)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", verdict).alias("verdict"), score.alias("score"))
