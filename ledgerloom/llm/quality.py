"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Features are counted over whole texts.  A document fails the base rules outright if it has few words or repeats many.
The other rules compare a ratio with a cutoff of the document's stratum.  Cutoffs come from labelled documents, of which
those of good quality that aren't toxic are good and all others bad:

* labels are dealt by a hash of the id into a fit half and a holdout half;
* a cutoff of a rule is a candidate if, on the fit half, the share of the bad that it rejects is over ``GAIN`` times the
  share of the good (counted with one more that is lost);
* the fit half also orders a stratum's candidates of all rules, by the good that they lose and then from the lenient to
  the strict; each one adds to what those before reject;
* on the holdout half, these growing sets of rules are tested in order, and testing stops at the first that fails, so
  that no correction for their number is needed (fixed-sequence testing).  A set passes if the exact binomial tail
  P(Bin(n, risk) <= k) is at most ``confidence`` / strata, where k of the n good holdout documents of the stratum are
  rejected by any of its rules: the Clopper-Pearson bound with Bonferroni correction over the strata.

So with probability 1 - ``confidence`` the rules together reject at most ``risk`` of the good documents of every stratum
at once.  That takes n >= log(confidence / strata) / log(1 - risk) good holdout documents even if none is rejected (119
for one stratum, 146 for two, 174 for four at the values here).  Strata with fewer are pooled, with the next larger ones
as long as the pool has too few, and the pool is one stratum of the test; without enough labels in all there is no
cutoff, and what passes the base rules is kept.

Null texts have no words and fail.  Null strata form a stratum.  A document with several labels counts as bad if one
says so; labels without a document or quality count nowhere.  A ratio equal to a cutoff isn't rejected; strata with as
many labels go by name.  Repeated rows get equal values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_side

WINDOW = 5
MIN_WORDS, MAX_REPEAT_HUNDREDTHS = 10, 20
RISK, CONFIDENCE = 0.025, 0.05
GAIN = 10


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Ratio of each rule and its cutoffs, the most lenient first; a document above the cutoff is rejected."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols per word": (F.col("n_symbols") / n, [3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2]),
        "repeated words": (F.col("n_repeat_words") / n, [0.19, 0.17, 0.15, 0.12, 0.1, 0.08]),
        "repeated lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]),
        "long words": (F.col("word_chars") / n, [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0]),
        "short words": (n / F.greatest(F.col("word_chars"), F.lit(1)), [0.9, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3]),
    }


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each document; one pass without a shuffle.

    Words in repeated windows: hashes of all windows; where some repeat, the (hash, place) pairs in order put equal
    windows side by side, and the places of those, in order, cover up to ``WINDOW`` words each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    df = df.withColumn("trimmed", trimmed)
    df = df.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[ \t-\r]+")))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \t-\r]")))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get("hashes", i + (k - 1)) for k in range(WINDOW)]))
    df = df.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    df = df.withColumn("pairs", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, step: F.coalesce(F.get("pairs", i)["h"] == F.get("pairs", i + step)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: same(i, -1) | same(i, 1))
    df = df.withColumn("places", F.when(F.col("pairs").isNotNull(), F.sort_array(F.transform(twice, lambda i: F.get("pairs", i)["i"]))))
    covered = F.aggregate(F.zip_with(F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))), F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("places").isNotNull(), covered).otherwise(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_HUNDREDTHS * F.col("n_words"))
    return df.drop("windows", "pairs", "places").withColumn("base_failed", failed)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact, for k up to n * p; 1 beyond, where it is over a half."""
    from math import log

    step = log(p / (1 - p))
    start = F.struct((n * F.lit(log(1 - p))).alias("term"), F.exp(n * F.lit(log(1 - p))).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(step)
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    return F.when(k > n * p, F.lit(1.0)).when(k < 1, F.exp(n * F.lit(log(1 - p)))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k.cast("long")), start, add, lambda acc: acc["total"]))


def least(tests: Column, risk: float, confidence: float) -> Column:
    """Good holdout documents that a stratum needs so that it can pass at all, if so many strata are tested."""
    return F.log(confidence / tests) / F.log(F.lit(1 - risk))


def pooled(held: DataFrame, risk: float, confidence: float) -> tuple[DataFrame, int]:
    """The strata that are tested by themselves, and the number of tests.

    ``held``: stratum of each good holdout document.  Only strata with enough of these to pass alone are put in order.
    """
    sizes = held.groupBy("stratum").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    able = sizes.filter(F.col("n") >= least(F.lit(1), risk, confidence))
    order = Window.orderBy(F.desc("n"), "stratum")
    able = materialise(able.withColumn("rank", F.row_number().over(order)).withColumn("rest", total - F.sum("n").over(order)), "strata")
    needed = least(F.col("rank") + (F.col("rest") > 0).cast("int"), risk, confidence)
    best = able.filter((F.col("n") >= needed) & ((F.col("rest") == 0) | (F.col("rest") >= needed))).agg(F.max("rank").alias("rank"), F.max_by("rest", "rank").alias("rest")).first()
    alone = best["rank"] or 0
    return able.filter(F.col("rank") <= alone).select("stratum"), alone + (1 if not alone or best["rest"] else 0)


def cutoffs(found: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> tuple[DataFrame, dict[str, float]]:
    """The cutoffs that the labelled holdout allows: stratum and one column per rule of strata tested by themselves, and
    those of the pool by rule."""
    toxic = F.max(F.coalesce("toxic", F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), toxic.alias("toxic")).filter("quality is not null").select("doc_id", ((F.col("quality") >= 1) & (F.col("toxic") < 1)).alias("good"))
    # How many cutoffs of each rule reject the document: as those are in order, it is the strictest ones, and a cutoff
    # rejects it if the number is at least ``need``.
    levels = F.array(*[reduce(lambda a, b: a + b, [(ratio > c).cast("int") for c in cuts]) for ratio, cuts in rules().values()])
    labelled = found.filter("not base_failed").join(good, "doc_id").select("stratum", "good", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1).alias("holdout"), levels.alias("levels"))
    labelled = materialise(labelled, "labelled")
    alone, tests = pooled(labelled.filter("good and holdout").select("stratum"), risk, confidence)
    alone = materialise(alone.select(F.col("stratum").alias("of"), F.lit(True).alias("own")), "alone")
    labelled = labelled.join(small_side(alone), F.col("stratum") == F.col("of"), "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn("of", F.coalesce("of", F.lit("")))

    spark = found.sparkSession
    grid = spark.createDataFrame([(k, name, step + 1, len(cuts) - step, c) for k, (name, (_, cuts)) in enumerate(rules().items()) for step, c in enumerate(cuts)], "which int, rule string, step int, need int, cutoff double")
    counts = labelled.filter("not holdout").select("own", "of", "good", F.posexplode("levels").alias("which", "level")).groupBy("own", "of", "which", "level").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    past = F.col("level") >= F.col("need")
    sums = [f for c in ("good", "bad") for f in (F.sum(c).alias(c), F.sum(F.when(past, F.col(c)).otherwise(0)).alias(f"{c}_out"))]
    steps = counts.join(F.broadcast(grid), "which").groupBy("own", "of", "which", "rule", "step", "need", "cutoff").agg(*sums)
    lost = (F.col("good_out") + 1) / (F.col("good") + 1)
    useful = steps.filter(F.col("bad_out") > GAIN * lost * F.col("bad"))
    turn = F.row_number().over(Window.partitionBy("own", "of").orderBy(F.col("good_out") / F.greatest("good", F.lit(1)), "step", "which"))
    useful = materialise(useful.select("own", "of", "which", "rule", "need", "cutoff", turn.alias("turn")), "useful")

    # The first of its stratum's candidates that rejects each good holdout document.
    lists = useful.groupBy("own", "of").agg(F.collect_list(F.struct("turn", "which", "need")).alias("list"))
    held = labelled.filter("good and holdout").join(small_side(lists), ["own", "of"])
    first = F.array_min(F.transform("list", lambda c: F.when(F.get("levels", c["which"]) >= c["need"], c["turn"])))
    out = held.groupBy("own", "of", first.alias("turn")).agg(F.count("*").alias("k"))
    sizes = out.groupBy("own", "of").agg(F.sum("k").alias("n"))
    in_turn = Window.partitionBy("own", "of").orderBy("turn")
    tested = useful.join(out, ["own", "of", "turn"], "left").join(sizes, ["own", "of"]).withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(in_turn))
    tested = tested.withColumn("safe", binomial_tail(F.col("n"), F.col("k"), risk) <= confidence / tests)
    chosen = tested.withColumn("open", F.min(F.col("safe").cast("int")).over(in_turn)).filter("open = 1")
    wide = materialise(chosen.groupBy("own", "of").agg(*[F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut {name}") for name in rules()]), "cutoffs")
    pool = wide.filter("not own").first()
    own = alone.join(wide.filter("own").drop("own"), "of", "left").drop("own").withColumnRenamed("of", "stratum")
    return own, {name: pool[f"cut {name}"] for name in rules() if pool and pool[f"cut {name}"] is not None}


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """The features of each document with base_failed and kept."""
    found = materialise(features(docs, stratum), "features")
    own, pool = cutoffs(found, labels, risk, confidence)
    own = own.withColumn("own", F.lit(True))
    out = found.join(small_side(own), "stratum", "left")
    cut = lambda name: F.when(F.col("own"), F.col(f"cut {name}")).otherwise(F.lit(pool.get(name)).cast("double"))
    bad = reduce(lambda a, b: a | b, [F.coalesce(ratio > cut(name), F.lit(False)) for name, (ratio, _) in rules().items()])
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("own", *[f"cut {name}" for name in rules()])


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; rows without an id can't be addressed and stay."""
    rejected = materialise(judged(docs, labels).filter("not kept").select("doc_id").distinct(), "rejected")
    return docs.join(small_side(rejected), "doc_id", "left_anti").select(docs.columns)
