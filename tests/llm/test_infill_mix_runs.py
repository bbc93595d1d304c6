"""Fill-in-middle, mixing and periodic runs against plain Python, on the smallest tables and on hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import infill, mixing, periods, queries
from tests.llm import brute

#: Nulls, empty, long and repeated texts and ids, marks, runs of one word; the other columns clash with names used inside.
HARD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n\x0b\r", "a"),
    (4, "word", "b"),
    (5, "the quick brown fox jumps over the lazy dog\n" * 3000, "b"),
    (6, "same text\nin two rows\n", "b"),
    (6, "same text\nin two rows\n", "b"),
    (None, "a text\n\nwithout an id", "c"),
    (8, "Ünï çødé\n日本語\n\U0001f600\x00 zero", None),
    (9, "x" * 40_000, "c"),
    (10, "it says <P> in here\nand goes on", "d"),
    (11, "nearly <P and <S\n> and <M <<M\n" * 3, "d"),
    (20, "na " * 5000, "d"),
    (21, "a b " * 6 + "a", "e"),
]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id bigint, text string, source string")
    clash = ("n", "form", "drawn", "output", "size", "place", "cell", "docs", "words", "hash", "part", "range", "of", "lam", "runs", "start", "collapsed", "n_words", "_taken", "h", "target")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


def sorted_rows(rows):
    return sorted(rows, key=repr)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 11 fill-in-middle

INFILL = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_infill_of_the_query(spark, small):
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text")
    assert sorted_rows(rows_of(queries.op11_fill_in_middle(spark, small), *INFILL)) == sorted_rows((i, *brute.infilled(i, t)) for i, t in docs)


def test_infill_of_hard_rows(spark, hard):
    want = sorted_rows((i, *brute.infilled(i, t)) for i, t, _ in HARD)
    assert sorted_rows(rows_of(infill.digests(hard), *INFILL)) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert infill.digests(hard.limit(0)).count() == 0


def test_infill_by_rates_and_other_marks(spark, hard):
    marks = ("<pre>", "<suf>", "[mid]")
    out = infill.infilled(hard, seed=3, rate=60, spm=0, marks=marks).withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in out} == {"plain", "psm"}
    assert sorted(map(repr, (r["back"] for r in out))) == sorted(map(repr, (t or "" for _, t, _ in HARD)))
    with pytest.raises(ValueError):
        infill.Automaton(("<P>", ""))


@pytest.mark.parametrize("block", [5, 64, 1 << 14])
def test_scan_hands_its_state_on(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK", block)
    rng = random.Random(block)
    parts = ["a", "\n", "\n\n", "é", "日本", "🙂", "<", "<P", "<S>", "P>", "PPPSSM", "<<P", "M", "\r", "\0", " word "]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 0, 1, 3, 10, 60]))) for _ in range(30)]
        raw = [t.encode() for t in texts]
        data, edges = b"".join(raw), np.cumsum([0, *map(len, raw)])
        scanned = infill.Scanned(np.frombuffer(data, np.uint8), edges, infill.MARKS)
        for k, t in enumerate(texts):
            numbers = struct.unpack(">4I", hashlib.sha256(f"7:{k}".encode()).digest()[:16])
            n, form, a, b, output = infill.cut(data, scanned, k, numbers, 100, 50, infill.MARKS)
            assert (n, form, a, b, brute.sha(output.decode())) == brute.infilled(k, t)[:5]


def test_bytes_that_are_no_text():
    data = b"\xff\x80<P\xe6\x97>\n\xf0\x9f"
    scanned = infill.Scanned(np.frombuffer(data, np.uint8), np.array([0, len(data)]), infill.MARKS)
    # \xff, \x80, <, P, \xe6 with \x97, >, \n and \xf0 with \x9f
    assert [scanned.before(len(data), kind) for kind in (infill.CHARACTER, infill.UNIT, infill.MARK)] == [8, 2, 0]


# 12 mixing


def test_mix_of_the_query(spark, small):
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text", "source")
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t, _ in docs}
    targets = brute.targets(docs)
    out = queries.op12_mix_sources(spark, small).collect()
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == sizes[r["doc_id"]] and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
    of = {i: s for i, _, s in docs}
    for r in out:
        assert (r["source_size"], pytest.approx(r["target"])) == (targets[of[r["doc_id"]]][0], targets[of[r["doc_id"]]][1])
        taken[of[r["doc_id"]]] += r["taken"]
    assert len(out) == len(docs) and all(abs(taken[s] - t) <= max(0.02 * t, 20) for s, (_, t) in targets.items())
    again = queries.op12_mix_sources(spark, small)
    assert sorted_rows(map(tuple, again.select(*out[0].asDict()).collect())) == sorted_rows(map(tuple, out))


def test_rates_are_the_tilt_that_meets_the_target(spark):
    rng = random.Random(8)
    docs = [(k, "w " * rng.choice([1, 2, 3, 10, 40, 41, 42, 300, 900]), rng.choice("abcdef")) for k in range(400)]
    out = mixing.mixed(spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)).collect()
    by_source = defaultdict(list)
    for r in out:
        by_source[r["target"], r["source_size"]].append((r["size"], r["rate"]))
    for (target, _), rows in by_source.items():
        scale = sum(n * n for n, _ in rows) / sum(n for n, _ in rows)
        lam = brute.multiplier([n for n, _ in rows], target, scale)
        assert all(rate == pytest.approx(min(3.0, math.exp(lam * n / scale)), rel=1e-4, abs=1e-6) for n, rate in rows)


def test_cells_are_split_by_hash(spark, monkeypatch):
    """One source holds most rows, all of one size: which get a copy more doesn't depend on partitions."""
    monkeypatch.setattr(mixing, "PART", 50)
    docs = [(k, "one two three", "hot") for k in range(1500)] + [(5000 + k, "four five " * (k % 9), "b") for k in range(200)] + [(7000 + k, "x", None) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    first, second = (sorted_rows(rows_of(mixing.mixed(df.repartition(n)), "doc_id", "target", "copies")) for n in (3, 7))
    assert first == second
    hot = [r for r in first if r[0] < 1500]
    assert abs(sum(3 * r[2] for r in hot) - hot[0][1]) <= 3 and {r[2] for r in hot} == {0, 1}


def test_mix_of_hard_rows(spark, hard):
    out = mixing.mixed(hard).collect()
    targets = brute.targets(HARD)
    assert len(out) == len(HARD) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    wanted = sorted((len(brute.WORD.findall(t or "")), *targets[s]) for _, t, s in HARD)
    assert sorted((r["size"], r["source_size"], r["target"]) for r in out) == [(a, b, pytest.approx(c)) for a, b, c in wanted]
    assert mixing.mixed(hard.limit(0)).count() == 0
    blank = mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mixed(hard, share=4.0)


def test_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, "e", "y"), (3, "f g", "x")], "doc_id bigint, text string, source string")
    mix = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id bigint, copies bigint")
    assert sorted(r["doc_id"] for r in mixing.repeated(docs, mix).collect()) == [1, 1, 3]
    assert mixing.repeated(docs, mix).columns == docs.columns


# 13 periodic runs


def made_words(rng, kinds, n):
    s = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if s:
            a, at = rng.randrange(len(s)), rng.randrange(len(s))
            s[at:at] = s[a : a + rng.randint(1, 25)] * rng.randint(1, 4)
    return [b"%d" % x for x in s]


def test_runs_equal_all_periods_tried():
    rng, found = random.Random(6), 0
    for _ in range(250):
        texts = [made_words(rng, rng.choice([1, 2, 2, 3, 5, 26]), rng.choice([0, 1, 5, 12, 13, 30, 60, 120])) for _ in range(rng.randint(1, 6))]
        for shortest in (12, 2, 5):
            for text, got in zip(texts, periods.runs_of_texts(texts, shortest), strict=True):
                assert got == brute.runs(text, shortest)
                found += len(got)
    assert found > 5000
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(12):  # Fibonacci words are full of runs
        a, b = b, b + a
    assert periods.runs_of_texts([b], 2)[0] == brute.runs(b, 2)


def test_long_runs_take_linear_time():
    one = [[b"a"] * 100_000, [b"%d" % (k % 7919) for k in range(100_000)]]
    assert periods.runs_of_texts(one) == [[(0, 100_000, 1)], [(0, 100_000, 7919)]]


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_the_query(spark, small, monkeypatch):
    docs = rows_of(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text")
    want = sorted_rows((i, *brute.run_row(i, t)) for i, t in docs)
    assert sorted_rows(rows_of(queries.op13_periodic_runs(spark, small), *RUNS)) == want
    assert sum(r[1] for r in want) > 10


def test_runs_of_hard_rows(spark, hard):
    want = sorted_rows((i, *brute.run_row(i, t)) for i, t, _ in HARD)
    assert sorted_rows(rows_of(periods.digests(hard), *RUNS)) == want
    out = {r["doc_id"]: r for r in periods.periodic_runs(hard).collect()}
    assert [tuple(x) for x in out[20]["runs"]] == [(0, 5000, 1)] and out[20]["collapsed"] == "na"
    assert [tuple(x) for x in out[21]["runs"]] == [(0, 13, 2)] and out[21]["collapsed"] == "a b"
    assert out[1]["runs"] == [] and out[1]["collapsed"] == "" and periods.digests(hard.limit(0)).count() == 0


def test_every_tenth_id_has_a_repeated_tail(spark):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:20]
    text = " ".join(f"w{k}" for k in range(97))
    docs = spark.createDataFrame([(k, text) for k in [*ids, 1]], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"].split(" ") for r in periods.with_repeated_tails(docs).collect()}
    assert all(got[k] == brute.tailed(k, text.split(" ")) for k in got) and len({tuple(x) for x in got.values()}) > 10
