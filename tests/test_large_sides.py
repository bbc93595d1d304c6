"""What large tables need of a plan: no rows of theirs in the driver, and no pairs that aren't asked for."""

from __future__ import annotations

import datetime
import random

import pyarrow as pa

from ledgerloom.functions.money import amount
from ledgerloom.operators import edits, matching
from ledgerloom.plans import consolidate, duplicates, folding

from .test_folding import FLAGS, VALUES, made


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def likeness(x: str, y: str) -> float:
    return (max(len(x), len(y)) - distance(x, y)) / max(len(x), len(y))


def test_names_that_share_their_first_half_don_t_meet(spark):
    names = spark.createDataFrame([(f"blue{n:05d}",) for n in range(0, 60_000, 300)], "t string")
    found = edits.met(edits.segments(names, 0.8), edits.offers(names, 0.8), 0.8)
    assert "Broadcast" not in plan(found)
    # All 200 names share four characters, and would make 40,000 pairs by them.
    assert found.distinct().count() < 2000


def test_one_edit_in_any_place(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abé漢") for _ in range(rng.randint(3, 9))) for _ in range(150)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for threshold in (0.8, 0.85, 0.9):
        ours = {(r["x"], r["y"]) for r in edits.close_texts(df, None, threshold).collect()}
        assert ours == {(x, y) for x in texts for y in texts if x <= y and likeness(x, y) >= threshold}


def test_duplicates_by_days_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    start = datetime.date(2023, 12, 1)
    names = ["gamma steel works", "gamma staal works", "gamma staal warks", "gamma stael wirks", "omega motors", "omega maters", "omaga mators"]

    def some(first):
        for k in range(first, first + 120):
            o = start + datetime.timedelta(rng.randrange(400))
            yield k, "", None, rng.choice(names), o, o + datetime.timedelta(rng.choice([0, 1, 31, 32, 33, 64, 200]) if rng.random() < 0.3 else rng.randrange(8))

    kind = "id int, s string, i string, n string, o date, c date"
    mine, known = list(some(0)), [r for r in some(1000) if r[3] in ("gamma staal warks", "omega maters", "omaga mators")]
    out = duplicates.verdicts(spark.createDataFrame(mine, kind), spark.createDataFrame(known, kind), "id", "s", "i", "n", "o", "c")
    expected = []
    for r in mine:
        found = [(2 if likeness(r[3], k[3]) > 0.85 else 3, -likeness(r[3], k[3]), k[0]) for k in known if likeness(r[3], k[3]) > 0.85 or (likeness(r[3], k[3]) > 0.8 and r[4] <= k[5] and k[4] <= r[5])]
        if found:
            tier, _, match = min(found)
            expected.append((r[0], match, duplicates.VERDICTS[tier]))
    assert {v for _, _, v in expected} == {"NAME", "DATE_OVERLAP"}
    assert sets(out) == sorted(expected, key=repr)
    assert "Broadcast" not in plan(out)


def test_overlaps_are_those_of_all_pairs_and_come_from_lists(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 3, raising=False)
    rng, start = random.Random(11), datetime.date(2023, 12, 1)
    rows = []
    for k in range(160):
        o = start + datetime.timedelta(rng.choice([0, 5, 31, 40, 64]))
        # Some times end before they begin.
        rows.append((k, rng.choice(["blue ring", "blue rings", "red bolt", None]), o, o + datetime.timedelta(rng.choice([-3, 0, 1, 33, 70]))))
    out = matching.overlapping_similar(spark.createDataFrame(rows, "id int, name string, o date, c date"), "id", "name", "o", "c")
    named = [r for r in rows if r[1]]
    expected = [(x[0], y[0]) for x in named for y in named if x[0] < y[0] and likeness(x[1], y[1]) > 0.8 and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, out.collect())) == expected
    # Pairs of rows are made after lists have met and are dealt, not by a join.
    shown = plan(out)
    assert "Broadcast" not in shown and shown.index("Generate explode(q") < shown.index("SortMergeJoin")


def test_records_are_not_dealt_by_their_few_fields(spark):
    records = spark.range(1000).selectExpr("id AS entity", "concat('f', id % 2) AS field", "'NSE' AS source", "concat('₹ ', id) AS value")
    checks = spark.createDataFrame([("f0", "amount", 10.0, None, None, False)], "field string, kind string, low double, high double, pattern string, nullable boolean")
    good = consolidate.prepared(records, checks).filter("valid")
    ruled = consolidate.with_rules(good, consolidate.rule_table(spark, {"a": (("f0", "f1"), ("ADMIN", "NSE"), False, False)}))
    assert "SortMergeJoin" not in plan(ruled)
    # Values of the field that no check names stay as they are.
    assert {(r["plain"], r["rank"]) for r in ruled.collect()} == {(f"{k}.0", 1) for k in range(10, 1000, 2)} | {(f"₹ {k}", 1) for k in range(1, 1000, 2)}
    # The parser takes no part in generated code, of which it would make methods too long for the JVM to compile.
    assert plan(good).count("Generate explode(transform") == 1


def test_amounts_with_and_without_units(spark):
    texts = {"₹ 1,234.50": 1234.5, " 12 Crores": 1.2e8, "2.5 lakhs": 2.5e5, "3 BN": 3e9, "4 m": 4e6, "5k": 5e3, "7 thousand": 7e3, "back 8 times": 8.0, "Rs -9.5": -9.5, "none": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", amount("t").alias("x"), amount("t", large=True).alias("y"))
    found = {r["t"]: (r["x"], r["y"]) for r in df.collect()}
    assert {t: x for t, (x, _) in found.items()} == texts
    assert found["back 8 times"][1] == 8e7 and found["5k"][1] == 5e3


def test_columns_fold_as_one_record_at_a_time():
    rng = random.Random(2)
    for name in FLAGS:
        for _ in range(200):
            records = made(rng, name, rng.randint(1, 40), rng.choice([VALUES, VALUES[:7], VALUES[7:]]))
            batch = pa.RecordBatch.from_pylist([folding.plain(r) for r in records], pa.schema({"value": pa.string(), "number": pa.float64(), "text": pa.string(), "source": pa.string(), "rank": pa.int32(), "at": pa.int64(), "time_based": pa.bool_(), "refresh": pa.bool_()}))
            rows = folding.Columns(batch)
            assert [rows.record(i) for i in range(len(records))] == records
            assert rows.folded(rows.record(0), "FIRST_VALUE", 1, len(records)) == folding.one_by_one(records[0], "FIRST_VALUE", records[1:])
