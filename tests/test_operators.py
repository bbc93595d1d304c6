"""Operators on small tables: properties, edge cases and sources."""

from __future__ import annotations

import datetime
import itertools
import random

from pyspark.sql import functions as F

from ledgerloom.functions.text import trigram_similarity
from ledgerloom.operators import matching, rows, summaries
from ledgerloom.plans import calendar, consolidate, health, quality, scoring
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import streams


def sets(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_similar_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(["steel", "stel", "bolt", "bolts", "iron", "ironed", "red", "a"]) for _ in range(rng.randint(1, 3))) for _ in range(60)})
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id int, name string")
    for threshold in (0.3, 0.6, 0.9):
        ours = {(r["a"], r["b"]) for r in matching.similar_pairs(df, None, "id", "name", threshold).collect()}
        a, b = df.alias("a"), df.alias("b")
        every = a.join(b, F.col("a.id") < F.col("b.id")).filter(trigram_similarity(F.col("a.name"), F.col("b.name")) >= threshold)
        assert ours == {(r[0], r[1]) for r in every.select("a.id", "b.id").collect()}


def test_similar_pairs_in_any_script(spark):
    names = ["Ελληνική Τράπεζα", "Ελληνικη Τράπεζα", "Εθνική Τράπεζα", "रिलायंस उद्योग", "रिलायंस उद्योग लि", "腾讯控股", "腾讯控股有限", "𝒜𝒷𝒸𝒹", "𝒜𝒷𝒸𝒹 ε", "Ünïted Bänk", "united bank"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for threshold in (0.3, 0.7):
        ours = {(r["a"], r["b"]) for r in matching.similar_pairs(df, None, "id", "name", threshold).collect()}
        a, b = df.alias("a"), df.alias("b")
        every = a.join(b, F.col("a.id") < F.col("b.id")).filter(trigram_similarity(F.col("a.name"), F.col("b.name")) >= threshold)
        assert ours == {(r[0], r[1]) for r in every.select("a.id", "b.id").collect()}
        assert {(0, 1), (3, 4)} <= ours or threshold > 0.5
    same = spark.createDataFrame([(1, "Τράπεζα"), (2, "Τράπεζα")], "id int, name string")
    assert sets(matching.similar_pairs(same, None, "id", "name", 1.0)) == [(1, 2, 1.0)]


def test_edit_pairs_within_a_block(spark):
    left = spark.createDataFrame([(1, "alpha", "x"), (2, "alpha", "y"), (3, "beta", None)], "id int, name string, g string")
    right = spark.createDataFrame([(1, "alphb", "x"), (2, "beta", "y"), (3, "beta", None)], "id int, name string, g string")
    assert sets(matching.edit_pairs(left, right, "id", "name", 0.7, "g").select("a", "b")) == [(1, 1)]


def test_few_pairs_of_names_meet(spark):
    from ledgerloom.operators import edits

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 8)))
    names = sorted({" ".join(word() for _ in range(3)) for _ in range(800)})
    df = spark.createDataFrame([(n,) for n in names], "t string")
    for threshold, most in ((0.75, 0.01), (0.6, 0.03)):
        pairs = edits.met(edits.segments(df, threshold), edits.offers(df, threshold), threshold).filter("x != y")
        assert pairs.select(F.least("x", "y"), F.greatest("x", "y")).distinct().count() < most * len(names) * (len(names) - 1) / 2


def test_tiered_prefers_keys(spark):
    records = spark.createDataFrame([(1, "Acme Ltd"), (2, "Poly-Plast Ltd"), (3, "Zenith Steels"), (4, "Nothing like it")], "id int, name string")
    master = spark.createDataFrame([(10, "ACME Limited"), (20, "Polyplast Limited"), (30, "Zenith Steel")], "mid int, name string")
    out = matching.tiered(records, master, "id", "name", "mid", "name")
    assert sets(out.select("record", "match", "confidence")) == [(1, 10, 90), (2, 20, 85), (3, 30, 75)]


def test_tiered_has_every_tier(spark):
    names = ["Acme & Co Ltd", "Poly-Plast Ltd", "Sterling Solar Power India", "Reliance", "Hexaware", "Sunshine", "Tata Sons", "रिलायंस", "Sol"]
    theirs = ["Acme and Co Limited", "Polyplast Limited", "Mega Sterlings Solarpower", "Relxanxe", "Hezawate", "Sumshime", "Tata Steel", "रिलायन्स", "Solx"]
    records = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    master = spark.createDataFrame([(10 + k, n) for k, n in enumerate(theirs)], "mid int, name string")
    out = matching.tiered(records, master, "id", "name", "mid", "name")
    assert sets(out.select("record", "match", "confidence")) == [(0, 10, 90), (1, 11, 85), (2, 12, 80), (3, 13, 75), (4, 14, 75), (5, 15, 75), (7, 17, 75), (8, 18, 75)]


def test_edit_pairs_are_all_pairs(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    rng = random.Random(3)
    names = ["tcs", "tcsl", "ab", "a", "", "रिलायंस", "रिलायन्स", "reliance", "relxanxe", "sunshine", "sumshime", "aaaaaaaa", "aaaaaaaaaa", "腾讯控股", "腾讯控"]
    names += ["".join(rng.choice("abक") for _ in range(rng.randint(0, 14))) for _ in range(150)]
    left, right = sorted(set(names)), sorted(set(names[::2]))
    for threshold in (0.75, 0.5, 0.9):
        out = matching.edit_pairs(spark.createDataFrame([(n,) for n in left], "n string"), spark.createDataFrame([(n,) for n in right], "n string"), "n", "n", threshold)
        brute = [(a, b) for a in left for b in right if a == b or (max(len(a), len(b)) - distance(a, b)) / max(len(a), len(b)) >= threshold]
        assert sets(out.select("a", "b")) == sorted(brute, key=repr)


def test_overlapping_crosses_buckets(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2024, 1, 1), d(2024, 6, 1), "x"), (2, d(2024, 5, 1), d(2024, 9, 1), "x"), (3, d(2024, 6, 2), d(2024, 6, 2), "x"), (4, d(2024, 5, 5), d(2024, 5, 6), "y")], "id int, s date, e date, g string")
    assert sets(matching.overlapping(df, "id", "s", "e", "g")) == [(1, 2), (2, 3)]


def test_fold_is_what_one_record_at_a_time_gives(spark):
    rules = {"f": (("price",), ("ADMIN", "NSE", "BSE"), False, True), "t": (("sub",), ("NSE", "BSE"), True, False)}
    rng = random.Random(5)
    data = [(e, f, rng.choice(["ADMIN", "NSE", "BSE", "OTHER"]), str(rng.choice([100, 100.004, 101, 250])), datetime.datetime(2024, 1, rng.randint(1, 28)), k) for k, (e, f) in enumerate(itertools.product(range(12), ["price", "sub"] * 4))]
    df = spark.createDataFrame(data, "entity int, field string, source string, value string, scraped_at timestamp, arrival int")
    ours = {(r["entity"], r["field"]): (r["value"], r["source"]) for r in consolidate.folded(consolidate.with_rules(df, consolidate.rule_table(spark, rules))).collect()}
    ranks = {f: {s: k for k, s in enumerate(ss)} for fs, ss, _, _ in rules.values() for f in fs}
    state: dict = {}
    for e, f, s, v, at, _ in data:
        rank, time_based, refresh = ranks[f].get(s, -1), f == "sub", f == "price"
        if (e, f) not in state:
            state[e, f] = (v, s, rank, at)
            continue
        ov, os, orank, oat = state[e, f]
        if abs(float(ov) - float(v)) <= 0.01:
            continue
        if rank != orank:
            wins = rank != -1 and (orank == -1 or rank < orank)
        elif time_based or (os == s and refresh and rank != -1):
            wins = at > oat
        else:
            wins = False
        if wins:
            state[e, f] = (v, s, rank, at)
    assert ours == {k: v[:2] for k, v in state.items()}


def test_canonical_doesn_t_depend_on_order(spark):
    rng = random.Random(1)
    data = [(1, "price", s, str(v), datetime.datetime(2024, 1, d), 0) for s, v, d in (("BSE", 5, 1), ("NSE", 7, 2), ("NSE", 8, 3), ("OTHER", 9, 4))]
    results = set()
    for _ in range(3):
        rng.shuffle(data)
        df = spark.createDataFrame(data, "entity int, field string, source string, value string, scraped_at timestamp, arrival int")
        ruled = consolidate.with_rules(df, consolidate.rule_table(spark, {"p": (("price",), ("NSE", "BSE"), False, False)}))
        results.add(tuple(consolidate.canonical(ruled).first()))
    assert results == {(1, "price", "7", "NSE", 3)}


def test_rows_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, None), (1, None, "b")], "k int, v int, extra string")
    assert sets(rows.latest_per_key(df, ["k"], ["v"]).select("v")) == sets(df.filter("v = 2 OR v IS NULL").select("v"))
    empty = df.limit(0)
    assert rows.latest_per_key(empty, ["k"], ["v"]).count() == 0
    assert rows.page_meta(empty, 1, 10).first()["total_pages"] == 0
    assert summaries.mode(empty, ["k"], "extra").count() == 0
    assert rows.most_complete(empty, ["k"], ["v"], ["extra"]).count() == 0


def test_upsert_writes_a_new_version(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    delta = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    out = writers.upsert(base, delta, ["k"], ["t"], str(tmp_path / "table"))
    assert sets(out) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_insert_absent_and_resume(spark, tmp_path):
    path = str(tmp_path / "series")
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    writers.append(base, path)
    delta = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sets(writers.insert_absent(spark.read.parquet(path), delta, ["k"], path)) == [(1, "a"), (2, "y")]
    assert sets(writers.resumed(delta, base, "k")) == [(2, "y")]


def test_csv_masters_and_report(spark, tmp_path):
    (tmp_path / "main.csv").write_text("SYMBOL, NAME OF COMPANY\nABC, Abc Ltd\n")
    (tmp_path / "sme.csv").write_text("Symbol,Company,ISIN Number\nXYZ,Xyz Ltd,INE000A01010\n")
    out = readers.csv_masters(spark, {"MAIN": str(tmp_path / "main.csv"), "SME": str(tmp_path / "sme.csv")}, {"symbol": ("SYMBOL",), "name": ("NAME OF COMPANY", "Company"), "isin": ("ISIN NUMBER",)})
    assert {tuple(r) for r in out.collect()} == {("ABC", "Abc Ltd", None, "MAIN"), ("XYZ", "Xyz Ltd", "INE000A01010", "SME")}
    writers.csv_report(out, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2


def test_json_records(spark):
    df = spark.createDataFrame([(1, '[{"a": 1}, {"a": 2}]'), (2, '{"data": [{"a": 3}]}'), (3, '{"a": 4}')], "id int, body string")
    assert sets(readers.json_records(df, "body", "struct<a:int>")) == [(1, 1), (1, 2), (2, 3), (3, 4)]


def test_detail_fields(spark):
    html = '<h2>About Acme</h2><p>Makes <b>things</b>.</p><table><tr><td>Lot Size</td><td>1,200 Shares</td></tr><tr><td>Registrar</td><td>Link &amp; Co</td></tr></table>INE123A01016<h3>Objects of the Issue</h3><ul><li>Expansion</li><li>Debt</li></ul><h3>Peer Comparison</h3><table><tr><th>Name</th></tr><tr><td>Zed</td></tr></table>'
    row = readers.detail_fields(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert (row[0]["lot_size"], row[0]["registrar"], row[0]["isin"], row[0]["description"], row[0]["objectives"]) == (1200, "Link & Co", "INE123A01016", "Makes things .", ["Expansion", "Debt"])
    assert row[0]["peers"] == [["Name"], ["Zed"]]
    assert row[1]["lot_size"] is None


def test_feed(spark):
    xml = "<rss><item><title><![CDATA[Acme IPO opens]]></title><link>http://x</link><pubDate>Mon</pubDate></item><item><title>Weather</title></item></rss>"
    items = readers.feed_items(spark.createDataFrame([(1, xml)], "id int, xml string"))
    assert sets(readers.announcements(items).select("title", "link")) == [("Acme IPO opens", "http://x")]


def test_routed(spark):
    good, review = readers.routed(spark.createDataFrame([(1, 80.0), (2, 70.0), (3, None)], "id int, confidence double"))
    assert sets(good.select("id")) == [(1,)] and sets(review.select("id")) == [(2,), (3,)]


def test_record_faults(spark):
    cols = "company_name string, segment string, offering_type string, detected_type string, issue_type string, lot_size int, price_range_min double, price_range_max double, issue_size double, open_date date, close_date date"
    d = datetime.date
    data = [("Good Company Ltd", "MAINBOARD", "IPO", None, None, 100, 100.0, 110.0, 5.0, d(2025, 1, 1), d(2025, 1, 4)), ("SIS", "MAINBOARD", "IPO", None, None, 1, 110.0, 100.0, None, d(2025, 1, 1), d(2025, 3, 1)), ("Cube Highways Trust", "SME", "IPO", "NCD", None, 500, 100.0, 150.0, 0.0, None, None), (None,) * 11]
    out = [sorted(f["rule"] for f in r["faults"]) for r in quality.record_faults(spark.createDataFrame(data, cols)).collect()]
    assert out[0] == []
    assert out[1] == ["IPO_DURATION_LONG", "LOT_SIZE_INVALID", "MIN_INVESTMENT_LOW_MAINBOARD", "NON_IPO_SCRIP_CODE_NAME", "PRICE_BAND_INVERTED"]
    assert "PRICE_BAND_TOO_WIDE_SME" in out[2] and "NON_IPO_TRUST_SHAPE" not in out[2]
    assert out[3] == ["REQUIRED_FIELD_MISSING"]


def test_scores(spark):
    cols = ", ".join(f"{f} double" for f in (*scoring.CONFIDENCE_FIELDS, "price", "industry_pe"))
    full = (100.0, 140.0, 20.0, 35.0, 25.0, 20.0, 2.0, 120.0, 60.0, 60.0, 55.0, 1200.0, 100.0, 20.0)
    out = scoring.score_of_ten(spark.createDataFrame([full, (None,) * 14], cols)).collect()
    assert (out[0]["total"], out[0]["label"], out[0]["confidence"]) == (9.8, "Exceptional (Invest)", 100.0)
    assert (out[1]["total"], out[1]["label"], out[1]["confidence"]) == (0.3, "Poor (Avoid)", 0.0)


def test_weighted_rating(spark):
    cols = "pe_ratio double, eps double, sector string, segment string, issue_size double, qib double, nii double, retail double, total_subscription double, gmp double, previous_gmp double, gmps int, price double, description string"
    out = scoring.weighted_rating(spark.createDataFrame([(10.0, 5.0, "Technology", "MAINBOARD", 1500.0, 12.0, 12.0, 6.0, 60.0, 55.0, 50.0, 3, 100.0, "Market leader, debt free"), (None,) * 14], cols)).collect()
    assert (out[0]["financial_score"], out[0]["market_score"], out[0]["subscription_score"], out[0]["gmp_score"], out[0]["fundamental_score"]) == (85.0, 100.0, 100.0, 100.0, 75.0)
    assert out[1]["rating"] >= 1.0


def test_calendar_single_day_opens_only(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, "A", d(2025, 10, 15), d(2025, 10, 15), d(2025, 10, 22)), (2, "B", d(2025, 9, 29), d(2025, 10, 1), None), (3, "C", None, d(2025, 10, 3), None)], "id int, name string, open_date date, close_date date, listing_date date")
    out = calendar.events(df, F.lit("2025-10-01").cast("date"), F.lit("2025-10-31").cast("date"))
    assert sets(out.select("id", F.dayofmonth("date"), "kind")) == [(1, 15, "OPENING_TODAY"), (1, 22, "LISTING"), (2, 1, "CLOSING_TODAY"), (3, 3, "CLOSING_TODAY")]
    days = calendar.by_day(out, calendar.spine(spark, "2025-10-01", "2025-10-31"))
    assert days.count() == 31


def test_alert_and_parse_health(spark):
    rows_ = spark.createDataFrame([(True, 9, 10, 0.1), (False, 3, 1, 1.0), (False, 0, 10, 0.5), (False, 0, 4, 0.1), (False, 0, None, None)], "c boolean, f int, n int, r double")
    out = [r[0] for r in rows_.select(health.alert(*[F.col(x) for x in "cfnr"])).collect()]
    assert out == [None, "CONSECUTIVE_FAILURES", "LOW_SUCCESS_RATE", None, None]


def test_failure_runs_are_those_of_the_sorted_history(spark):
    rng = random.Random(5)
    history = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *range(40)]), k, rng.choice([True, True, False, None])) for k in range(200)] + [(9, 1, 500, False), (8, 1, 501, True)]
    expected = {}
    for key, _, _, failed in sorted(history, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        expected[key] = 0 if failed is False else expected.get(key, 0) + (failed is True)
    df = spark.createDataFrame(history, "key int, at int, id int, failed boolean")
    out = summaries.failure_runs(df, "key", ["at", "id"], F.col("failed"))
    assert {r["key"]: (r["failures"], r["alarm"]) for r in out.collect()} == {k: (n, n >= 3) for k, n in expected.items()}
    # A success stands behind the failures of its own place.
    tied = spark.createDataFrame([(1, 5, True), (1, 5, False), (1, 6, True)], "key int, at int, failed boolean")
    assert [r["failures"] for r in summaries.failure_runs(tied, "key", ["at"], F.col("failed")).collect()] == [1]
    assert summaries.failure_runs(df.limit(0), "key", ["at"], F.col("failed")).count() == 0


def test_nearest_ranks(spark):
    rng = random.Random(6)
    table = [(rng.choice([None, 1, 2]), rng.choice([None, *range(8)])) for _ in range(90)] + [(5, 3), (6, None)]
    df = spark.createDataFrame(table, "key int, value int")
    for share in (0.0, 0.1, 0.5, 0.99):
        groups = {k: sorted(v for key, v in table if key == k and v is not None) for k, _ in table}
        expected = {k: g[int(len(g) * share)] for k, g in groups.items() if g}
        assert {r["key"]: r["p"] for r in summaries.nearest_ranks(df, ["key"], "value", share, "p").collect()} == expected


def test_pairs_of_nulls_empty_texts_and_repeated_rows(spark):
    names = [(1, "steel bolt"), (2, "steel bolt"), (3, "steel bolts"), (4, ""), (5, None), (6, "..."), (7, "Bolt, steel")]
    df = spark.createDataFrame(names, "id int, name string")
    out = {(r["a"], r["b"]) for r in matching.similar_pairs(df, None, "id", "name", 0.6).collect()}
    assert out == {(1, 2), (1, 3), (2, 3), (1, 7), (2, 7), (3, 7)}
    same = matching.edit_pairs(df, df, "id", "name", 0.9)
    other = matching.edit_pairs(df, df.select("*"), "id", "name", 0.9)
    assert {(1, 2), (2, 1), (1, 1), (1, 3), (3, 1)} <= {(r["a"], r["b"]) for r in same.collect()}
    assert sets(same) == sets(other)
    assert matching.similar_pairs(df.limit(0), None, "id", "name", 0.6).count() == matching.edit_pairs(df.limit(0), df, "id", "name", 0.6).count() == 0


def test_streams_give_batch_results(spark, small):
    s = streams.stream_of(spark, small, "events").select("user_id", "ts", "event_id")
    batch = rows.latest_per_key(spark.read.parquet(f"{small}/events.parquet").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    assert sets(streams.available_now(streams.latest(s, "user_id", ["ts", "event_id"]), "complete").select("user_id", "event_id")) == sets(batch.select("user_id", "event_id"))


def test_sessions(spark, small):
    s = streams.stream_of(spark, small, "events").select("user_id", "ts")
    out = streams.available_now(streams.sessions(s, "user_id", "ts", delay="1 second"), "append")
    assert out.filter("n < 1 OR end <= start").count() == 0


def test_recommended(spark):
    users = spark.createDataFrame([(1, 50, ["x"]), (2, 10, ["y"])], "u int, strength int, sectors array<string>")
    items = spark.createDataFrame([(k, "xy"[k % 2], float(k)) for k in range(20)], "i int, sector string, score double")
    out = scoring.recommended(users, items, "u", "i", "sector", "score", 4)
    assert sets(out.select("u", "i", "rank")) == sorted([(1, 16, 3), (1, 17, 4), (1, 18, 1), (1, 19, 2), (2, 16, 4), (2, 17, 3), (2, 18, 2), (2, 19, 1)], key=repr)


def test_by_dates(spark):
    kind = "id int, name string, o string, c string"
    day = lambda df: df.withColumns({x: F.to_date(x) for x in "oc"})
    records = day(spark.createDataFrame([(1, "alpha", "2025-01-01", "2025-01-03"), (2, "alphb", "2025-02-01", "2025-02-03"), (3, "zzzzz", "2025-02-01", "2025-02-03"), (4, "near", "2025-03-02", "2025-03-05"), (5, "none", None, "2025-03-05"), (6, "two", "2025-04-02", "2025-04-05")], kind))
    master = day(spark.createDataFrame([(11, "other", "2025-01-01", "2025-01-03"), (12, "alpha", "2025-02-01", "2025-02-03"), (13, "alpha", "2025-02-01", "2025-02-03"), (14, "x", "2025-03-03", "2025-03-05"), (15, "y", "2025-03-01", "2025-03-05"), (16, None, "2025-04-01", "2025-04-05"), (17, "w", "2025-04-01", "2025-04-05"), (18, "v", "2025-04-03", "2025-04-05")], kind))
    # Equal names: the smaller id.  Several rows a day before don't count; the single one a day after does.
    assert sets(matching.by_dates(records, master, "id", "id", "o", "c", "name")) == [(1, 11, "DATES"), (2, 12, "NAME"), (4, 15, "NEAR"), (6, 18, "NEAR")]
    assert matching.by_dates(records.limit(0), master, "id", "id", "o", "c", "name").count() == 0


def test_overlapping_similar(spark):
    rows_ = [(1, "sunrise foods", "2025-01-01", "2025-03-20"), (2, "sunrise food", "2025-03-20", "2025-03-21"), (3, "sunrise foods", "2025-03-21", "2025-03-22"), (4, "moonlight", "2025-01-01", "2025-12-31"), (5, None, "2025-01-01", "2025-12-31")]
    df = spark.createDataFrame(rows_, "id int, name string, o string, c string").withColumns({x: F.to_date(x) for x in "oc"})
    assert sets(matching.overlapping_similar(df, "id", "name", "o", "c")) == [(1, 2), (2, 3)]


def test_enriched(spark):
    records = spark.createDataFrame([(1, "Sunrise Foods Ltd"), (2, "Sunrise Food"), (3, "Elsewhere"), (4, None)], "id int, name string")
    master = spark.createDataFrame([("Sunrise Foods", 7), ("SUNRISE FOODS LIMITED", 5), ("Unlike", 1), (None, 2)], "title string, lot int")
    assert sets(matching.enriched(records, master, "id", "name", "title", "lot")) == [(1, "sunrise foods", 5), (2, "sunrise foods", 5)]


def test_versions_of_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, parent int")
    kept, orphans = writers.split_unmatched(df, "parent")
    assert (sets(kept), sets(orphans)) == ([(1, 10), (3, 30)], [(2, None)])
    assert sets(writers.retained(df, "id", F.lit(1), str(tmp_path))) == sets(df.filter("id > 1"))
    writers.refreshed(spark, "offers_now", kept, str(tmp_path))
    before = spark.table("offers_now")
    writers.refreshed(spark, "offers_now", orphans, str(tmp_path))  # readers of the version before are left alone
    assert (sets(before), sets(spark.table("offers_now"))) == (sets(kept), sets(orphans))


def test_observed(spark, small):
    seen = []
    streams.observed(streams.stream_of(spark, small, "events"), lambda batch, epoch: seen.append(batch.count()))
    assert sum(seen) == spark.read.parquet(f"{small}/events.parquet").count()


def test_verdicts_on_duplicates(spark):
    from ledgerloom.plans import duplicates

    kind = "id int, s string, i string, n string, o string, c string"
    day = lambda df: df.withColumns({x: F.to_date(x) for x in "oc"})
    known = day(spark.createDataFrame([(10, "ABC", None, "Alpha Motors", "2024-01-01", "2024-01-05"), (9, "ABC", "INE1", "Gamma Steel Works", "2024-03-01", "2024-05-20"), (8, "", None, "Gamma Steel Works", None, None), (7, None, "", None, "2024-01-01", "2024-01-02")], kind))
    mine = day(spark.createDataFrame([(1, "ABC", "INE1", "x", None, None), (2, "", "INE1", "x", None, None), (3, None, None, "Alpha Motor", None, None), (4, None, None, "Gamma Stael Warks", "2024-05-20", "2024-06-01"), (5, None, None, "Gamma Staal Warks", "2024-05-19", "2024-06-01"), (6, None, None, "Gamma Staal Warks", "2024-05-21", "2024-06-01"), (7, "", "", "", "2024-01-01", "2024-01-02"), (8, None, None, None, None, None)], kind))
    out = duplicates.verdicts(mine, known, "id", "s", "i", "n", "o", "c")
    assert sets(out) == [(1, 9, "SYMBOL"), (2, 9, "ISIN"), (3, 10, "NAME"), (4, 8, "NAME"), (5, 9, "DATE_OVERLAP")]
    assert duplicates.verdicts(mine.limit(0), known, "id", "s", "i", "n", "o", "c").count() == 0


def test_tables_nested_broken_and_quoted(spark):
    pages = [
        (1, "<p>Peer companies</p><table><tr><td>a<table><tr><td>x</td></tr></table>b</td><td title='1>0'>c &amp; d</td></tr></table><table><tr><td>z</td></tr></table>"),
        (2, "<table><tr><td>before</table>PEER<TABLE><TR><TH>h<TD>i<TR><TD>j"),
        (3, "Peer <!-- <table><tr><td>no</td></tr></table> --> <table><tr></tr><tr><td></td></tr></table>"),
        (4, "no heading <table><tr><td>a</td></tr></table>"),
        (5, "Peer <table <tr><td a='x>1 < 2</td></tr></table>"),
        (6, None),
        (7, "Peer" + "<!-- " * 20_000),
        (8, "Peer<table>" + "<tr><td title=\"" * 20_000),
    ]
    df = spark.createDataFrame(pages, "id int, html string")
    out = {r["id"]: r["t"] for r in df.select("id", readers.table_rows(F.col("html"), "Peer").alias("t")).collect()}
    assert out[1] == [["a x b", "c & d"]] and out[2] == [["h", "i"], ["j"]] and out[3] == [[""]]
    assert out[4] == [] and out[6] in (None, []) and out[7] == [] and len(out[8]) <= 20_000


def test_feeds_of_all_kinds(spark):
    feeds = [
        (1, "<rss><channel><item><title>One</title><link>l?a=1&amp;b=2</link></item></channel></rss>"),
        (2, "<rss><channel><item><title><![CDATA[IPO & <b>x</b>]]></title></item><item><description>d</description><pubDate>Mon</pubDate></item></channel></rss>"),
        (3, "<rss><channel><item><title>cut & bare</title></item><item><title>lost"),
        (4, "<rss><channel></channel></rss>"),
        (5, ""),
        (6, None),
    ]
    out = sets(readers.feed_items(spark.createDataFrame(feeds, "id int, xml string")))
    assert out == [(1, "One", "l?a=1&b=2", None, None), (2, "IPO & x", None, None, None), (2, None, None, "d", "Mon"), (3, "cut & bare", None, None, None)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 a")
    (tmp_path / "b.txt").write_bytes(b"no")
    out = readers.binary_files(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]*)$", 1), F.col("content").cast("string"), "length")
    assert sets(out) == [("a.pdf", "%PDF-1.4 a", 10)]


def test_parents_with_their_latest_child(spark):
    parents = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    children = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "a"), (9, 1, "x"), (None, 3, "n")], "parent int, t int, v string")
    out = rows.with_latest_child(parents, children, "id", "parent", ["t", "v"])
    assert sets(out.select("id", "v")) == sorted([(1, "b"), (2, None), (None, None)], key=repr)
