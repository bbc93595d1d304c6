"""Runs of records against the fold of all records, one at a time."""

from __future__ import annotations

import datetime
import random

import pytest

from ledgerloom.plans import consolidate, folding

RULES = {"p": (("price",), ("ADMIN", "NSE", "BSE"), False, True), "t": (("sub",), ("NSE", "BSE"), True, False), "d": (("lot",), ("BSE", "NSE"), False, False)}
FLAGS = {"price": (False, True, ("ADMIN", "NSE", "BSE")), "sub": (True, False, ("NSE", "BSE")), "lot": (False, False, ("BSE", "NSE"))}


def made(rng, name, n, values):
    time_based, refresh, sources = FLAGS[name]
    out = []
    for _ in range(n):
        source, value = rng.choice([*sources, "OTHER", "NEWS"]), rng.choice(values)
        number = None if value.isalpha() else float(value)
        out.append(folding.Record(value, number, value.strip().lower(), source, sources.index(source) if source in sources else -1, rng.choice([None, *range(20)]), time_based, refresh))
    return out


VALUES = ("100", "100.005", "100.01", "100.015", "100.02", "100.03", "250", "abc", "ABC", "xyz")


@pytest.mark.parametrize("name", FLAGS)
def test_a_run_does_to_any_winner_what_its_records_do(name):
    rng = random.Random(name)
    for _ in range(400):
        records = made(rng, name, rng.randint(0, 25), rng.choice([VALUES, VALUES[:2], ("1", "2")]))
        run = folding.Run()
        for x in records:
            run.add(x)
        for winner in made(rng, name, 12, VALUES):
            assert run.applied(winner, "BEFORE") == folding.one_by_one(winner, "BEFORE", records)


@pytest.mark.parametrize("name", FLAGS)
def test_runs_stay_short(name):
    rng = random.Random(5)
    run, longest = folding.Run(), 0
    for x in made(rng, name, 3000, [f"{k / 100:.2f}" for k in range(10_000, 20_000)]):
        run.add(x)
        longest = max(longest, sum(len(g[0]) for g in run.guards) + len(run.last))
    assert longest <= 40


@pytest.mark.parametrize("held", [0, 3, 1000])
def test_a_part_gives_its_outcome_and_its_run(monkeypatch, held):
    monkeypatch.setattr(folding, "HELD", held)
    rng = random.Random(held)
    for name in FLAGS:
        records, part = made(rng, name, 30, VALUES), folding.Part()
        for x in records:
            part.add(x)
        assert part.outcome() == folding.one_by_one(records[0], "FIRST_VALUE", records[1:])
        for winner in made(rng, name, 12, VALUES):
            assert part.summed().applied(winner, "BEFORE") == folding.one_by_one(winner, "BEFORE", records[1:])


def test_hot_field_over_many_tasks(spark):
    """One field has most records; whatever the number of parts, the outcome is that of the fold in one list."""
    rng = random.Random(11)
    data, start = [], datetime.datetime(2024, 1, 1)
    for k in range(4000):
        entity, name = (1, "price") if k % 3 else (rng.randrange(30), rng.choice(["price", "sub", "lot"]))
        at = None if rng.random() < 0.05 else start + datetime.timedelta(minutes=rng.randrange(5000))
        data.append((entity, name, rng.choice(["ADMIN", "NSE", "BSE", "OTHER"]) if rng.random() < 0.3 else "BSE", rng.choice([*VALUES, None, "7", " 7 "]), at, k))
    df = spark.createDataFrame(data, "entity int, field string, source string, value string, scraped_at timestamp, arrival int")
    records = consolidate.with_rules(df, consolidate.rule_table(spark, RULES))
    want = {tuple(r) for r in consolidate.folded(records).select("entity", "field", "value", "source", "reason").collect()}
    log: list = []
    state: dict = {}
    listed = consolidate.with_rules(df, consolidate.rule_table(spark, RULES)).filter("value IS NOT NULL").orderBy("arrival").collect()
    for r in listed:
        number = None if r["value"].strip().isalpha() else float(r["value"])
        x = folding.Record(r["value"], number, r["value"].strip().lower(), r["source"], r["rank"], r["scraped_at"] and int(r["scraped_at"].timestamp()), r["time_based"], r["refresh"])
        old = state.setdefault((r["entity"], r["field"]), x)
        if not x.alike(old):
            wins, why = x.judged(old)
            log.append((r["arrival"], old.source, old.value, x.source, x.value, x.source if wins else old.source, why))
            state[r["entity"], r["field"]] = x if wins else old
    for parts in (1, 25):
        found = folding.conflict_log(records, parts)
        columns = ("arrival", "existing_source", "existing_value", "source", "value", "chosen_source", "reason")
        assert sorted(map(tuple, found.select(*columns).collect())) == sorted(log)
        out = folding.folded_in_runs(records, parts).select("entity", "field", "value", "source", "reason")
        assert {tuple(r) for r in out.collect()} == want
    assert folding.folded_in_runs(records.limit(0)).count() == 0
