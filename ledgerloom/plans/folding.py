"""The order-dependent fold of field values, in pieces that tasks work out by themselves.

A store that sees one record at a time judges each against the winner so far.  What a run of records does to any incoming
winner can be said in short: the first record that beats it decides, as from there on the winner doesn't matter any more.
A ``Run`` is that list of records, its guards, each with what its win leads to at the end of the run; and the last records,
which give the reason under which a winner that no guard beats is kept.  Guards that lead to the same end are pruned: a
record is not needed if others of at least its rank and time beat whatever it beats, and two values that no third is
equivalent to suffice for that.  So a run stays short, whatever its length, and runs are put together in order.

Records are sorted by range over entity, field and arrival.  A hot field lies in many tasks, each of which makes one run of
its part; a field's runs, one for each task that holds some of it, are then applied one after the other.  Only a task's
first and last field can go on in another task, so that the others need no run: they are folded over a batch's columns, and
no record is made but those that win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ship, written
from .consolidate import TOLERANCE, severity

#: No two numbers so far apart are equivalent to a third one.
APART = 2 * TOLERANCE + 1e-6


@dataclass(slots=True)
class Record:
    """``number`` and ``text``: the value as a number, if it is one, and in small letters; ``rank``: -1 if unlisted."""

    value: str
    number: float | None
    text: str
    source: str
    rank: int
    at: int | None
    time_based: bool
    refresh: bool

    def alike(self, other: Record) -> bool:
        if self.number is not None and other.number is not None:
            return abs(self.number - other.number) <= TOLERANCE
        return self.text == other.text

    def separate(self, other: Record) -> bool:
        """Whether no value is equivalent to both."""
        if self.number is not None and other.number is not None:
            return abs(self.number - other.number) > APART
        return self.text != other.text

    def judged(self, old: Record) -> tuple[bool, str]:
        """Whether this one wins over the older one, and the reason."""
        if self.rank != old.rank:
            return self.rank != -1 and (old.rank == -1 or self.rank < old.rank), "SOURCE_PRIORITY"
        newer = self.at is None or old.at is None or self.at > old.at
        if self.time_based:
            return newer, "TIME_BASED_PRIORITY" if newer else "TIME_BASED_PRIORITY_EXISTING_NEWER"
        if self.source == old.source and self.rank != -1 and self.refresh:
            return newer, "SAME_SOURCE_REFRESH" if newer else "SAME_SOURCE_REFRESH_EXISTING_NEWER"
        return False, "DEFAULT_KEEP_EXISTING"

    def outdoes(self, other: Record) -> bool:
        """Whether this one beats every winner that the other beats, but for winners of this one's own value."""
        if self.rank != other.rank:
            return self.rank != -1 and (other.rank == -1 or self.rank < other.rank)
        timeless = not (self.time_based or (self.refresh and self.rank != -1))
        return timeless or self.at is None or (other.at is not None and self.at >= other.at)


@dataclass
class Run:
    #: (records, winner, reason): who is beaten by one of the records, and by none of those before, ends with the winner;
    #: without a reason, it is that of the record's win.
    guards: list[tuple[list[Record], Record, str | None]] = field(default_factory=list)
    last: list[Record] = field(default_factory=list)

    def idle(self, x: Record) -> bool:
        """Whether a record changes no guard and adds none, as nearly all records of a long run."""
        for _, winner, reason in self.guards:
            if not x.alike(winner):
                wins, why = x.judged(winner)
                if wins or why != reason:
                    return False
        if x.rank == -1 and not x.time_based:
            return True
        better: list[Record] = []
        for those, _, _ in self.guards:
            for a in those:
                if a.outdoes(x):
                    if (a.number, a.text) == (x.number, x.text) or any(a.separate(b) for b in better):
                        return True
                    better.append(a)
        return False

    def add(self, x: Record) -> None:
        """The run with one record more."""
        if not self.idle(x):
            self.guarded(x)
        last = [x]
        for y in self.last:
            if any(a.separate(b) for k, a in enumerate(last) for b in last[:k]):
                break
            if (y.number, y.text) not in {(z.number, z.text) for z in last}:
                last.append(y)
        self.last = last

    def guarded(self, x: Record) -> None:
        guards: list[tuple[list[Record], Record, str | None]] = []
        for those, winner, reason in self.guards:
            if not x.alike(winner):
                wins, why = x.judged(winner)
                winner, reason = (x, why) if wins else (winner, why)
            if guards and guards[-1][1] is winner and guards[-1][2] == reason:
                guards[-1] = (pruned([*guards[-1][0], *those], []), winner, reason)
            else:
                guards.append((those, winner, reason))
        # Unlisted sources beat nobody, but by time.
        if x.rank != -1 or x.time_based:
            before = [g for those, _, _ in guards for g in those]
            if kept := pruned([x], before):
                guards.append((kept, x, None))
        self.guards = guards

    def applied(self, old: Record, reason: str) -> tuple[Record, str]:
        """What becomes of a winner and the reason it is kept for."""
        for those, winner, why in self.guards:
            for g in those:
                if not g.alike(old):
                    wins, own = g.judged(old)
                    if wins:
                        return winner, why or own
        for x in self.last:
            if not x.alike(old):
                return old, x.judged(old)[1]
        return old, reason


def pruned(those: list[Record], before: list[Record]) -> list[Record]:
    """Records without those that the others, or those ``before``, make needless."""
    kept = list(those)
    for g in those:
        better = [a for a in (*before, *kept) if a is not g and a.outdoes(g)]
        same = any((a.number, a.text) == (g.number, g.text) for a in better)
        if same or any(a.separate(b) for k, a in enumerate(better) for b in better[:k]):
            kept.remove(g)
    return kept


def one_by_one(winner: Record, reason: str, records: list[Record]) -> tuple[Record, str]:
    for x in records:
        if not x.alike(winner):
            wins, why = x.judged(winner)
            winner, reason = (x, why) if wins else (winner, why)
    return winner, reason


class Columns:
    """Records as columns, of which values and texts are read only where they are needed."""

    __slots__ = ("value", "number", "text", "source", "rank", "at", "time_based", "refresh")

    def __init__(self, batch: pa.RecordBatch) -> None:
        plain = lambda c: c.to_numpy(zero_copy_only=False).tolist() if c.null_count == 0 else c.to_pylist()
        self.value, self.text = batch.column("value"), batch.column("text")
        for name in ("number", "rank", "at", "time_based", "refresh"):
            setattr(self, name, plain(batch.column(name)))
        coded = batch.column("source").dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.source = [None if k is None else names[k] for k in plain(coded.indices)]

    def record(self, i: int) -> Record:
        return Record(self.value[i].as_py(), self.number[i], self.text[i].as_py(), self.source[i], self.rank[i], self.at[i], self.time_based[i], self.refresh[i])

    def folded(self, winner: Record, reason: str, start: int, end: int) -> tuple[Record, str]:
        """What ``one_by_one`` gives for the records from ``start`` to before ``end``."""
        number, rank, at, source, time_based, refresh = self.number, self.rank, self.at, self.source, self.time_based, self.refresh
        own, best, since, by, said = winner.number, winner.rank, winner.at, winner.source, winner.text
        won = -1
        for i in range(start, end):
            x = number[i]
            if x is None or own is None:
                if self.text[i].as_py() == said:
                    continue
            elif abs(x - own) <= TOLERANCE:
                continue
            r = rank[i]
            if r != best:
                reason = "SOURCE_PRIORITY"
                if r == -1 or (best != -1 and r > best):
                    continue
            else:
                newer = at[i] is None or since is None or at[i] > since
                if time_based[i]:
                    reason = "TIME_BASED_PRIORITY" if newer else "TIME_BASED_PRIORITY_EXISTING_NEWER"
                elif r != -1 and refresh[i] and source[i] == by:
                    reason = "SAME_SOURCE_REFRESH" if newer else "SAME_SOURCE_REFRESH_EXISTING_NEWER"
                else:
                    newer, reason = False, "DEFAULT_KEEP_EXISTING"
                if not newer:
                    continue
            won, own, best, since, by, said = i, x, r, at[i], source[i], self.text[i].as_py()
        return (winner if won < 0 else self.record(won)), reason


#: Records of a field that are held as they are, before a run is made of them.
HELD = 1000


class Part:
    """What a task has of one field."""

    def __init__(self) -> None:
        self.first: Record | None = None
        self.held: list[Record] = []
        self.run: Run | None = None

    def add(self, x: Record) -> None:
        if self.first is None:
            self.first = x
        elif self.run is not None:
            self.run.add(x)
        else:
            self.held.append(x)
            if len(self.held) > HELD:
                self.summed()

    def summed(self) -> Run:
        if self.run is None:
            self.run = Run()
            for x in self.held:
                self.run.add(x)
            self.held = []
        return self.run

    def outcome(self) -> tuple[Record, str]:
        """What the part gives by itself."""
        if self.run is not None:
            return self.run.applied(self.first, "FIRST_VALUE")
        return one_by_one(self.first, "FIRST_VALUE", self.held)


RECORD = "value string, number double, text string, source string, rank int, at bigint, time_based boolean, refresh boolean"
NAMES = [part.split()[0] for part in RECORD.split(", ")]


def plain(r: Record) -> dict:
    return {n: getattr(r, n) for n in NAMES}


ORDER = ["entity", "field", "arrival", "source", "value"]


def comparable(records: DataFrame) -> DataFrame:
    """What the fold needs of records; those without a value don't take part."""
    compared = F.col("plain") if "plain" in records.columns else F.col("value")
    known = records.filter(F.col("value").isNotNull() & compared.isNotNull())
    return known.select("entity", "field", "arrival", "value", compared.try_cast("double").alias("number"), F.lower(F.trim(compared)).alias("text"), "source", "rank", F.unix_micros(F.col("scraped_at").cast("timestamp")).alias("at"), "time_based", "refresh")


def dealt(records: DataFrame, parts: int | None = None) -> DataFrame:
    by = comparable(records)
    if "plain" in records.columns:
        # Dealing by range goes through all rows twice, which normalising is too dear for.
        by = written(by, "plain")
    return by.repartitionByRange(parts, *ORDER) if parts else by.repartitionByRange(*ORDER)


def folded_in_runs(records: DataFrame, parts: int | None = None) -> DataFrame:
    """(entity, field, value, source, reason): records in the order of their arrival, each against the winner so far.

    Records need entity, field, source, value, scraped_at, arrival, rank, time_based and refresh, as ``with_rules`` gives
    them, and may have ``plain``, the normalised value that is compared.  Null values don't take part; arrivals of a field
    must differ, or equal ones are taken in the order of source and value.
    """
    found = outcomes(dealt(records, parts).sortWithinPartitions(*ORDER).withColumn("task", F.spark_partition_id()))
    single, several = found
    return single.unionByName(several.filter("is_last").select(*single.columns))


def outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What fields come to: those that lie in one task, and a row for each task of the others.

    ``rows``: sorted by task and ``ORDER``, with ``task``.  The rows of several tasks have the winner and reason before
    them (``entry``, null for the first) and after them, and whether they are the field's last.
    """
    spark = rows.sparkSession
    ship(spark)
    key = f"entity {rows.schema['entity'].dataType.simpleString()}, field {rows.schema['field'].dataType.simpleString()}"

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        # The field whose records the next batch may go on with, and whether it is the task's first.
        waiting: tuple[tuple, Part] | None = None
        edge = True

        def row_of(key: tuple, part: Part, run: bool) -> tuple:
            return (*key, part.first if run else None, part.summed() if run else Run(), *part.outcome())

        for batch in batches:
            rows, starts = Columns(batch), fields_of(batch)
            keys = [tuple(batch.column(c)[i].as_py() for c in ("task", "entity", "field")) for i in starts]
            for k, (key, start, end) in enumerate(zip(keys, starts, [*starts[1:], batch.num_rows], strict=True)):
                if waiting and waiting[0] != key:
                    last = key[0] != waiting[0][0]
                    out.append(row_of(*waiting, edge or last))
                    waiting, edge = None, last
                if waiting is None and not edge and k + 1 < len(keys) and keys[k + 1][0] == key[0]:
                    # Fields between a task's first and last lie in it as a whole: their outcome is enough.
                    out.append((*key, None, Run(), *rows.folded(rows.record(start), "FIRST_VALUE", start + 1, end)))
                    continue
                waiting = waiting or (key, Part())
                for i in range(start, end):
                    waiting[1].add(rows.record(i))
            if len(out) >= 1000:
                yield packed(out, batch_types)
                out = []
        if waiting:
            out.append(row_of(*waiting, True))
        if out:
            yield packed(out, batch_types)

    record = f"struct<{struct_type(RECORD)}>"
    schema = f"task int, {key}, first {record}, guards array<struct<those:array<{record}>,winner:{record},reason:string>>, last array<{record}>, value string, source string, reason string"
    batch_types = arrow_types(spark, schema)
    made = written(rows.mapInArrow(summaries, schema), "runs")
    counted = made.groupBy("entity", "field").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("source").alias("source"), F.first("reason").alias("reason"))
    single = counted.filter("n = 1").drop("n")
    several = made.join(counted.filter("n > 1").select(F.col("entity").alias("_e"), F.col("field").alias("_f")), F.col("entity").eqNullSafe(F.col("_e")) & F.col("field").eqNullSafe(F.col("_f"))).drop("_e", "_f")
    after = f"{key}, task int, entry {record}, entry_reason string, value string, source string, reason string, is_last boolean"
    after_types = arrow_types(spark, after)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for entity, name, those in zip(*(batch.column(c).to_pylist() for c in ("entity", "field", "those")), strict=True):
                winner, reason = None, "FIRST_VALUE"
                for k, part in enumerate(those):
                    entry, first = (winner, reason), Record(**part["first"])
                    if winner is None:
                        winner = first
                    else:
                        winner, reason = one_by_one(winner, reason, [first])
                    run = Run([([Record(**g) for g in x["those"]], Record(**x["winner"]), x["reason"]) for x in part["guards"]], [Record(**x) for x in part["last"]])
                    winner, reason = run.applied(winner, reason)
                    out.append((entity, name, part["task"], entry[0] and plain(entry[0]), entry[1], winner.value, winner.source, reason, k == len(those) - 1))
            columns = list(zip(*out, strict=True)) or [()] * len(after_types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, after_types.types, strict=True)], schema=after_types)

    parts_of = several.groupBy("entity", "field").agg(F.array_sort(F.collect_list(F.struct("task", "first", "guards", "last"))).alias("those"))
    return single, parts_of.mapInArrow(in_order, after)


def conflict_log(records: DataFrame, parts: int | None = None) -> DataFrame:
    """(entity, field, arrival, existing_source, existing_value, source, value, chosen_source, reason, severity): a row for
    each record that meets a winner that it isn't equivalent to, in the fold of ``folded_in_runs``.

    Runs give the winner before each task's part of a field; with it each task goes through its records once more.  Only
    fields that lie in several tasks have such entries, at most two a task, which is why they are broadcast.
    """
    spark = records.sparkSession
    rows = written(dealt(records, parts).withColumn("task", F.spark_partition_id()), "dealt")
    in_tasks = lambda df: df.repartition(F.col("task")).sortWithinPartitions("task", *ORDER)
    entries = outcomes(in_tasks(rows))[1].filter("entry IS NOT NULL").select(F.col("entity").alias("_e"), F.col("field").alias("_f"), F.col("task").alias("_t"), "entry")
    entries = written(entries, "entries")
    same = F.col("entity").eqNullSafe(F.col("_e")) & F.col("field").eqNullSafe(F.col("_f")) & (F.col("task") == F.col("_t"))
    both = in_tasks(rows.join(F.broadcast(entries), same, "left").drop("_e", "_f", "_t"))
    key = f"entity {rows.schema['entity'].dataType.simpleString()}, field {rows.schema['field'].dataType.simpleString()}, arrival {rows.schema['arrival'].dataType.simpleString()}"
    schema = f"{key}, existing_source string, existing_value string, source string, value string, chosen_source string, reason string, existing_text string, text string"
    types = arrow_types(spark, schema)

    def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, winner = None, None
        for batch in batches:
            out: list[tuple] = []
            for task, entity, name, arrival, entry, *rest in zip(*(batch.column(c).to_pylist() for c in ("task", "entity", "field", "arrival", "entry", *NAMES)), strict=True):
                if of != (task, entity, name):
                    of, winner = (task, entity, name), entry and Record(**entry)
                x = Record(*rest)
                if winner is None:
                    winner = x
                elif not x.alike(winner):
                    wins, why = x.judged(winner)
                    out.append((entity, name, arrival, winner.source, winner.value, x.source, x.value, x.source if wins else winner.source, why, winner.text, x.text))
                    winner = x if wins else winner
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    found = both.mapInArrow(log, schema)
    return found.withColumn("severity", severity(F.col("field"), F.col("existing_text"), F.col("text"))).drop("existing_text", "text")


def fields_of(batch: pa.RecordBatch) -> list[int]:
    """Where the fields of a sorted batch begin."""
    if not batch.num_rows:
        return []
    codes = [batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in ("task", "entity", "field")]
    changed = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return [0, *(np.flatnonzero(changed) + 1).tolist()]


def struct_type(fields: str) -> str:
    return ",".join(part.replace(" ", ":", 1) for part in fields.split(", "))


def arrow_types(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def packed(rows: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    tasks, entities, names, firsts, runs, winners, reasons = zip(*rows, strict=True)
    guards = [[{"those": [plain(g) for g in those], "winner": plain(winner), "reason": why} for those, winner, why in run.guards] for run in runs]
    columns = [tasks, entities, names, [r and plain(r) for r in firsts], guards, [[plain(x) for x in run.last] for run in runs], [w.value for w in winners], [w.source for w in winners], reasons]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)
