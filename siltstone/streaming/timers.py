"""State that ends by event time: leases of documents and entries of traces, with timers in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WANTS = "document_id long, operation_id string, kind string, at timestamp, seconds int"
OUTCOME = "document_id long, operation_id string, at timestamp, outcome string"


def _micros(at: pd.Timestamp) -> int:
    return at.value // 1000


def _step(held: tuple[str, int] | None, operation: str, kind: str, at: int, seconds: int) -> tuple[tuple[str, int] | None, list[tuple[str, int, str]]]:
    """The lease after a request, and what came of it. held: (operation, end); times in microseconds."""
    out = []
    if held and held[1] <= at:
        out.append((held[0], held[1], "expired"))
        held = None
    if kind == "release":
        ok = held is not None and held[0] == operation
        return (None if ok else held), [*out, (operation, at, "released" if ok else "not_held")]
    if held and held[0] != operation:
        return held, [*out, (operation, at, "busy")]
    return (operation, at + seconds * 1_000_000), [*out, (operation, at, "renewed" if held else "granted")]


def _told(key: int, rows: list[tuple[str, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"document_id": pd.Series([key] * len(rows), dtype="int64"), "operation_id": [r[0] for r in rows], "at": pd.to_datetime([r[1] for r in rows], unit="us"), "outcome": [r[2] for r in rows]})


class Leases(StatefulProcessor):
    """One lease for each document. A timer at its end reports it as expired as soon as the watermark has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "operation string, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        held, out = (tuple(held) if held else None), []
        for r in pd.concat(list(rows)).sort_values(["at", "operation_id", "kind"]).itertuples():
            before = held
            held, told = _step(held, r.operation_id, r.kind, _micros(r.at), int(r.seconds))
            out += told
            if before and before != held:
                self.handle.deleteTimer(before[1] // 1000)
            if held and held != before:
                self.handle.registerTimer(held[1] // 1000)
        self.held.update(held) if held else self.held.clear()
        yield _told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            operation, ends = self.held.get()
            if ends // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.held.clear()
                yield _told(key[0], [(operation, ends, "expired")])

    def close(self) -> None:
        pass


def lease_stream(wants: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Outcomes of a stream of requests (WANTS): granted, renewed, busy, released, not_held, and expired at the end of a lease that no one has
    renewed or given up. Needs the RocksDB state store."""
    marked = wants.withWatermark("at", late)
    return marked.groupBy("document_id").transformWithStateInPandas(Leases(), OUTCOME, "Append", "EventTime")


def lease_outcomes(wants: DataFrame, until) -> DataFrame:
    """The same of a table. until: the time up to which ends of leases are reported. Requests of a document are folded in order, in batches as
    they come, so no document is held whole."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for frame in batches:
            out: dict[str, list] = {"document_id": [], "operation_id": [], "at": [], "outcome": []}

            def say(key, told):
                for operation, at, outcome in told:
                    for c, v in zip(out, (key, operation, at, outcome), strict=True):
                        out[c].append(v)

            for r in frame.itertuples():
                if r.document_id != key:
                    key, held = r.document_id, None
                if r.kind == "end":
                    if held and held[1] <= _micros(r.at):
                        say(key, [(held[0], held[1], "expired")])
                    continue
                held, told = _step(held, r.operation_id, r.kind, _micros(r.at), int(r.seconds))
                say(key, told)
            yield pd.DataFrame(out).assign(at=lambda x: pd.to_datetime(x["at"], unit="us"))

    ends = wants.select("document_id").distinct().select("document_id", F.lit("").alias("operation_id"), F.lit("end").alias("kind"), F.lit(until).cast("timestamp").alias("at"), F.lit(0).alias("seconds"))
    both = wants.select("document_id", "operation_id", "kind", "at", "seconds").withColumn("last", F.lit(0)).unionByName(ends.withColumn("last", F.lit(1)))
    return both.repartition("document_id").sortWithinPartitions("document_id", "last", "at", "operation_id", "kind").drop("last").mapInPandas(run, OUTCOME)


class Entries(StatefulProcessor):
    """Entries of a trace by key: a new value replaces the one before; what has not been set again for the time to live ends."""

    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (at, n), out = self.last.get() if self.last.exists() else (None, 0), []
        for r in sorted(_micros(x) for f in rows for x in f["at"]):
            if at is not None and at + self.micros <= r:
                out.append((at, n))
                n = 0
            if at is not None:
                self.handle.deleteTimer((at + self.micros) // 1000)
            at, n = r, n + 1
            self.handle.registerTimer((at + self.micros) // 1000)
        self.last.update((at, n))
        yield self._told(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, n = self.last.get()
            self.last.clear()
            yield self._told(key[0], [(at, n)])

    def _told(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key] * len(rows), dtype="int64"), "ended": pd.to_datetime([a + self.micros for a, _ in rows], unit="us"), "n": pd.Series([n for _, n in rows], dtype="int64")})

    def close(self) -> None:
        pass


def entry_stream(puts: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, ended, n): lives of entries of a stream (key long, at), with how often each was set. Needs the RocksDB state store."""
    return puts.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Entries(seconds), "key long, ended timestamp, n long", "Append", "EventTime")


def entry_lives(puts: DataFrame, seconds: int) -> DataFrame:
    """The same of a table, all lives ended."""
    w = Window.partitionBy("key").orderBy("at")
    gap = F.unix_micros("at") - F.unix_micros(F.lag("at").over(w))
    lives = puts.withColumn("life", F.sum(F.when(gap >= seconds * 1_000_000, 1).otherwise(0)).over(w))
    return lives.groupBy("key", "life").agg((F.max("at") + F.make_dt_interval(secs=F.lit(seconds))).alias("ended"), F.count(F.lit(1)).alias("n")).drop("life")
