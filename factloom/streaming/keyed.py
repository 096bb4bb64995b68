"""Streams with keyed state: a bounded memory of spans, conflicts and folded facts whose work follows the batch, and
sessions with a side output of late rows.

State lives in RocksDB by key, is read and written for the keys of a batch only, and comes back from the checkpoint. Each
call to the state from Python costs a round trip, so a key's state is a list of packed entries, read in one call and added
to in one, however many rows a batch brings. Small keys share a block by their hash, which is then what has the state.
Outputs of several kinds are one stream with a ``kind`` column, which a file sink partitions by, so that all kinds of a
batch are committed together.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.operators.quality import ingest_eligible, span_hash
from factloom.operators.temporal import KEY

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Spans that a session remembers.
MOST_SPANS = 10_000
#: Blocks that small keys are dealt to; a batch reads the blocks of its keys, so each should fit a task many times over.
BLOCKS = 2_048
#: Fewer for known facts: their blocks are compared as arrays, and each salt has blocks of its own.
FACT_BLOCKS = 256
#: Pairs of a new fact and a known one that a task holds at a time, more only if a single fact has more.
MOST_PAIRS = 1_000_000
_OPEN = 2**63 - 1


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def from_micros(column: str) -> Column:
    return F.timestamp_micros(column)


def run_to(stream: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Everything that is there into Parquet files, with the state store that keyed state needs."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)
    try:
        return stream.writeStream.format("parquet").partitionBy(*by).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def feed(arrivals: Sequence[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Let each arrival's files come to the folder after the ones before are worked off: one restart, one batch for each."""
    for a in arrivals:
        a.write.mode("append").parquet(folder)
        start(a.sparkSession.readStream.schema(a.schema).parquet(folder)).awaitTermination()


def _block(blocks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def _arrays(fields: str) -> str:
    """The schema of packed rows: an array for each field."""
    return ", ".join(f"{n} array<{t}>" for n, t in (f.split() for f in fields.split(", ")))


def _packed(rows: Sequence[tuple]) -> tuple:
    return tuple(map(list, zip(*rows, strict=True)))


def _unpacked(entries: Any) -> Iterator[tuple]:
    """The rows of a list state, in the order they came."""
    for columns in entries.get():
        yield from zip(*columns, strict=True)


# ---- spans


class SpanMemory(StatefulProcessor):
    """The spans of a session, of which the first is forgotten when there are too many; the state is a log of them.

    A repeat does not renew a span's place unless ``renew``.
    """

    def __init__(self, most: int, ttl_ms: int | None, renew: bool) -> None:
        self.most, self.ttl_ms, self.renew = max(1, most), ttl_ms, renew

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", _arrays("hash string, at long"))

    def _take(self, held: OrderedDict, span: str, at: int) -> None:
        held.pop(span, None)
        held[span] = at
        if len(held) > self.most:
            held.popitem(last=False)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held: OrderedDict[str, int] = OrderedDict()
        logged, new, aged = 0, [], False
        for span in _unpacked(self.spans):
            self._take(held, *span)
            logged += 1
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            while self.ttl_ms is not None and held and next(iter(held.values())) <= r.at - self.ttl_ms:
                held.popitem(last=False)
                aged = True
            known = r.hash in held
            if known and not self.renew:
                continue
            self._take(held, r.hash, r.at)
            new.append((r.hash, r.at))
            if not known:
                yield Row(group_id=key[0], session_id=key[1], seq=r.seq, role=r.role, text=r.text, hash=r.hash, at=r.at)
        if aged or logged + len(new) > 2 * self.most:
            self.spans.put([_packed(list(held.items()))])
        elif new:
            self.spans.appendValue(_packed(new))
        if self.ttl_ms is not None and held:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(next(reversed(held.values())) + self.ttl_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """All spans of an idle session are older than allowed."""
        self.spans.clear()
        return iter(())


def first_sights(messages: DataFrame, most: int = MOST_SPANS, ttl: str | None = None, late: str = "1 hour", renew: bool = False) -> DataFrame:
    """Messages whose role and text their tenant's session does not remember, for a stream of
    ``messages(group_id, session_id, seq, role, text, event_time)``.

    Short texts and secrets go before anything is remembered. A session remembers at most ``most`` spans, exactly, and
    forgets the one that it has held longest (with ``renew``: that was seen least recently), so a repeat of a forgotten
    span comes out again. With a ``ttl`` spans are also forgotten by age, and idle sessions leave no state. Rows of a batch
    are taken by (event_time, seq). Null texts are short; null times are not taken.
    """
    rows = ingest_eligible(messages).filter("event_time is not null").withColumn("hash", span_hash(F.col("role"), F.col("text")))
    ttl_ms = None
    if ttl is not None:
        ttl_ms = messages.sparkSession.range(1).select(F.expr(f"unix_millis(timestamp '2000-01-01 00:00:00' + interval {ttl}) - unix_millis(timestamp '2000-01-01 00:00:00')")).first()[0]
        rows = rows.withWatermark("event_time", late)
    rows = rows.select("group_id", "session_id", "seq", "role", "text", "hash", F.unix_millis(F.col("event_time").cast("timestamp")).alias("at"))
    out = rows.groupBy("group_id", "session_id").transformWithState(
        SpanMemory(most, ttl_ms, renew), "group_id string, session_id string, seq long, role string, text string, hash string, at long", "Append", "None" if ttl is None else "EventTime"
    )
    return out.withColumn("event_time", F.timestamp_millis("at")).drop("at")


# ---- conflicts


class KnownFacts(StatefulProcessor):
    """The facts of a block of subjects and predicates that have come so far (of one salt: a part of them)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getListState("facts", _arrays("key string, fact_id long, object string, ends long"))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._append(initialState)

    def _append(self, facts: pd.DataFrame) -> None:
        if len(facts):
            self.facts.appendValue(tuple(facts[c].tolist() for c in ("key", "fact_id", "object", "ends")))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        own = new[new["own"]]
        held = [pd.DataFrame(dict(zip(("key", "fact_id", "object", "ends"), e, strict=True))) for e in self.facts.get()]
        pool = pd.concat([*held, own[["key", "fact_id", "object", "ends"]]], ignore_index=True)
        self._append(own)
        if not len(pool):
            return
        n = len(pool)
        keys = pd.factorize(pd.concat([pool["key"], new["key"]], ignore_index=True))[0]
        objects = pd.factorize(pd.concat([pool["object"], new["object"]], ignore_index=True))[0]
        ids, ends = pool["fact_id"].to_numpy(), pool["ends"].to_numpy()
        order = np.lexsort((ids, keys[:n]))
        ids, ends, pool_keys, pool_objects = ids[order], ends[order], keys[:n][order], objects[:n][order]
        starts = np.searchsorted(pool_keys, keys[n:], "left")
        pairs = np.searchsorted(pool_keys, keys[n:], "right") - starts
        new_ids, begins = new["fact_id"].to_numpy(), new["begins"].to_numpy()
        ran, at = np.cumsum(pairs), 0
        while at < len(new):  # a hot key's rows meet it a part at a time
            after = max(at + 1, int(np.searchsorted(ran, (ran[at - 1] if at else 0) + MOST_PAIRS, "right")))
            some = pairs[at:after]
            row = np.repeat(np.arange(at, after), some)
            other = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(starts[at:after], some)
            hit = (ids[other] < new_ids[row]) & (pool_objects[other] != objects[n:][row]) & ((ends[other] == _OPEN) | (ends[other] > begins[row]))
            row, found = row[hit], ids[other[hit]]
            if len(row):
                hits, firsts = np.unique(row, return_index=True)
                yield pd.DataFrame({"fact_id": new_ids[hits], "salt": np.int32(key[-1]), "conflicts": np.split(found, firsts[1:])})
            at = after


def _salt(salts: int) -> Column:
    return F.pmod(F.xxhash64("fact_id"), F.lit(salts)).cast("int")


def conflicts_of_stream(new: DataFrame, known: DataFrame | None = None, salts: int = 1, blocks: int = FACT_BLOCKS) -> DataFrame:
    """(fact_id, salt, conflicts): what each arriving fact contradicts among those that came before it.

    ``known`` are facts stored before the stream began; they become its first state. A batch touches the state of the blocks
    of its own subjects and predicates only. With ``salts`` the facts of a key are dealt over so many states and each arrival asks
    all of them, so a hot key is not one task; :func:`merged_conflicts` brings an arrival's parts together. Arrivals come
    in the order of their ids.
    """
    block = _block(blocks, *KEY)
    held = lambda f: f.dropna(subset=[*KEY, "fact_id", "object"]).withColumns({"block": block, "key": F.to_json(F.struct(*KEY)), "ends": F.coalesce(micros("invalid_at"), F.lit(_OPEN))})
    rows = held(new).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.select("block", "salt", "key", "fact_id", "object", "ends", F.coalesce(micros("valid_at"), F.lit(_OPEN)).alias("begins"), (F.col("salt") == _salt(salts)).alias("own"))
    first = None if known is None else held(known).withColumn("salt", _salt(salts)).select("block", "salt", "key", "fact_id", "object", "ends").groupBy("block", "salt")
    return rows.groupBy("block", "salt").transformWithStateInPandas(KnownFacts(), "fact_id long, salt int, conflicts array<long>", "Append", "None", initialState=first)


def merged_conflicts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("fact_id").agg(F.sort_array(F.flatten(F.collect_list("conflicts"))).alias("conflicts"))


# ---- changes

_FACT = "fact_id long, confidence double, pinned boolean, ends long, attested long, attested_by string, reason string, ended_by string, version long"
CHANGED = "kind string, fact_id long, mutation_id long, version long, confidence double, pinned boolean, ends long, attested long, attested_by string, reason string, ended_by string, deleted boolean"


class FoldedFacts(StatefulProcessor):
    """The facts of a block as they stand after the changes so far; the state is a log of them, in which the last row of a
    fact counts, and one without a version says that it is deleted."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.facts = handle.getListState("facts", _arrays(_FACT))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        columns = (initialState.fact_id, initialState.confidence, initialState.pinned, initialState.ends)
        n = len(initialState.fact_id)
        self.facts.appendValue((*columns, [None] * n, [None] * n, [None] * n, [None] * n, [0] * n))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        blank = dict.fromkeys(c.split()[0] for c in CHANGED.split(", "))
        names = ("confidence", "pinned", "ends", "attested", "attested_by", "reason", "ended_by")
        facts: dict[int, tuple] = {}
        logged, touched = 0, {}
        for fact_id, *now in _unpacked(self.facts):
            logged += 1
            if now[-1] is None:
                del facts[fact_id]
            else:
                facts[fact_id] = tuple(now)
        for r in sorted(rows, key=lambda r: (r.at, r.mutation_id)):
            now = facts.get(r.fact_id)
            if now is None:
                yield Row(**(blank | {"kind": "unknown", "fact_id": r.fact_id, "mutation_id": r.mutation_id}))
                continue
            confidence, pinned, ends, attested, by, reason, ended_by, version = now
            touched.setdefault(r.fact_id, version + 1)
            if r.action == "delete":
                del facts[r.fact_id]
                continue
            if r.action == "confirmed":
                confidence, pinned, attested, by = min(1.0, confidence + 0.2), True, r.at, r.actor
            elif r.action == "corrected":
                confidence, pinned, attested, by = max(0.0, confidence - 0.4), False, r.at, r.actor
            elif r.action == "invalidate":
                ends, reason, ended_by = (r.at if ends is None else ends), r.reason, r.actor
            facts[r.fact_id] = (confidence, pinned, ends, attested, by, reason, ended_by, version)
        log = []
        for fact_id, version in touched.items():
            now = facts.get(fact_id)
            if now is None:
                log.append((fact_id, *[None] * 8))
                yield Row(**(blank | {"kind": "fact", "fact_id": fact_id, "version": version, "deleted": True}))
                continue
            facts[fact_id] = (*now[:-1], version)
            log.append((fact_id, *facts[fact_id]))
            yield Row(**(blank | dict(zip(names, now, strict=False)) | {"kind": "fact", "fact_id": fact_id, "version": version, "deleted": False}))
        if not log:
            return
        if not facts:
            self.facts.clear()
        elif logged + len(log) > 2 * len(facts):
            self.facts.put([_packed([(i, *f) for i, f in facts.items()])])
        else:
            self.facts.appendValue(_packed(log))


def changes_of_stream(changes: DataFrame, facts: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """New versions of the facts that a stream of changes touches (kind ``fact``), and changes of facts that are not there,
    never were or are deleted (kind ``unknown``).

    ``facts`` become the first state; later batches read the state of their own facts' blocks only. Changes of a batch are folded
    by (ts, mutation_id), batches as they come. Repeated ids in ``facts`` are one fact, the last read.
    """
    block = _block(blocks, "fact_id").alias("block")
    changes, facts = (df.withColumn("fact_id", F.col("fact_id").cast("long")) for df in (changes, facts))
    rows = changes.filter("fact_id is not null").select(block, "fact_id", "mutation_id", "action", micros("ts").alias("at"), "reason", "actor")
    fact = F.struct("fact_id", F.col("confidence").cast("double").alias("confidence"), "pinned", micros("invalid_at").alias("ends"))
    first = facts.filter("fact_id is not null").groupBy(block).agg(F.collect_list(fact).alias("f")).select("block", "f.fact_id", "f.confidence", "f.pinned", "f.ends").groupBy("block")
    return rows.groupBy("block").transformWithState(FoldedFacts(), CHANGED, "Append", "None", initialState=first)


def folded_facts(facts: DataFrame, versions: DataFrame) -> DataFrame:
    """``facts`` as the newest of their versions (rows of kind ``fact``) have them; deleted ones are gone."""
    latest = versions.groupBy("fact_id").agg(F.max_by(F.struct("confidence", "pinned", "ends", "attested", "attested_by", "reason", "ended_by", "deleted"), "version").alias("v"))
    j = facts.join(latest, "fact_id", "left").filter("v is null or not v.deleted")
    pick = lambda new, old: F.when(F.col("v").isNull(), F.col(old)).otherwise(F.col(f"v.{new}"))
    out = {"confidence": pick("confidence", "confidence"), "pinned": pick("pinned", "pinned"), "invalid_at": F.when(F.col("v").isNull(), F.col("invalid_at")).otherwise(from_micros("v.ends"))}
    out |= {"last_attested_at": from_micros("v.attested"), "last_attested_by": F.col("v.attested_by"), "invalidate_reason": F.col("v.reason"), "invalidated_by": F.col("v.ended_by")}
    return j.withColumns(out).drop("v")


# ---- sessions

SESSIONS = "kind string, session_id string, begins long, ends long, turns long, max_outbound long, max_original long, turns_over long, outbound_tokens long, original_tokens long"


class SessionWindows(StatefulProcessor):
    """Open windows of a block of sessions: records less than ``gap_ms`` apart. Windows come out once the watermark is past
    them, records from before the watermark at once and as late."""

    def __init__(self, gap_ms: int, threshold: int) -> None:
        self.gap_ms, self.threshold = gap_ms, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getListState("windows", _arrays("session_id string, first long, last long, turns long, outbound long, original long, over long"))

    def _close(self, watermark: int, windows: list[tuple]) -> Iterator[Row]:
        still = []
        for w in windows:
            session, first, last, turns, outbound, original, over = w
            if last + self.gap_ms > watermark:
                still.append(w)
            else:
                yield Row(kind="session", session_id=session, begins=first, ends=last + self.gap_ms, turns=turns, max_outbound=outbound, max_original=original, turns_over=over, outbound_tokens=None, original_tokens=None)
        if still:
            self.windows.put([_packed(still)])
        else:
            self.windows.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if still:
            self.handle.registerTimer(min(w[2] for w in still) + self.gap_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        parts, windows = list(_unpacked(self.windows)), []
        for r in rows:
            if r.at < watermark:
                yield Row(kind="late", session_id=r.session_id, begins=r.at, ends=None, turns=None, max_outbound=None, max_original=None, turns_over=None, outbound_tokens=r.outbound_tokens, original_tokens=r.original_tokens)
            else:
                parts.append((r.session_id, r.at, r.at, 1, r.outbound_tokens, r.original_tokens, int(r.outbound_tokens > self.threshold)))
        for p in sorted(parts, key=lambda p: (p[0] is not None, p[0] or "", p[1])):
            w = windows[-1] if windows else None
            if w and w[0] == p[0] and p[1] - w[2] < self.gap_ms:
                windows[-1] = (w[0], w[1], max(w[2], p[2]), w[3] + p[3], max(w[4], p[4]), max(w[5], p[5]), w[6] + p[6])
            else:
                windows.append(p)
        yield from self._close(watermark, windows)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self._close(timerValues.getCurrentWatermarkInMs(), list(_unpacked(self.windows)))


def monitor_sessions(records: DataFrame, threshold: int, gap_ms: int, late: str = "30 minutes", blocks: int = BLOCKS) -> DataFrame:
    """Activity windows (kind ``session``) and late records (kind ``late``) of a stream of
    ``records(session_id, t, original_tokens, outbound_tokens)``.

    Nothing is lost: what comes behind the watermark is a late row, every other record counts in one window. The last
    windows of a stream come out when a far record, under any session id, moves the watermark past them. Null times or
    token counts are not taken.
    """
    rows = records.dropna(subset=["t", "outbound_tokens", "original_tokens"]).withWatermark("t", late)
    # Without the watermarked column itself, Spark leaves late rows to the processor.
    rows = rows.select(_block(blocks, "session_id").alias("block"), "session_id", F.unix_millis("t").alias("at"), F.col("original_tokens").cast("long"), F.col("outbound_tokens").cast("long"))
    return rows.groupBy("block").transformWithState(SessionWindows(gap_ms, threshold), SESSIONS, "Append", "EventTime")


def far_record(spark: SparkSession, t: str = "2100-01-01 00:00:00") -> DataFrame:
    """A record that moves the watermark past all others; its own window stays open."""
    return spark.range(1).select(F.lit(None).cast("string").alias("session_id"), F.lit(t).cast("timestamp").alias("t"), F.lit(0).cast("long").alias("original_tokens"), F.lit(0).cast("long").alias("outbound_tokens"))
