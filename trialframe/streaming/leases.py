"""Streaming leases: closed intervals, and a tracker with ownership."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.operators.leases import CLAIM, REFRESH, RELEASE
from trialframe.session import durable, scratch_scope
from trialframe.sources.writers import publish, read_version, version_before
from trialframe.streaming.feed import drain_batches
from trialframe.streaming.fold import fold_in_order, touched


#: Setting for a query on closed_leases().
MERGE_BEFORE_SHUFFLE = {
    "spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition": "true"
}


def _gap(ttl_seconds: Column) -> Column:
    # Session windows merge beats exactly one gap apart, but a lease has
    # expired at that instant: the gap is one microsecond short of the ttl.
    micros = (ttl_seconds.cast("decimal(18,6)") * 1_000_000).cast("long") - 1
    return F.concat(micros.cast("string"), F.lit(" microseconds"))


def closed_leases(beats: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Leases whose end has passed the watermark (append mode).

    ``beats``: keys, ts, ttl_seconds.  Beats behind the watermark are dropped.
    Session windows cannot shorten a lease, so beats of different ttl that meet
    in one raise; use ``timers.timed_leases`` for those.  Start the query under ``MERGE_BEFORE_SHUFFLE``, so that the beats of a busy
    key are merged into sessions before they are shuffled.
    """
    session = F.session_window("ts", _gap(F.col("ttl_seconds"))).alias("lease")
    return (
        beats.withWatermark("ts", delay)
        .groupBy(*keys, session)
        .agg(
            F.count("*").alias("beats"), F.min("ttl_seconds").alias("_least"), F.max("ttl_seconds").alias("_most")
        )
        .select(
            *keys,
            F.col("lease.start").alias("lease_start"),
            (F.col("lease.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("lease_end"),
            F.when(F.col("_least") == F.col("_most"), F.col("beats"))
            .otherwise(F.raise_error(F.lit("the ttl changed within a lease: use timers.timed_leases")).cast("long"))
            .alias("beats"),
        )
    )


KEY = ["project", "fingerprint"]
LATE = "late"

TRACKED = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("lease_start", T.TimestampType()),
        T.StructField("lease_end", T.TimestampType()),
        T.StructField("beats", T.LongType()),
        T.StructField("state", T.StringType()),
    ]
)

_STATE = "project string, fingerprint string, agent_id string, began long, ends long, beats long, live boolean"
#: A row of the fold: an ended lease (``state``), or the key's new state.
_FOLDED = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("began", T.LongType()),
        T.StructField("ends", T.LongType()),
        T.StructField("beats", T.LongType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("state", T.StringType()),
    ]
)


def micros(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(20,6)") * 1_000_000).cast("long")


class LeaseFold:
    """One lease of a key; times in microseconds.

    Only the owner refreshes or releases.  An expired lease is remembered,
    since its owner may still refresh it, for ``memory`` after its end.
    """

    def __init__(self, watermark: int, memory: int | None) -> None:
        self.watermark, self.memory = watermark, memory
        self.state = NO_LEASE

    @property
    def state(self) -> tuple:
        return self.agent, self.began, self.ends, self.beats, self.live

    @state.setter
    def state(self, state: tuple) -> None:
        self.agent, self.began, self.ends, self.beats, self.live = state

    def _ended(self, ends: int, state: str) -> tuple:
        return (self.agent, self.began, ends, self.beats, False, state)

    def _open(self, agent: str, at: int, ttl: int) -> None:
        self.state = (agent, at, at + ttl, 1, True)

    def _expire(self, at: int) -> list[tuple]:
        out = []
        if self.live and self.ends <= at:
            out = [self._ended(self.ends, "expired")]
            self.live = False
        forgotten = self.memory is not None and self.ends + self.memory <= at
        if self.agent is not None and not self.live and forgotten:
            self.state = NO_LEASE
        return out

    def row(self, at, event_id, agent, kind, ttl, began, ends, beats, live) -> list[tuple]:
        if at is None:  # the stored state sorts first
            self.state = (agent, began, ends, beats, live)
            return []
        out = self._expire(at)
        owner = self.agent is not None and self.agent == agent
        if kind == CLAIM and not self.live:
            self._open(agent, at, ttl)
        elif kind == REFRESH and owner and self.live:
            self.ends, self.beats = at + ttl, self.beats + 1
        elif kind == REFRESH and owner:
            # Expired, not released: the beat opens a new lease.
            self._open(agent, at, ttl)
        elif kind == RELEASE and owner:
            if self.live:
                out.append(self._ended(at, "released"))
            self.state = NO_LEASE
        return out

    def finish(self) -> list[tuple]:
        out = self._expire(self.watermark)
        if self.agent is not None:
            out.append((self.agent, self.began, self.ends, self.beats, self.live, None))
        return out


NO_LEASE = (None, 0, 0, 0, False)
_LIVE, _ENDED, _NOBODY = range(3)


class LeaseTransition:
    """What a run of events makes of any lease before it.

    After a beat (a claim or refresh that counts) the next beat depends on that
    beat alone, so beats form a forest that one pass from the end resolves:
    the last beat that follows from each, where its lease opened (-1: with the
    beat itself or before), the beats since, and how it stands.  A lease from
    before meets the run only at its owner's first event and at the first claim
    after its end, so the results at claims and at owners' first events suffice.
    """

    def __init__(self, rows: list[tuple], memory: int | None) -> None:
        self.memory, self.seed = memory, None
        if rows and rows[0][0] is None:
            self.seed, rows = (rows[0][2], *rows[0][5:9]), rows[1:]
        n = len(rows)
        at = [r[0] for r in rows]
        self.until = at[-1] if rows else None
        agent, kind = [r[2] for r in rows], [r[3] for r in rows]
        ends = [r[0] + r[4] if r[3] != RELEASE else 0 for r in rows]
        claims = [i for i in range(n) if kind[i] == CLAIM]
        claim_at = [at[i] for i in claims]
        found: list[tuple | None] = [None] * n
        own: dict[str, int] = {}

        def follow(i: int) -> tuple:
            """(last beat, opening or -1, beats since, standing) from a beat at i."""
            o, end = own.get(agent[i], n), ends[i]
            if o < n and at[o] < end:
                if kind[o] == RELEASE:
                    return released(i, o)
                last, opened, beats, stands = found[o]
                return last, opened, beats + (opened < 0), stands
            c = bisect_left(claims, bisect_left(at, end, i + 1))
            c = claims[c] if c < len(claims) else n
            mine = o < c and (memory is None or at[o] < end + memory)
            if mine and kind[o] == RELEASE:
                return released(i, o)
            if mine or c < n:
                return opening(o if mine else c)
            if i + 1 == n or at[-1] < end:
                return i, -1, 0, _LIVE
            return i, -1, 0, _ENDED if memory is None or at[-1] < end + memory else _NOBODY

        def released(i: int, o: int) -> tuple:
            c = bisect_left(claims, o + 1)
            return opening(claims[c]) if c < len(claims) else (i, -1, 0, _NOBODY)

        def opening(i: int) -> tuple:
            last, opened, beats, stands = found[i]
            return (last, i, beats + 1, stands) if opened < 0 else (last, opened, beats, stands)

        for i in range(n - 1, -1, -1):
            if kind[i] != RELEASE:
                found[i] = follow(i)
            if kind[i] != CLAIM:
                own[agent[i]] = i

        def state(result: tuple) -> tuple:
            last, opened, beats, stands = result
            if stands == _NOBODY:
                return NO_LEASE
            return agent[last], at[opened], ends[last], beats, stands == _LIVE

        #: Time of each claim, and the state at the end if it opens a lease.
        self.claim_at, self.claimed = claim_at, [state(opening(i)) for i in claims]
        #: Of each agent its first refresh or release: time, kind, claims before it, and what follows from it.
        self.own = {}
        for who, i in own.items():
            renewed = extended = None
            if kind[i] == REFRESH:
                renewed = state(opening(i))
                last, opened, beats, stands = found[i]
                extended = renewed if opened >= 0 or stands == _NOBODY else (ends[last], 1 + beats, stands == _LIVE)
            self.own[who] = (at[i], kind[i], bisect_left(claims, i), renewed, extended)

    def _claimed(self, place: int) -> tuple | None:
        return self.claimed[place] if place < len(self.claimed) else None

    def after(self, state: tuple) -> tuple:
        agent, began, ends, beats, live = state if self.seed is None else self.seed
        if self.until is None:
            return agent, began, ends, beats, live
        at, kind, before, renewed, extended = self.own.get(agent, (None, None, 0, None, None)) if agent is not None else (None,) * 5
        if live and at is not None and at < ends:
            if kind == RELEASE:
                return self._claimed(before) or NO_LEASE
            if len(extended) == 3:
                return agent, began, extended[0], beats + extended[1], extended[2]
            return extended
        place = bisect_left(self.claim_at, ends) if live else 0
        forgotten = None if self.memory is None else ends + self.memory
        # The owner's event counts before the next claim, while the lease is remembered.
        if at is not None and before <= place and (forgotten is None or at < forgotten):
            if kind == RELEASE:
                return self._claimed(before) or NO_LEASE
            return renewed
        if self._claimed(place) is not None:
            return self.claimed[place]
        if agent is None or not live and forgotten is not None and forgotten <= self.until:
            return NO_LEASE
        if live and ends <= self.until:
            return NO_LEASE if forgotten is not None and forgotten <= self.until else (agent, began, ends, beats, False)
        return agent, began, ends, beats, live


@dataclass(frozen=True)
class LeaseMachine:
    """Leases of a key (microseconds); ``watermark`` ends what is played, ``memory`` as in LeaseFold."""

    watermark: int
    memory: int | None = None

    def fold(self) -> LeaseFold:
        return LeaseFold(self.watermark, self.memory)

    def transition(self, rows: list[tuple]) -> LeaseTransition:
        return LeaseTransition(rows, self.memory)


def _earlier(spark: SparkSession, root: str, batch: int, schema: str) -> DataFrame:
    version = version_before(spark, root, batch)
    if version is None:
        return spark.createDataFrame([], schema)
    return read_version(spark, root, version)


def track_batches(root: str, delay_seconds: float = 0, memory_seconds: float | None = None):
    """foreachBatch function: apply a batch of events to the stored leases.

    The watermark is the latest event time seen less ``delay_seconds``; events
    behind that of the batches before are written as ``late`` and change
    nothing.  The rows of a busy key are played in many tasks at once.
    """
    memory = None if memory_seconds is None else int(memory_seconds * 1_000_000)

    def track(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        arrived = durable(
            events.where("ts is not null").select(
                *KEY, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "agent_id", "kind",
                micros(F.col("ttl_seconds")).alias("ttl"),
            )
        )
        before = _earlier(spark, f"{root}/clock", batch, "watermark long").first()
        newest = arrived.agg(F.max("at")).first()[0]
        marks = [before.watermark] if before else []
        marks += [newest - int(delay_seconds * 1_000_000)] if newest is not None else []
        if not marks:
            return
        watermark = max(marks)
        fresh = arrived.where(F.col("at") >= before.watermark) if before else arrived
        state = _earlier(spark, f"{root}/state", batch, _STATE)
        none = {c: F.lit(None).cast("long") for c in ("at", "event_id", "ttl", "began", "ends", "beats")}
        columns = ["at", "event_id", "agent_id", "kind", "ttl", "began", "ends", "beats", "live"]
        seeds = touched(state, fresh, KEY, "left_semi").select(
            *KEY, *[none[c].alias(c) for c in ("at", "event_id", "ttl")], "agent_id",
            F.lit("").alias("kind"), "began", "ends", "beats", "live",
        ).select(*KEY, *columns)
        rows = fresh.select(
            "*", *[none[c].alias(c) for c in ("began", "ends", "beats")], F.lit(False).alias("live")
        ).select(*KEY, *columns)
        folded = durable(
            fold_in_order(
                seeds.union(rows), KEY, ["at", "event_id"], LeaseMachine(watermark, memory), _FOLDED
            )
        )
        rest = touched(state, fresh, KEY, "left_anti")
        lapsed = rest.where(F.col("live") & (F.col("ends") <= watermark)).withColumn("state", F.lit("expired"))
        late = arrived.where(F.col("at") < before.watermark) if before else arrived.limit(0)
        ended = folded.where("state is not null").unionByName(lapsed).select(
            *KEY, "agent_id", F.timestamp_micros("began").alias("lease_start"),
            F.timestamp_micros("ends").alias("lease_end"), "beats", "state",
        )
        flagged = late.select(
            *KEY, "agent_id", F.timestamp_micros("at").alias("lease_start"),
            F.lit(None).cast("timestamp").alias("lease_end"), F.lit(0).cast("long").alias("beats"),
            F.lit(LATE).alias("state"),
        )
        ended.union(flagged).write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        kept = rest.withColumn("live", F.col("live") & (F.col("ends") > watermark))
        if memory is not None:
            kept = kept.where(F.col("live") | (F.col("ends") + memory > watermark))
        publish(folded.where("state is null").drop("state").unionByName(kept), f"{root}/state", batch)
        publish(spark.range(1).select(F.lit(watermark).cast("long").alias("watermark")), f"{root}/clock", batch)

    def track_and_clean(events: DataFrame, batch: int) -> None:
        with scratch_scope(events.sparkSession):
            track(events, batch)

    return track_and_clean


def track_leases(
    events: DataFrame, root: str, delay_seconds: float = 0, memory_seconds: float | None = None
) -> DataFrame:
    """Leases as they end, from claim, refresh and release events.

    Inside a micro-batch events count in order of (ts, event_id), however they
    arrive.  Returns the table under ``root``: a row for each ended lease
    (``released`` or ``expired``) and for each late event (``late``, with the
    event's time as ``lease_start``).
    """
    drain_batches(events, track_batches(root, delay_seconds, memory_seconds), root)
    return events.sparkSession.read.schema(TRACKED).option("recursiveFileLookup", True).parquet(f"{root}/rows")
