"""Streaming admission: the first candidate of a key wins while its lease lives."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.operators.admission import ACCEPTED, CLAIMED, KEY
from trialframe.session import durable, scratch_scope
from trialframe.sources.writers import publish
from trialframe.streaming.feed import drain_batches
from trialframe.streaming.fold import fold_in_order, touched
from trialframe.streaming.leases import _earlier, micros

ADMITTED = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("candidate_id", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)
_FOLDED = T.StructType([*ADMITTED.fields, T.StructField("until", T.LongType())])
_STATE = "project string, fingerprint string, until long"


class AdmissionFold:
    """State of a key: when the lease of the last accepted candidate ends (microseconds)."""

    def __init__(self) -> None:
        self.state: int | None = None

    def row(self, at, candidate_id, ttl, until) -> list[tuple]:
        if until is not None:  # the stored state sorts first
            self.state = until
            return []
        if self.state is None or self.state <= at:
            self.state = at + ttl
            return [(candidate_id, ACCEPTED, None)]
        return [(candidate_id, CLAIMED, None)]

    def finish(self) -> list[tuple]:
        return [] if self.state is None else [(None, None, self.state)]


class AdmissionTransition:
    """When the last lease of a run ends, by when the one before it ended.

    A step function: a candidate that is accepted settles all after it, so
    one pass from the end finds what follows from each.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.seed = None
        if rows and rows[0][3] is not None:
            self.seed, rows = rows[0][3], rows[1:]
        at = [r[0] for r in rows]
        last = [r[0] + r[2] for r in rows]
        for i in range(len(rows) - 1, -1, -1):
            following = bisect_left(at, last[i], i + 1)
            if following < len(rows):
                last[i] = last[following]
        steps = [i for i in range(len(rows)) if i + 1 == len(rows) or last[i + 1] != last[i]]
        self.upto, self.last = [at[i] for i in steps], [last[i] for i in steps]

    def after(self, until: int | None) -> int | None:
        until = until if self.seed is None else self.seed
        step = 0 if until is None else bisect_left(self.upto, until)
        return self.last[step] if step < len(self.last) else until


class AdmissionMachine:
    fold = staticmethod(AdmissionFold)
    transition = staticmethod(AdmissionTransition)


def admit_batches(root: str, memory_seconds: float | None = None):
    """foreachBatch function: decide a batch of candidates, update the leases.

    With ``memory_seconds``, leases that ended that long before the newest
    candidate are forgotten, which bounds the state.
    """

    def decide(candidates: DataFrame, batch: int) -> None:
        arrived = durable(
            candidates.where("ts is not null").select(
                *KEY, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "candidate_id",
                micros(F.col("ttl_seconds")).alias("ttl"), F.lit(None).cast("long").alias("until"),
            )
        )
        state = _earlier(candidates.sparkSession, f"{root}/state", batch, _STATE)
        none = F.lit(None).cast("long")
        seeds = touched(state, arrived, KEY, "left_semi").select(
            *KEY, none.alias("at"), none.alias("candidate_id"), none.alias("ttl"), "until"
        )
        folded = durable(
            fold_in_order(seeds.union(arrived), KEY, ["at", "candidate_id"], AdmissionMachine(), _FOLDED)
        )
        decisions = folded.where("reason is not null").drop("until")
        decisions.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        leases = folded.where("until is not null").select(*KEY, "until").unionByName(
            touched(state, arrived, KEY, "left_anti")
        )
        newest = arrived.agg(F.max("at")).first()[0]
        if memory_seconds is not None and newest is not None:
            leases = leases.where(F.col("until") > newest - int(memory_seconds * 1_000_000))
        publish(leases, f"{root}/state", batch)

    def decide_and_clean(candidates: DataFrame, batch: int) -> None:
        with scratch_scope(candidates.sparkSession):
            decide(candidates, batch)

    return decide_and_clean


def admit_stream(candidates: DataFrame, root: str, memory_seconds: float | None = None) -> DataFrame:
    """Decide candidates (key, ts, candidate_id, ttl_seconds) and return the table of decisions.

    Inside a micro-batch candidates count in order of (ts, candidate_id),
    however they arrive; micro-batches count in order of arrival.
    """
    drain_batches(candidates, admit_batches(root, memory_seconds), root)
    return candidates.sparkSession.read.schema(ADMITTED).option("recursiveFileLookup", True).parquet(f"{root}/rows")
