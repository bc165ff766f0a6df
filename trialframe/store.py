"""One directory with results, lease events, artifacts and the leaderboard."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from trialframe.operators.admission import admit
from trialframe.operators.leaderboard import leaderboard_snapshot
from trialframe.operators.leases import lease_states
from trialframe.schemas import RESULT_SCHEMA
from trialframe.sources import writers
from trialframe.sources.readers import read_results

_EVENTS = (
    "project string, fingerprint string, agent_id string, kind string, "
    "ts timestamp, event_id string, ttl_seconds double"
)


class TrialStore:
    """Tables of one collection of projects, under ``root``.

    ``contracts`` is a table with defaults filled in.  All state is
    append-only; lease state and leaderboard are computed from it.
    """

    def __init__(self, spark: SparkSession, root: str, contracts: DataFrame):
        self.spark = spark
        self.root = root.rstrip("/")
        self.contracts = contracts

    def _read(self, name: str, schema) -> DataFrame:
        path = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        return self._read("results", RESULT_SCHEMA)

    def lease_events(self) -> DataFrame:
        return self._read("lease_events", _EVENTS)

    def write_results(self, results: DataFrame) -> None:
        writers.append_results(results, f"{self.root}/results")

    def write_artifacts(self, artifacts: DataFrame) -> None:
        writers.write_artifacts(artifacts, f"{self.root}/artifacts")

    def record_lease_events(self, events: DataFrame) -> None:
        """Append accepted claims, refreshes and releases."""
        events.select(*self.lease_events().columns).write.mode("append").parquet(
            f"{self.root}/lease_events"
        )

    def leases(self, as_of: Column) -> DataFrame:
        return lease_states(self.lease_events(), as_of)

    def live_claims(self, as_of: Column) -> DataFrame:
        return self.leases(as_of).where("state = 'open'")

    def admit(self, candidates: DataFrame, as_of: Column) -> DataFrame:
        """Decide candidates against stored results and leases live at ``as_of``."""
        held = self.live_claims(as_of).selectExpr(
            "project", "fingerprint", "lease_start AS claimed_at",
            "lease_end AS expires_at",
        )
        return admit(candidates, self.results(), held)

    def rebuild_leaderboard(self) -> DataFrame:
        snapshot = leaderboard_snapshot(self.results(), self.contracts)
        return writers.republish(snapshot, f"{self.root}/leaderboard")

    def leaderboard(self) -> DataFrame:
        """The published leaderboard, built first when there is none."""
        return writers.read_published(
            self.spark, f"{self.root}/leaderboard",
            lambda: leaderboard_snapshot(self.results(), self.contracts),
        )


__all__ = ["TrialStore", "read_results"]
