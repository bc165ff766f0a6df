"""Small row builders and brute-force versions for tests."""

from __future__ import annotations

from datetime import datetime, timedelta

RESULT = (
    "project string, objective string, fingerprint string, run_id string, "
    "status string, metric_name string, metric_value double, completed_at timestamp"
)
START = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return START + timedelta(microseconds=round(seconds * 1_000_000))


def results(spark, rows):
    """rows: (project, objective, fingerprint, run_id, status, metric[, second])."""
    full = [(*r[:5], "loss", r[5], at(r[6] if len(r) > 6 else i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RESULT)


def contract_table(spark, *rows):
    """rows: (name, objective, limit)."""
    from trialframe.sources.contracts import with_defaults

    df = spark.createDataFrame(
        [(n, "loss", o, k) for n, o, k in rows],
        "name string, metric string, objective string, leaderboard_limit int",
    )
    return with_defaults(df)


def board_by_loop(rows, objective, limit):
    """Scan rows in file order, keep the best per fingerprint, sort, cut."""
    sign = 1 if objective == "minimize" else -1
    best = {}
    for row in sorted(rows, key=lambda r: (r[2], r[3])):
        if row[4] in ("completed", "keep"):
            seen = best.get(row[2])
            if seen is None or sign * row[5] < sign * seen[5]:
                best[row[2]] = row
    order = sorted(best.values(), key=lambda r: sign * r[5])
    return len(best), [(r[2], r[3], r[5]) for r in order[:limit]]
