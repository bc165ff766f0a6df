"""URL filter: rules first, then the ratio of two character models (operator 8).

URLs that a rule decides train one smoothed variable-order Markov model for
accepted and one for rejected URLs.  The others are judged by the difference of
the two log-likelihoods per byte, against a threshold calibrated on a fifth of
the decided URLs that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.llm import bytemodel

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path); fixed values.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)
FOLDS = 5
_BINS_PER_BIT = 200


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    fits = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, below = rule.partition("/")
        hit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + below)
        fits, verdict = F.when(hit, F.lit(rule)).otherwise(fits), F.when(hit, F.lit(action)).otherwise(verdict)
    return fits, verdict


def threshold(scores: DataFrame) -> float:
    """The least score to accept: best mean of both classes' recall on ``(score, verdict)``.

    Works on counts per bin of the score, whose range is bounded by the model.
    Of equally good thresholds the one nearest to 0, even likelihoods, counts.
    0 without scores of both classes.
    """
    rows = (
        scores.groupBy(F.floor(F.col("score") * _BINS_PER_BIT).alias("bin"))
        .agg(F.count_if(F.col("verdict") == ALLOW).alias("good"), F.count_if(F.col("verdict") == BLOCK).alias("bad"))
        .orderBy("bin")
        .collect()
    )
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return 0.0
    best, passed_bad, passed_good, low = (-1.0, 0, 0), bad, good, rows[0].bin
    for r in rows:
        # Any threshold above the bin before and up to this one accepts the same.
        at = min(max(0, low), r.bin)
        value = passed_good / good + (bad - passed_bad) / bad
        best = max(best, (round(value, 9), -abs(at), at))
        passed_good, passed_bad, low = passed_good - r.good, passed_bad - r.bad, r.bin + 1
    return best[2] / _BINS_PER_BIT


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``pages`` has ``page_id`` and ``url``; other columns are not read.
    ``verdict`` is the rule's, else ``allow`` where ``score`` (log-likelihood
    difference per byte, in bits) reaches the calibrated threshold.  A URL
    without host and path and a table without accepted or rejected URLs leave
    nothing to compare: score 0 and ``allow``.  Repeated rows each get a row.
    """
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text"))
    fold = F.crc32(F.col("text")) % FOLDS
    seen = rows.where((fold != 0) & F.col("ruled").isNotNull()).select(F.col("ruled").alias("kind"), "text")
    model = bytemodel.freeze(bytemodel.window_counts(seen), "witten_bell")
    if model is None or model.kinds != [ALLOW, BLOCK]:
        plain = F.coalesce("ruled", F.lit(ALLOW)).alias("verdict")
        return rows.select("page_id", "host", "path", "rule", plain, F.lit(0.0).alias("score"))
    score = F.when(F.col("n_bytes") > 0, (F.col("bits")[1] - F.col("bits")[0]) / F.col("n_bytes")).otherwise(0.0)
    unseen = rows.where((fold == 0) & F.col("ruled").isNotNull()).select(F.col("ruled").alias("verdict"), "text")
    least = threshold(bytemodel.scored(unseen, "text", model).select(score.alias("score"), "verdict"))
    ruled = (F.col("n_bytes") == 0) | (F.col("score") >= least)
    return (
        bytemodel.scored(rows, "text", model)
        .withColumn("score", score)
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("ruled", F.when(ruled, ALLOW).otherwise(BLOCK)).alias("verdict"),
            "score",
        )
    )
