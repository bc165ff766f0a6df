"""Near-duplicate vectors and the fixity audit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.llm import vectors, warc


@pytest.mark.parametrize("sizes", [(1000, 2000), (40, 60)], ids=["whole", "blocks"])
def test_links_of_vectors(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "TARGET", sizes[0])
    monkeypatch.setattr(vectors, "SHARD", sizes[1])
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 16))
    near = base[0] + 0.03 * rng.normal(size=(90, 16))
    x = np.concatenate([base, near, base[:10] * 2.0, base[20:40] + 0.02 * rng.normal(size=(20, 16))])
    label = [k % 2 if k < 200 else 0 for k in range(len(x))]
    rows = [(k, [float(v) for v in row], int(c), "x") for k, (row, c) in enumerate(zip(x, label, strict=True))]
    odd = [
        (900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [None] + [1.0] * 15, 0, "x"),
        (904, rows[0][1], None, "x"), (905, [float("inf")] * 16, 0, "x"), (906, [], 0, "x"), (None, rows[0][1], 0, "x"),
        (907, rows[0][1][:8], 0, "x"),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int, id string")
    out = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(out) == len(rows) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    got = np.array([out[k].n_links for k in range(len(x))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    group = np.arange(len(x))
    for _ in range(len(x)):
        group = np.minimum(group, np.where(linked, group[None, :], len(x)).min(1))
    assert [out[k].component_id for k in range(len(x))] == group.tolist()
    assert all(out[r[0]].n_links == 0 and out[r[0]].kept for r in odd)
    assert out[None].component_id is None
    assert [out[k].audit_links for k in (100, 200)] == want[[100, 200]].tolist()
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_null_components_and_other_lengths_link_with_nothing(spark):
    rows = [(1, [0.6, 0.8]), (2, [0.6, 0.8, None]), (3, [None, 0.6, 0.8]), (4, [0.6, 0.8]), (5, [None, None]), (6, [0.6, 0.8, 0.0])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert [(out[k].n_links, out[k].component_id, out[k].kept) for k in range(1, 7)] == [
        (1, 1, True), (0, 2, True), (0, 3, True), (1, 1, False), (0, 5, True), (0, 6, True),
    ]


@pytest.mark.parametrize("ids", [range(1, 121, 2), [99, 100, 101, 103]])
def test_audit_asks_through_classes_and_of_other_ids(spark, ids):
    """Id 100 equals 99; odd ids alone are audited by hash or all."""
    df = spark.createDataFrame(
        [(k, [1.0, 0.01 * (k // 2 if k < 99 else 50)], 0) for k in ids], "vec_id long, embedding array<double>, label int"
    )
    out = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    audited = {k: r for k, r in out.items() if r.audit_links is not None}
    assert audited and all(r.audit_links == r.n_links for r in audited.values())
    assert 100 not in out or 100 in audited


def concentrated(spark):
    """Vectors of one label, of which a third lie near each other, and of a small label."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    hot = centre / np.linalg.norm(centre) + np.sqrt((1 / 0.985 - 1) / 64) * rng.normal(size=(500, 64))
    x = np.concatenate([rng.normal(size=(1000, 64)), hot, rng.normal(size=(60, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, [float(v) for v in row], int(k >= 1500)) for k, row in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.mark.parametrize("nearest", [2, 4])
def test_a_group_of_near_vectors_shares_shards(spark, monkeypatch, nearest):
    monkeypatch.setattr(vectors, "TARGET", 20)
    x, df = concentrated(spark)
    classes = vectors.usable(df)
    rows = vectors._shards(classes, vectors.centroids(classes), nearest).where("label = 0").collect()
    held = {r.id: set(r.shards) for r in rows}
    links = np.argwhere(np.triu(x[1000:1500] @ x[1000:1500].T >= 0.98, 1)) + 1000
    assert len(links) > 20_000
    assert np.mean([bool(held[a] & held[b]) for a, b in links.tolist()]) > 0.98


def test_the_sample_is_cut_per_label_before_the_driver(spark):
    _, df = concentrated(spark)
    drawn = vectors._drawn(vectors.usable(df), {(0, 64): 50, (1, 64): 2})
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {0: 800, 1: 32}


def test_links_count_once_whatever_shards_they_share(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TARGET", 60)
    monkeypatch.setattr(vectors, "SHARD", 120)
    x, df = concentrated(spark)
    members = vectors.usable(df).where("label = 0")
    # As after a failed audit: more shards than two for each vector.
    found = vectors._find(vectors._shards(members, vectors.centroids(members), 4), 0.98, 96, 64)
    got = {r.id: r.n for r in found.groupBy("id").agg(F.sum("links").alias("n")).collect()}
    linked = x[:1500] @ x[:1500].T >= 0.98
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert all(got.get(k, 0) <= want[k] for k in range(1500))
    assert sum(got.values()) >= 0.95 * want.sum()


def pages(spark, n=3000):
    rows = [(k, f"http://a/{k}", "p" * (k % 900)) for k in range(n)] + [(5, "http://a/5", "ppppp")] * 3
    rows += [(None, None, None), (7, None, "other"), (7, "", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_finds_exactly_the_damage(spark):
    source = warc.manifest(pages(spark)).drop("stored")
    changed = source.withColumn("digest", F.when(F.col("page_id").isin(3, 1500), F.lit("0")).otherwise(F.col("digest")))
    replica = changed.where("page_id is null or page_id <> 2048").union(
        source.where("page_id = 9").withColumn("offset", F.lit(1 << 40))
    )
    out = {(r.page_id, r.kind) for r in warc.audit(source, replica).collect()}
    assert out == {(3, "altered"), (1500, "altered"), (2048, "missing"), (9, "extra")}
    assert warc.audit(source, source).count() == 0
    assert warc.audit(source.limit(0), source.limit(0)).count() == 0
    assert warc.audit(source, source.limit(0)).count() == source.count()


def test_offsets_are_gapless(spark):
    rows = warc.manifest(pages(spark)).toPandas().sort_values(["archive", "offset"])
    for _, part in rows.groupby("archive"):
        ends = (part.offset + part.length * part.copies).tolist()
        assert part.offset.tolist() == [0, *ends[:-1]]
    assert rows.copies.sum() == 3006
    assert rows[rows.page_id == 5].copies.tolist() == [4]
