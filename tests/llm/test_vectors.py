"""Whitening and top-k search against plain versions."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquetry.llm import topk, whitening
from marquetry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def numbers(seed, n, d):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32).tolist()


V = numbers(1, 30, 6)
#: Null, empty, odd entries, equal vectors, ids that repeat or are null, other lengths, huge entries.
ODD = [
    *[(i, v) for i, v in enumerate(V)],
    *[(100 + i, V[3]) for i in range(40)],
    (50, V[5]),
    (50, V[5]),
    (50, V[6]),
    (150, [0.0] * 6),
    (None, V[3]),
    (None, V[7]),
    (200, None),
    (201, []),
    (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
    (300, [1.0, NAN, 0.0, 0.0, 0.0, 0.0]),
    (350, [1.0, INF, 0.0, 0.0, 0.0, -INF]),
    (400, [1.0, 2.0]),
    (401, [1.5, -2.0]),
    (402, [0.5, -2.0]),
    (450, [3.0e38, -3.0e38, 1.0]),
    (451, [-3.0e38, 3.0e38, 1.0]),
    (-50, V[9]),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clash = ("x", "d", "i", "n", "q", "score", "own", "rank", "component", "query_id", "deviation")
    return df.select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    out = {"odd": frame(spark, ODD), "none": frame(spark, [])}
    if os.path.isdir(SF):
        out["sf"] = spark.read.parquet(f"{SF}/embeddings.parquet")
    return out


def plain(df, scale, plus=0):
    out = []
    for i, v in ((r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()):
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, tuple(int(max(-(2.0**61), min(2.0**61, math.floor(c * scale)))) + plus for c in v)))
    return out


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_whitening(tables, which):
    df = tables[which]
    rows = plain(df, 64, 1_000_000)
    got: dict = {}
    for r in whitening.whiten(df).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert sum(map(len, got.values())) == sum(min(16, len(x)) for _, x in rows)
    for d in {len(x) for _, x in rows}:
        fit = sorted({x for _, x in rows if len(x) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        y = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
        e, u = np.linalg.eigh(y.T @ y / n)
        e, u = e[::-1], u[:, ::-1]
        some = e > 1e-12 * e.sum()
        signs: dict = {}
        for i, x in rows:
            if len(x) != d:
                continue
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            for k in range(min(16, d)):
                found = [r for r in got[i, k + 1] if r["n"] == n and (r["deviation"] is None or int(r["deviation"]) == dev)]
                assert found and (dev < 10**38) == (found[0]["deviation"] is not None)
                assert math.isclose(found[0]["explained"], e[k] / e.sum() if some[k] else 0.0, rel_tol=1e-6, abs_tol=1e-12)
                assert found[0]["identity_error"] <= 1e-9
                want = float(np.array([float(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ u[:, k] / math.sqrt(e[k])) if some[k] else 0.0
                if abs(want) > 1e-3 and d > 3:
                    sign = signs.setdefault(k, 1 if found[0]["whitened"] * want > 0 else -1)
                    assert any(math.isclose(r["whitened"] * sign, want, rel_tol=1e-5, abs_tol=1e-7) for r in found)
                if not some[k]:
                    assert found[0]["whitened"] == 0.0


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_jacobi_keeps_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    scale = np.logspace(0, -7, d)
    a = scale[:, None] * (q @ np.diag(np.linspace(1, 2, d)) @ q.T) * scale
    e, v = whitening.jacobi(a)
    assert np.all(np.diff(e) <= 0) and np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    inverse = np.linalg.inv(q @ np.diag(np.linspace(1, 2, d)) @ q.T) / scale[:, None] / scale
    assert math.isclose(1 / e[-1], np.linalg.eigvalsh(inverse)[-1], rel_tol=1e-10)  # the least one, told by the inverse


def test_jacobi_of_zero_and_equal_diagonals():
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    e, _ = whitening.jacobi(np.ones((4, 4)))
    assert np.allclose(e, [4, 0, 0, 0])


def wanted(rows, every, k):
    out = []
    for at, (i, q) in enumerate(rows):
        if i is not None and i % every == 0:
            scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, x, strict=True)))), j is None, j or 0, j) for o, (j, x) in enumerate(rows) if o != at and len(x) == len(q)]
            out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_top_k(tables, which):
    df = tables[which]
    got = sorted((tuple(r) for r in topk.search(df).collect()), key=str)
    assert got == wanted(plain(df, 256), 50, 5)


def test_top_k_over_many_shards(tables, monkeypatch):
    """Small shards, groups and blocks give the same rows."""
    rows = plain(tables["odd"], 256) + [(i, tuple(x)) for i, x in enumerate(np.random.default_rng(3).integers(-9, 9, (400, 6)).tolist(), 1000)]
    x, ids = np.array([r[1] for r in rows if len(r[1]) == 6]), np.array([-1 if r[0] is None else r[0] for r in rows if len(r[1]) == 6])
    none = np.array([r[0] is None for r in rows if len(r[1]) == 6])
    own = np.flatnonzero(~none & (ids % 50 == 0))
    queries = (np.arange(len(own)), ids[own], x[own])
    one = topk.search_group(x, ids, none, queries, 5)
    for shard, block, rest in ((7, 3, 0), (64, 2, 8), (100, 50, 1000)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk.search_shard, "__defaults__", (rest,))
        got = topk.search_group(x, ids, none, queries, 5)
        assert all((a == b).all() for a, b in zip(one, got, strict=True))


def test_lists_stop_early():
    """Where few entries decide, most of the lists stay unread."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 3, (4096, 8))
    x[:10] += 1000
    depths = []
    read = topk.Lists.go_on
    try:
        topk.Lists.go_on = lambda self, depth: depths.append(depth / self.m) or read(self, depth)
        found = [np.unique(c) for _, c, _ in topk.search_shard(np.abs(x[:2]), x, np.full(2, -np.inf), 6, rest=32)]
    finally:
        topk.Lists.go_on = read
    assert max(depths) <= 1 / 8 and len(np.concatenate(found)) <= 64


@pytest.mark.parametrize("operator", [whitening.whiten, topk.search])
def test_empty_tables(tables, operator):
    assert operator(tables["none"]).count() == 0


def test_queries(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert dict(QUERIES["op11_whitening"](spark, SF).dtypes)["deviation"] == "bigint"
    assert QUERIES["op12_topk"](spark, SF).count() == 50


def test_shared_folder_has_a_scheme(spark, monkeypatch, tmp_path):
    """Arrow and Spark open the same folder, whatever Hadoop's default file system is; a cluster must name one."""
    from marquetry.llm import common

    assert common.shared_dir(spark).startswith("file:/")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://elsewhere/")
        conf.set("fs.viewfs.mounttable.elsewhere.link./ckpt", f"file:{tmp_path}")
        monkeypatch.setattr(common, "_named", lambda spark: "/ckpt/")
        assert common.shared_dir(spark) == "viewfs://elsewhere/ckpt"
    finally:
        conf.set("fs.defaultFS", before)
    monkeypatch.setattr(common, "_named", lambda spark: None)
    monkeypatch.setattr(common, "_is_local", lambda spark: False)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)
