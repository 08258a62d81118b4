"""Top-k search, Hamerly clusters and whitening against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caravel.llm import hamerly, norm_search, whitening
from caravel.llm.queries import ORACLE_SQL, QUERIES
from caravel.llm.vectors import products

KIND = "vec_id long, embedding array<float>, label int, v string, score int"


def frame(spark, rows):
    """Vectors, beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, "x", 7) for i, v in rows], KIND)


def some(n, width=64, seed=0, scale=1.0):
    r = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in row] for row in r.normal(size=(n, width)) * scale]


def code(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def best(rows, k=5, every=50):
    """All products, in Python integers."""
    kept = {(i, tuple(code(v))) for i, v in rows if sound(v)}
    out = []
    for i, q in kept:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for j, c in kept if j != i)
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = [(7, None), (8, []), (9, [1.0, None]), (10, [float("nan")] * 64), (11, [float("inf")] + [0.0] * 63), (None, [0.1] * 64)]


@pytest.mark.parametrize("start", [0.75, 0.05, 2.0])
def test_search_equals_all_products(spark, start):
    """Lengths of all sizes, copies, ties, repeats and odd rows; with mostly coordinate pruning, mostly length pruning, and length pruning only."""
    rows = [(100 + i, [x * s for x in v]) for i, (v, s) in enumerate(zip(some(400), np.random.default_rng(1).lognormal(0, 1.2, 400), strict=True))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000 + i, some(1, seed=5)[0]) for i in range(40)] + [rows[0], rows[50]] + ODD + [(0, [0.0] * 64)]
    got = norm_search.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0, bucket_rows=64, head_buckets=1, coordinate_from=start)
    assert found(got) == best(rows)


def test_search_in_passes(spark):
    rows = list(enumerate(some(150, 8)))
    got = norm_search.top_k(frame(spark, rows), F.col("vec_id") % 2 == 0, k=3, bucket_rows=16, pass_bytes=16 * 8 * 8)
    assert found(got) == best(rows, 3, 2)


def test_search_of_little(spark):
    ask = F.col("vec_id") % 50 == 0
    assert norm_search.top_k(frame(spark, []), ask).count() == 0
    assert norm_search.top_k(frame(spark, ODD[:5]), ask).count() == 0
    assert norm_search.top_k(frame(spark, [(50, [1.0])]), ask).count() == 0
    two = [(50, [1.0, -2.0]), (3, [1.0])]
    assert found(norm_search.top_k(frame(spark, two), ask)) == [(50, 1, 3, 65536)]


def test_coordinates_bound_the_cosine():
    """No vector that reaches the threshold is missed, and at a high one most are left out."""
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.normal(size=(500, 16)) / 4)
    rows[:40] = rows[0] + np.floor(r.normal(size=(40, 16)) * 6)
    block = norm_search.Block(list(range(500)), "f8", rows.tobytes(), 16)
    unit = rows[0] / np.linalg.norm(rows[0])
    cosine = (block.rows / block.lengths[:, None]) @ unit
    for local in (0.1, 0.5, 0.8, 0.95):
        assert set(np.flatnonzero(cosine >= local)) <= set(norm_search._by_coordinates(unit, local, block, 3))
    assert len(norm_search._by_coordinates(unit, 0.95, block, 3)) < 100


def test_pruning_saves_products():
    r = np.random.default_rng(3)
    rows = np.floor(256 * r.normal(size=(2000, 16)) * np.sort(r.lognormal(0, 1, 2000))[::-1, None])
    rows = rows[np.argsort(-np.linalg.norm(rows, axis=1), kind="stable")]
    blocks = [norm_search.Block(list(range(i, i + 100)), "f8", rows[i : i + 100].tobytes(), 16) for i in range(0, 2000, 100)]
    queries = norm_search.Block(list(range(5000, 5050)), "f8", rows[::40].tobytes(), 16)
    tops, counts = norm_search.Tops(50, 5), {}
    for b in blocks:
        norm_search.search_block(queries, tops, b, 0.6, counts=counts)
    assert counts["coordinate"] > 0 and sum(counts.values()) < 50 * 2000 / 2


@pytest.mark.parametrize("size", [1, 1e4, 1e9, 1e16])
def test_products_are_exact(size):
    r = np.random.default_rng(4)
    a, b = (np.floor(r.normal(size=(5, 7)) * size) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert products(a, b).tolist() == want


def lloyd(rows, k, rounds, width=64):
    kept = [(i, code(v)) for i, v in rows if sound(v) and len(v) == width]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and sound(v) and len(v) == width)
    cents = [code(v) for _, v in seeds[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            if own := [x for (_, x), o in zip(kept, of) if o == j]:
                cents[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *nearest(x)) for i, x in kept]
    every = sum(d for _, d, _ in last)
    return sorted(((i, j, d, sum(e for _, e, o in last if o == j), every, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last), key=repr)


@pytest.mark.parametrize(("k", "copies"), [(6, 0), (6, 80), (1, 3), (500, 5)])
def test_clusters_equal_lloyd(spark, k, copies):
    middles = some(5, seed=9)
    rows = [(i, [a * 0.2 + b for a, b in zip(v, middles[i % 5])]) for i, v in enumerate(some(120, seed=8))]
    rows += [(500 + i, rows[2][1]) for i in range(copies)] + [rows[0], rows[0]] + ODD + [(12, [1.0] * 63)]
    assert found(hamerly.cluster(frame(spark, rows), k=k)) == lloyd(rows, k, 5)


def test_clusters_of_nothing(spark):
    assert hamerly.cluster(frame(spark, [])).count() == 0
    assert hamerly.cluster(frame(spark, ODD[:5])).count() == 0


def test_bounds_hold_and_save_scans(spark):
    r = np.random.default_rng(6)
    rows = np.floor(256 * (r.normal(size=(3000, 8)) * 0.2 + r.normal(size=(10, 8))[r.integers(0, 10, 3000)])).astype(np.int64)
    cents = rows[:10].copy()
    state, moved, scans = None, None, []
    for _ in range(8):
        cluster, upper, lower, n = hamerly.assign(rows, cents, state, moved)
        d = np.sqrt(hamerly.squared(rows, cents))
        each = np.arange(len(rows))
        assert (cluster == d.argmin(axis=1)).all() and (upper >= d[each, cluster]).all()
        d[each, cluster] = np.inf
        assert (lower <= d.min(axis=1)).all()
        scans.append(n)
        new = np.array([np.floor_divide(rows[cluster == j].sum(axis=0), max(1, (cluster == j).sum())) if (cluster == j).any() else cents[j] for j in range(10)])
        state, moved, cents = (cluster, upper, lower), np.sqrt(np.square(new - cents).sum(axis=1)) * hamerly.UP, new
    assert scans[-1] < scans[0] / 3


def test_huge_components_are_held(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {r["vec_id"]: r for r in hamerly.cluster(frame(spark, rows), k=2).collect()}
    assert len(got) == 3 and all(r["distance"] >= 0 for r in got.values())


def whitened(rows, components=8):
    x = np.array([[math.floor(1024 * float(np.float32(a))) + 100_000 for a in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    centred = (off / n).astype(float)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    return n, (off**2).sum(axis=1), (centred @ vectors / np.sqrt(np.maximum(e, 1e-300)))[:, :components], e[:components] / e.sum()


def test_whitening_equals_eigenvectors(spark):
    mix = np.random.default_rng(11).normal(size=(64, 64)) * np.linspace(3, 0.2, 64)
    rows = [(i, [float(np.float32(x)) for x in np.array(v) @ mix + 500]) for i, v in enumerate(some(700, seed=10))]
    got = whitening.whiten(frame(spark, rows + ODD[:5] + [(12, [1.0] * 63)]).repartition(7)).collect()
    n, deviation, want, explained = whitened(rows)
    assert len(got) == 8 * len(rows)
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(abs(r["whitened"]) - abs(want[i, c])) < 1e-6 and math.isclose(r["explained"], explained[c], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
    sign = {(r["component"], r["whitened"] * want[r["vec_id"], r["component"] - 1] > 0) for r in got if abs(r["whitened"]) > 1e-3}
    assert len(sign) == 8


def test_merging_loses_nothing():
    """Any tree of merges has the singular values of all rows, also of fewer rows than dimensions."""
    r = np.random.default_rng(12)
    rows = (r.normal(size=(90, 12)) * 500).astype(np.int64) + 100_000
    parts = [whitening.Summary.of(p) for p in np.split(rows, [1, 3, 4, 30, 60])]
    one = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3])).merged(parts[4].merged(parts[5]))
    want = np.linalg.svd(rows - rows.mean(axis=0), compute_uv=False)
    assert one.n == 90 and one.sums == rows.sum(axis=0).tolist()
    assert np.allclose(one.values, want, rtol=1e-12)
    cov = (one.values[:, None] * one.vectors).T @ (one.values[:, None] * one.vectors) / 90
    assert np.allclose(cov, np.cov(rows.T, bias=True), rtol=1e-10, atol=1e-8)


def test_levels_of_merging(spark):
    rows = list(enumerate(some(200, 6, seed=13)))
    df = frame(spark, rows).repartition(150).select(F.col("embedding").alias("v"))
    one = whitening.fit(df, 6)
    x = np.array([[math.floor(1024 * a) + 100_000 for a in v] for _, v in rows])
    assert one.n == 200 and np.allclose(one.values, np.linalg.svd(x - x.mean(axis=0), compute_uv=False), rtol=1e-10)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    same = whitening.whiten(frame(spark, [(1, [0.5] * 4), (1, [0.5] * 4), (None, [0.5] * 4)])).collect()
    assert len(same) == 12 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}
    line = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert {(r["component"], r["whitened"] and abs(r["whitened"])) for r in line} == {(1, 1.0), (2, None)}
    assert whitening.whiten(frame(spark, [(1, [3e38] * 3), (2, [1.0] * 3)])).where("deviation is null").count() == 6


@pytest.mark.parametrize("name", ["op11_norm_search", "op12_hamerly"])
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.project(",".join(cols)).fetchall())


def test_ids_meet_in_arrow():
    """A list column with odd lengths becomes rows that end in zeros."""
    from caravel.llm.vectors import matrix

    assert matrix(pa.array([[1.0], [], [2.0, 3.0]])).tolist() == [[1, 0], [0, 0], [2, 3]]
