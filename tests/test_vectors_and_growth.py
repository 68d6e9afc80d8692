"""The vector index against brute force, and graphs that grow against whole runs."""

import numpy as np
import pytest

from lodestar.operators import graph, vectors
from lodestar.operators.components import connected_components, grown_components
from lodestar.workspace import Workspace

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, cell string"


def brute(rows, queries, k):
    def unit(v, size):
        v = np.array(v if v is not None and len(v) == size else np.zeros(size), np.float64)
        n = np.sqrt(v @ v)
        return v / n if n > 0 and np.isfinite(n) else np.zeros(size)

    size = 4
    has = [(i, unit(v, size)) for i, v in rows if i is not None]
    out = {}
    for q, v in queries:
        like = sorted((-np.floor(float(unit(v, size) @ x) * 1e4 + 0.5) / 1e4, i) for i, x in has)
        out[q] = [(i, -s) for s, i in like[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.id, pytest.approx(r.similarity)))
        assert r.rank == len(out[r.query])
    return out


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 4))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=4)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(n, None), (n + 1, [0.0] * 4), (n + 2, [1.0, 2.0]), (n + 3, []), (None, [1.0] * 4)]
    return rows + odd + [(n + 4 + i, rows[5][1]) for i in range(9)]  # and ties


@pytest.mark.parametrize("block", [vectors.BLOCK_BYTES, 8 * 4 * 16])
def test_index_is_exact(spark, monkeypatch, block):
    """Also where cells and questions are dealt out in blocks of 16; nulls, zeros, other sizes, ties and more than there are."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
    rows = sample(300)
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    index = vectors.build_index(docs)
    assert index.rows.count() == len(rows) - 1
    queries = [r for r in rows if r[0] is not None and (r[0] % 7 == 0 or r[0] >= 300)]
    asked = docs.where("vec_id % 7 = 0 OR vec_id >= 300")
    for k in (1, 12, 400):
        assert found(vectors.nearest_batch(index, asked, k, probe=2)) == brute(rows, queries, k)


def test_cells_out_of_reach_are_not_read(spark, monkeypatch):
    rows = sample(600)[:600]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    seen = []
    scanned = vectors._scanned
    monkeypatch.setattr(vectors, "_scanned", lambda index, asked, wanted, k, size: (seen.append(wanted.count()), scanned(index, asked, wanted, k, size))[1])
    index = vectors.build_index(docs, cells=6)
    got = found(vectors.nearest_batch(index, docs.where("vec_id < 12"), 5, probe=1))
    assert got == brute(rows, rows[:12], 5)
    assert seen[0] == 12 and seen[1] <= 12  # of 60 others


def test_recall_of_the_first_cells(spark):
    """Cells are counted on other questions than those that recall is measured for."""
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    index, asked = vectors.build_index(docs), docs.where("vec_id % 50 = 0")
    probe = vectors.probe_for(index, docs.where("vec_id % 50 <> 0"), 10, 0.95)
    assert 1 < probe < index.cells.count()
    all_of, some = vectors.nearest_batch(index, asked, 10), vectors.nearest_batch(index, asked, 10, probe=probe, exact=False)
    shared = all_of.select("query", "id").intersect(some.select("query", "id")).count()
    assert all_of.count() == 100 and shared >= 90


def test_empty_index_and_no_questions(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, None, None)], SCHEMA)
    assert vectors.nearest_batch(vectors.build_index(none), some, 3).count() == 0
    assert vectors.nearest_batch(vectors.build_index(some), none, 3).count() == 0
    assert vectors.probe_for(vectors.build_index(none), some, 3) == 0 == vectors.probe_for(vectors.build_index(some), none, 3)
    only = spark.createDataFrame([(1, None, "x"), (2, None, "x")], SCHEMA)
    assert found(vectors.nearest_batch(vectors.build_index(only), some, 1)) == {1: [(1, 0.0)], 2: [(1, 0.0)]}


def test_components_grow(spark):
    rng, ws = np.random.default_rng(5), Workspace(spark, "test")
    edges = [tuple(map(int, e)) for e in rng.integers(0, 400, (330, 2))] + [(7, 7), (None, 3), (3, None)]
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    got = connected_components(make(edges[:0]), ws)
    for start in range(0, len(edges), 111):
        got = ws.save(grown_components(got, make(edges[start : start + 111])), "grown")
    pairs = lambda df: sorted(map(tuple, df.select("node", "root").collect()))
    assert pairs(got) == pairs(connected_components(make(edges), Workspace(spark, "whole")))
    assert pairs(grown_components(got, make([]))) == pairs(got)


def test_degrees_grow(spark):
    make = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    old, new = [("a", "b"), ("b", "c"), ("d", "d")], [("b", "a"), ("a", "c"), ("c", "a"), ("e", "e"), ("d", "f"), ("d", "f")]
    ids = lambda rows: spark.createDataFrame(sorted({(x,) for e in rows for x in e}), "id string")
    got = graph.grown_degrees(graph.degrees(ids(old), make(old)), make(old), make(new))
    want = graph.degrees(ids(old + new), make(old + new))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
