"""Importance resampling, circulant MinHash and ranked search against brute force, on edge cases and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import minhash, ranked_search, resample
from lodestar.workspace import Workspace

LONG = "lorem ipsum dolor sit " * 30_000
EDGES = [
    (1, "one two three four five six seven " * 4, "a"),
    (2, "One TWO three four five six seven " * 4, "a"),
    (2, "One TWO three four five six seven " * 4, "a"),
    (2, "quite another text than before, of one id " * 3, "a"),
    (3, None, None),
    (4, "", ""),
    (5, " \t\n\x0b ", "a"),
    (6, LONG, "b"),
    (7, "ÀÉ 日本 😀 x\r\ny", "b"),
    (8, "word", "b"),
    (9, "word", "b"),
    (10, "!!! ... ???", "b"),
    (None, "one two three four five six seven " * 4, "a"),
    (None, None, None),
]
TARGET = [(1, "one two three", "x"), (1, "four lorem", "x"), (None, "ÀÉ word", "x"), (3, None, "x"), (4, "", "x"), (5, "nowhere", "x"), (1, "one two three", "x")]
CLASHES = "fp rep component_id digest node n keys root id item query score rank pilot part place row fit terms tfs side task bytes weight offsets buckets".split()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(TARGET, "item_id int, text string, term string")


def words(pattern, text):
    return re.findall(pattern, (text or "").encode().lower())


# 11 importance resampling


def slow_resample(docs, target, runs=1, buckets=10_000, percent=10, least=20):
    def features(text):
        w = words(rb"[0-9a-z\x80-\xff]+", text)
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    own, aimed = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in aimed for b in f)
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for (d, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append((d, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return Counter(rows), [(r[4], r[0]) for r in fit[: percent * len(fit) // 100]]


@pytest.mark.parametrize("options", [{}, {"runs": 3, "buckets": 97, "percent": 60}, {"percent": 100, "least_words": 0}, {"percent": 0}])
def test_resample_edges(spark, edges, target, options):
    got = resample.importance_resample(edges, target, **options).collect()
    slow = {"least" if k == "least_words" else k: v for k, v in options.items()}
    rows, drawn = slow_resample([r[:2] for r in EDGES], [r[1] for r in TARGET], **slow)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == rows
    ranked = sorted((r.rank, r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[1:] for r in ranked] == drawn


def test_resample_streams_cut_anywhere(spark, edges, target, monkeypatch):
    whole = {tuple(r) for r in resample.importance_resample(edges, target).collect()}
    monkeypatch.setattr(resample, "PACKET", 3)
    assert {tuple(r) for r in resample.importance_resample(edges, target).collect()} == whole


def test_resample_empty_tables(spark, edges, target):
    assert resample.importance_resample(edges.limit(0), target).collect() == []
    assert len(resample.importance_resample(edges, target.limit(0)).collect()) == len(EDGES)
    with pytest.raises(ValueError):
        resample.importance_resample(edges, target, buckets=1 << 17)


def test_resample_ranks_of_many_equal_rows(spark, target):
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("one two three " * 10).alias("text")).repartition(7)
    got = resample.importance_resample(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1501))


# 12 MinHash


def slow_components(docs, width=2, percent=80):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def components(df, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.minhash_components(df, **options).collect())


@pytest.mark.parametrize("width", [1, 2, 5])
def test_minhash_edges(spark, edges, width):
    assert components(edges, shingle=width) == slow_components([r[:2] for r in EDGES], width)
    assert minhash.minhash_components(edges.limit(0)).collect() == []
    kept = {r.doc_id: r.kept for r in minhash.minhash_components(edges).collect()}
    assert kept[None] is True and kept[1] is True


def near(rng, base, changes, fresh):
    out = list(base)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"w{next(fresh)}"
    return " ".join(out)


@pytest.mark.parametrize("percent", [60, 80])
def test_minhash_of_groups_around_the_limit(spark, percent, monkeypatch):
    """Chains, strays and templates on either side of the limit, with sets dealt out in many small cells."""
    monkeypatch.setattr(minhash, "PART_BYTES", 4000)
    monkeypatch.setattr(minhash, "TASK_BYTES", 9000)
    monkeypatch.setattr(minhash, "GRID_BYTES", 5000)
    rng, fresh = random.Random(3), iter(range(10**9))
    docs = []
    for _ in range(6):
        base = [f"b{next(fresh)}" for _ in range(rng.randint(8, 120))]
        docs += [near(rng, base, rng.randint(0, max(1, len(base) // 12)), fresh) for _ in range(25)]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = slow_components(docs, percent=percent)
    assert 3 < len({c for _, _, c in want}) < len(docs)  # some link, some don't
    assert components(df, percent=percent) == want


def test_template_below_the_limit_makes_no_pairs(spark, monkeypatch):
    """8,000 texts that share 100 of 114 shingles each: all pairs are at 0.78, none is written."""
    shared = [f"c{i}" for i in range(101)]
    texts = [(d, " ".join([*shared, *(f"u{d}x{i}" for i in range(14))])) for d in range(8000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    rows, save = {}, Workspace.save

    def counted(self, df, name):
        out = save(self, df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(Workspace, "save", counted)
    got = minhash.minhash_components(docs).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 114 for r in got) and len(got) == 8000
    assert max(n for name, n in rows.items() if name in ("links", "stars of centres", "stars")) <= 8000
    assert rows["cells"] < 100 * 8000
    a, b = (minhash.shingle_set(minhash.words_of(t), 2) for _, t in texts[:2])
    assert minhash.common(a, b) == 100


def test_permutations_are_permutations():
    """Each step of both can be undone, so no two positions meet."""
    x = np.random.default_rng(0).integers(0, 1 << 32, 1 << 20, np.uint32)
    x = np.unique(x)
    assert len(np.unique(minhash._first(x))) == len(x)
    assert len(np.unique(minhash._second(x.copy()))) == len(x)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 4000
        both = rng.integers(0, 1 << 63, int(n * share), np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (n - len(both)) // 2, np.uint64)])) for _ in range(2))
        alike = minhash.common(a, b) / (len(a) + len(b) - minhash.common(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - alike) < 0.12


# 13 ranked search


def slow_search(docs, items, top):
    pattern = rb"[0-9a-z\x80-\xff]+"
    found = [(d, Counter(words(pattern, t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in found:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = 0
            for t in set(words(pattern, text)):
                df, tf = sum(t in x for _, x in found), c[t]
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return Counter(out)


@pytest.mark.parametrize("top", [1, 3, 50])
def test_search_edges(spark, edges, target, top, monkeypatch):
    monkeypatch.setattr(ranked_search, "PILOT", 2)
    got = ranked_search.ranked_search(edges, target, top).collect()
    assert Counter(map(tuple, got)) == slow_search([r[:2] for r in EDGES], [r[:2] for r in TARGET], top)


def test_search_empty_tables(spark, edges, target):
    assert ranked_search.ranked_search(edges.limit(0), target).collect() == []
    assert ranked_search.ranked_search(edges, target.limit(0)).collect() == []
    assert ranked_search.ranked_search(edges.where("doc_id = 4"), target).collect() == []


@pytest.mark.parametrize("settings", [{}, {"WINDOW": 3, "SHARD_DOCS": 40, "PILOT": 4}, {"BLOCK_BYTES": 200, "SHARD_POSTINGS": 100}])
def test_search_of_skewed_words(spark, settings, monkeypatch):
    """Common and rare words, copies that tie, shards and windows of any size, queries in blocks."""
    for name, value in settings.items():
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(100)]  # ties
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(99, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranked_search.ranked_search(df, spark.createDataFrame(items, "item_id long, text string"), 20).collect()
    assert Counter(map(tuple, got)) == slow_search(docs, items, 20)


def test_shard_skips_what_cannot_beat_the_heap():
    """A rare term's documents are scored, windows with the common term alone are not."""
    docs = 128 * 200
    rows = np.concatenate([np.arange(docs), np.arange(0, docs, 1280)])
    terms = np.concatenate([np.zeros(docs, np.int64), np.ones(len(rows) - docs, np.int64)])
    shard = ranked_search.Shard(terms, rows, np.where(terms == 1, 1000, 1 + rows % 7))
    looked, window = [], shard._window
    shard._window = lambda pivot, here, beat: looked.append(pivot) or window(pivot, here, beat)
    found = shard.search([0, 1], 1, 5)
    scores = 1 + np.arange(docs) % 7 + np.where(np.arange(docs) % 1280 == 0, 1000, 0)
    best = sorted(range(docs), key=lambda d: (-scores[d], d))[:5]
    assert sorted(found, key=lambda x: (-x[0], x[1])) == [(int(scores[d]), d) for d in best]
    assert len(looked) < 70
