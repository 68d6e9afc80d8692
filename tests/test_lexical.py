"""Many questions at once against the search of one."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import lexical, search

SF = "/root/testdata/sf0.001"
SCHEMA = "chunk_id string, text string, source_name string, theme_id string, collection string, theme_name string, domain_tags array<string>, entity_ids array<string>, graph_boost double, numeric_fact_count int, object_type string, key string"


def rows_of(spark):
    long = "filler words go on " * 60
    rows = [
        ("a1", "Nickel matte, nickel slag and copper", "nickel.pdf", "t1", "metals", "nickel works", ["nickel"], ["onto:nickel"], 2.0, 3, "title", "x"),
        ("a2", "Nickel matte, nickel slag and copper", "nickel.pdf", "t1", "metals", "nickel works", None, None, None, None, None, "x"),
        ("a3", "Copper at 5 % of the matte", "copper.pdf", "t2", "metals", None, [], [], 0.0, 0, "body", "x"),
        ("a4", long + "nickel matte is here " + long, "long.pdf", "t2", "metals", None, None, None, 1.0, 1, None, "x"),
        ("a5", long + "another nickelmatte is here " + long, "long.pdf", "t2", None, None, None, None, 1.0, 1, None, "x"),
        ("a6", None, "nickel.pdf", "t3", None, None, None, None, None, None, None, None),
        ("a7", "", None, None, None, None, None, None, None, None, None, None),
        ("a8", "Печь при 5 мг/л, ёмкость и никель", "печь.pdf", "t4", "руда", "никель", ["никель"], None, None, None, None, "x"),
        (None, "nickel without a key", None, None, None, None, None, None, None, None, None, None),
    ]
    copies = [(f"b{i}", "the same copied nickel text", "copies.pdf", "t5", "metals", None, None, None, float(i % 3), 0, None, "x") for i in range(60)]
    return spark.createDataFrame(rows + copies, SCHEMA)


QUESTIONS = [
    "nickel matte", "Nickel matte, nickel slag", "matte is", "copper 5 %", "the", "", None, "никель и ёмкость печи", "nickel.pdf metals", "zzz",
    "words go on filler words", "ickel", "copied nickel text", "of the matte",
]


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append((r.key, r.score))
        assert r.rank == len(out[r.query])
    return out


def one_by_one(rows, questions, k):
    out = {}
    for i, q in enumerate(questions):
        got = [(r.chunk_id, r.score) for r in search.search(rows, q or "", k).collect()]
        if got:
            out[i] = got
    return out


@pytest.fixture(scope="module")
def wanted(spark):
    return one_by_one(rows_of(spark).where("chunk_id IS NOT NULL").coalesce(1), QUESTIONS, 50)


@pytest.mark.parametrize("block,shard", [(lexical.BLOCK_BYTES, lexical.SHARD_ROWS), (40, 3)])
def test_same_as_one_by_one(spark, wanted, monkeypatch, block, shard):
    """Nulls, empty and long texts, copies, phrases across word ends, rows that score without a match; also in small blocks and shards."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "SHARD_ROWS", shard)
    rows = rows_of(spark)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query int, question string")
    index = lexical.build_index(rows.repartition(3))
    for k in (1, 4, 50):
        assert found(lexical.search_batch(index, asked, k)) == {q: hits[:k] for q, hits in wanted.items()}


def test_documents_and_repeated_questions(spark):
    from lodestar.plans.text_queries import chunks

    rows = chunks(spark, SF).coalesce(4).cache()
    texts = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").orderBy("conv_id", "turn").limit(4).collect()]
    part = rows.where("length(text) > 1000").select(F.substring("text", 901, 60).alias("t")).orderBy("t").first().t
    texts = [*texts, part, texts[0]]
    asked = spark.createDataFrame(list(enumerate(texts)), "query int, question string")
    got = found(lexical.search_batch(lexical.build_index(rows), asked, 8))
    want = one_by_one(rows, texts, 8)
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items()}
    assert all(a[1] == pytest.approx(b[1]) for q in want for a, b in zip(got[q], want[q]))
    assert got[0] == got[len(texts) - 1]


def test_empty_tables(spark):
    rows = rows_of(spark)
    asked = spark.createDataFrame([(1, "nickel")], "query int, question string")
    assert lexical.search_batch(lexical.build_index(rows.limit(0)), asked).count() == 0
    assert lexical.search_batch(lexical.build_index(rows), asked.limit(0)).count() == 0


def test_a_shard_scores_many_questions_at_once():
    """Frequent tokens as rows of gains, rare ones by lists, phrases on top: as added up one question and row at a time."""
    import random

    import numpy as np
    import pyarrow as pa

    rng, n = random.Random(5), 300
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=30)) for _ in range(n)]
    boost = [rng.random() for _ in range(n)]
    plain = pa.array([""] * n)
    names = ["key", "source", "clean", "hay", "low", "tokens", "name", "place", "marked", "meta", "boost"]
    columns = [pa.array([f"k{i:03}" for i in range(n)]), plain, pa.array(texts), pa.array(texts), pa.array([len(t) for t in texts]), pa.array([t.split() for t in texts]), plain, plain, plain, plain, pa.array(boost)]
    asked = [" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(lexical.AT_ONCE + 40)] + [texts[7][3:40]]
    block = lexical.Block(list(enumerate(asked)))
    shard = lexical.Shard(pa.record_batch(columns, names=names), block, pa.array(block.tokens, pa.string()))
    got = dict(shard.best(8, np.zeros(len(asked))))
    assert len(shard.gains) > 1 and (shard.column < 0).any()  # some tokens are scored in one way, some in the other
    for number, text in enumerate(asked):
        score = [sum(1 + np.log1p(t.split().count(w)) for w in set(text.split()) if w in t.split()) + 8.0 * (text in t) + b for t, b in zip(texts, boost)]
        best = sorted(((-round(s, 4), f"k{i:03}") for i, s in enumerate(score)))[:8]
        assert [(-s, k) for s, k, _ in got[number]] == [(pytest.approx(s), k) for s, k in best]
