"""Queries against their SQL, and operators, on inputs that the test tables don't hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.text import compact
from lodestar.operators import extraction, kg, search
from lodestar.plans import catalog, fixtures

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name):
    db = duckdb.connect()
    for p in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = db.execute(catalog.SQL[name]).fetchdf()
    got = catalog.QUERIES[name](spark, str(folder)).toPandas()[list(rows.columns)]
    assert len(got) == len(rows) > 0
    order = lambda pdf: sorted(pdf.itertuples(index=False, name=None), key=repr)
    for g, w in zip(order(got), order(rows)):
        assert g == pytest.approx(w)


def write_documents(folder, texts):
    db = duckdb.connect()
    db.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO d VALUES (?, ?, 'en', 'web', ?)", [(i, t, len(t)) for i, t in enumerate(texts)])
    db.execute(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("name", ["chunk_quality", "select_chunks"])
def test_texts_that_name_a_standard(spark, tmp_path, name):
    words = "we held the leaching run at twenty degrees and it was well. "
    write_documents(tmp_path, [f"the iso norm. {words * 6}", f"gost 12. {words * 9} a@b.org ГОСТ 12", words * 8])
    same_as_sql(spark, tmp_path, name)


def test_runs_of_marks(spark, tmp_path):
    write_documents(tmp_path, ["Ment, , . Au ou", ", ".join(["be"] + [""] * 90), "a , !! b ,;: c", "plain"])
    same_as_sql(spark, tmp_path, "compact_texts")
    row = spark.createDataFrame([("a,,b 0,5",)], "t string")
    assert row.select(compact("t").alias("x")).first().x == "a, , b 0,5"  # the operator's own rule


def test_half_a_digit_goes_up(spark):
    chunks = spark.createDataFrame([("a", "text", [])], "chunk_id string, text string, domain_tags array<string>")
    triples = spark.createDataFrame([("x", "MENTIONS", "onto:a", "a")], "subject_id string, predicate string, object_id string, chunk_id string")
    facts = spark.createDataFrame([], "chunk_id string, property_id string, unit string")
    central = spark.createDataFrame([("onto:a", 0.000005)], "id string, centrality double")
    # 0.12005: half even gave 0.12, and the SQL has 0.1201
    assert kg.retrieval_index(chunks, triples, facts, central).first().graph_boost == 0.1201


def test_token_counts_are_those_of_the_list(spark):
    texts = ["heap-leach heap leach. heap, heap_leach heap", "", "1.5 5 a.b a.b+ a.b ёлка Ёлка елка", "aheap heap\nheap"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalize("t").alias("t"))
    for token in ("heap", "heap-leach", "a.b", "елка", "1.5"):
        listed = F.size(F.array_remove(T.search_tokens("t"), "")) - F.size(F.array_remove(T.search_tokens("t"), token))
        assert rows.where(T.token_count(F.col("t"), token) != listed).count() == 0


def test_tokens_are_not_listed_one_by_one(spark):
    rows = spark.createDataFrame([("a heap", "x")], "text string, chunk_id string")
    plan = search.with_scores(rows, "what of a heap")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "filter(" not in plan


@pytest.mark.parametrize("name", ["part", "customer"])
def test_small_tables_are_spread(spark, name):
    """Their files have one row group, which one task would read and work on."""
    rows = fixtures.table(spark, SF, name)
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_facts_of_repeated_texts_are_found_once(spark, monkeypatch):
    """What does not depend on a row's key is worked out once for each text of a task; ids still differ by row."""
    ontology = extraction.Ontology((), {"concentration": ("sulfate",)})
    text, calls = "Sulfate at 5 mg/L and 20 °C.", []
    found = extraction._quantities
    monkeypatch.setattr(extraction, "_quantities", lambda o, t: calls.append(t) or found(o, t))
    rows = spark.createDataFrame([(str(i), "s", text) for i in range(50)], "object_id string, source_name string, text string")
    want = sorted(f[0] for i in range(50) for f in extraction.facts_of(ontology, text, "s", str(i)))
    calls.clear()
    run = {}
    monkeypatch.setattr(type(rows), "mapInPandas", lambda self, f, schema: run.setdefault("f", f) and self)
    extraction.extract_facts(rows, ontology)
    batches = [rows.select("text", "source_name", "object_id").toPandas()]
    got = [i for pdf in run["f"](batches) for i in pdf["fact_id"]]
    assert sorted(got) == want and len(set(got)) == 100 and calls == [text]
