"""Tables by manifests: what is rewritten, two writers at once, lost writers, streams."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestar.operators.store import KnowledgeStore
from lodestar.operators.tables import VersionedTables
from lodestar.streaming import ingest


@pytest.fixture
def store(spark, tmp_path):
    return KnowledgeStore(spark, f"file://{tmp_path}/store")


def facts(spark, sources, per=3, text="a"):
    rows = [(f"f{s}.{i}", f"s{s}", f"t{s % 4}", text, [text]) for s in sources for i in range(per)]
    return spark.createDataFrame(rows, "fact_id string, source_id string, theme_id string, text string, tags array<string>")


def rows(df):
    return sorted((r.fact_id, r.source_id, r.theme_id, r.text) for r in df.collect())


def test_only_files_with_touched_keys_are_written_anew(spark, store):
    for s in range(8):
        store.append("numeric_facts", facts(spark, [s]).coalesce(1))
    before = set(store.files("numeric_facts"))
    assert len(before) == 8
    store.upsert("numeric_facts", facts(spark, [5], 2, "new").coalesce(1), ("source_id",))
    after = set(store.files("numeric_facts"))
    assert len(before & after) == 7 and len(after - before) <= 2
    want = rows(facts(spark, [0, 1, 2, 3, 4, 6, 7]).unionByName(facts(spark, [5], 2, "new")))
    assert rows(store.read("numeric_facts")) == want
    store.append("numeric_facts", facts(spark, [9]).coalesce(1))
    assert after < set(store.files("numeric_facts"))  # appending rewrites nothing
    store.upsert("numeric_facts", facts(spark, [77]).coalesce(1), ("source_id",))
    assert after < set(store.files("numeric_facts"))  # nor do keys that are new


def test_two_writers_at_once(spark, store):
    store.write("numeric_facts", facts(spark, [0]))
    errors = []

    def add(s):
        try:
            store.append("numeric_facts", facts(spark, [s])) if s % 2 else store.upsert("numeric_facts", facts(spark, [s]), ("source_id",))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add, args=(s,)) for s in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and rows(store.read("numeric_facts")) == rows(facts(spark, range(7)))


def test_second_to_commit_makes_its_change_anew(spark, store, monkeypatch):
    """A rival commits between reading and committing: nothing of either is lost."""
    store.write("numeric_facts", facts(spark, [1, 2]))
    rival, commit, calls = KnowledgeStore(spark, store.root), store._commit, []

    def late(table, version, manifest):
        if not calls:
            calls.append(1)
            rival.upsert(table, facts(spark, [1], 1, "rival"), ("source_id",))
        return commit(table, version, manifest)

    monkeypatch.setattr(store, "_commit", late)
    store.upsert("numeric_facts", facts(spark, [1, 2], 2, "mine"), ("source_id",))
    assert rows(store.read("numeric_facts")) == rows(facts(spark, [1, 2], 2, "mine"))
    store.rewrite("numeric_facts", lambda old: old.where("source_id = 's2'"))
    assert rows(store.read("numeric_facts")) == rows(facts(spark, [2], 2, "mine"))


def test_a_lost_writer_leaves_nothing_that_is_read(spark, store):
    store.write("numeric_facts", facts(spark, [1]))
    store._put("numeric_facts", facts(spark, [2]))  # and no manifest
    assert rows(store.read("numeric_facts")) == rows(facts(spark, [1]))
    reader = store.read("numeric_facts")
    store.write("numeric_facts", facts(spark, [3]))
    assert rows(reader) == rows(facts(spark, [1]))  # the version before is still there
    for s in (4, 5):
        store.write("numeric_facts", facts(spark, [s]))
    assert len(store.versions("numeric_facts")) == 2 and rows(store.read("numeric_facts")) == rows(facts(spark, [5]))


def test_columns_and_types_that_change(spark, store, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}/other")
    tables.append("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    tables.append("t", spark.createDataFrame([(2, "b", [1])], "k int, v string, more array<int>"))
    assert sorted(map(str, tables.read("t").collect())) == ["Row(k=1, v='a', more=None)", "Row(k=2, v='b', more=[1])"]
    tables.upsert("t", spark.createDataFrame([(1 << 40, None)], "k long, v string"), ("k",))
    assert sorted(r.k for r in tables.read("t").collect()) == [1, 2, 1 << 40] and dict(tables.read("t").dtypes)["k"] == "bigint"
    tables.upsert("t", spark.createDataFrame([(7, None)], "k long, v string"), ("k", "v"), together=True)
    tables.upsert("t", spark.createDataFrame([(7, None), (None, None)], "k long, v string"), ("k", "v"), together=True)
    assert sorted(str(r.k) for r in tables.read("t").collect()) == ["1", str(1 << 40), "2", "7", "None"]
    tables.write("t", tables.read("t").limit(0))
    assert tables.read("t").count() == 0
    assert not tables.exists("none")
    with pytest.raises(FileNotFoundError):
        tables.read("none")
    with pytest.raises(KeyError):
        store.read("no such table")


def test_themes_of_any_name(spark, tmp_path):
    tables = VersionedTables(spark, f"file://{tmp_path}/names")
    names = ["007", "a/b", "журналы__x", "100%", "x=y", "{a}[b]*?", "", None, "a b"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "theme_id string, v int")
    tables.write("t", df)
    tables.upsert("t", spark.createDataFrame([(n, i + 100) for i, n in enumerate(names[:6])], "theme_id string, v int"), ("theme_id",))
    got = sorted((r.v, r.theme_id) for r in tables.read("t").where("v >= 100").collect())
    assert got == [(i + 100, n) for i, n in enumerate(names[:6])] and tables.read("t").count() == 9


def test_stream_keeps_all_rows_of_a_source(spark, tmp_path, store):
    """Many rows of one source, within a batch and over batches, with repeats."""
    want = facts(spark, [1, 2], 40)
    want.union(want.limit(7)).repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = ingest.stream_table(spark, f"{tmp_path}/in", want.schema, 1)
        ingest.upsert_stream(stream, store, "numeric_facts", f"{tmp_path}/check").awaitTermination()
    assert rows(store.read("numeric_facts")) == rows(want)


def test_stream_batch_is_taken_in_once(spark, store):
    """A batch that runs again after its commit changes nothing, though rows came in between."""
    first = facts(spark, [1])
    store.upsert("numeric_facts", first, ("fact_id",), together=True, batch=("stream", 0))
    store.upsert("numeric_facts", facts(spark, [1], 3, "later"), ("fact_id",), together=True, batch=("stream", 1))
    store.upsert("numeric_facts", first, ("fact_id",), together=True, batch=("stream", 0))
    store.append("numeric_facts", first, batch=("stream", 1))
    assert rows(store.read("numeric_facts")) == rows(facts(spark, [1], 3, "later"))
    store.append("numeric_facts", facts(spark, [2]), batch=("other", 0))
    assert store.read("numeric_facts").select(F.countDistinct("source_id")).first()[0] == 2


def test_stream_of_whole_sources_replaces_them(spark, tmp_path, store):
    store.write("numeric_facts", facts(spark, [1, 2], 5))
    facts(spark, [1], 2, "new").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.stream_table(spark, f"{tmp_path}/in", facts(spark, []).schema)
    ingest.upsert_stream(stream, store, "numeric_facts", f"{tmp_path}/check", keys=("source_id",)).awaitTermination()
    assert rows(store.read("numeric_facts")) == rows(facts(spark, [1], 2, "new").unionByName(facts(spark, [2], 5)))


def test_violations_are_counted_as_they_are_listed(spark):
    """counts are those of the listed rows, nulls and blanks included, and no join has a row for each fact."""
    from collections import Counter

    from lodestar.operators.store import violation_counts, violations

    sources = spark.createDataFrame([("s1",), ("s2",), ("s2",), (None,), ("",)], "source_id string")
    chunks = spark.createDataFrame(
        [("c1", "s1", "x"), ("c1", "s1", ""), ("c1", "s9", "x"), ("c2", None, None), ("c3", "", "x"), (None, "s9", "x"), (None, "s8", "x"), ("", "s1", "x"), ("c4", "s2", "x")], "chunk_id string, source_id string, text string"
    )
    facts = spark.createDataFrame([("f1", "s1", "c1", 1.0, "g"), ("f2", None, "c9", 1.0, ""), ("f3", "", "c9", None, None), ("f4", "s1", None, 2.0, None), ("f5", "s1", "", 2.0, "g"), ("f6", "s1", "c8", 0.0, "g")], "fact_id string, source_id string, chunk_id string, value double, unit string")
    for few in (True, False):
        given = [x.limit(0) if few else x for x in (chunks, facts)]
        rows = violation_counts(sources, *given)
        want = Counter((r.level, r.rule) for p in violations(sources, *given) for r in p.collect())
        assert {(r.level, r.rule): r.n for r in rows.collect()} == want
    assert len([x for x in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]) == 1
