"""Files to answers on a small folder."""

import pytest

from lodestar.operators.extraction import Ontology, Term
from lodestar.plans.engine import Engine

ONTOLOGY = Ontology(
    terms=(Term("nickel", "Material", ("nickel",)), Term("leaching", "Process", ("leaching",), ("heap leaching",)), Term("copper", "Material", ("copper",))),
    properties={"temperature": ("temperature",)},
)
FILES = {
    "reports/leach/nickel 2019.txt": "Page 1\n\u200bNickel leaching was studied at length in this work.\n\nThe temperature of nickel leaching was 60 °C in all of the runs that were made.\n\n| run | yield |\n|---|---|\n| one | 71 % |\n| two | 75 % |",
    "reports/leach/copper.txt": "Copper was recovered from solution by heap leaching over many months of the year.",
    "reports/safety/rules.txt": "Workers must wear helmets at all times, and visitors must be led by a guide.",
    "reports/safety/empty.txt": " ",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    for name, text in FILES.items():
        path = root / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    e = Engine(spark, f"file://{root}/store", ONTOLOGY)
    e.folder = str(root / "in")
    e.report = {r.relative_path: r for r in e.ingest(e.folder).collect()}
    e.built = e.build("compressed_kg")
    return e


def test_report(engine):
    r = engine.report["reports/leach/nickel 2019.txt"]
    assert (r.theme_id, r.chunks, r.error) == ("отчеты__leach", 2, None) and r.numeric_facts >= 3
    assert engine.report["reports/safety/empty.txt"].error == "no text"


def test_store_is_whole(engine):
    assert engine.validate().count() == 0
    stats = {(r.kind, r.key): r.n for r in engine.stats().collect()}
    assert stats["rows", "chunks"] == stats["rows", "source_fragments"] == 4 and stats["rows", "sources"] == stats["rows", "ingestion_runs"] == 3
    assert stats["facts_by_property", "temperature"] == 1


def test_texts_are_cleaned_and_tables_described(engine):
    rows = {r.object_type: r for r in engine.store.read("chunks").where("source_name = 'nickel 2019.txt'").collect()}
    assert rows["chunk"].text.startswith("Nickel leaching") and "Page 1" not in rows["chunk"].text and "|" not in rows["chunk"].text
    assert "Строка 2: run = two; yield = 75 %." in rows["table"].text and rows["table"].citation_name.startswith("nickel 2019.txt#table:")
    assert rows["chunk"].lightrag_text.startswith("[METADATA]\nsource: nickel 2019.txt\n") and rows["chunk"].domain_tags == ["nickel", "leaching"]


def test_ingest_again_changes_nothing(engine):
    before = engine.store.read("chunks").count()
    assert [r.relative_path for r in engine.ingest(engine.folder).collect()] == ["reports/safety/empty.txt"]
    assert engine.store.read("chunks").count() == before


def test_graphs(engine, spark):
    assert set(engine.built) == {"cheap_kg", "retrieval_edges", "retrieval_index", "search_index", "selected_chunks", "selection_report", "themes"}
    index = {(r.source_name, r.object_type): r for r in spark.read.parquet(engine.built["retrieval_index"]).collect()}
    nickel = index["nickel 2019.txt", "chunk"]
    assert nickel.graph_boost > index["rules.txt", "chunk"].graph_boost and nickel.numeric_fact_count == 1
    catalog = {r.theme_id: r for r in spark.read.parquet(engine.built["themes"]).collect()}
    assert {c.label for c in catalog["отчеты__leach"].central} >= {"nickel", "leaching", "copper"} and not catalog["отчеты__safety"].central
    m = engine.metrics().first()
    assert m.nodes > 8 and m.health == "ok" and {t.kind for t in m.tops} == {"top_degree", "top_pagerank", "top_betweenness"}


def test_ask(engine):
    got = engine.ask("What is the temperature of nickel leaching?")
    assert "60 °C" in got["answer"] and got["hits"][0]["source_name"] == "nickel 2019.txt"
    assert [f["property_id"] for f in got["facts"]][:1] == ["temperature"] and engine.ask("hello there")["facts"] == []
    assert engine.route("safety rules").first().theme_id == "отчеты__safety"
    seen = []
    engine.settings.model = lambda q, context: seen.append(context) or "It was 60 °C."
    assert engine.ask("temperature of nickel leaching")["answer"] == "It was 60 °C." and "параметр=temperature" in seen[0] and "[1] theme=" in seen[0]
    engine.settings.model = None


def test_many_questions(engine, spark):
    """As one question over all ready rows, from the stored index."""
    from lodestar.operators import search

    texts = ["What is the temperature of nickel leaching?", "safety rules", "heap leaching of copper", "zzz"]
    got = engine.hits_many(spark.createDataFrame(list(enumerate(texts)), "query int, question string")).orderBy("query", "rank").collect()
    for i, t in enumerate(texts):
        want = [(r.chunk_id, r.score, r.source_name) for r in search.search(engine._ready_rows(), t, engine.settings.hits).collect()]
        assert [(r.chunk_id, r.score, r.source_name) for r in got if r.query == i] == want


def test_themes_that_are_parsed_are_asked_where_none_is_ready(engine):
    status = {r.theme_id: r.status for r in engine._graph("themes").collect()}
    first, last = min(status), max(status)
    for t in status:
        engine.set_status(t, "parsed_ready")
    engine.set_status(last, "failed")
    assert [r.theme_id for r in engine.route("nickel leaching").collect()] == [first]
    engine.set_status(first, status[first])
    assert [r.theme_id for r in engine.route("zzz").collect()] == [first]
    engine.set_status(last, status[last])


def test_vectors_and_status(engine):
    engine.settings.embedder = lambda texts: [[float("safety" in t), float("nickel" in t.lower())] for t in texts]
    engine.build("retrieval_kg")
    assert engine.route("nickel").first().vector == 1.0
    engine.set_status("отчеты__safety", "failed")
    assert "отчеты__safety" not in [r.theme_id for r in engine.route("safety rules", "search_ready").collect()]
    engine.settings.embedder = None


def test_reports_and_preflight(engine, tmp_path):
    assert engine.quality().where("theme_id = 'отчеты__leach'").first().sources == 2 and engine.documents().count() == 3 and engine.runs().count() == 3
    assert [r.theme_id for r in engine.preview(engine.folder).collect()] == ["отчеты__leach", "отчеты__safety"]
    assert engine.preflight(engine.folder).where("level = 'error'").count() == 0
    (tmp_path / "x.bin").write_text("")
    assert engine.nightly(str(tmp_path))["status"] == "failed"


def test_catalog_rows_are_refreshed(engine):
    """One theme's row has its own graph's central nodes then; its status, and other rows, stay."""
    rows = lambda: {r.theme_id: r for r in engine._graph("themes").collect()}
    before = rows()
    theme = min(before)
    engine.refresh_catalog([theme, "no such theme"])
    after = rows()
    tops = {t.label.lower() for t in engine.metrics([theme]).first().tops}
    assert set(after) == set(before) and all(after[t] == before[t] for t in before if t != theme)
    assert after[theme].status == before[theme].status and after[theme].sources == before[theme].sources
    assert {x.label for x in after[theme].central} == {" ".join(x.replace("ё", "е").split()) for x in tops}
    assert tops and {x.weight for x in after[theme].central} == {1.0, 0.8, 0.5}


def test_delete(engine):
    source = engine.store.read("sources").where("source_name = 'copper.txt'").first().source_id
    engine.delete_source(source)
    assert engine.store.read("chunks").where(f"source_id = '{source}'").count() == 0 and engine.store.read("chunks").count() == 3


def test_new_chunks_are_found_before_the_next_build(engine, spark, tmp_path):
    folder = tmp_path / "reports" / "leach"
    folder.mkdir(parents=True)
    (folder / "cobalt.txt").write_text("Cobalt sulphate crystals were grown slowly from the purified solution of the plant.")
    engine.ingest(str(tmp_path)).collect()
    question = "cobalt sulphate crystals"
    assert engine.ask(question)["hits"][0]["source_name"] == "cobalt.txt"
    asked = spark.createDataFrame([(1, question)], "query int, question string")
    assert engine.hits_many(asked).where("rank = 1").first().source_name == "cobalt.txt"
    assert not [r for r in engine.rows().collect() if r.source_name == "copper.txt"]  # deleted above, still in the stored index
