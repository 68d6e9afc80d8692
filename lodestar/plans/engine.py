"""The whole flow: files to a knowledge store, the store to graphs and an index, questions to answers.

Stage 1 reads new files, cuts them into chunks, extracts facts, terms and
triples, and upserts all tables. Stage 2 builds what a graph mode asks for, all
themes in one job. ``ask`` routes a question to themes, searches their chunks
and answers from the best of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocabulary as V
from ..functions.text import document_type, section_title, section_type, source_year
from ..operators import answers, chunking, graph, kg, lexical, search, selection, store, themes, upkeep
from ..operators.extraction import MOST_TAGS, Ontology, constraints_of, extract_facts, fact_context, find_terms, parse_query
from ..operators.tables import VersionedTables
from ..sources import readers
from ..workspace import Workspace

#: What each mode builds, and the status that its themes reach.
MODES = {
    "vector_only": ((), "search_ready"),
    "cheap_kg": (("cheap",), "cheap_kg_ready"),
    "retrieval_kg": (("cheap", "index"), "retrieval_kg_ready"),
    "compressed_kg": (("cheap", "index", "selection"), "compressed_kg_ready"),
    "full_kg": (("cheap", "index", "selection"), "full_kg_ready"),
}


@dataclass
class Settings:
    """What a run can be told; the defaults are those of an ordinary one."""

    ignored_folders: tuple[str, ...] = ("node_modules", ".git", "__pycache__")
    rules: themes.ThemeRules = field(default_factory=themes.ThemeRules)
    max_themes: int = 3
    hits: int = 8
    per_document: int = 4
    min_kg_score: float = 0.18
    theme_cap: int = 48
    candidate_cap: int = 800
    parsers: dict[str, readers.Parser] | None = None
    model: Callable[[str, str], str] | None = None
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    reranker: Callable[[list[str]], list[float]] | None = None

    def updated(self, **changes) -> Settings:
        """With some settings changed; unknown ones are refused."""
        return replace(self, **changes)

    def save(self, path: str) -> None:
        """To YAML: the plain values."""
        import yaml

        plain = {f.name: list(v) if isinstance(v, tuple) else v for f in fields(self) if isinstance(v := getattr(self, f.name), (int, float, str, tuple))}
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(plain, f, allow_unicode=True, sort_keys=True)

    @classmethod
    def load(cls, path: str) -> Settings:
        """From YAML: plain values only; unknown keys are refused."""
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


class Engine:
    def __init__(self, spark: SparkSession, root: str, ontology: Ontology = Ontology(), settings: Settings | None = None) -> None:
        self.spark, self.ontology, self.settings = spark, ontology, settings or Settings()
        self.store = store.KnowledgeStore(spark, root)
        self.root = root.rstrip("/")
        self.graphs = VersionedTables(spark, f"{self.root}/graphs")

    # stage 1

    def ingest(self, folder: str, limit: int | None = None) -> DataFrame:
        """New files of ``folder`` into the store; gives (relative_path, theme_id, chunks, numeric_facts, error)."""
        known = self.store.read("sources").select(F.col("original_path").alias("relative_path")) if self.store.exists("sources") else None
        files = readers.discover(self.spark, folder, self.settings.ignored_folders, limit=limit, known=known)
        return self.ingest_objects(readers.parse(files, self.settings.parsers))

    def _cleaned(self, objects: DataFrame) -> DataFrame:
        """Objects without noise: of each document its type, and lines that stand on several of its pages."""
        name = F.element_at(F.split("relative_path", "/"), -1)
        rows = objects.withColumn("source_name", name)
        first = rows.where("object_index = 0").select("relative_path", document_type(F.col("source_name"), F.col("text")).alias("document_type"), source_year(F.col("source_name"), F.col("text")).alias("_year"))
        pages = rows.where("object_type = 'text'")
        noise = chunking.repeated_lines(pages, "relative_path", "object_index").groupBy("group").agg(F.collect_set("line").alias("_noise"))
        rows = rows.join(first.dropDuplicates(["relative_path"]), "relative_path", "left").join(noise.withColumnRenamed("group", "relative_path"), "relative_path", "left")
        return chunking.without_noise(rows, document_type="document_type", repeated="_noise").drop("_noise")

    def _objects(self, cleaned: DataFrame) -> DataFrame:
        """Chunks and tables (object_type, chunk_index, chunk) of cleaned objects."""
        parted = cleaned.withColumn("_parts", chunking.split_tables(F.col("text")))
        tables = parted.select(*cleaned.columns, F.posexplode("_parts.tables").alias("chunk_index", "_table"))
        tables = tables.withColumn("chunk", chunking.table_text(F.col("_table"))).withColumn("object_type", F.lit("table")).drop("_table")
        chunks = chunking.packed(parted.withColumn("_rest", F.col("_parts.rest")).drop("_parts"), text="_rest").drop("_rest").withColumn("object_type", F.lit("chunk"))
        return tables.unionByName(chunks).withColumn("chunk_index", F.col("chunk_index") + 1)

    def ingest_objects(self, objects: DataFrame) -> DataFrame:
        """The same from parsed objects (relative_path, source_hash, object_type, object_index, page, text, error).

        Texts are cleaned, tables described beside their lines, the rest packed into
        chunks; fragments without term or number are left out.
        """
        ws = Workspace(self.spark, "ingest")
        objects = ws.save(objects, "objects")
        good = objects.where("error IS NULL")
        first = good.where("object_index < 3").groupBy("relative_path").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("object_index", "text"))), lambda s: s["text"])).alias("preview"))
        placed = themes.resolve(first, self.settings.rules).select("relative_path", "theme_id", "collection", "theme_name", "year", "source_type")
        rows = self._objects(self._cleaned(good)).join(placed, "relative_path")
        rows = chunking.with_ids(rows.withColumn("_hash", F.col("source_hash")), F.col("source_name"), F.col("_hash"), kind=F.col("object_type"), at=F.concat_ws(".", F.nullif("object_index", F.lit(0)), "chunk_index")).drop("_hash")
        section = F.nullif(section_title(F.col("chunk")), F.lit(""))
        rows = rows.select(
            "chunk_id", "fragment_id", "object_id", "source_id", "source_hash", "source_name", F.col("relative_path").alias("original_path"), "theme_id", "collection", "theme_name", "source_type",
            F.coalesce("year", "_year").alias("year"), "object_type", "chunk_index", "page", "document_type", section.alias("section"),
            section_type(F.col("source_name"), F.col("chunk"), F.col("object_type"), F.col("document_type")).alias("section_type"),
            chunking.citation_name(F.col("source_name"), F.col("object_type"), F.col("page"), section, F.col("object_id")).alias("citation_name"),
            "text_hash", F.length("chunk").alias("chars"), F.col("chunk").alias("text"),
        )
        rows = ws.save(rows.dropDuplicates(["chunk_id"]), "rows")
        terms = ws.save(find_terms(rows, self.ontology, "chunk_id"), "terms")
        tags = terms.groupBy("chunk_id", "term_id").agg(F.min("start").alias("at")).groupBy("chunk_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "term_id"))), lambda s: s["term_id"]), 1, MOST_TAGS).alias("domain_tags"))
        chunks = rows.join(tags, "chunk_id", "left").withColumn("domain_tags", F.coalesce("domain_tags", F.array().cast("array<string>")))
        rows = ws.save(chunks.where((F.col("object_type") == "table") | chunking.worth_storing(F.col("text"), F.size("domain_tags"))), "kept")
        meta = [(c, F.col(c)) for c in ("object_id", "object_type", "document_type", "year", "page", "section", "section_type")]
        chunks = rows.withColumn("lightrag_text", chunking.with_header([("source", F.col("source_name")), *meta, ("domain_tags", F.array_join("domain_tags", ","))], F.col("text")))
        terms = terms.join(rows.select("chunk_id"), "chunk_id", "left_semi")
        keys = rows.select("chunk_id", "object_id", "source_id", "fragment_id", "theme_id")
        facts = extract_facts(rows, self.ontology).join(keys, "object_id").withColumn("fact_id", F.concat(F.lit("fact:"), "fact_id"))
        facts = ws.save(facts, "facts")
        self.store.upsert("chunks", chunks, ("source_id", "original_path"))
        fragments = rows.select("fragment_id", "source_id", "source_hash", "source_name", "original_path", "object_id", "object_type", "citation_name", "text_hash", "chars", "domain_tags", "theme_id")
        self.store.upsert("source_fragments", fragments, ("source_id", "original_path"))
        self.store.upsert("numeric_facts", facts, ("source_id",))
        self.store.upsert("triples", self._triples(rows, terms, facts), ("source_id",))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        sources = rows.groupBy("source_id", "source_hash", "source_name", "original_path", "theme_id", "collection", "theme_name", "source_type").agg(F.sum("chars").alias("total_chars"), F.count("*").alias("objects_count"), F.min("year").alias("year"))
        self.store.upsert("sources", sources.withColumn("updated_at", now), ("source_id", "original_path"))
        runs = sources.select(F.concat(F.lit("run:"), F.substring(F.sha1(F.concat_ws("|", "source_hash", now)), 1, 16)).alias("run_id"), "source_id", "source_name", "source_hash", "objects_count", F.lit("processed").alias("status"), now.alias("created_at"))
        self.store.append("ingestion_runs", runs)
        self._merge_entities(terms, rows)
        counts = rows.groupBy(F.col("original_path").alias("relative_path"), "theme_id").agg(F.count("*").alias("chunks"))
        n_facts = facts.join(rows.select("chunk_id", "original_path"), "chunk_id").groupBy(F.col("original_path").alias("relative_path")).agg(F.count("*").alias("numeric_facts"))
        errors = objects.groupBy("relative_path").agg(F.max("error").alias("error"))
        report = errors.join(counts, "relative_path", "left").join(n_facts, "relative_path", "left")
        report = report.select("relative_path", "theme_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("numeric_facts", F.lit(0)).alias("numeric_facts"), "error")
        return Workspace(self.spark, "report").save(report, "report")

    @staticmethod
    def _triples(rows: DataFrame, terms: DataFrame, facts: DataFrame) -> DataFrame:
        t = lambda s, p, o: (s.alias("subject_id"), F.lit(p).alias("predicate"), o.alias("object_id"))
        keys = rows.select("chunk_id", "source_id", "theme_id")
        onto = lambda c: F.concat(F.lit("onto:"), c)
        parts = [
            rows.select(*t(F.col("source_id"), "CONTAINS", F.col("chunk_id")), "source_id", "chunk_id", "theme_id"),
            terms.select("chunk_id", "term_id").distinct().join(keys, "chunk_id").select(*t(F.col("chunk_id"), "MENTIONS", onto(F.col("term_id"))), "source_id", "chunk_id", "theme_id"),
            facts.select(*t(F.col("chunk_id"), "HAS_NUMERIC_FACT", F.col("fact_id")), "source_id", "chunk_id", "theme_id"),
            facts.select("fact_id", F.explode("entity_ids").alias("e"), "source_id", "chunk_id", "theme_id").select(*t(F.col("fact_id"), "ABOUT_ENTITY", onto(F.col("e"))), "source_id", "chunk_id", "theme_id"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        key = F.sha1(F.concat_ws("|", "subject_id", "predicate", "object_id", "chunk_id"))
        return out.withColumn("triple_id", F.concat(F.lit("triple:"), key)).dropDuplicates(["triple_id"])

    def _merge_entities(self, terms: DataFrame, rows: DataFrame) -> None:
        labels = self.spark.createDataFrame([(f"onto:{t.term_id}", t.all_labels[0] if t.all_labels else t.term_id) for t in self.ontology.terms], "entity_id string, label string")
        own = terms.join(rows.select("chunk_id", "source_id"), "chunk_id").groupBy(F.concat(F.lit("onto:"), "term_id").alias("entity_id")).agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
        new = own.join(labels, "entity_id").select("entity_id", "label", "source_ids")
        new = Workspace(self.spark, "entities").save(new, "entities")
        self.store.rewrite("entities", lambda old: new if old is None else store.merge_entities(old, new))

    # stage 2

    def build(self, mode: str = "retrieval_kg") -> dict[str, str]:
        """What ``mode`` needs, below ``graphs`` of the store; gives the paths written."""
        builds, status = MODES[mode]
        ws, out = Workspace(self.spark, "build"), {}
        chunks, triples, facts = (self.store.read(t) for t in ("chunks", "triples", "numeric_facts"))

        def write(name: str, df: DataFrame) -> None:
            out[name] = self.graphs.write(name, df)

        if "cheap" in builds:
            write("cheap_kg", kg.cheap_kg(triples, facts))
        if "index" in builds:
            entities = self.store.read("entities")
            edges = kg.edge_counts(triples)
            nodes = edges.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
            onto = nodes.where("id LIKE 'onto:%'").join(entities.select(F.col("entity_id").alias("id"), "label"), "id", "left").select("id", F.coalesce("label", F.regexp_replace("id", "^onto:", "")).alias("label"))
            edges = ws.save(kg.retrieval_edges(triples, facts, kg.similarity_edges(onto)), "edges")
            central = ws.save(graph.weighted_centrality(nodes, edges, ws), "centrality")
            write("retrieval_edges", edges)
            write("retrieval_index", kg.retrieval_index(chunks, triples, facts, central))
        write("search_index", lexical.build_index(self.rows(), keep=("theme_id",), ws=ws))
        if "selection" in builds:
            rows = selection.top_candidates(chunks.withColumn("n_tags", F.size("domain_tags")), self.settings.candidate_cap)
            has_fact = facts.select("chunk_id", F.lit(True).alias("has_fact")).distinct()
            rows = rows.join(has_fact, "chunk_id", "left")
            rows = selection.with_selection_scores(rows, F.coalesce("has_fact", F.lit(False)), F.col("n_tags"), F.col("citation_name")).drop("has_fact", "rank")
            s, rows = self.settings, ws.save(rows, "scored")
            write("selected_chunks", selection.select_chunks(rows, s.per_document, s.min_kg_score, theme_cap=s.theme_cap))
            write("selection_report", selection.selection_report(chunks, rows, self._graph("selected_chunks"), s.per_document))
        if self.settings.embedder:
            named = chunks.groupBy("theme_id").agg(F.min("theme_name").alias("theme_name"), F.min("collection").alias("collection"))
            old = self._graph("theme_embeddings")
            write("theme_embeddings", ws.save(upkeep.theme_embeddings(upkeep.profile_texts(named, chunks), old, self.settings.embedder), "vectors"))
        write("themes", self._themes(status, self._graph("retrieval_edges") if "index" in builds else None, central if "index" in builds else None))
        ws.clear()
        return out

    def _graph(self, name: str) -> DataFrame | None:
        return self.graphs.read(name) if self.graphs.exists(name) else None

    def _themes(self, status: str, edges: DataFrame | None = None, centrality: DataFrame | None = None) -> DataFrame:
        """The catalog; with a graph, each theme's 20 most central terms too."""
        chunks, sources, triples = self.store.read("chunks"), self.store.read("sources"), self.store.read("triples")
        n = sources.groupBy("theme_id").agg(F.count("*").alias("sources"), F.min("source_type").alias("source_type"))
        rows = chunks.groupBy("theme_id").agg(
            F.min("theme_name").alias("theme_name"), F.min("collection").alias("collection"), F.array_sort(F.collect_set("year")).alias("years"),
            F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("domain_tags")))), " ").alias("ontology_text"),
        )
        kind = "array<struct<label:string,weight:double,score:double>>"
        if centrality is not None:
            own = triples.where("object_id LIKE 'onto:%'").select("theme_id", F.col("object_id").alias("id")).distinct().join(centrality, "id")
            rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("centrality"), "id"))
            label = F.translate(F.regexp_replace("id", "^onto:", ""), "_", " ")
            top = own.withColumn("r", rank).where("r <= 20").groupBy("theme_id").agg(F.collect_list(F.struct(label.alias("label"), F.lit(1.0).alias("weight"), F.col("centrality").alias("score"))).alias("central"))
            rows = rows.join(top, "theme_id", "left").withColumn("central", F.coalesce("central", F.array().cast(kind)))
        else:
            rows = rows.withColumn("central", F.array().cast(kind))
        rows = rows.join(n, "theme_id", "left").withColumns({"status": F.lit(status), "sources": F.coalesce("sources", F.lit(0))})
        years = F.array_join(F.col("years").cast("array<string>"), " ")
        return rows.withColumn("keyword_text", F.concat_ws(" ", "theme_id", "collection", "theme_name", "source_type", "ontology_text", years))

    def set_status(self, theme_id: str, status: str) -> None:
        """Names a theme's state anew, as after a failed build."""
        if status not in V.READINESS:
            raise ValueError(status)
        self.graphs.rewrite("themes", lambda old: old.withColumn("status", F.when(F.col("theme_id") == theme_id, status).otherwise(F.col("status"))))

    def metrics(self, theme_ids: list[str] | None = None, top_n: int = 20) -> DataFrame:
        """Metrics of the store's graph, or of that of some themes."""
        entities, facts, triples = (self.store.read(t) for t in ("entities", "numeric_facts", "triples"))
        if theme_ids:
            facts, triples = (df.where(F.col("theme_id").isin(theme_ids)) for df in (facts, triples))
            entities = entities.join(triples.select(F.col("object_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
        vertices, edges = graph.store_graph(entities, facts, triples)
        return graph.graph_metrics(vertices, edges, entities.select(F.col("entity_id").alias("id"), "label"), Workspace(self.spark, "metrics"), top_n)

    def refresh_catalog(self, theme_ids: list[str]) -> None:
        """Metrics of each of the themes anew, and catalog rows that are as the store now is, with the most central nodes of the theme's own graph.

        Statuses stay; a theme that had no row is ``parsed_ready``. Names that no chunk has change nothing, and other rows stay as they are.
        """
        if not theme_ids:
            return
        lists = [graph.central_labels(self.metrics([t])).select(F.lit(t).alias("theme_id"), F.struct("label", "weight", "score").alias("node")) for t in dict.fromkeys(theme_ids)]
        central = reduce(DataFrame.unionByName, lists).groupBy("theme_id").agg(F.array_sort(F.collect_list("node")).alias("found"))  # 3 lists of 20 a theme
        own = self._themes("parsed_ready").where(F.col("theme_id").isin(theme_ids)).join(central, "theme_id", "left")
        ws = Workspace(self.spark, "refresh")
        fresh = ws.save(own.withColumn("central", F.coalesce("found", "central")).drop("found"), "rows")

        def renewed(old: DataFrame) -> DataFrame:
            held = fresh.join(old.select("theme_id", F.col("status").alias("held")), "theme_id", "left").withColumn("status", F.coalesce("held", "status"))
            return old.join(fresh.select("theme_id"), "theme_id", "left_anti").unionByName(held.select(*old.columns))

        self.graphs.rewrite("themes", renewed)
        ws.clear()

    # questions

    def rows(self) -> DataFrame:
        """The retrieval index where it has been built, with the chunks that came since; else the chunks. Chunks that are gone are left out."""
        built, chunks = self._graph("retrieval_index"), self.store.read("chunks")
        if built is None:
            return chunks
        later = chunks.join(built.select("chunk_id"), "chunk_id", "left_anti")
        later = later.select("chunk_id", *(c for c in built.columns if c in later.columns and c != "chunk_id"))
        return built.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(later, allowMissingColumns=True)

    def _ready_rows(self, min_readiness: str = "search_ready") -> DataFrame:
        """``rows`` of the themes that are ready; all of them before there is a catalog."""
        catalog = self._graph("themes")
        if catalog is None:
            return self.rows()
        ready = catalog.where(store.readiness_rank(F.col("status")) >= V.READINESS[min_readiness])
        return self.rows().join(ready.select("theme_id"), "theme_id", "left_semi")

    def route(self, question: str, min_readiness: str = "search_ready") -> DataFrame:
        """The ready themes to ask; where the scores name none, those of the best hits, and at last the first ones.

        Where no theme is as ready as asked, those that are parsed are taken, with any score.
        """
        found = self._routed(question, min_readiness)
        if min_readiness != "parsed_ready" and not found.limit(1).count():
            return self._routed(question, "parsed_ready", 0.0)
        return found

    def _routed(self, question: str, min_readiness: str, min_score: float = 0.10) -> DataFrame:
        catalog, vector = self._graph("themes"), None
        vectors = self._graph("theme_embeddings") if self.settings.embedder else None
        if vectors is not None:
            vector = self.settings.embedder([question])[0]
            catalog = catalog.join(vectors.select("theme_id", F.col("embedding").alias("profile")), "theme_id", "left")
        found = search.route_themes(catalog, question, vector, self.settings.max_themes, min_readiness, min_score, fallback=False)
        if found.limit(1).count():
            return found
        best = search.search(self._ready_rows(min_readiness), question, 1, group="theme_id").select("theme_id", F.col("score").alias("route_score"))
        best = best.orderBy(F.desc("route_score"), "theme_id").limit(self.settings.max_themes)
        return best if best.limit(1).count() else search.route_themes(catalog, question, vector, self.settings.max_themes, min_readiness)

    def hits(self, question: str, theme_ids: list[str] | None = None) -> list[dict]:
        """The best chunks of the routed themes, or of all where these have none."""
        ids = theme_ids or [r.theme_id for r in self.route(question).collect()]
        rows = self.rows()
        got = search.search(rows.where(F.col("theme_id").isin(ids)), question, self.settings.hits, group="theme_id").collect() if ids else []
        if not got and not theme_ids:
            got = search.search(self._ready_rows(), question, self.settings.hits).collect()
        best = sorted((r.asDict(recursive=True) for r in got), key=lambda h: (-h["score"], h["chunk_id"]))
        return search.rerank(best, self.settings.reranker)

    def hits_many(self, questions: DataFrame, key: str = "query", text: str = "question", min_readiness: str = "search_ready") -> DataFrame:
        """The best chunks of all ready themes for each of ``questions``: (query, rank, score, and the chunk's columns).

        One pass over the index that ``build`` stores for a block of questions. Chunks
        that came since are prepared for this call, those that are gone are left out.
        """
        ws, rows = Workspace(self.spark, "hits"), self._ready_rows(min_readiness)
        stored = self._graph("search_index")
        if stored is None:
            index = lexical.build_index(rows, keep=("theme_id",), ws=ws)
        else:
            later = rows.join(stored.select(F.col("key").alias("chunk_id")), "chunk_id", "left_anti")
            index = stored.join(rows.select(F.col("chunk_id").alias("key")), "key", "left_semi")
            index = index.unionByName(lexical.build_index(later, keep=("theme_id",), ws=ws))
        best = lexical.search_batch(index, questions, self.settings.hits, key, text, ws).withColumnRenamed("key", "chunk_id")
        return best.select("query", "chunk_id", "rank", F.col("score").alias("hit_score")).join(rows, "chunk_id").withColumnRenamed("hit_score", "score")

    def facts(self, question: str, this_year: int | None = None, limit: int = 12) -> list[dict]:
        """Facts that a question asks for by terms, numbers, places or years; none where it names nothing of the kind."""
        parsed = self.parse(question, this_year or date.today().year)
        if not parsed.is_structured or not self.store.exists("numeric_facts"):
            return []
        found = search.fact_search(self.store.read("numeric_facts"), constraints_of(self.spark, parsed), parsed.term_ids, parsed.expanded, limit, parsed.places)
        return [r.asDict(recursive=True) for r in found.collect()]

    def ask(self, question: str, theme_ids: list[str] | None = None) -> dict:
        """The answer with its hits and the facts that match the question's terms and numbers."""
        found, facts = self.hits(question, theme_ids), self.facts(question)
        model = self.settings.model
        if model and facts:  # a model reads the facts above the passages
            model = lambda q, context, ask=self.settings.model: ask(q, f"{fact_context(facts)}\n\n{context}")
        text = answers.answer(question, found, model)
        if facts and not found:
            text = fact_context(facts)
        return {"answer": text, "hits": found, "facts": facts}

    def extract(self, text: str) -> list[tuple]:
        from ..operators.extraction import facts_of

        return facts_of(self.ontology, text)

    def parse(self, question: str, this_year: int):
        return parse_query(question, self.ontology, this_year)

    # upkeep

    def stats(self) -> DataFrame:
        return store.store_stats({t: self.store.read(t) for t in store.TABLES if self.store.exists(t)})

    def validate(self) -> DataFrame:
        return store.validate(self.store.read("sources"), self.store.read("chunks"), self.store.read("numeric_facts"))

    def delete_source(self, source_id: str) -> None:
        for name in store.TABLES:
            if self.store.exists(name):
                self.store.rewrite(name, lambda old, name=name: store.delete_source({name: old}, source_id)[name])

    def quality(self) -> DataFrame:
        return upkeep.quality_report(self.store.read("sources"), self.store.read("numeric_facts"))

    def documents(self, limit: int = 500) -> DataFrame:
        return upkeep.list_documents(self.store.read("sources"), self.store.read("chunks"), self._graph("themes"), limit)

    def runs(self, most: int = 50) -> DataFrame:
        return upkeep.recent_runs(self.store.read("ingestion_runs"), most)

    def preview(self, folder: str, limit: int | None = None) -> DataFrame:
        """What themes the files of ``folder`` would have, without storing anything."""
        objects = readers.parse(readers.discover(self.spark, folder, self.settings.ignored_folders, limit=limit), self.settings.parsers)
        texts = objects.where("error IS NULL").groupBy("relative_path").agg(F.min_by("text", "object_index").alias("preview"), F.sum(F.ceil(F.length("text") / 3200)).alias("chunks"))
        return themes.theme_distribution(themes.resolve(texts, self.settings.rules))

    def preflight(self, folder: str) -> DataFrame:
        """(level, message) of what would hinder a run: no files, no parser for them, an empty ontology, settings that can't work."""
        listed = readers.discover(self.spark, folder, self.settings.ignored_folders, limit=None).select("relative_path")
        ext = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
        parsers = self.settings.parsers or readers.PARSERS
        counts = {r.ext: r["n"] for r in listed.groupBy(ext.alias("ext")).agg(F.count("*").alias("n")).collect()}  # a row for each extension
        found = [] if counts else [("error", f"{folder} has no file of a supported kind")]
        found += [("warning", f"{n} files of kind {e} have no parser") for e, n in sorted(counts.items()) if e not in parsers]
        found += [] if self.ontology.terms else [("warning", "the ontology has no terms, so no term will be found")]
        s = self.settings
        found += [("error", f"{k} must be above zero") for k in ("max_themes", "hits", "per_document", "theme_cap", "candidate_cap") if getattr(s, k) <= 0]
        return self.spark.createDataFrame(found, "level string, message string")

    def nightly(self, folder: str, mode: str = "compressed_kg") -> dict:
        """Both stages one after the other, if nothing hinders them; gives what happened."""
        checks = [tuple(r) for r in self.preflight(folder).collect()]
        if any(level == "error" for level, _ in checks):
            return {"status": "failed", "checks": checks}
        report = self.ingest(folder).agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")).first()
        return {"status": "done", "checks": checks, "stage1": report.asDict(), "stage2": self.build(mode)}
