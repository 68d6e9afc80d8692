"""Upkeep of themes and documents, and the clean-up of text before chunking."""

from pyspark.sql import functions as F

from lodestar.operators import chunking, upkeep


def test_selectors(spark):
    t = spark.createDataFrame([("a__leaching", "Heap Leaching", "articles"), ("b__x", "Other", "reports")], "theme_id string, theme_name string, collection string")
    ids = lambda s: sorted(r.theme_id for r in upkeep.select_themes(t, s).collect())
    assert ids(["heap-leaching"]) == ids(["leach"]) == ["a__leaching"] and ids(["b__x", "articles"]) == ["a__leaching", "b__x"] and len(ids([])) == 2


def test_profiles_and_vectors(spark):
    t = spark.createDataFrame([("a", "A", "c"), ("b", "B", "c")], "theme_id string, theme_name string, collection string")
    c = spark.createDataFrame([("1", "a", "plain text", []), ("2", "a", "with 5 tags", ["x"])], "chunk_id string, theme_id string, text string, domain_tags array<string>")
    p = upkeep.profile_texts(t, c, most_chars=15)
    rows = {r.theme_id: r.profile for r in p.collect()}
    assert rows["a"] == "A\nc\nwith 5 tags\nplai" and rows["b"].startswith("B\nc")
    first = upkeep.theme_embeddings(p)
    calls = []
    stored = first.where("theme_id = 'a'")
    again = upkeep.theme_embeddings(p, stored, lambda texts: calls.append(texts) or [[1.0, 2.0]] * len(texts))
    got = {r.theme_id: r.embedding for r in again.collect()}
    assert got["b"] == [1.0, 2.0] and len(got["a"]) == 64
    m = upkeep.mean_vectors(spark.createDataFrame([("k", [1.0, 3.0]), ("k", [3.0, 5.0])], "k string, embedding array<double>"), "k").first()
    assert m.embedding == [2.0, 4.0]


def test_reports(spark):
    c = spark.createDataFrame([("a",), ("a",), ("b",)], "theme_id string")
    f = spark.createDataFrame([("a", "mg/L", "1", 1.0), ("a", "", "1", 2.0), ("z", "C", None, 3.0)], "theme_id string, unit string, chunk_id string, value double")
    health = spark.createDataFrame([("b", "weak_graph"), ("a", "ok")], "theme_id string, graph_health string")
    rows = {r.theme_id: r for r in upkeep.quality_report(c, f, health).collect()}
    assert (rows["a"].facts_without_unit, rows["a"].issues) == (1, ["numeric_facts_without_unit"])
    assert rows["b"].issues == ["weak_graph"] and rows["z"].issues == ["empty_theme", "numeric_facts_without_chunk"]


def test_statuses(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "file_name string")
    s = spark.createDataFrame([("a", "failed", 2), ("a", "processed", 1), ("b", "pending", 1), ("b", "failed", 3)], "file_name string, status string, updated_at int")
    got = upkeep.queued_outcomes(q, s)
    assert {r.file_name: r.status for r in got.collect()} == {"a": "processed", "b": "failed", "c": "queued"}
    r = upkeep.status_counts(got).first()
    assert (r.total, r.processed, r.failed, r.in_flight, r.done) == (3, 1, 1, 1, False)
    d = spark.createDataFrame([("1", "x", 1), ("2", "x", 5), ("3", "y", 3)], "doc_id string, file_name string, updated_at int")
    assert [r.doc_id for r in upkeep.latest_documents(d).collect()] == ["2", "3"]


def test_import(spark):
    old = spark.createDataFrame([("1",), ("fact:1",), ("2",)], "fact_id string")
    assert sorted(r.fact_id for r in upkeep.import_facts(old, None).collect()) == ["fact:1", "fact:2"]
    assert upkeep.import_facts(old, old.limit(1)).count() == 1
    assert spark.range(1).select(upkeep.route_reason(["b", "a", "z"], F.lit("a b")).alias("x")).first().x == "a, b"


def test_noise_goes(spark):
    text = "Head\nBody one.\n12\nhttp://x.org/a\n[1] doi: a footnote\n\n\nReferences\n1. gone\nAppendix A\nstays"
    df = spark.createDataFrame([(text, "article", ["head"]), (text, "patent", [])], "text string, kind string, lines array<string>")
    rows = {r.kind: r.text for r in chunking.without_noise(df, document_type="kind", repeated="lines").collect()}
    assert rows["article"] == "Body one.\n\nAppendix A\nstays"
    assert rows["patent"] == "Head\nBody one.\n\nReferences\n1. gone\nAppendix A\nstays"


def test_tables_and_headers(spark):
    df = spark.createDataFrame([("| n | |\n|--|--|\n| a | 1 |\n| b | |", None, "3", " t ")], "table string, a string, c string, t string")
    r = df.select(chunking.table_text(F.col("table"), F.array(F.lit("nickel"))).alias("d"), chunking.with_header([("b", F.lit(2)), ("a", F.col("a")), ("c", F.col("c"))], F.col("t")).alias("h")).first()
    lines = r.d.split("\n")
    assert lines[1] == "Таблица содержит 2 строк и 2 столбцов: n, Колонка 2." and lines[3] == "Связанные доменные теги: nickel."
    assert lines[4:6] == ["Строка 1: n = a; Колонка 2 = 1.", "Строка 2: n = b."] and lines[-4] == "| n | |"
    assert r.h == "[METADATA]\nb: 2\nc: 3\n[/METADATA]\n\nt"


def test_fragments_are_left_out(spark):
    df = spark.createDataFrame([("short", 0), ("short 5", 0), ("short", 1), ("x" * 60, 0)], "t string, n int")
    assert [r.x for r in df.select(chunking.worth_storing(F.col("t"), F.col("n")).alias("x")).collect()] == [False, True, True, True]


def test_noise_goes_in_one_pass_over_the_lines(spark):
    """lists of references of every kind, line by line, and a document of many lines, against a loop; no state carries all lines kept."""
    import random
    import re

    rng = random.Random(14)
    parts = ["", "", "one line", "two  Blanks", "References", "Литература", "Appendix B", "12", "page 3 of 9", "My Header", "МЁД и  мед", "https://x.org/a", "[1] doi:10.1/x", " kept\xa0", "appendix", "h", "a$1", "x\\y"]
    texts = ["\n".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(300)] + ["\n".join(f"line {i}" for i in range(20_000)), None]
    df = spark.createDataFrame([(i, t, ["article", "patent"][i % 2], ["my header", "мед и мед"]) for i, t in enumerate(texts)], "i int, text string, kind string, lines array<string>")
    rows = chunking.without_noise(df, document_type="kind", repeated="lines")
    got = {r.i: r.text for r in rows.collect()}
    for i, t in enumerate(texts):
        kept, tail = [], False
        for line in (t or "").split("\n"):
            line = re.sub(r"[ \t]{2,}", " ", line.replace("\xa0", " ")).strip()
            if not line:
                kept += [""] if kept and kept[-1] else []
            elif re.fullmatch(r"(page )?\d+( of \d+)?", line) or " ".join(line.lower().replace("ё", "е").split()) in ("my header", "мед и мед"):
                continue
            else:
                tail = True if i % 2 == 0 and line in ("References", "Литература") else False if line.lower().startswith("appendix") else tail
                kept += [] if tail or line.startswith(("https:", "[1] doi")) else [line]
        assert got[i] == "\n".join(kept).strip(), (i, t)
    assert " aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_all_white_space(spark):
    from lodestar.functions import text as T

    points = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    x = F.concat("c", "c", F.lit("a b"), "c")
    assert points.where(T.strip(x) != F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).count() == 0
    assert points.where(T.strip(x) == "a b").count() == len(T.WHITE)


def test_marks_become_blanks_in_one_go(spark):
    from lodestar.functions import text as T
    from lodestar.functions import vocabulary as V

    points = spark.range(0, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    text = F.concat(F.lit("a"), "c", F.lit("b в-"), "c", F.lit("\nг -\nd e-\n\nf 1-\n2"))
    for odd in (V.ODD_GLYPHS, "", "[x-z]"):
        t = F.regexp_replace(F.regexp_replace(text, V.INVISIBLE, " "), V.CONTROL, " ")
        t = F.regexp_replace(F.regexp_replace(t, odd, " ") if odd else t, V.IMAGE_MARK, " ")
        t = F.regexp_replace(t, rf"(?U)(?<={V.LETTER})-\s*\n\s*(?={V.LETTER})", "")
        t = F.array_join(F.transform(T.lines(t), lambda s: T.strip(F.regexp_replace(s, r"[ \t]{2,}", " "))), "\n")
        assert points.where(F.array_join(T.clean_lines(text, odd), "\n") != t).count() == 0
