"""Labels of any number in texts, facts by many constraints, and running aggregates, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, terms
from lodestar.operators.extraction import Ontology, Term, facts_of
from lodestar.operators.prefix import running_before


def slow_find(labels, text):
    """One regular expression for each label, the longest first."""
    low, taken, found, seen = " ".join(text.lower().replace("ё", "е").split()), set(), [], set()
    for label, term in sorted(((" ".join(x.lower().replace("ё", "е").split()), t) for x, t in labels), key=lambda x: -len(x[0])):
        if not label or label in seen:
            continue
        seen.add(label)
        for m in re.finditer(rf"(?<!\w){re.escape(label)}(?!\w)", low):
            if not taken & set(range(*m.span())):
                taken |= set(range(*m.span()))
                found.append((term, label, *m.span()))
    return sorted(found, key=lambda x: (x[2], x[3]))


TEXTS = ["", None, "a b a b a", "Ёлка  ёлка\nелка", "(x) a(x) (x)b", "b b b b", "a-b, a b; A B_ a", "%% % a%", "c " * 4000, "ab a\xa0b"]
LABELS = [("a b a", "1"), ("a b", "2"), ("a", "3"), ("b b", "4"), ("ЕЛКА", "5"), ("елка", "6"), ("(x)", "7"), ("%%", "8"), ("", "9"), ("  ", "10"), ("a  b", "11"), ("c c", "12"), ("-", "13"), ("b, a", "14")]


def test_labels_as_by_regular_expressions():
    rng = random.Random(1)
    for text in TEXTS:
        assert terms.Labels(LABELS).find(text) == slow_find(LABELS, text or "")
    for _ in range(300):
        labels = [(" ".join(rng.choices("abc", k=rng.randint(1, 4))), str(i)) for i in range(rng.randint(1, 9))]
        text = " ".join(rng.choices(["a", "b", "c", "ab", "a,", "-b"], k=40))
        assert terms.Labels(labels).find(text) == slow_find(labels, text)


@pytest.mark.parametrize("broadcast_bytes", [0, None])
def test_labels_in_a_table(spark, broadcast_bytes):
    """Sent to all tasks or joined: the same, with repeated rows, nulls and a word that many labels share."""
    rng = random.Random(2)
    labels = LABELS + [(f"w w{i} {'w' if i % 2 else ''}", f"w{i}") for i in range(200)] + [(None, "x")]
    texts = TEXTS + [" ".join(f"w w{rng.randrange(220)}" for _ in range(30)) for _ in range(20)]
    rows = [(i % 20, t) for i, t in enumerate(texts)] + [(0, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"row": F.lit(1), "label": F.lit("a"), "key": F.lit("k")}).repartition(3)
    table = spark.createDataFrame([(t, x, i) for i, (x, t) in enumerate(labels)], "term_id string, label string, pos int")
    got = Counter(map(tuple, terms.find_labels(docs, table, "doc_id", broadcast_bytes=broadcast_bytes).collect()))
    assert got == Counter((k, *m) for k, t in rows for m in slow_find([x for x in labels if x[0]], t or ""))
    assert terms.find_labels(docs.limit(0), table, "doc_id", broadcast_bytes=broadcast_bytes).count() == 0
    assert terms.find_labels(docs, table.limit(0), "doc_id", broadcast_bytes=broadcast_bytes).count() == 0


def test_fact_ids_do_not_depend_on_blanks():
    ontology = Ontology((Term("ni", "Metal", ("никель",)),), {"concentration": ("содержание",)})
    a = facts_of(ontology, "Расчёт:  содержание никеля  при 5   мг/л\n", "s", "o")
    b = facts_of(ontology, "Расчет: содержание никеля при 5 мг/л", "s", "o")
    assert a == b and a[0][8] == " 5 мг/л" and a[0][14] == "Расчет: содержание никеля при 5 мг/л"


def meets(fact, c):
    (_, dim, v, v2, own), (c_dim, op, w, w2, wanted) = fact, c
    if c_dim not in (None, "unknown") and c_dim != dim or own and wanted and not set(own) & set(wanted):
        return False
    ends = lambda a, b: (min(x for x in (a, b) if x is not None), max(x for x in (a, b) if x is not None))
    if v is None or w is None:
        return False
    (low, high), (c_low, c_high) = ends(v, v2), ends(w, w2)
    return low <= c_low if op in ("<", "<=") else high >= c_low if op in (">", ">=") else low <= c_high and c_low <= high


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_facts_meet_many_constraints(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, [], ["a"], ["b"], ["a", "c"], ["d"]])
    facts = [(f"f{i}", rng.choice(["x", "y", "z", None, "unknown"]), rng.choice([None, *range(12)]), rng.choice([None, None, *range(12)]), some()) for i in range(400)]
    facts += [("same", "x", 3, None, ["a"])] * 3
    wanted = [(rng.choice(["x", "y", "q", None, "unknown"]), rng.choice(["<", "<=", ">", ">=", "=", "range", None]), rng.choice([None, *range(-3, 15)]), rng.choice([None, None, *range(12)]), some() or ["e"]) for _ in range(40)]
    wanted = [(d, o, w if o not in ("<", "<=", ">", ">=") or w is None else (w - 14 if o[0] == "<" else w + 9), w2, e) for d, o, w, w2, e in wanted]
    number = lambda x: None if x is None else float(x)
    df = spark.createDataFrame([(i, d, number(v), number(w), e) for i, d, v, w, e in facts], "fact_id string, dimension string, value double, value_max double, entity_ids array<string>")
    df = df.withColumns({"operator": F.lit("observed"), "begin": F.lit(1), "key": F.lit("k"), "low": F.lit(0), "of": F.lit("")})
    c = spark.createDataFrame([(d, o, number(w), number(w2), e) for d, o, w, w2, e in wanted], "c_dimension string, c_operator string, c_value double, c_value_max double, c_entity_ids array<string>")
    assert c.count() > search.FEW
    got = Counter(r.fact_id for r in search.facts_matching(df, c).collect())
    # a value of null with a second one counts as that one
    whole = [(i, d, v if v is not None else w, w, e) for i, d, v, w, e in facts]
    asked = [(d, o, w if w is not None else w2, w2, e) for d, o, w, w2, e in wanted]
    assert got == Counter(f[0] for f in whole if any(meets(f, c) for c in asked))
    assert 0 < len(got) < 400


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_facts_meet_intervals_held_or_sorted(spark, monkeypatch, sent):
    """intervals that all tasks hold and those sorted in give the same; numbers are in Spark's order, where NaN is greater than all."""
    monkeypatch.setattr(search, "SENT", sent)
    rng, inf, nan = random.Random(sent), float("inf"), float("nan")
    number = lambda *more: rng.choice([None, -inf, inf, nan, -0.0, 0.0, *more, *[x / 2 for x in range(-30, 30)]])
    own = lambda: rng.choice([None, [], ["a"], ["b", "b"], ["a", None], [None], ["=a", "all"], ["d"]])
    facts = spark.createDataFrame([(i, rng.choice(["x", "y", "", None, "unknown"]), "observed", number(), number(None, None), own()) for i in range(500)], "fact_id int, dimension string, operator string, value double, value_max double, entity_ids array<string>").repartition(3)
    asked = [(rng.choice(["x", "y", "", "q"]), "range", w, w + rng.choice([0.0, 0.5]), own()) for w in [rng.randrange(-30, 30) / 2 for _ in range(60)]]
    asked += [("x", ">", 11.0, None, ["a"]), ("x", ">=", 9.0, 14.0, ["a"]), ("y", "<", -12.0, None, []), (None, "=", nan, None, ["d"]), ("unknown", "=", 0.0, None, None), ("y", "=", inf, None, None), ("", ">", nan, None, None)]
    columns = "c_dimension string, c_operator string, c_value double, c_value_max double, c_entity_ids array<string>"
    got = sorted(r.fact_id for r in search.facts_matching(facts, spark.createDataFrame(asked, columns)).collect())
    # a few at a time are a filter
    few = [search.facts_matching(facts, spark.createDataFrame(asked[i : i + 30], columns)) for i in range(0, len(asked), 30)]
    assert got == sorted({r.fact_id for df in few for r in df.collect()}) and 0 < len(got) < 500
    none = spark.createDataFrame([("x", "=", None, None, None)] * 40, columns)
    assert search.facts_matching(facts, none).count() == 0


def test_facts_are_not_shuffled(spark):
    """with many constraints facts were shuffled twice, to be sorted and to be found again."""
    facts = spark.range(300).select("id", F.lit("d").alias("dimension"), F.lit("observed").alias("operator"), F.col("id").cast("double").alias("value"), F.lit(None).cast("double").alias("value_max"), F.array(F.lit("a")).alias("entity_ids"))
    asked = spark.range(100).select(F.lit("d").alias("c_dimension"), F.lit("range").alias("c_operator"), (F.col("id") / 4).alias("c_value"), (F.col("id") / 4 + 0.25).alias("c_value_max"), F.array(F.lit("a")).alias("c_entity_ids"))
    found = search.facts_matching(facts, asked)
    assert found.count() == 26 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # intervals that touch are one, for each of the two keys
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(search, "meets", lambda edges, *rest: seen.append(edges.where("NOT last").collect()) or F.lit(True))
        search.facts_matching(facts, asked)
    assert [(r.key, r.begin) for r in sorted(seen[0], key=lambda r: r.key)] == [("=a", 0.0), ("all", 0.0)]


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_before(spark, how):
    """One group over all partitions, small ones, null groups and values."""
    rng = random.Random(5)
    rows = [(rng.choice(["big"] * 8 + ["a", "b", None]), i, rng.choice([None, *range(9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v long").repartition(4)
    got = {r.i: r.before for r in running_before(df, ["g"], [F.col("i")], "v", how, parts=9).collect()}
    for g, i, _ in rows:
        earlier = [v for h, j, v in rows if h == g and j < i and v is not None]
        assert got[i] == ((sum if how == "sum" else max)(earlier) if earlier else None)
    assert running_before(df.limit(0), ["g"], [F.col("i")], "v").count() == 0


def test_budget_of_one_large_theme(spark):
    """All chunks in one theme: sums are made by partitions of the range, and the first that doesn't fit ends it."""
    rows = spark.range(20_000).select(F.lit("t").alias("theme_id"), F.col("id").alias("chunk_id"), F.lit("x").alias("text"), F.lit(3).alias("size"))
    rows = rows.union(spark.createDataFrame([("u", 100_001, "y", 10_000), ("u", 100_002, "z", 1)], "theme_id string, chunk_id long, text string, size int"))
    kept = search.budgeted(rows, ["chunk_id"], "size", 9000, group="theme_id").collect()
    assert sorted((r.theme_id, r.chunk_id) for r in kept) == [("t", i) for i in range(3000)] + [("u", 100_001)]
    cut = search.budgeted(rows, ["chunk_id"], "size", 1000, group="theme_id", truncate=True).collect()
    assert sorted((r.theme_id, r.chunk_id, r.used) for r in cut)[-2:] == [("t", 333, 1), ("u", 100_001, 1000)] and len(cut) == 335


@pytest.mark.parametrize("probed", [1, 3, 1 << 40])
def test_runs_are_drawn_by_their_hash(spark, monkeypatch, probed):
    """F8: the runs of least hash of all texts, whichever texts tell how small a hash has to be."""
    from hashlib import md5

    monkeypatch.setattr(terms, "PROBED", probed)
    rng = random.Random(8)
    texts = [None, "", "one", "a  b", "Ёж_1 И ёж", "x-y z, q r", "a b\nc d e"] + [" ".join(rng.choices(["a", "Bc", "dé", "ё", "4", "b,", "\n", ""], k=60)) for _ in range(40)]
    word = r"[^\W]"
    runs = {m.group(1) for t in texts if t for n in (1, 2) for m in re.finditer(rf"(?<!{word})(?=({word}+{f' {word}+' * n})(?!{word}))", t.lower())}
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for most in (1, 20, len(runs), len(runs) + 5):
        got = [tuple(r) for r in terms.drawn_runs(docs, most).collect()]
        assert [(x, h) for h, x in sorted((md5(x.encode()).hexdigest(), x) for x in runs)[:most]] == got
    assert terms.drawn_runs(docs.limit(0), 5).count() == 0


def test_labels_are_made_once(spark, tmp_path):
    """F8: what it takes to make the labels is not done again to count their bytes."""
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    labels = spark.createDataFrame([("t", "a b", 0), ("u", "c", 1)], "term_id string, label string, pos int").mapInPandas(made, "term_id string, label string, pos int")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    assert terms.find_labels(docs, labels, "doc_id").count() == 2
    assert seen.value == 2
