"""The pipeline: each stage on its own input against brute force, and the whole run."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, minhash, secret_scan, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay(stages):
    columns = stages[0][0].columns
    assert all(after.columns == columns for _, after in stages[:-1]) and "doc_id" in stages[-1][1].columns


def test_rules_keep_clean_documents(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[0])
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert set(after) <= set(before)
    assert all(d in after for d, t in before.items() if len(set(zip(words(t), words(t)[1:], words(t)[2:]))) == len(words(t)) - 2 >= 48)


def test_fingerprint_groups_of_the_stage_input(stages):
    """op1's own rule, two bits of 3-word fingerprints, on what the stage reads; the stage's rule is below."""
    before = {r.doc_id: r.text for r in stages[1][0].collect()}
    fps = {d: simhash.fingerprint(t) for d, t in before.items()}
    groups = {d: min(x for x in fps if (fps[x] ^ fps[d]).bit_count() <= 2) for d in fps}
    while any(groups[groups[d]] != groups[d] for d in groups):
        groups = {d: groups[groups[d]] for d in groups}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2 and groups[a] != groups[b]:
                low, high = sorted((groups[a], groups[b]))
                groups = {d: low if g == high else g for d, g in groups.items()}
    assert {r.doc_id: r.component_id for r in simhash.simhash_components(stages[1][0]).collect()} == groups


def near_groups(texts):
    """Least document of each group by 5-word Jaccard of 0.8, all pairs compared."""
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return set(root.values())


def test_near_copies_go(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1])
    assert set(after) == near_groups(before)


@pytest.mark.parametrize("part", [1, 1024])
def test_edited_copies_go(spark, monkeypatch, part):
    """Copies with words changed, in a crowd and in chains, around and across the limit of 0.8; blocks split into many cells, and not."""
    monkeypatch.setattr(minhash, "PART_BYTES", 4096 * part)
    monkeypatch.setattr(minhash, "TASK_BYTES", 9000 * part)
    monkeypatch.setattr(minhash, "GRID_BYTES", 4096 * part)
    rng, texts = random.Random(3), {}
    for group in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            own = list(base)
            for at in rng.sample(range(120), rng.randrange(7)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
            base = own if group % 2 else base
    got = simhash.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == near_groups(texts) and len(got) < len(texts)


def test_no_contamination_is_left(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    find = decontaminate.Decontaminator(items).find
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[2])
    assert set(after) == {d for d, t in before.items() if not find(t)}


def test_no_secret_is_left(stages):
    scan = secret_scan.Scanner().scan
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[3])
    assert set(before) == set(after) and not any(scan(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not scan(t))


def test_run(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages[-1][1].collect()}


def test_run_on_awkward_tables(spark, tmp_path):
    """Nulls, repeated rows, an empty benchmark, and no document at all."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text + " more", None, None, None), (None, text, "en", "a", 1), (3, None, "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).withColumn("host", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) in (["1", "None"], ["1", "2", "None"])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
