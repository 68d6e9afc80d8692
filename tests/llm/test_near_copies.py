"""The pipeline's near-dedup finds candidates by fingerprints, which are confirmed on the full sets."""


from lodestar.llm import minhash, simhash
from lodestar.workspace import Workspace


def test_candidates_without_a_band_are_confirmed(spark):
    a, b, c = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "quite another text of as many words as the others"
    texts = spark.createDataFrame([(1, a), (2, b), (3, c)], "id long, text string")
    nodes = spark.createDataFrame([(1, 6, [11]), (2, 6, [12]), (3, 6, [13])], "id long, n long, keys array<long>")
    near = spark.createDataFrame([(2, 1), (3, 1)], "src long, dst long")
    sets_of = lambda wanted: minhash.full_sets(texts.join(wanted, "id").select("id", "text"), 5)
    found = minhash.alike_components(nodes, sets_of, 80, Workspace(spark, "near"), near)
    assert [tuple(r) for r in found.select("id", "root").collect()] == [(2, 1)]


def test_the_stage_asks_for_near_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "another text of its own")]
    seen = {}

    def spy(fps, plan, ws, find=simhash.links):
        seen["fps"], seen["links"] = fps.count(), (found := ws.save(find(fps, plan, ws), "seen")).count()
        return found

    monkeypatch.setattr(simhash, "links", spy)
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    prints = [simhash.majority(minhash.shingle_set(minhash.words_of(t), 5)) for _, t in rows]
    near = bin(prints[0] ^ prints[1]).count("1")
    assert seen["fps"] == len(set(prints)) and seen["links"] == (0 < near <= simhash.RADIUS)
