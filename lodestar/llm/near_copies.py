"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and which of each group stays.

Texts with one set are one node. Nodes meet by their SimHash fingerprints first,
by the pigeonhole search that the caller gives. Those within its radius are a part
of the links only, so all nodes then meet as ``minhash`` has it, by the bands of a
circulant signature, stars of centres and cells with a prefix filter, in which
those joined already are not compared again. Each link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .minhash import alike_components, full_sets, signed

SHINGLE, PERCENT = 5, 80


def text_digest(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def copies_to_keep(docs: DataFrame, ws: Workspace, fingerprint: Callable[[np.ndarray], int], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, digest): of each component of ``docs`` (doc_id, text) the least doc_id, and of its texts that with the least digest.

    Rows with null doc_id don't count. Null texts are as empty ones; texts without words are one component.
    ``fingerprint`` is that of a set of hashes, and ``search`` takes distinct ones (fp, rep)
    and gives pairs (src, dst) of near ones.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", text_digest().alias("digest"), "text")
    firsts = [F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")]
    nodes = signed(docs, SHINGLE, fingerprint=fingerprint).groupBy("node").agg(*firsts).drop("node")
    nodes = ws.save(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # from here on ids are fixed

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps = nodes.join(wanted, "id").select("id", "rep.*")
        return full_sets(docs.join(reps, ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "text"), SHINGLE)

    own = nodes.where("fp IS NOT NULL").select("id", "fp")
    fps = ws.save(own.groupBy("fp").agg(F.min("id").alias("rep")), "fingerprints")
    same = own.join(fps, "fp").where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    near = ws.save(search(fps).unionByName(same), "near fingerprints")
    roots = alike_components(nodes.where("keys IS NOT NULL").select("id", "n", "keys"), sets_of, PERCENT, ws, near)
    of = nodes.select("id", "rep").join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("rep").alias("rep"))
    return ws.save(of.select("rep.*"), "kept")
