"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from veridoc.llm import merkle
from veridoc.llm.common import table
from veridoc.llm.queries import QUERIES

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_of(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(nodes, fanout):
    """Levels up to one node, and each first node's siblings."""
    grown = [nodes]
    while len(grown[-1]) > 1:
        grown.append([H("".join(grown[-1][i : i + fanout])) for i in range(0, len(grown[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in grown[:-1]:
            first = i // fanout * fanout
            path.append((level[first:i], level[i + 1 : first + fanout]))
            i //= fanout
        paths.append(path)
    return grown[-1][0], paths


def brute(rows, fanout=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, leaves = [], {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        digests = [leaf_of(r, r["text"]) for r in own]
        top, paths = tree(digests, fanout)
        subs.append(top)
        leaves[g] = list(zip(own, digests, paths, strict=True))
    if not subs:
        return []
    root, uppers = tree(subs, fanout)
    out = []
    for g, top, upper in zip(order, subs, uppers, strict=True):
        for r, digest, path in leaves[g]:
            whole = [*path, *upper]
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = text.translate(LOWER)
            node = leaf_of(r, text)
            for a, b in whole:
                node = H("".join([*a, node, *b]))
            out.append((r["doc_id"], digest, top, root, H("".join("".join(a + b) for a, b in whole)), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def tampered():
    return {"text": F.expr("CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}


@pytest.mark.parametrize("fanout,height", [(2, 1), (3, 2), (8, 4)])
def test_manifest(spark, fanout, height):
    rows = [(i, f"Text {i} É\n" * (i % 4) if i % 11 else None, [None, "en", "en", "fr", "é"][i % 5] if i != 77 else "lone", None if i % 7 == 0 else "s", i if i % 5 else None, "x") for i in range(130)]
    rows += [(None, "No Id", "en", "s", 1, "x"), (5, "Twice", None, "s", 1, "y"), (6, "Same", "en", "s", 1, "y"), (6, "Same", "en", "s", 1, "y"), (500, "Ä" * 300_000, "fr", "s", 1, "z"), (501, "", "fr", "", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, path string").repartition(5)
    found = merkle.manifest(df, received=tampered(), fanout=fanout, height=height, proofs=True)
    assert got(found) == brute([r.asDict() for r in df.collect()], fanout)
    first = found.where("doc_id = 1").first()
    assert merkle.fold(first.leaf.encode(), [(x.before.encode(), x.behind.encode()) for x in first.path]).decode() == first.root


def test_manifest_small_tables(spark):
    df = spark.createDataFrame([(3, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == H("")
    two = df.unionByName(df.withColumn("lang", F.lit(None).cast("string")))
    rows = [r.asDict() for r in two.collect()]
    assert {r.root for r in merkle.manifest(two).collect()} == {brute(rows)[0][3]}


def test_manifest_query(spark, small):
    docs = [r.asDict() for r in table(spark, small, "documents").collect()]
    assert got(QUERIES["op11_merkle_manifest"](spark, small)) == brute(docs)
