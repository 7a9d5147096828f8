"""Merkle manifest of a dataset: every row's digest, a tree for each group of rows, one root, and a proof for each row.

H is the hex SHA-256 of its concatenated inputs (digests as hex text).  A row's leaf is H of its fields, each `-` if null, else
its UTF-8 byte count, `:` and its value.  In a group (language) leaves ascend by doc_id; while there are several
nodes, every `fanout` consecutive ones, the last run fewer (even one), become their H.  What remains is the group's subroot;
subroots, ordered by group (null first, bytewise), make the root in the same way.

1. Leaves are DataFrame expressions; places inside a group come from exact ranks over sampled ranges.
2. An aligned block of fanout ** height leaves is one contiguous numpy matrix of 64-byte hex rows, reshaped by the fanout and
   hashed row by row, level by level.  A block leaves one node; blocks of nodes go on in the same way, so that the
   rounds grow with the logarithm of the rows to the base of the block (4096).
3. Going down again, a block meets the path of its top (a few siblings a level); the siblings of node i at a level are the
   rest of run i // fanout, by index arithmetic on the level's matrix.
4. `received` replaces columns by expressions, as a copy of the table may have them: a row's leaf is taken from these,
   folded with the siblings of the original and compared with the root.

Scale: texts are hashed where they are read; what is shuffled is a digest or two a row, and a task holds one block at a time.
Groups of any size split into blocks; the number of groups isn't bounded either (subroots are ranked and blocked like leaves).
Digests and places are written tables, so a lost executor costs one step.

Defined cases: a null in any field is `-` (a null doc_id ranks first); empty and very long texts are hashed whole; rows of one
group with equal doc_id are ordered by their leaves, and equal rows (whose leaves are equal) arbitrarily; an empty table
returns no rows; other columns, whatever their names, are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veridoc.operators.ranking import exact_rank

from .common import dropped, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields with their sizes."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _hex(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def matrix(digests: pa.Array) -> np.ndarray:
    """Hex digests as contiguous rows of 64 bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def levels(leaves: np.ndarray, fanout: int, height: int) -> list[np.ndarray]:
    """The level of the leaves and `height` levels above: full runs are rows of the reshaped matrix, the rest is one more."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        full = len(below) // fanout
        made = [_hex(run) for run in below[: full * fanout].reshape(full, fanout * 64)]
        if full * fanout < len(below):
            made.append(_hex(below[full * fanout :].tobytes()))
        out.append(np.frombuffer(b"".join(made), np.uint8).reshape(-1, 64))
    return out


def siblings(level: bytes, node: int, fanout: int) -> tuple[bytes, bytes]:
    """The run's digests before and behind a node of a level (its matrix as bytes)."""
    first = node - node % fanout
    return level[first * 64 : node * 64], level[(node + 1) * 64 : (first + fanout) * 64]


def height_of(size: int, fanout: int, most: int) -> int:
    """Levels above `size` nodes until one is left, `most` at most."""
    h = 0
    while size > 1 and h < most:
        size, h = -(-size // fanout), h + 1
    return h


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its siblings, level by level, lead to."""
    for before, behind in path:
        node = _hex(before + node + behind)
    return node


_PATH = "path array<struct<before: string, behind: string>>"
_PATHS = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))


def _tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """One node for each block of nodes (grp, place, size, digest)."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        size = block["size"][0].as_py()
        top = levels(matrix(block["digest"]), fanout, height_of(size, fanout, height))[-1]
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "place": [key[1].as_py()], "size": [-(-size // fanout**height)], "digest": [top.tobytes().decode()]})

    block = F.expr(f"place div {fanout**height}")
    return nodes.select("grp", "place", "size", "digest").groupBy("grp", block.alias("block")).applyInArrow(run, "grp string, place bigint, size bigint, digest string")


def _grown(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """Tables of nodes, each one's blocks being the next one's nodes, up to one node a group."""
    out = [nodes]
    while (nodes.agg(F.max("size")).first()[0] or 0) > 1:
        nodes = written(_tops(nodes, fanout, height), "tops")
        out.append(nodes)
    return out


def _descended(rounds: list[DataFrame], paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """grp, place, path of the nodes of rounds[0] from those of each group's last node."""

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        grown = [m.tobytes() for m in levels(matrix(block["digest"]), fanout, height_of(block["size"][0].as_py(), fanout, height))]
        upper = [(x["before"], x["behind"]) for x in above["path"][0].as_py()]
        path = [[*[tuple(x.decode() for x in siblings(m, i // fanout**k, fanout)) for k, m in enumerate(grown[:-1])], *upper] for i in range(block.num_rows)]
        return pa.table({"grp": block["grp"], "place": block["place"], "path": pa.array([[{"before": a, "behind": b} for a, b in p] for p in path], _PATHS)})

    block = F.expr(f"place div {fanout**height}").alias("block")
    for nodes in reversed(rounds[:-1]):
        found = nodes.select("grp", "place", "size", "digest").groupBy("grp", block).cogroup(paths.select("grp", F.col("place").alias("block"), "path").groupBy("grp", "block"))
        paths = written(found.applyInArrow(run, f"grp string, place bigint, {_PATH}"), "paths")
    return paths


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, received: dict[str, Column] | None = None, fanout: int = 8, height: int = 4, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with `proofs` also path (before and behind a node, upwards)."""
    got = received or {}
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    original = leaf_digest([F.col(f) for f in fields])
    arrived = leaf_digest([got.get(f, F.col(f)) for f in fields]) if got else F.lit(None).cast("string")
    leaves = docs.select(grp.alias("grp"), F.col(doc_id).alias("doc_id"), original.alias("digest"), arrived.alias("arrived"))
    # Texts are hashed once; the sample that finds the splitters reads digests.
    leaves = written(leaves.withColumn("arrived", F.when(F.col("arrived") != F.col("digest"), F.col("arrived"))), "leaves")
    placed = written(exact_rank(leaves, ["doc_id", "digest"], ["grp"], rank="place", size="size"), "placed")
    dropped(leaves)
    rounds = _grown(placed, fanout, height)
    subroots = rounds[-1].select(F.col("grp").alias("own"), F.lit("").alias("grp"), "digest")
    subroots = written(exact_rank(subroots, ["own"], ["grp"], rank="place", size="size"), "subroots")
    crown = _grown(subroots, fanout, height)
    top = crown[-1].select("grp", "place", F.expr("array()").cast("array<struct<before: string, behind: string>>").alias("path"))
    root = crown[-1].select(F.col("digest").alias("root"))
    of_groups = _descended(crown, top, fanout, height)
    starts = subroots.join(of_groups.drop("grp"), "place").select(F.col("own").alias("grp"), F.lit(0).cast("bigint").alias("place"), F.col("digest").alias("subroot"), "path")
    starts = written(starts.join(F.broadcast(root)), "starts")  # one row of one digest
    if len(rounds) == 1:  # every group is a lone leaf
        blocks = starts
    else:
        blocks = _descended(rounds[1:], starts.select("grp", "place", "path"), fanout, height).join(starts.select("grp", "subroot", "root"), "grp")

    outputs = {"leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()} | ({"path": _PATHS} if proofs else {})

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        grown = [m.tobytes() for m in levels(matrix(block["digest"]), fanout, height_of(block["size"][0].as_py(), fanout, height))]
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        upper = [(x["before"].encode(), x["behind"].encode()) for x in above["path"][0].as_py()]
        over = b"".join(a + b for a, b in upper)
        ends: dict[bytes, bytes] = {}  # blocks whose leaves are as they were end in one and the same node
        rows: dict[str, list] = {k: [] for k in outputs}
        for i, (leaf, arrived) in enumerate(zip(block["digest"].to_pylist(), block["arrived"].to_pylist(), strict=True)):
            own = [siblings(m, i // fanout**k, fanout) for k, m in enumerate(grown[:-1])]
            node = fold((arrived or leaf).encode(), own)
            if node not in ends:
                ends[node] = fold(node, upper)
            folded = ends[node].decode()
            made = {"leaf": leaf, "subroot": subroot, "root": root, "proof_sha256": hashlib.sha256(b"".join(a + b for a, b in own) + over).hexdigest(), "folded_root": folded, "verified": folded == root}
            if proofs:
                made["path"] = [{"before": a.decode(), "behind": b.decode()} for a, b in [*own, *upper]]
            for k, v in made.items():
                rows[k].append(v)
        return pa.table({"doc_id": block["doc_id"]} | {k: pa.array(v, outputs[k]) for k, v in rows.items()})

    schema = f"doc_id {dict(placed.dtypes)['doc_id']}, " + ", ".join(f"{k} {'boolean' if k == 'verified' else 'string'}" for k in outputs if k != "path") + (f", {_PATH}" if proofs else "")
    block = F.expr(f"place div {fanout**height}").alias("block")
    return placed.groupBy("grp", block).cogroup(blocks.select("grp", F.col("place").alias("block"), "path", "subroot", "root").groupBy("grp", "block")).applyInArrow(run, schema)
