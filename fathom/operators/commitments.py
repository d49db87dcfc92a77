"""Merkle roots, proofs and openings of long leaf lists, by subtrees of aligned blocks.

A round hashes each block of 2**LEVELS nodes of a job in a row of its own, so no
row holds more than a block, and a job of n leaves takes log(n) / LEVELS rounds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .ordered import in_order

LEVELS = 10


def leaf_nodes(leaves: DataFrame, order: str, *then: str) -> DataFrame:
    """(job, i, leaf, node, n): leaves (job, leaf, order columns) numbered from 0, hashed, with the job's count."""
    placed = in_order(leaves, order, *then, keys=["job"])
    counts = leaves.groupBy("job").agg(F.count("*").alias("n"))
    return placed.join(counts, "job").select("job", F.col("place").alias("i"), "leaf", scalars.leaf_hash(F.col("leaf")).alias("node"), "n")


def _zero(level: int) -> bytearray:
    """The root of 2**level padding nodes."""
    node = bytes(32)
    for _ in range(level):
        node = hashlib.sha256(b"\x01" + node + node).digest()
    return bytearray(node)


def _blocks(nodes: DataFrame, rounds_done: int) -> DataFrame:
    """(job, n, b, levels): each block's levels from its nodes to its root."""
    left = F.ceil(F.col("n") / F.lit(2.0 ** (LEVELS * rounds_done)))
    full = F.pow(F.lit(2.0), F.ceil(F.log2(left))).cast("int")
    size = F.least(full, F.lit(2**LEVELS))
    rows = nodes.groupBy("job", "n", F.expr(f"i div {2**LEVELS}").alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("rows"))
    own = F.transform("rows", lambda r: r.node)
    padded = F.concat(own, F.array_repeat(F.lit(_zero(LEVELS * rounds_done)), size - F.size("rows")))
    return rows.select("job", "n", "b", scalars.node_levels(padded).alias("levels"))


def _rounds(nodes: DataFrame) -> int:
    most = nodes.agg(F.max("n")).first()[0] or 1
    rounds = 1
    while 2 ** (LEVELS * rounds) < most:
        rounds += 1
    return rounds


def _upper(blocks: DataFrame) -> DataFrame:
    return blocks.select("job", "n", F.col("b").alias("i"), F.get(F.element_at("levels", -1), F.lit(0)).alias("node"))


def roots(nodes: DataFrame) -> DataFrame:
    """(job, leaves, root) of leaf_nodes, the root as hex."""
    current = nodes.select("job", "n", "i", "node")
    for k in range(_rounds(nodes)):
        current = _upper(_blocks(current, k))
    return current.select("job", F.col("n").alias("leaves"), F.lower(F.hex("node")).alias("root"))


def proofs(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job, index, proof) for wanted (job, index): sibling nodes from leaf to root; null if the index is no leaf's."""
    current, found = nodes.select("job", "n", "i", "node"), None
    rounds = _rounds(nodes)
    for k in range(rounds):
        blocks = _blocks(current, k)
        here = F.floor(F.col("index") / F.lit(2.0 ** (LEVELS * k))).cast("bigint")
        asked = wanted.select("job", "index").distinct().withColumn("b", F.floor(here / 2**LEVELS).cast("bigint"))
        local = here % 2**LEVELS
        inner = F.slice("levels", F.lit(1), F.size("levels") - 1)
        path = F.transform(inner, lambda level, d: F.get(level, F.floor(local / F.pow(F.lit(2.0), d)).cast("int").bitwiseXOR(F.lit(1))))
        part = asked.where("index >= 0").join(blocks, ["job", "b"]).where("index < n").select("job", "index", F.lit(k).alias("round"), path.alias("path"))
        found = part if found is None else found.unionByName(part)
        if k + 1 < rounds:
            current = _upper(blocks)
    whole = found.groupBy("job", "index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("round", "path"))), lambda r: r.path)).alias("proof"))
    return wanted.select("job", "index").join(whole, ["job", "index"], "left")


def openings(nodes: DataFrame, challenges: DataFrame) -> DataFrame:
    """(job, leaves, proofs) for challenges (job, index): null as a whole if any index of the job is no leaf's."""
    proved = proofs(nodes, challenges)
    with_leaf = proved.join(nodes.select("job", F.col("i").alias("index"), "leaf"), ["job", "index"], "left")
    row = F.struct("index", "leaf", "proof")
    by = with_leaf.groupBy("job").agg(F.every(F.col("proof").isNotNull()).alias("good"), F.sort_array(F.collect_list(row)).alias("rows"))
    kept = lambda c: F.when(F.col("good"), c)
    return by.select("job", kept(F.transform("rows", lambda r: F.struct(r.index.alias("index"), r.leaf.alias("leaf")))).alias("leaves"), kept(F.transform("rows", lambda r: r.proof)).alias("proofs"))


def reveal_holds(root: Column, leaves: Column, proofs: Column) -> Column:
    """Whether every opened leaf is under the hex root; none opened is true, unequal lengths are false."""
    pairs = F.arrays_zip(leaves.alias("l"), proofs.alias("p"))
    return (F.size(leaves) == F.size(proofs)) & F.forall(pairs, lambda x: scalars.proof_holds(root, x["l"]["leaf"], x["l"]["index"], x["p"]))
