"""Merkle manifest of a table, kept as a tree of SHA-256 midstates.

Every row is a leaf; the leaves of a tree stand in the order of doc_id, runs of ``fanout`` nodes in a row become their
parent's digest, level by level, until one is left. The roots of all trees, in the order of the trees' names, are the
leaves of one more tree, whose root stands for the table.

A digest in hex fills one block of SHA-256, so the state of a parent's hash before each child slot is eight words. The
manifest keeps these copied states: a changed leaf is folded up to the root by resuming, at each level, the state of its
slot with the replacement and the siblings to its right only. Nothing to the left is hashed again.

Levels are built in blocks of about ``block`` nodes, a group each, so a table of any size takes a few
jobs; places within a tree come from a range sort and sums over its partitions, never from a window over a tree. To fold,
leaves meet the levels of their block and, once per block, the path of that block to the root.

Defined cases: a null value is ``-``; nulls order first, in doc_id and in the tree column; rows of one doc_id stand in the
order of their digests; rows that repeat are leaves each; a text is one value of any length; an empty table has no leaves,
no trees and no root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import named, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOTS = "roots"
LEVELS = "tree string, block long, level int, below long, digests binary, states binary"


class Manifest(NamedTuple):
    """leaves (tree, at, n, has_id, k, leaf, now), blocks of leaves (tree, block, level, below, digests, states: the nodes of a
    level and the states before their slots), paths (tree, block, path, subroot, root: from such a block up to the root)."""

    leaves: DataFrame
    blocks: DataFrame
    paths: DataFrame
    fanout: int
    depth: int


# --- SHA-256 by its published rules, over arrays of lanes ---------------------------------------------------------------

@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, list[int]]:
    """The first state and the round constants: fractions of the square and cube roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]

    def cube_root(n: int) -> int:
        low, high = 0, 1 << 40
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if middle**3 <= n else (low, middle)
        return low

    first = [isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]]
    return np.array(first, np.uint32)[:, None], [cube_root(p << 96) & 0xFFFFFFFF for p in primes[:64]]


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, lanes) after a block of 16 words (16, lanes)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for k, x in zip(_constants()[1], w, strict=True):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + np.uint32(k) + x
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.array([a, b, c, d, e, f, g, h])


def in_hex(state: np.ndarray) -> np.ndarray:
    """Digests (8, lanes) as the 16 words of their 64 hex digits."""
    raw = np.ascontiguousarray(state.T).astype(">u4").view(np.uint8)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    return np.ascontiguousarray(digits[np.stack([raw >> 4, raw & 15], axis=2)].reshape(len(raw), 64).view(">u4").astype(np.uint32).T)


def closed(state: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    """Digests of messages of whole blocks: the last block holds the mark of the end and the length alone."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 1 << 31, np.asarray(blocks) * 512
    return compressed(state, last)


def _lanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(-1, 8).T).astype(np.uint32)


def _bytes(state: np.ndarray) -> bytes:
    return np.ascontiguousarray(state.T).astype(">u4").tobytes()


# --- leaves and places --------------------------------------------------------------------------------------------------

def leaf(values: dict[str, Column]) -> Column:
    """Digest of the values in order, each as its UTF-8 length, a colon and itself, or ``-``."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(part(c) for c in values.values())), 256)


def leaves_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", **changed: Column) -> DataFrame:
    """(tree, has_id, k, leaf, now): ``now`` is the leaf with some fields as they are given in ``changed``."""
    values = {c: named(c) for c in fields}
    return docs.select(
        F.coalesce(F.concat(F.lit("="), named(tree).cast("string")), F.lit("-")).alias("tree"), F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce("doc_id", F.lit(0)).alias("k"), leaf(values).alias("leaf"), leaf(values | changed).alias("now"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row within its tree from 0, and ``n``, the rows of the tree; written.

    A range sort by tree and order (row numbers part what repeats), then sums over a tree's partitions.
    """
    keys = ["tree", *order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    kept = written(ranged.withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.shiftright("number", 33)))
    held = kept.groupBy("tree", "part").agg(F.min("number").alias("begin"), F.count(F.lit(1)).alias("m"))
    of_tree = W.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("m").over(of_tree.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = held.select("tree", "part", (before - F.col("begin")).alias("shift"), F.sum("m").over(W.partitionBy("tree")).alias("n"))
    return written(kept.join(parts, ["tree", "part"]).withColumn("at", F.col("number") + F.col("shift")).drop("number", "part", "shift"))


# --- the tree -----------------------------------------------------------------------------------------------------------

def block_depth(fanout: int, block: int) -> int:
    """Levels of a block of at most ``block`` nodes, one at least."""
    depth = 1
    while fanout ** (depth + 1) <= block:
        depth += 1
    return depth


def _build(rows: pa.Table, fanout: int, most: int) -> pa.Table:
    """Rows (tree, block, at, n, digest as hex) of one block -> its levels, the last with the root of the block alone."""
    rows = rows.sort_by("at")
    tree, block, n = rows["tree"][0].as_py(), rows["block"][0].as_py(), rows["n"][0].as_py()
    levels = 0
    while levels < most and fanout**levels < n:
        levels += 1
    now, out = [bytes.fromhex(x) for x in rows["digest"].to_pylist()], []
    for level in range(levels + 1):
        digests, lanes = b"".join(now), _lanes(b"".join(now))
        states = np.empty_like(lanes)
        states[:, ::fanout] = _constants()[0]
        for slot in range(1, fanout if level < levels else 1):  # the state before a slot is copied on from the one to its left
            left = np.arange(slot - 1, len(now) - 1, fanout)
            states[:, left + 1] = compressed(states[:, left], in_hex(lanes[:, left]))
        out.append((tree, block, level, -(-n // fanout**levels), digests, _bytes(states)))
        now = [hashlib.sha256(b"".join(x.hex().encode() for x in now[i : i + fanout])).digest() for i in range(0, len(now), fanout)]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["tree", "block", "level", "below", "digests", "states"])


def _grown(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """Nodes (tree, at, n, digest) -> the written blocks (tree, block, level, below, digests, states) of each stage, up to the roots."""
    size, stages = fanout**depth, []
    while True:
        dealt = nodes.select("tree", F.expr(f"at div {size}").alias("block"), (F.col("at") % size).alias("at"), "n", "digest")
        stages.append(written(dealt.groupBy("tree", "block").applyInArrow(lambda t: _build(t, fanout, depth), LEVELS)))
        tops = stages[-1].groupBy("tree", "block").agg(F.max_by("digests", "level").alias("top"), F.max("below").alias("n"))
        nodes = tops.select("tree", F.col("block").alias("at"), "n", F.lower(F.hex("top")).alias("digest"))
        if nodes.where("n > 1").isEmpty():  # a tree that ended goes on as one node
            return stages


def _root_of(stage: DataFrame) -> DataFrame:
    """(tree, digest) of the trees' last stage: one block each."""
    return stage.groupBy("tree").agg(F.lower(F.hex(F.max_by("digests", "level"))).alias("digest"))


def _paths(rows: pa.Table, fanout: int, depth: int) -> pa.Table:
    """Levels of one block -> (tree, at, path) of its nodes: per level the run that a node stands in, its states and its slot."""
    rows = rows.sort_by("level")
    tree, block, levels = rows["tree"][0].as_py(), rows["block"][0].as_py(), list(zip(rows["digests"].to_pylist(), rows["states"].to_pylist(), strict=True))
    out = []
    for at in range(len(levels[0][0]) // 32):
        path, node = [], at
        for digests, states in levels[:-1]:
            first = node - node % fanout
            path.append({"digests": digests[32 * first : 32 * (first + fanout)], "states": states[32 * first : 32 * (first + fanout)], "slot": node % fanout})
            node //= fanout
        out.append((tree, block * fanout**depth + at, path))
    step = pa.struct([("digests", pa.binary()), ("states", pa.binary()), ("slot", pa.int32())])
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), [pa.string(), pa.int64(), pa.list_(step)], strict=True)], ["tree", "at", "path"])


PATH = "array<struct<digests: binary, states: binary, slot: int>>"


def build(leaves: DataFrame, fanout: int = 2, block: int = 4096) -> Manifest:
    """Leaves (tree, has_id, k, leaf, now) -> the manifest."""
    depth = block_depth(fanout, block)
    kept = placed(leaves, ["has_id", "k", "leaf"])
    stages = _grown(kept.select("tree", "at", "n", F.col("leaf").alias("digest")), fanout, depth)
    roots = _root_of(stages[-1]).select(F.lit(ROOTS).alias("tree"), F.col("tree").alias("name"), "digest")
    forest = placed(roots, ["name"])
    above = _grown(forest.select("tree", "at", "n", "digest"), fanout, depth)

    def lifted(steps: list[DataFrame]) -> DataFrame:
        """(tree, at, path) of the nodes at the lowest of the stages, up to their tree's root."""
        climbs = [s.groupBy("tree", "block").applyInArrow(lambda t: _paths(t, fanout, depth), f"tree string, at long, path {PATH}") for s in steps]
        path = climbs[-1]
        for lower in reversed(climbs[:-1]):
            upper = path.select("tree", F.col("at").alias("block"), F.col("path").alias("rest"))
            path = lower.withColumn("block", F.expr(f"at div {fanout**depth}")).join(upper, ["tree", "block"]).select("tree", "at", F.concat("path", "rest").alias("path"))
        return path

    root = F.broadcast(_root_of(above[-1]).select(F.col("digest").alias("root")))  # one row
    of_roots = lifted(above).select("at", F.col("path").alias("rest")).join(forest.select("at", F.col("name").alias("tree"), F.col("digest").alias("subroot")), "at").crossJoin(root).drop("at")
    below = lifted(stages[1:]) if len(stages) > 1 else stages[0].select("tree", F.col("block").alias("at"), F.array().cast(PATH).alias("path")).distinct()
    paths = below.join(of_roots, "tree").select("tree", F.col("at").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root")
    return Manifest(kept, stages[0], written(paths), fanout, depth)


def _resume(now: np.ndarray, proof: np.ndarray, seen: np.ndarray, at: np.ndarray, digests: np.ndarray, states: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level up: (digests of the parents, states of the proofs, blocks in the proofs). ``at``: places among the level's nodes."""
    out, proof, seen = np.empty_like(now), proof.copy(), seen.copy()
    slot = at % fanout
    right = np.minimum(fanout - 1 - slot, digests.shape[1] - 1 - at)
    for s, r in sorted(set(zip(slot.tolist(), right.tolist(), strict=True))):
        some = np.flatnonzero((slot == s) & (right == r))
        state = compressed(states[:, at[some]], in_hex(now[:, some]))
        for step in (*range(-s, 0), *range(1, r + 1)):
            sibling = in_hex(digests[:, at[some] + step])
            if step > 0:
                state = compressed(state, sibling)
            proof[:, some] = compressed(proof[:, some], sibling)
        seen[some] += s + r
        out[:, some] = closed(state, s + 1 + r)
    return out, proof, seen


def _fold(rows: pa.Table, levels: pa.Table, path: pa.Table, fanout: int, size: int) -> pa.Table:
    """Rows (at, now) of a block, its levels and its path -> rows with proof and folded."""
    levels = levels.sort_by("level")
    at = rows["at"].to_numpy() % size
    now = _lanes(bytes.fromhex("".join(rows["now"].to_pylist())))
    proof, seen = np.repeat(_constants()[0], len(at), axis=1), np.zeros(len(at), np.int64)
    for digests, states in list(zip(levels["digests"].to_pylist(), levels["states"].to_pylist(), strict=True))[:-1]:
        now, proof, seen = _resume(now, proof, seen, at, _lanes(digests), _lanes(states), fanout)
        at = at // fanout
    for step in path["path"][0].as_py():
        now, proof, seen = _resume(now, proof, seen, np.full(len(at), step["slot"]), _lanes(step["digests"]), _lanes(step["states"]), fanout)
    hexes = lambda x: [x[:, i].astype(">u4").tobytes().hex() for i in range(x.shape[1])]
    return rows.append_column("proof", pa.array(hexes(closed(proof, seen)))).append_column("folded", pa.array(hexes(now)))


def fold(manifest: Manifest) -> DataFrame:
    """(tree, doc_id, leaf, subroot, root, proof, folded): every leaf's ``now`` folded up to the root with its own siblings."""
    fanout, size = manifest.fanout, manifest.fanout**manifest.depth
    dealt = manifest.leaves.select("tree", F.expr(f"at div {size}").alias("block"), "at", "has_id", "k", "leaf", "now")
    above = manifest.paths.select("tree", "block", "path", "subroot", "root")
    beside = manifest.blocks.select("tree", "block", "level", "digests", "states", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root")).unionByName(
        above.select("tree", "block", F.lit(-1).alias("level"), F.lit(None).cast("binary").alias("digests"), F.lit(None).cast("binary").alias("states"), "path", "subroot", "root"))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    out = "tree string, has_id boolean, k {k}, leaf string, subroot string, root string, proof string, folded string".format(**kinds)

    def run(rows: pa.Table, sides: pa.Table) -> pa.Table:
        sides = sides.sort_by("level")
        top, levels = sides.slice(0, 1), sides.slice(1)
        found = _fold(rows, levels, top, fanout, size)
        for c in ("subroot", "root"):
            found = found.append_column(c, pa.array([top[c][0].as_py()] * found.num_rows, pa.string()))
        return found.select(["tree", "has_id", "k", "leaf", "subroot", "root", "proof", "folded"])

    folded = dealt.groupBy("tree", "block").cogroup(beside.groupBy("tree", "block")).applyInArrow(run, out)
    return folded.select("tree", F.when(F.col("has_id"), F.col("k")).alias("doc_id"), "leaf", "subroot", "root", "proof", "folded")
