"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has four 16-bit segments. Two fingerprints that differ in at most three bits have a segment i
that agrees while segment i+1 (cyclic) differs in at most one bit: with up to three errors over four segments at
least one segment is clean, and every clean segment would have to be followed by the same dirty one otherwise. So a
key is (i, the bits of segment i, a Golay index for segment i+1). The perfect (23, 12) Golay code decodes each padded
segment to the one codeword within three bits; a fingerprint is filed under the index of its own segment and looked
up under the indices of the segment and of its 16 one-bit neighbours (up to six different ones). Rows that meet
under a key are verified bit by bit.

Only distinct fingerprints are filed, and a key gives back a spanning forest of its true links, never all pairs, so
groups of thousands of copies stay linear in what they emit. The filed and the looked-up rows of a key are cut into
blocks of about ``hot`` rows and every two blocks meet in a group of their own, so a task holds two blocks at a time.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other;
repeated rows and equal texts share a class; a null doc_id never names a component unless all its ids are null;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.llm.common import boxed, named, remove, text_or_empty, unboxed, written, written_at
from logfold.llm.components import components

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR, LENGTH, INFO = 0b110001110101, 23, 12


def _remainders(words: np.ndarray) -> np.ndarray:
    words = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - INFO - 1, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - (LENGTH - INFO))), words)
    return words


@lru_cache(maxsize=1)
def golay_leaders() -> np.ndarray:
    """The error of three bits or less that each remainder of the perfect code stands for."""
    one = 1 << np.arange(LENGTH, dtype=np.int64)
    errors = np.unique(np.concatenate([[0], one, (one[:, None] | one).ravel(), (one[:, None, None] | one[:, None] | one).ravel()]))
    leader = np.zeros(1 << (LENGTH - INFO), np.int64)
    leader[_remainders(errors)] = errors
    return leader


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(own, near): the codeword index of every 16-bit segment, and of it and its 16 neighbours, repeats as -1."""
    segments = np.arange(1 << 16, dtype=np.int64)
    own = (segments ^ golay_leaders()[_remainders(segments)]) >> (LENGTH - INFO)
    near = np.sort(np.stack([own, *(own[segments ^ (1 << b)] for b in range(16))], axis=1), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return own, near


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all word shingles of a UTF-8 text; ties give 0."""
    found = text.lower().split()  # bytes: only A-Z and ASCII white space
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    hashes = np.fromiter((digest(s, seed) for s in shingles), "<u8", n)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty(text_col).cast("binary").alias("t")).mapInArrow(scan, "doc_id long, fp long")


def _file_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    own, near = golay_tables()
    for batch in batches:
        signed = batch["fp"].to_numpy(np.int64)
        fps, out = signed.view(np.uint64), []
        seg = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
        for i in range(4):
            prefix, other = (i << 28) | (seg[i] << 12), seg[(i + 1) % 4]
            out.append(pd.DataFrame({"key": prefix | own[other], "fp": signed, "filed": True}))
            row, col = np.nonzero(near[other] >= 0)
            out.append(pd.DataFrame({"key": prefix[row] | near[other][row, col], "fp": signed[row], "filed": False}))
        yield pd.concat(out)


def forest(filed: np.ndarray, asked: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that span the components of the graph between ``filed`` and ``asked`` fingerprints (uint64)."""
    nodes = np.union1d(filed, asked)
    is_filed, open_ = np.isin(nodes, filed), np.ones(len(nodes), bool)
    links = []
    for start in np.flatnonzero(is_filed):
        if not open_[start]:
            continue
        open_[start], todo = False, [start]
        while todo:
            u = todo.pop()
            candidates = np.flatnonzero(open_ if is_filed[u] else open_ & is_filed)
            hit = candidates[np.bitwise_count(nodes[candidates] ^ nodes[u]) <= limit]
            open_[hit] = False
            todo.extend(hit)
            links.extend((nodes[u], nodes[v]) for v in hit)
    return links


def _verify(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last group, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = rest[GROUP].iloc[-1]
            cut = len(rest) - int((rest[GROUP] == last).all(axis=1).to_numpy()[::-1].argmin()) if (rest[GROUP].iloc[0] != last).any() else 0
            if cut:
                yield _links(rest.iloc[:cut], limit)
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None:
            yield _links(rest, limit)

    return run


GROUP = ["key", "own", "other"]


def _links(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    group, fps, filed = rows[GROUP].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), rows["filed"].to_numpy(bool)
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
    last = np.r_[first[1:], len(group)]
    mixed = (np.minimum.reduceat(fps, first) != np.maximum.reduceat(fps, first)) & np.logical_or.reduceat(filed, first)
    links = [x for a, b in zip(first[mixed], last[mixed]) for x in forest(fps[a:b][filed[a:b]], fps[a:b], limit)]
    ends = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})


def links(distinct_fps: DataFrame, limit: int = 3, hot: int = 4096) -> DataFrame:
    """(a, b): links among distinct fingerprints that span all components at ``limit`` (3 at most) differing bits."""
    if not 0 <= limit <= 3:
        raise ValueError("four segments promise up to three differing bits")
    keys = distinct_fps.select("fp").mapInPandas(_file_keys, "key long, fp long, filed boolean")
    blocks = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
    mine, every = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    met = keys.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine).withColumn("each", F.explode(every))
    dealt = met.select("key", F.when(F.col("filed"), F.col("mine")).otherwise(F.col("each")).alias("own"), F.when(F.col("filed"), F.col("each")).otherwise(F.col("mine")).alias("other"), "fp", "filed")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInPandas(_verify(limit), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs, words, seed))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes, limit))
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- near copies by similarity: Golay keys link the dense groups, shingle sets that share a rare prefix find the rest --

#: Documents whose shingles are counted to order all shingles (so many at least, and one in so many of all), how many of the
#: repeated ones are kept, and rounds of heads.
ORDER_ROWS, ORDER_SHARE, ORDER_KEPT, HEAD_ROUNDS = 4096, 64, 200_000, 3
#: Bits of a parity sketch: whether an odd number of a set's hashes falls on a bit. Sets that differ in k hashes differ in k bits at most.
SKETCH_BITS = 1024
#: Runs of so many rows propose all their pairs (no more than half as many for each row); in longer runs only pairs whose sketches allow it leave the join.
SMALL_RUN = 16
#: Heads that a row of a wide run meets in a round. A round that links fewer than one in ``HEAD_YIELD`` of the rows it saw is the last one.
HEADS, HEAD_YIELD = 8, 8


def _shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted hashes of the word shingles; a shorter text, even one without words, is its own only shingle."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(found) - words + 1))


def _sets(words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i)
                found.append(_shingle_set(text.as_py(), words).view(np.int64))
                size += len(found[-1])
                if size > 1 << 18:
                    yield _set_rows(ids, found)
                    ids, found, size = [], [], 0
            if ids:
                yield _set_rows(ids, found)

    return scan


def _set_rows(ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], ["id", "shingles"])


def _prefixes(common: np.ndarray, counts: np.ndarray, similarity: float, words: int):
    """(s, id, n, pos, sketch): the rarest shingles of each set, by (count, hash); two sets of the similarity share one of
    them. The sketch, as longs, stands with the first."""

    def rows(parts: list) -> pa.RecordBatch:
        size = [len(p[1]) for p in parts]
        columns = [np.concatenate([p[1] for p in parts]), np.repeat([p[0] for p in parts], size), np.repeat([p[2] for p in parts], size).astype(np.int32), np.concatenate([np.arange(k, dtype=np.int32) for k in size])]
        at = np.cumsum([0, *size])[:-1]
        sketch = np.full(sum(size), None, object)
        for i, p in zip(at, parts, strict=True):
            sketch[i] = p[3]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(sketch, pa.list_(pa.int64()))], ["s", "id", "n", "pos", "sketch"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                found = _shingle_set(text.as_py(), words)
                odd = np.bincount((found % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
                kept = len(found) - math.ceil(similarity * len(found) - 1e-6) + 1
                parts.append((i.as_py(), found[:kept].view(np.int64), len(found), sketch))
                size += len(parts[-1][1])
                if size > 1 << 18:
                    yield rows(parts)
                    parts, size = [], 0
            if parts:
                yield rows(parts)

    return scan


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by s, those whose s stands in another row too (``run``) and those with a sketch; repeated rows once.
    Holds one row between batches."""
    held, before = None, False  # the last row, and whether the row before it has its s
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        first = held is None
        values = rows[["s", "id", "n", "pos"]].to_numpy(np.int64)
        new = np.r_[True, (values[1:] != values[:-1]).any(axis=1)]
        rows, s = rows[new].reset_index(drop=True), values[new, 0]
        same = s[1:] == s[:-1]
        keep = np.r_[False if first else before, same] | np.r_[same, False]
        before, held = bool(same[-1]) if len(same) else (before and not first), rows.iloc[-1:]
        out = rows[:-1].assign(run=keep[:-1])
        yield out[out["run"] | out["sketch"].notna()]
    if held is not None:
        out = held.assign(run=before)
        yield out[out["run"] | out["sketch"].notna()]


def _shingle_order(texts: DataFrame, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated shingles of a sample and their counts. They only say what comes last: any order finds the same pairs."""
    share = int((1 << 20) * min(1.0, max(ORDER_ROWS / max(1, rows), 1 / ORDER_SHARE)))
    sample = texts.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share).select("node", "text").mapInArrow(_sets(words), "id long, shingles array<long>")
    counted = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "s").limit(ORDER_KEPT).toArrow()
    common = found["s"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    return common[order], found["n"].to_numpy()[order]


def text_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, set_block: int = 128) -> DataFrame:
    """(h, root) of every different text (h its MD5; null counts as empty): groups linked by a Jaccard likeness of word shingles.

    First the Golay keys: texts whose fingerprints (over the same shingles) are linked are proposed to each other, which
    links groups of near copies in time that is linear in them. The fingerprint misses pairs close to the threshold;
    those are found without exception by a second proposal: sets of n shingles that reach the similarity have one of
    their n - ceil(similarity * n) + 1 first shingles in common, in any order of all shingles. Rows that share such a
    shingle meet in a join, and filters by length and place, in runs of more than ``SMALL_RUN`` rows by the sketch too, leave
    out what cannot reach it. All proposals are compared by sketches and by their exact shingle sets, a pair a row.

    A run is the rows of one shingle. What is linked counts as one group from then on and is not compared again. Runs of
    several groups with more than ``set_block`` rows first propose their rows to ``HEADS`` heads only, each that of the rows
    of about the same size (every other time at the same place, too), for some rounds; then all pairs of different groups
    are compared, in all runs.
    """
    if not 0 < similarity <= 1:
        raise ValueError("a similarity above 0 and up to 1")
    known = docs.select(text_or_empty().alias("text")).select("text", F.md5(F.col("text").cast("binary")).alias("h"))
    texts = written(known.dropDuplicates(["h"]).withColumn("node", F.monotonically_increasing_id()))
    common, counts = _shingle_order(texts, texts.count(), words)
    prefixes = texts.select("node", "text").mapInArrow(_prefixes(common, counts, similarity, words), "s long, id long, n int, pos int, sketch array<long>")
    kept = written(prefixes.repartition("s").sortWithinPartitions("s", "id", "n", "pos").mapInPandas(_shared, "s long, id long, n int, pos int, sketch array<long>, run boolean"))
    shared, sketches = kept.where("run").select("s", "id", "n", "pos"), kept.where("sketch IS NOT NULL").select("id", "n", "sketch")

    def allowed(n: str, m: str, k: str, l: str) -> Column:
        """Whether two sketches allow the similarity."""
        differ = reduce(Column.__add__, (F.bit_count(F.get(k, F.lit(i)).bitwiseXOR(F.get(l, F.lit(i)))) for i in range(SKETCH_BITS // 64)))
        return differ * (1 + similarity) <= (1 - similarity) * (F.col(n) + F.col(m)) + 1e-6

    def verified(pairs: DataFrame, *done: str) -> DataFrame:
        """The pairs that reach the similarity; sets are made for those whose sketches allow it. Tables ``done`` go once the pairs are written."""
        left, right = (sketches.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"k{k}")) for k in "ab")
        asked, at_asked = written_at(pairs.distinct())
        remove(docs.sparkSession, *done)
        close, at_close = written_at(asked.join(left, "a").join(right, "b").where(allowed("na", "nb", "ka", "kb")).select("a", "b").distinct())
        chosen, at_chosen = written_at(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets, at_sets = written_at(texts.join(chosen, "node", "left_semi").select("node", "text").mapInArrow(_sets(words), "id long, shingles array<long>"))
        left, right = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
        enough = F.size(F.array_intersect("sa", "sb")) * (1 + similarity) + 1e-6 >= similarity * (F.size("sa") + F.size("sb"))
        sure = written(close.join(left, "a").join(right, "b").where(enough).select("a", "b").distinct())
        remove(docs.sparkSession, at_asked, at_close, at_chosen, at_sets)
        return sure

    def possible(x: str, y: str) -> Column:
        n, m, p, q = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
        near = F.least(n, m) + 1e-6 >= similarity * F.greatest(n, m)
        return near & (F.least(n - p, m - q) * (1 + similarity) + 1e-6 >= similarity * (n + m)) & (F.col(f"{x}.root") != F.col(f"{y}.root"))

    def ends(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    prints = written(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), words))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = links(classes).join(classes.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(classes.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    alike = prints.join(classes, "fp").where("doc_id <> least").select(*ends("doc_id", "least"))
    found = [verified(near.select(*ends("x", "y")).unionByName(alike))]
    open_, at_open = shared, None
    for turn in range(HEAD_ROUNDS + 1):
        roots = components(reduce(DataFrame.unionByName, found))
        rooted = open_.select("s", "id", "n", "pos").join(roots, F.col("id") == F.col("node"), "left").select("s", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
        several = rooted.groupBy("s").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s", "rows")
        before = at_open
        open_, at_open = written_at(rooted.join(several, "s"))
        if before:
            remove(docs.sparkSession, before)
        rows, wide = open_.agg(F.count(F.lit(1)), F.count_if(F.col("rows") > set_block)).first()
        if not rows:
            break
        if turn == HEAD_ROUNDS or not wide or turn and found[-1].count() < wide / HEAD_YIELD:
            once = F.col("x.id") < F.col("y.id")
            few, (many, at_many) = open_.where(F.col("rows") <= SMALL_RUN), written_at(open_.where(F.col("rows") > SMALL_RUN).join(sketches.select("id", "sketch"), "id").select("s", "id", "n", "pos", "root", "sketch"))
            met = few.alias("x").join(few.alias("y"), "s").where(once & possible("x", "y")).select(*ends("x.id", "y.id"))
            met_often = many.alias("x").join(many.alias("y"), "s").where(once & possible("x", "y") & allowed("x.n", "y.n", "x.sketch", "y.sketch")).select(*ends("x.id", "y.id"))
            found.append(verified(met.unionByName(met_often), at_open, at_many))
            roots = components(reduce(DataFrame.unionByName, found))
            break
        ways = open_.where(F.col("rows") > set_block).select("s", "id", "n", "pos", "root", F.explode(F.sequence(F.lit(0), F.lit(HEADS - 1))).alias("way"))
        dealt = ways.withColumn("like", F.floor(F.log("n") / max(-math.log(similarity) / 4, 1e-3) + F.col("way") / HEADS)).withColumn("place", F.when(F.col("way") % 2 == 1, F.col("pos")).otherwise(-1))
        by = ["s", "way", "like", "place"]
        heads = dealt.groupBy(*by).agg(F.min_by(F.struct("id", "n", "pos", "root"), F.struct(F.xxhash64("id", F.pmod("s", F.lit(4)), "way", F.lit(turn)), "id", "n", "pos")).alias("h"))
        met = dealt.alias("x").join(heads.select(*by, "h.*").alias("y"), by).where(possible("x", "y"))
        found.append(verified(met.select(*ends("x.id", "y.id"))))
    return texts.select("h", "node").join(roots, "node", "left").select("h", F.coalesce("root", "node").alias("root"))


def _text_key() -> Column:
    return F.md5(text_or_empty().cast("binary"))


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, set_block: int = 128) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of the row's group, null only if all its ids are null."""
    roots = written(text_groups(docs, similarity, words, set_block))
    ids = docs.select(_text_key().alias("h"), "doc_id").groupBy("h").agg(F.min("doc_id").alias("least")).join(roots, "h")
    named = ids.groupBy("root").agg(F.min("least").alias("component_id")).join(roots, "root").select("h", "component_id")
    return docs.select("doc_id", _text_key().alias("h")).join(named, "h").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """Keeps one row of each group of near copies, all its columns as they are; texts alike to none all stay.

    The kept row has the group's smallest doc_id (rows without one only if all lack it), then the smallest text hash and
    row hash. So rows that repeat collapse to one, while rows of one doc_id with unlike texts all stay. Null texts count
    as empty, and empty ones as copies of each other.
    """
    roots = text_groups(docs, similarity, words)
    every = F.xxhash64(*(F.to_json(F.struct(named(c))) if isinstance(docs.schema[c].dataType, T.MapType) else named(c) for c in docs.columns))
    key = {"no_id": F.col("doc_id").isNull(), "k": F.coalesce("doc_id", F.lit(0)), "h": _text_key(), "row_hash": every}
    least = F.min(F.struct(*key)).alias("kept")
    per_text = docs.select(*(c.alias(n) for n, c in key.items())).groupBy("h").agg(least)
    kept = per_text.join(roots, "h").groupBy("root").agg(F.min("kept").alias("kept")).select("kept.*")
    rows = boxed(docs, **key).dropDuplicates(list(key)).join(written(kept), list(key), "left_semi")
    return unboxed(rows, docs)
