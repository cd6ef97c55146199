"""Threshold-scaled sketches: mergeable document fingerprints with containment estimates.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the length of the text. So two
sketches are comparable as they are, and the sketch of a union is the union of the sketches. Shingles are five words
(fewer words: the whole sequence); hashes have 31 bits.

A short text may have no shingle below the fraction. A sketch therefore also holds one mark per text: the hash of its
whole word sequence, with the top bit set, which no shingle hash has. Marks never count where shingles were kept; they
tell texts apart, or equal, where none was. A union holds the marks of all its texts.

The printed form is the kept hashes and marks in order, eight hex digits each: equal texts have equal fingerprints.

Defined cases: null text counts as empty; a text without words prints as "" and is fully alike to another such text and
not at all to any other; repeated rows get equal fingerprints; the next document after the smallest id is the largest,
itself if alone; rows of one doc_id are ordered by a hash of their text, rows without one come last in the descending
order; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logfold.llm.common import named, text_or_empty, total_bytes, written

WORDS, FRACTION, SEED = 5, 1 / 4, 42
RANGE = 1 << 31
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) | 1 for i in range(1, 9)], np.uint64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct 31-bit hashes of a text's word shingles, in order, and last the text's mark (from 2**31 on)."""
    found = text.encode().split()
    if not found:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in found), np.uint64, len(found))
    take = min(words, len(h))
    mixed = np.full(len(h) - take + 1, np.uint64(take))
    for i in range(take):
        mixed ^= h[i : len(h) - take + 1 + i] * _MULTIPLIERS[i]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mark = RANGE | digest(h.tobytes(), SEED) & (RANGE - 1)
    return np.append(np.unique((mixed & np.uint64(RANGE - 1)).astype(np.uint32)), np.uint32(mark))


def sketch(hashes: np.ndarray, fraction: float = FRACTION) -> str:
    """The printed sketch of sorted hashes: those below the fraction, and the marks."""
    kept = hashes[(hashes < int(fraction * RANGE)) | (hashes >= RANGE)]
    return kept.astype(">u4").tobytes().hex()


def parse(printed: str) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, marks)."""
    found = np.frombuffer(bytes.fromhex(printed), ">u4").astype(np.int64)
    return found[found < RANGE], found[found >= RANGE]


def merge(a: str, b: str) -> str:
    """The sketch of two sketches' shingles together: exactly what the union of the texts' shingles would have."""
    both = np.union1d(np.concatenate(parse(a)), np.concatenate(parse(b)))
    return both.astype(">u4").tobytes().hex()


def shingles_of(printed: str, fraction: float = FRACTION) -> float:
    """The estimated number of distinct shingles behind a sketch."""
    return len(parse(printed)[0]) / fraction


def containment(a: str, b: str) -> tuple[float, float]:
    """(share of a's shingles that b holds, Jaccard likeness), both estimated from the kept hashes, else from the marks."""
    (x, mark_a), (y, mark_b) = parse(a), parse(b)
    if not len(x) and (not len(y) or not len(mark_a)):
        x, y = mark_a, mark_b
    if not len(x):
        same = 1.0 if a == b else 0.0
        return same, same
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / len(x), common / (len(x) + len(y) - common)


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column and row of ``docs`` with the ``fingerprint`` of its text (never null) beside it (one of that name is replaced)."""
    others = [f for f in docs.schema.fields if f.name != "fingerprint"]
    at = [f.name for f in others].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([sketch(shingle_hashes(t.as_py() or "")) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*(f.name for f in others), "fingerprint"])

    plain = docs.select(*(named(f.name) for f in others)).toDF(*(f"c{i}" for i in range(len(others))))
    return plain.mapInArrow(run, T.StructType([*others, T.StructField("fingerprint", T.StringType())]))


# --- the next document -------------------------------------------------------------------------------------------------

def _place() -> Column:
    """One number that never falls as (doc_id is there, doc_id, text hash) rises; nulls lie below all ids."""
    share = F.pmod(F.col("h"), F.lit(1 << 52).cast("long")).cast("double") / float(1 << 52)
    return F.when(F.col("doc_id").isNull(), F.lit(-1e300) * (1 - share / 2)).otherwise(F.col("doc_id").cast("double") + share)


def _dealt(docs: DataFrame, ranges: int, fan: int = 256) -> DataFrame:
    """Adds ``range``: about even ranges of the order, by quantiles of all rows and then of each part's rows."""
    placed = docs.withColumn("place", _place())
    parts = -(-ranges // fan)
    quantiles = lambda n: F.percentile_approx("place", F.array(*(F.lit(i / n) for i in range(1, n))), 10_000)
    part = F.lit(0)
    if parts > 1:
        bounds = sorted(set(placed.agg(quantiles(parts)).first()[0] or []))
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("place")))
    placed = placed.withColumn("part", part)
    inside = min(ranges, fan)
    if inside == 1:
        return placed.withColumn("range", F.col("part").cast("long"))
    # at most ``fan`` rows of ``fan`` numbers: half a megabyte; written, so every use and every repeated stage has the same
    bounds = written(placed.groupBy("part").agg(F.array_sort(F.array_distinct(quantiles(inside))).alias("bounds")))
    step = F.size(F.filter("bounds", lambda b: b <= F.col("place")))
    return placed.join(F.broadcast(bounds), "part").withColumn("range", (F.col("part") * (fan + 1) + step).cast("long")).drop("bounds")


def chained(docs: DataFrame, range_bytes: int = 16 << 20, most_ranges: int = 1 << 16) -> DataFrame:
    """(range, head, doc_id, text), each partition sorted by range, ``head`` last, then falling (doc_id, text hash).

    The row after a row of the same range is the next document; the last one is a head, the first row of the range
    below (of the last range: of the first), and has no next one. So no task sees more than its ranges, and nothing is
    ordered in one place but one key per range. There are at most ``most_ranges`` ranges (larger inputs get larger ones).
    """
    docs = docs.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    ranges = min(most_ranges, max(1, -(-total_bytes(docs, "text") // range_bytes)))
    dealt = _dealt(docs, ranges).select("range", F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("k"), "h", "text")
    top = dealt.groupBy("range").agg(F.max(F.struct("has_id", "k", "h")).alias("top"))
    by_range = W.orderBy("range")
    chain = top.select("top.*", "range", F.coalesce(F.lead("range").over(by_range), F.first("range").over(by_range)).alias("to"))
    heads = dealt.join(F.broadcast(chain), ["range", "has_id", "k", "h"]).dropDuplicates(["range"])
    rows = dealt.withColumn("head", F.lit(False)).unionByName(heads.drop("range").withColumnRenamed("to", "range").withColumn("head", F.lit(True)))
    ordered = rows.repartition("range").sortWithinPartitions("range", "head", F.desc("has_id"), F.desc("k"), F.desc("h"))
    return ordered.select("range", "head", F.when(F.col("has_id"), F.col("k")).alias("doc_id"), "text")


def edited(docs: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next):
    every document against its edited text, whose last third is the beginning of the next document, and the next document."""

    def compare(doc_id: int | None, text: str, printed: str, other: str, other_printed: str) -> tuple:
        third = len(text) // 3
        changed = text[: len(text) - third] + other[:third]
        mine = printed if changed == text else sketch(shingle_hashes(changed))
        near, far = containment(printed, mine), containment(printed, other_printed)
        return doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), printed, mine, near[0], far[0], near[1], far[1]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: range, doc_id, text, fingerprint
        for batch in batches:
            found = []
            for at, head, doc_id, text in zip(*(batch.column(n) for n in ("range", "head", "doc_id", "text")), strict=True):
                at, head, doc_id, text = at.as_py(), head.as_py(), doc_id.as_py(), text.as_py()
                printed = sketch(shingle_hashes(text))
                if held is not None and held[0] == at:
                    found.append(compare(*held[1:], text, printed))
                held = None if head else (at, doc_id, text, printed)
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    schema = ", ".join(f"{n} {'long' if i < 2 else 'string' if i < 5 else 'double'}" for i, n in enumerate(names))
    return chained(docs, range_bytes).mapInArrow(run, schema)
