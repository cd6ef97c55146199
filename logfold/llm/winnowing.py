"""Benchmark decontamination by winnowing.

Texts are ASCII-lower-cased words. A window is ``window`` words of an item in a row (an item of fewer words is one window
of its own length). Of the k-gram hashes of a text the least one of every ``window - k + 1`` neighbours is kept, so two
texts that share ``window`` words in a row keep the same gram inside them: no shared window is missed. Windows of short
items keep every gram of their own length, for each of the at most ``window - 1`` lengths that occur.

The kept grams of the items make a bitmap of ``2 ** BITS`` bits, 2 MB at any number of items, which lets a task pass over
nearly all grams of the corpus where they arise; what is left meets the items' grams in a join. A gram that meets is
extended to the windows around it, at most ``window - k + 1``, and these meet the distinct windows of all items by their
very words. So a phrase that many items and documents have costs rows in proportion to its places, never their product.

Defined cases: null and empty texts have no words, so documents without any are clean and items without any have no
window; a row without doc_id is a document; rows that repeat get equal results; a text of any length is one row of a task;
rows that repeat an item_id add their windows to that item; rows without item_id are one item, printed as empty; columns
of other names pass through ``clean`` and are ignored elsewhere; no items, no hits; no documents, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import KEY, boxed, key_of, text_runs, unboxed, written

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW, GRAM, BITS = 10, 6, 24
HIGHEST = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    """Hashes of words as they come, forgotten once there are a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def gram_words(n: int, window: int = WINDOW, gram: int = GRAM) -> int:
    """Words of a gram for windows of n words: short windows are grams themselves."""
    return min(gram, n) if n >= window else n


def winnowed(hashes: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, grams) kept of the word hashes of texts laid end to end (``doc`` numbers the texts), for windows of n words."""
    size, w = len(hashes) - k + 1, n - k + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = hashes[:size] + np.uint64(n)
    for j in range(1, k):
        g = g * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + size]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    keep = doc[:size] == doc[k - 1 : k - 1 + size]
    if w > 1:
        after = np.concatenate([np.where(keep, g, HIGHEST), np.full(w - 1, HIGHEST)])
        least = np.minimum.reduce([after[j : j + size] for j in range(w)])
        before = np.concatenate([np.zeros(w - 1, np.uint64), least])
        keep &= g == np.maximum.reduce([before[j : j + size] for j in range(w)])
    at = np.flatnonzero(keep)
    return at, g[at]


def _words(texts: list[bytes | None], known: _Hashes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, hashes, number of each word's text, where each text begins) of some texts."""
    each = [WORDS.findall(t.lower()) if t else [] for t in texts]
    words = [w for ws in each for w in ws]
    sizes = np.array([len(ws) for ws in each], np.int64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return words, hashes, np.repeat(np.arange(len(each)), sizes), np.concatenate([[0], sizes.cumsum()])


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item, n, grams, windows) of the rows of ``items`` that have words: kept grams and all windows, as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, hashes, doc, _ = _words([text], known)
                if words:
                    n = min(window, len(words))
                    grams = winnowed(hashes, doc, n, gram_words(n, window, gram))[1].view(np.int64)
                    found.append((item, n, grams.tolist(), list(dict.fromkeys(b" ".join(words[s : s + n]) for s in range(len(words) - n + 1)))))
            columns = zip(*found, strict=True) if found else [[]] * 4
            types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["item", "n", "grams", "windows"])

    some = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    return some.mapInArrow(run, "item string, n int, grams array<long>, windows array<binary>")


def bitmap(grams: DataFrame, bits: int = BITS) -> np.ndarray:
    """The lowest ``bits`` bits of all grams as a set: at most ``2 ** (bits - 6)`` rows come to the driver."""
    low = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))
    rows = grams.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 AS int))")).alias("set"))
    found, held = rows.toPandas(), np.zeros(1 << (bits - 6), np.int64)
    held[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return held


def _may_hold(held: np.ndarray, grams: np.ndarray) -> np.ndarray:
    low = (grams & np.uint64((len(held) << 6) - 1)).astype(np.int64)
    return (held[low >> 6].view(np.uint64) >> (low & 63).astype(np.uint64)) & np.uint64(1) > 0


def candidates(docs: DataFrame, spark: SparkSession, lengths: list[int], held: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(has_id, k, h, n_words, hits) of every row; hits: (n, gram, first, windows) for the kept grams that the bitmap lets
    pass, with the words of the windows that hold the gram, the first of them at word ``first``."""
    shared = spark.sparkContext.broadcast(held)
    hit = pa.struct([("n", pa.int32()), ("gram", pa.int64()), ("first", pa.int32()), ("windows", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            every, n_words, hits = batch.column(3).to_pylist(), [], []
            for begin, end in text_runs(every):
                words, hashes, doc, starts = _words(every[begin:end], known)
                n_words += np.diff(starts).tolist()
                of_text: list[list] = [[] for _ in range(begin, end)]
                for n in lengths:
                    k = gram_words(n, window, gram)
                    at, grams = winnowed(hashes, doc, n, k)
                    some = _may_hold(shared.value, grams)
                    for place, value in zip(at[some].tolist(), grams[some].view(np.int64).tolist(), strict=True):
                        text = int(doc[place])
                        low, high = int(starts[text]), int(starts[text + 1])
                        first, last = max(low, place - (n - k)), min(place, high - n)
                        if first <= last:
                            of_text[text].append({"n": n, "gram": value, "first": first - low, "windows": [b" ".join(words[s : s + n]) for s in range(first, last + 1)]})
                hits += of_text
            columns = [*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(hit))]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "n_words", "hits"])

    kind = docs.select(key_of()["k"].alias("k")).schema["k"].dataType.simpleString()
    rows = docs.select(*(c.alias(n) for n, c in key_of().items()), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"has_id boolean, k {kind}, h long, n_words long, hits array<struct<n: int, gram: bigint, first: int, windows: array<binary>>>")


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(has_id, k, h, doc_id, n_words, n_hit, items, spans), a row per row of ``docs``: words inside windows of items, the
    sorted ids of those items, and the hit words as (first, end) spans, joined where they touch."""
    sides = written(item_windows(items, window, gram))
    grams = sides.select("n", F.explode("grams").alias("gram")).distinct()
    lengths = sorted(r.n for r in sides.select("n").distinct().collect())  # at most ``window`` numbers
    rows = written(candidates(docs, docs.sparkSession, lengths, bitmap(grams), window, gram))
    hits = rows.select(*KEY, F.explode("hits").alias("u")).select(*KEY, "u.*").join(grams, ["n", "gram"], "left_semi")
    places = hits.select(*KEY, "n", "first", F.posexplode("windows").alias("step", "words")).select(*KEY, "n", (F.col("first") + F.col("step")).alias("first"), "words").distinct()
    known = sides.select("item", F.explode("windows").alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("of"))
    met = places.join(known, "words").select(*KEY, "first", (F.col("first") + F.col("n")).alias("end"), "of")
    by_place = W.partitionBy(*KEY).orderBy("first", "end")
    before = F.max("end").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    marked = met.withColumn("fresh", before.isNull() | (F.col("first") > before)).withColumn("span", F.sum(F.col("fresh").cast("int")).over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    spans = marked.groupBy(*KEY, "span").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.array_distinct(F.flatten(F.collect_set("of"))).alias("of"))
    of_row = spans.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("of")))).alias("items")
    )
    return rows.select(*KEY, "n_words").join(of_row, KEY, "left").select(
        *KEY, F.when(F.col("has_id"), F.col("k")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The result of ``overlaps`` with its items as a number and a digest of their ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    dirty = overlaps(docs, items, window, gram).where("n_hit > 0").select(*KEY)
    return unboxed(boxed(docs, **key_of()).join(dirty, KEY, "left_anti"), docs)
