"""Ranked lexical search, a term at a time with a limit on accumulators.

``index_of`` writes an inverted index of all documents: shards of neighbouring rows with their postings by term. Corpus
counts (documents, terms, documents of a term) are sums over shards. Queries, in blocks, meet every shard. In a shard the
terms of a query come rarest first. Once all terms still to come, each at its highest weight in the shard, sum to less
than the k-th best partial score (or than the k-th best score of the shards this task has done), no document that has
none of the terms so far can enter the k best: no accumulator is created any more, and those that exist are updated
exactly by the remaining terms. Each task passes on k documents a query at most; the k best of those are the result.

Scores are whole numbers, so the result does not depend on shards, partitions or the order of terms.

Defined cases: null and empty texts have no terms and are in no count; rows without doc_id rank before others of the same
score; rows that repeat rank each for itself; the rows of an item_id are one query (a null item_id is one too); a query
without terms, or none of whose terms occur, has no result; scores of 0 are left out; no documents, no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import written

TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SHARD = "shard long, ids binary, known binary, sizes binary, terms array<binary>, ends binary, docs binary, counts binary"
#: A row holds megabytes: a Parquet page or row group is looked at for its end after every row, not after a hundred.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
POOL = "item_id {k}, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, A to Z in lower case."""
    return TERMS.findall(text.lower()) if text else []


class Filling:
    """The documents of a shard to be: every term is kept once, a posting as two numbers of 32 bits."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.known: dict[bytes, int] = {}
        #: The numbers of the terms of all documents, one after the other, their counts, and where each document ends.
        self.numbers, self.counts, self.ends = array("i"), array("i"), array("q")

    def add(self, doc_id: int | None, found: dict[bytes, int]) -> None:
        known = self.known
        self.ids.append(doc_id)
        self.numbers.extend([known.setdefault(t, len(known)) for t in found])
        self.counts.extend(found.values())
        self.ends.append(len(self.counts))

    def row(self, number: int) -> tuple:
        """The row of the shard; documents in the order of their ids."""
        ids, n, terms = self.ids, len(self.ids), sorted(self.known)
        order = np.array(sorted(range(n), key=lambda i: (ids[i] is not None, ids[i] or 0)), np.int64)
        place, at = np.empty(n, np.int64), np.empty(len(terms), np.int64)
        place[order], at[[self.known[t] for t in terms]] = np.arange(n), np.arange(len(terms))
        tf, ends = np.frombuffer(self.counts, np.int32), np.frombuffer(self.ends, np.int64)
        lengths = np.diff(ends, prepend=0)
        sizes = np.add.reduceat(tf, ends - lengths, dtype=np.int64)[order]
        keys = at[np.frombuffer(self.numbers, np.int32)]
        df = np.bincount(keys, minlength=len(terms))
        keys *= n
        docs = np.repeat(place.astype(np.int32), lengths)
        keys += docs
        by_term = keys.argsort()
        del keys
        known, values = np.array([ids[i] is not None for i in order], bool), np.array([ids[i] or 0 for i in order], np.int64)
        return number, values.tobytes(), known.tobytes(), sizes.tobytes(), terms, df.cumsum().tobytes(), docs[by_term].tobytes(), tf[by_term].tobytes()


def _shard(number: int, ids: list[int | None], found: list[dict[bytes, int]]) -> list[tuple]:
    """Documents, their terms with counts -> the row of a shard."""
    filling = Filling()
    for doc_id, counts in zip(ids, found, strict=True):
        filling.add(doc_id, counts)
    return [filling.row(number)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def index_of(docs: DataFrame, shard_docs: int = 8192, shard_postings: int = 1 << 21) -> DataFrame:
    """The written shards of the documents that have terms: rows of ``SHARD``, of so many documents or postings at most (or one document)."""
    schema = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("terms", pa.list_(pa.binary())), ("ends", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filling, number = Filling(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = Counter(terms_of(text.as_py()))
                if found:
                    filling.add(doc_id.as_py(), found)
                if len(filling.ids) == shard_docs or len(filling.counts) >= shard_postings:
                    full, number, filling = _table([filling.row(number)], schema), number + 1, Filling()
                    yield full
        if filling.ids:
            yield _table([filling.row(number)], schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SHARD), **WIDE)


def corpus_counts(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sizes], pa.int64()), pa.array([int(x.sum()) for x in sizes], pa.int64())], ["n", "l"])

    total = index.select("sizes").mapInArrow(run, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return total[0], total[1]


def document_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) of the given distinct terms that occur: shards give a row per term of theirs, not per posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, ends in zip(batch.column(0), batch.column(1), strict=True):
                df = np.diff(np.frombuffer(ends.as_py(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([words.values, pa.array(df)], ["term", "df"])

    found = index.select("terms", "ends").mapInArrow(run, "term binary, df long")
    return found.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(dict.fromkeys(terms_of(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = items.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return each.select("item_id", F.explode("terms").alias("term")).distinct()


class Shard:
    """The postings of a shard; weights within documents are computed once a term, for all queries of a block."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, terms: list[bytes], ends: bytes, docs: bytes, counts: bytes, n: int, length: int) -> None:
        self.ids, self.known = np.frombuffer(ids, np.int64), np.frombuffer(known, bool)
        own = np.frombuffer(sizes, np.int64)
        self.m = 100 - 50 + ((50 * own * n) // length if int(own.max()) * 50 * n < 1 << 63 else np.array([50 * int(x) * n // length for x in own], np.int64))
        self.place = {t: i for i, t in enumerate(terms)}
        self.ends = np.concatenate([[0], np.frombuffer(ends, np.int64)])
        self.docs, self.counts = np.frombuffer(docs, np.int32), np.frombuffer(counts, np.int32)
        self.ready: dict[bytes, tuple[np.ndarray, np.ndarray, int]] = {}

    def weights(self, term: bytes) -> tuple[np.ndarray, np.ndarray, int] | None:
        """(documents, weights, highest weight) of a term."""
        if term not in self.place:
            return None
        if term not in self.ready:
            i = self.place[term]
            docs, tf = self.docs[self.ends[i] : self.ends[i + 1]], self.counts[self.ends[i] : self.ends[i + 1]].astype(np.int64)
            found = (1_000_000_000 * tf) // (1000 * tf + 20 * self.m[docs])
            self.ready[term] = docs, found, int(found.max())
        return self.ready[term]

    def best(self, terms: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that may be among the k best of a query, whose terms come rarest first with their weights;
        no score below ``least`` is needed."""
        lists = [(w, *found) for t, w in terms if w > 0 and (found := self.weights(t)) is not None]
        rest = np.array([w * top for w, _, _, top in lists], np.int64)[::-1].cumsum()[::-1].tolist() + [0]
        scores, held, open_still = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), True
        for step, (w, docs, weights, _) in enumerate(lists):
            if open_still:
                partial = scores[held]
                kth = int(np.partition(partial, len(partial) - k)[len(partial) - k]) if len(partial) >= k else 0
                open_still = rest[step] >= max(kth, least, 1)
            if open_still:
                held[docs] = True
                scores[docs] += w * weights
            else:
                some = held[docs]
                scores[docs[some]] += w * weights[some]
        found = np.flatnonzero(scores >= max(least, 1))
        if len(found) > k:
            found = found[np.argsort(-scores[found], kind="stable")[:k]]  # places are in the order of ids
        return found, scores[found]


def _asked_of(row: list[pa.Scalar], wanted: set[bytes]) -> tuple:
    """A shard's row with the wanted terms and their postings only; the others are never made objects or copied."""
    ids, known, sizes, terms, ends, docs, counts = row
    at = np.flatnonzero(pc.is_in(terms.values, value_set=pa.array(wanted, pa.binary())).to_numpy(zero_copy_only=False))
    ends = np.frombuffer(ends.as_buffer(), np.int64)
    runs = [slice(ends[i - 1] if i else 0, ends[i]) for i in at.tolist()]
    some = lambda x: np.concatenate([np.frombuffer(x.as_buffer(), np.int32)[r] for r in runs] or [np.empty(0, np.int32)])
    lengths = np.array([r.stop - r.start for r in runs], np.int64)
    return ids.as_py(), known.as_py(), sizes.as_py(), terms.values.take(pa.array(at)).to_pylist(), lengths.cumsum(), some(docs), some(counts)


def search(index: DataFrame, items: DataFrame, k: int = 50, query_rows: int = 512) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest scores of every item, ties by doc_id."""
    n, length = corpus_counts(index)
    asked = written(query_terms(items))
    df = document_counts(index, asked.select("term").distinct())
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "term").select("item_id", F.struct("df", "term", weight.alias("w")).alias("t"))
    of_item = weighed.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["term"].alias("term"), t["w"].alias("w"))).alias("terms"))
    blocks = of_item.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-items.count() // query_rows))).cast("long"))).groupBy("block").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    groups = max(1, index.rdd.getNumPartitions())
    dealt = index.withColumn("part", F.pmod(F.xxhash64("ids", "docs"), F.lit(groups).cast("long")))
    spread = blocks.select("items", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"))
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[object, list[int]] = {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                row, asked = [batch.column(c)[i] for c in range(7)], batch.column(7)[i].as_py()
                shard = Shard(*_asked_of(row, {t["term"] for item in asked for t in item["terms"]}), n, length)
                for item in asked:
                    bests = floors.setdefault(item["item_id"], [])
                    found, scores = shard.best([(t["term"], t["w"]) for t in item["terms"]], k, bests[-1] if len(bests) == k else 1)
                    floors[item["item_id"]] = sorted([*bests, *scores.tolist()], reverse=True)[:k]
                    out[0].extend([item["item_id"]] * len(found))
                    out[1].extend(int(shard.ids[d]) if shard.known[d] else None for d in found)
                    out[2].extend(scores.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(7).type.value_type.field("item_id").type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["item_id", "doc_id", "score"])

    met = dealt.join(spread, "part").select("ids", "known", "sizes", "terms", "ends", "docs", "counts", "items")
    pool = met.mapInArrow(run, POOL.format(k=kind))
    best = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return pool.withColumn("rank", best).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
