"""Lexical retrieval packing: each window is filled with the nearest unused documents of its seed.

Documents are tokenized once and put in the order of three weighted MinHash tokens: the token of a text that is least by
a hash in which rarer tokens (higher ids) tend to come first. Texts that share rare tokens so lie side by side. Ranges of
that order, cut by a row number too, so that copies never fill one, go to the tasks, and each task cuts its rows into
shards of about ``shard_tokens``. A shard is thus lexically close, however large the corpus is.

A shard has its own BM25 inverted index over the documents' token ids, all of them; a token of many documents has a dense
row, the others have postings. A seed document opens a window; unused neighbours follow by falling score (ties by order)
until the window is full. The document that is cut there goes on in the next window, as its seed. Only a shard's last
window can stay short; it is split into sequences whose lengths are powers of two, which need no padding.

Token ids are those of the JSON tokenizer at its default settings. They come from the rank file of the same vocabulary,
which is several times faster (a test compares both); texts with a very long run of white space, which its pattern
cannot take, go through the JSON file itself.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; long texts run over as
many windows as they need; a null doc_id stays null in its pieces; extra columns are ignored; no rows, no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import text_or_empty, written

K1, B = 1.2, 0.75
END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}
MARKERS = set(SPECIAL)
#: White space in a row that the fast encoder is trusted with.
LONGEST_GAP = 20_000
#: Tokens of more than this share of a shard's documents get a dense row.
COMMON = 1 / 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a rank file, by default one of the installed public vocabularies; loaded once per worker."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken")) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def plain_encoder(vocabulary: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def id_array(text: str, vocabulary: str = "byte_bpe_50k") -> np.ndarray:
    """The ids of a text, special markers among them, without any added at its ends; never a Python list of a long text."""
    if len(text) > LONGEST_GAP and any(m.end() - m.start() > LONGEST_GAP for m in re.finditer(r"\s+", text)):
        return np.array(plain_encoder(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)
    return encoder(vocabulary).encode_to_numpy(text, allowed_special=MARKERS, disallowed_special=())


def token_ids(text: str, vocabulary: str = "byte_bpe_50k") -> list[int]:
    return id_array(text, vocabulary).tolist()


@lru_cache(maxsize=1)
def _ranks(tokens: int = 1 << 16, seeds: int = 3) -> np.ndarray:
    """For each seed the order in which tokens are least: an exponential draw at a rate of the id + 1."""
    ids = np.arange(tokens, dtype=np.uint64)
    h = ids * np.uint64(0x9E3779B97F4A7C15) + np.array([s * 0xBF58476D1CE4E5B9 & (1 << 64) - 1 for s in range(1, seeds + 1)], np.uint64)[:, None]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    share = ((h ^ (h >> np.uint64(29))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-12
    return np.argsort(np.argsort(-np.log(share) / (ids + 1.0), axis=1), axis=1).astype(np.int32)


def lexical_keys(ids: np.ndarray) -> list[int]:
    """Weighted MinHashes of the ids: the token of a text that is least, likelier a rare one (a high id), as its rank."""
    return [int(rank.take(ids, mode="wrap").min()) for rank in _ranks()]


class Index:
    """BM25 postings of a shard's documents (arrays of token ids)."""

    def __init__(self, docs: list[np.ndarray], common: float = COMMON) -> None:
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        pairs = [np.unique(d, return_counts=True) for d in docs]
        term = np.concatenate([t for t, _ in pairs]).astype(np.int64)
        tf = np.concatenate([c for _, c in pairs]).astype(np.float32)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in pairs])
        df = np.bincount(term)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / max(1.0, lengths.mean())))).astype(np.float32)
        often = df > max(2, common * n)
        row = np.cumsum(often) - 1
        self.dense = np.zeros((int(often.sum()), n), np.float32)
        self.dense[row[term[often[term]]], doc[often[term]]] = weight[often[term]]
        rare = ~often[term] & (df[term] > 1)  # a token of one document speaks for no other
        ends = np.searchsorted(doc, np.arange(1, n))
        self.rows = [row[t[often[t]]] for t in np.split(term, ends)]
        term, doc, weight = term[rare], doc[rare], weight[rare]
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, n)))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(df) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The scores of all documents for the distinct tokens of one; tokens that only the seed has are left out."""
        terms = self.terms[seed]
        first, size = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(first - np.r_[0, size.cumsum()[:-1]], size) + np.arange(size.sum()) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.dense[self.rows[seed]].sum(axis=0, dtype=np.float64)


def retrieval_order(docs: list[np.ndarray], window: int) -> list[int]:
    """The order in which documents enter the stream of windows: a seed, then its nearest unused documents."""
    if not docs:
        return []
    index, unused, order = Index(docs), np.ones(len(docs), bool), []
    at, next_seed, seed = 0, 0, -1
    while len(order) < len(docs):
        room = window - at % window
        if seed < 0 or room == window:  # the last window closed flush: a fresh seed
            while not unused[next_seed]:
                next_seed += 1
            seed = next_seed
            unused[seed] = False
            order.append(seed)
            at += len(docs[seed])
            continue
        scores = np.where(unused, index.scores(seed), -1.0)
        for near in np.argsort(-scores, kind="stable"):
            if not unused[near]:
                break  # all unused ones come first
            unused[near] = False
            order.append(int(near))
            at += len(docs[near])
            room -= len(docs[near])
            if room <= 0:
                seed = int(near)  # cut at the window's end: it goes on as the next seed
                break
    return order


def cut(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(doc, start, length, sequence, offset) pieces of documents laid end to end; the rest is cut at powers of two."""
    total = sum(lengths)
    ends = list(range(window, total + 1, window))
    at, rest = total - total % window, total % window
    while rest:
        at += 1 << (rest.bit_length() - 1)
        ends.append(at)
        rest = total - at
    pieces, sequence, begin, place = [], 0, 0, 0
    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            take = min(length - start, ends[sequence] - place)
            pieces.append((doc, start, take, sequence, place - begin))
            start, place = start + take, place + take
            if place == ends[sequence]:
                sequence, begin = sequence + 1, place
    return pieces


def tokenized(docs: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids, n, k1, k2, k3): the ids with the end id as little-endian bytes of the type ``_width``, and the lexical keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(vocabulary)
        for batch in batches:
            ids = [np.append(id_array(t.as_py(), vocabulary), END_ID).astype(width) for t in batch.column(1)]
            keys = zip(*(lexical_keys(x) for x in ids), strict=True) if ids else [[]] * 3
            columns = [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(list(k), pa.int64()) for k in keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n", "k1", "k2", "k3"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary, n long, k1 long, k2 long, k3 long")


def _width(vocabulary: str) -> str:
    return "<u2" if encoder(vocabulary).n_vocab <= 1 << 16 else "<u4"


def _pack_shard(first_sequence: int, held: list[tuple[int | None, np.ndarray]], window: int, with_ids: bool) -> tuple[int, pa.RecordBatch]:
    order = retrieval_order([x for _, x in held], window)
    ids = [held[i][1].astype("<u4") for i in order]
    pieces = np.array(cut([len(x) for x in ids], window), np.int64).reshape(-1, 5)
    spans = [ids[d][s : s + n] for d, s, n, *_ in pieces]
    columns = [
        pa.array([held[order[d]][0] for d in pieces[:, 0]], pa.int64()), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array([zlib.crc32(s) for s in spans], pa.int64()),
        pa.array([len(ids[d]) for d in pieces[:, 0]], pa.int64()), pa.array(first_sequence + pieces[:, 3]), pa.array(pieces[:, 4]),
    ]
    names = [x.split()[0] for x in PIECES.split(", ")]
    if with_ids:
        columns, names = [*columns, pa.array([s.tobytes() for s in spans], pa.binary())], [*names, "ids"]
    return first_sequence + int(pieces[-1, 3]) + 1, pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, window: int = 2048, with_ids: bool = False, vocabulary: str = "byte_bpe_50k", shard_tokens: int = 1 << 19, most_tasks: int = 1 << 14) -> DataFrame:
    """One row per piece; ``with_ids`` adds its ids as little-endian unsigned 32-bit bytes.

    A task takes the rows of one range, about eight shards' tokens (more beyond ``most_tasks`` ranges), and holds a shard at a time.
    """
    rows = written(tokenized(docs, vocabulary).withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = min(most_tasks, max(1, -(-tokens // (8 * shard_tokens))))
    dealt = rows.repartitionByRange(tasks, "k1", "k2", "k3", "row").sortWithinPartitions("k1", "k2", "k3", "row").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held, size, sequence = _width(vocabulary), [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, ids in zip(batch.column(0), batch.column(1), strict=True):
                held.append((doc_id.as_py(), np.frombuffer(ids.as_py(), width)))
                size += len(held[-1][1])
                if size >= shard_tokens:
                    sequence, out = _pack_shard(sequence, held, window, with_ids)
                    held, size = [], 0
                    yield out
        if held:
            yield _pack_shard(sequence, held, window, with_ids)[1]

    return dealt.mapInArrow(run, PIECES + ", ids binary" * with_ids)
