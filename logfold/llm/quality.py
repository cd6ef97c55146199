"""Quality scores by histogram gradient-boosted trees over document statistics.

``statistics`` turns a text into fixed numbers (never its source, language, id or labels); ``fit`` bins them and
boosts regression trees on the logistic loss; the trees are flattened into arrays that ``Model.predict`` walks for a
whole batch at once, one level per step. Fitting uses at most ``SAMPLE_ROWS`` labelled documents, picked by a hash of
their id from all labelled rows; scoring covers every document.

Defined cases: null and empty texts are scored like any other (all statistics 0); null labels are ignored, several
labels of a document count as their largest; with no labels, or only one class, every score is the smoothed share of
label 1 (0.5 without labels); repeated rows get equal scores; of a labelled id with several texts the one with the least hash
is learnt; extra columns of any name are ignored by ``score`` and kept by ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import boxed, text_or_empty, unboxed

#: The most labelled documents a model is fitted on.
SAMPLE_ROWS = 20_000
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "one_char_words", "distinct_words", "top_word", "top3_words", "upper", "title_words", "upper_words", "digits", "space", "high_bytes", "period", "comma", "other_marks", "pipe", "bang", "hash_percent", "marked_words", "log_lines", "mean_line", "short_lines", "distinct_lines", "top_line", "distinct_pairs", "words_a_sentence", "byte_entropy",
)
_CLASSES = {
    "upper": range(65, 91), "digits": range(48, 58), "space": (32, 9, 10, 11, 12, 13), "high_bytes": range(128, 256), "period": b".?", "comma": b",;:",
    "other_marks": b"\"'()[]{}<>/\\=_-+*^~`$&@", "pipe": b"|", "bang": b"!", "hash_percent": b"#%$&*",
}
_WEIGHT = np.zeros((len(_CLASSES), 256))
for _row, _bytes in enumerate(_CLASSES.values()):
    _WEIGHT[_row, list(_bytes)] = 1.0
_MARKS = frozenset(b"!#$%&*|+=~^<>@/\\{}[]_")


def statistics(text: bytes) -> list[float]:
    """One row of STATISTICS for a UTF-8 text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = dict(zip(_CLASSES, (_WEIGHT @ counts) / size, strict=True))
    lengths = np.fromiter(map(len, words), np.int64, n)
    tally = Counter(words)
    top = [c for _, c in tally.most_common(3)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_tally = Counter(lines)
    repeats = np.fromiter(tally.values(), np.int64, len(tally))
    titled = repeats[[w[:1].isupper() for w in tally]].sum()
    upper_words = repeats[list(map(bytes.isupper, tally))].sum()
    marked = repeats[[w[-1] in _MARKS for w in tally]].sum()
    pairs = len(set(zip(words, words[1:])))
    p = counts[counts > 0] / size
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths == 1).mean(), len(tally) / n, top[0] / n, sum(top) / n,
        share["upper"], titled / n, upper_words / n, share["digits"], share["space"], share["high_bytes"], share["period"], share["comma"],
        share["other_marks"], share["pipe"], share["bang"], share["hash_percent"], marked / n, np.log1p(len(lines)),
        size / max(1, len(lines)), sum(len(x) < 20 for x in lines) / max(1, len(lines)), len(line_tally) / max(1, len(lines)),
        max(line_tally.values(), default=0) / max(1, len(lines)), pairs / max(1, n - 1), n / max(1, counts[46] + counts[63] + counts[33]), -(p * np.log2(p)).sum(),
    ]


@dataclass
class Model:
    """Trees in arrays: node t of tree k has feature[k, t] < 0 if it is a leaf; its children are left and left + 1."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, np.maximum(f, 0)] > threshold[at]))
            total += value[at]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, l2: float = 1.0) -> Model:
    """Boosts ``trees`` trees on binned statistics; a split needs ``least`` rows on each side."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base, width = float(np.log(share / (1 - share))), 2 ** (depth + 1)
    shape = (trees, width)
    model = Model(base, np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), depth)
    if len(y) < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n_features, margin = x.shape[1], np.full(len(y), base)
    offset = np.arange(n_features) * bins
    flat = (binned + offset).ravel()
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at, nodes, free = np.zeros(len(y), np.int64), [0], 1
        for level in range(depth + 1):
            grown = []
            for node in nodes:
                rows = np.flatnonzero(at == node)
                g, h = grad[rows].sum(), hess[rows].sum()
                model.value[k, node] = rate * g / (h + l2)
                if level == depth or len(rows) < 2 * least:
                    continue
                cell = flat.reshape(-1, n_features)[rows].ravel()
                spread = lambda v: np.bincount(cell, np.repeat(v[rows], n_features), n_features * bins).reshape(n_features, bins).cumsum(axis=1)  # noqa: E731, B023
                gl, hl = spread(grad), spread(hess)
                nl = np.bincount(cell, minlength=n_features * bins).reshape(n_features, bins).cumsum(axis=1)
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                f, b = divmod(int(gain.argmax()), bins)
                if not gain[f, b] > 1e-6 or b >= len(edges[f]):
                    continue
                model.feature[k, node], model.threshold[k, node], model.left[k, node] = f, edges[f][b], free
                at[rows] = free + (binned[rows, f] > b)
                grown += [free, free + 1]
                free += 2
            nodes = grown
        margin += model.value[k, at]
    return model


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents whose labels are never learnt; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` documents with a label outside the held-out fold; their statistics come to the driver."""
    wanted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    columns = ", ".join(f"s{i} double" for i in range(len(STATISTICS)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(bytes(t)) for t in batch["t"]], columns=[f"s{i}" for i in range(len(STATISTICS))], dtype=float)
            yield out.assign(quality=batch["quality"].to_numpy(), doc_id=batch["doc_id"].to_numpy())

    found = docs.select("doc_id", text_or_empty().cast("binary").alias("t")).join(F.broadcast(wanted), "doc_id")
    # of several texts of an id one, before anything is collected
    found = found.groupBy("doc_id").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"), F.max("quality").alias("quality")).repartition(64, "doc_id")
    rows = found.mapInPandas(scan, f"{columns}, quality int, doc_id long").toArrow().to_pandas().sort_values("doc_id")  # the same model whatever the order of the rows
    return fit(rows[[f"s{i}" for i in range(len(STATISTICS))]].to_numpy(), (rows["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the text's other columns are not read."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(bytes(t)) for t in batch["t"]], float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.predict(x)})

    return docs.select("doc_id", text_or_empty().cast("binary").alias("t")).mapInPandas(scan, "doc_id long, score double")


def scored(model: Model):
    """A column function: the score of a text, null counting as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.array([statistics((t or "").encode()) for t in texts], float).reshape(-1, len(STATISTICS))))

    return of


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows whose text scores ``least`` or more, all their columns as they are."""
    return unboxed(boxed(docs, text=F.col("text")).withColumn("score", scored(model)(F.col("text"))).where(F.col("score") >= least), docs)
