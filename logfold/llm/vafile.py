"""Exact top-k inner products by vector-approximation files.

Every component is coded as one of 256 equal cells between its dimension's smallest and largest value. A scan over
blocks of codes bounds each inner product: the product with the cells' centres, plus or minus half a cell times the
query's absolute components. What cannot reach the k-th best lower bound goes. Of the rest the exact vectors of the
``first_reads`` highest bounds of each query are read; their k-th exact score then decides which others have a bound that
can still reach it, and only those are read. After that the k-th result is certain.

Equal vectors are kept k + 1 at most, those with the smallest ids: any further copy ranks below them for every query,
the query's own row included. Equal queries are searched once, with k + 1 results, one of which may be the query itself.
A query whose id has other vectors too is searched for itself, and rows of its own id are left out from the start. So no
group of copies meets in one task.

Defined cases: a null vector, and one with a null or non-finite component, takes no part; rows with a null id take no
part; vectors meet only those of their own length (empty ones score 0); rows that repeat an id count as one row if
their vectors are equal, else each takes part, as a candidate and as a query: an id's results are then the k best of all
its pairs with rows of other ids; with fewer than k candidates all are given; components so large that a score may not fit in 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import written

CELLS = 256


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): v = floor(scale * component) as longs, for the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v")
    )


BLOCK = "dim int, ids binary, own binary, data binary"
#: In place of the id whose rows a query leaves out: none.
NO_ID = -(1 << 63)


def _pack(rows: int, low: dict[int, np.ndarray] | None = None, step: dict[int, np.ndarray] | None = None):
    """Rows (key, own, v) -> blocks of at most ``rows`` keys of one length, with codes or else the vectors themselves."""

    def block(dim: int, ids: list, own: list, vectors: list) -> pd.DataFrame:
        exact = np.array(vectors, np.int64).reshape(len(ids), dim)
        codes = exact if low is None else np.clip((exact - low[dim]) // step[dim], 0, CELLS - 1).astype(np.uint8)
        return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, np.int64).tobytes()], "own": [np.array(own, np.int64).tobytes()], "data": [codes.tobytes()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for i, o, v in zip(batch["key"], batch["own"], batch["v"], strict=True):
                ids, own, vectors = held.setdefault(len(v), ([], [], []))
                ids.append(i)
                own.append(o)
                vectors.append(v)
                if len(ids) == rows:
                    yield block(len(v), *held.pop(len(v)))
        for dim, lists in held.items():
            yield block(dim, *lists)

    return run


def _bounds(low: dict[int, np.ndarray], step: dict[int, np.ndarray], keep: int):
    """Pairs of blocks -> (query, id, best): bounds of what may be among the query's ``keep`` best of this block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, q_ids, q_own, q_data, ids, own, data in batch[["dim", "q_ids", "q_own", "q_data", "ids", "own", "data"]].itertuples(index=False):
                q_id, c_id = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q = np.frombuffer(q_data, np.int64).reshape(len(q_id), dim).astype(float)
                centre = low[dim] + np.frombuffer(data, np.uint8).reshape(len(c_id), dim) * step[dim] + (step[dim] - 1) / 2.0
                middle = q @ centre.T
                slack = np.abs(q) @ ((step[dim] - 1) / 2.0) + 1e-9 * (np.abs(q).sum(axis=1) + 1) * (np.abs(centre).max(initial=0) + 1)
                left_out = np.frombuffer(q_own, np.int64)
                out = (left_out != NO_ID)[:, None] & (left_out[:, None] == np.frombuffer(own, np.int64)[None, :])
                middle[out] = -np.inf
                least = np.full(len(q_id), -np.inf)
                if len(c_id) > keep:
                    least = np.partition(middle, len(c_id) - keep, axis=1)[:, len(c_id) - keep] - 2 * slack
                row, col = np.nonzero((middle >= least[:, None]) & ~out)
                yield pd.DataFrame({"query": q_id[row], "id": c_id[col], "upper": middle[row, col] + slack[row], "lower": middle[row, col] - slack[row]})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 512, first_reads: int = 32) -> DataFrame:
    """(id, v) rows and queries -> (query_id, rank, vec_id, score), the k highest exact products, ties to smaller ids."""
    keep = k + 1  # one of them may be the query itself
    same = W.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    whole = vectors.select("id", "v").dropDuplicates(["id", "v"])
    rows = written(whole.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= keep).select("id", "v").withColumn("key", F.monotonically_increasing_id()))
    several = whole.groupBy("id").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("id", F.col("id").alias("own"))
    asked = written(queries.select("id", "v").dropDuplicates(["id", "v"]).join(several, "id", "left").withColumn("own", F.coalesce("own", F.lit(NO_ID))))
    classes = written(asked.select("v", "own").distinct().withColumn("key", F.monotonically_increasing_id()))
    ranges = rows.select(F.size("v").alias("dim"), F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
    low = {0: np.zeros(0, np.int64)} | {int(d): g.sort_values("pos")["low"].to_numpy(np.int64) for d, g in ranges.groupby("dim")}
    high = {0: np.zeros(0, np.int64)} | {int(d): g.sort_values("pos")["high"].to_numpy(np.int64) for d, g in ranges.groupby("dim")}
    if any(sum(max(abs(int(a)), abs(int(b))) ** 2 for a, b in zip(low[d], high[d], strict=True)) >= 1 << 63 for d in low):
        raise ValueError("components are too large for scores of 64 bits")
    step = {d: (high[d] - low[d]) // CELLS + 1 for d in low}
    blocks = rows.select("key", F.col("id").alias("own"), "v").mapInPandas(_pack(block_rows, low, step), BLOCK)
    groups = max(1, rows.rdd.getNumPartitions())
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups).cast("long")))
    asked_blocks = classes.select("key", "own", "v").mapInPandas(_pack(query_rows), BLOCK).select(
        "dim", F.col("ids").alias("q_ids"), F.col("own").alias("q_own"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part")
    )
    bounded = dealt.join(asked_blocks, ["dim", "part"]).mapInPandas(_bounds(low, step, keep), "query long, id long, upper double, lower double")
    by_lower = W.partitionBy("query").orderBy(F.desc("lower"), "id")
    marked = bounded.withColumn("at", F.row_number().over(by_lower))
    floor = F.max(F.when(F.col("at") == keep, F.col("lower"))).over(W.partitionBy("query"))
    left = marked.withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("query", "id", "upper")
    by_upper = W.partitionBy("query").orderBy(F.desc("upper"), "id")
    left = written(left.withColumn("place", F.row_number().over(by_upper)))
    asked_for = classes.select(F.col("key").alias("query"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("long"), lambda x, y: x + y)
    read = lambda some: some.select("query", F.col("id").alias("key")).join(rows, "key").join(asked_for, "query").select("query", "id", product.alias("score"))
    first = written(read(left.where(F.col("place") <= max(keep, first_reads))))
    bound = first.groupBy("query").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(keep - 1)).alias("bound"))
    rest = left.where(F.col("place") > max(keep, first_reads)).join(bound, "query").where(F.col("upper") >= F.col("bound"))
    by_score = W.partitionBy("query").orderBy(F.desc("score"), "id")
    best = first.unionByName(read(rest)).withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= keep).drop("at")
    own = asked.join(classes.select(F.col("key").alias("query"), "v", "own"), ["v", "own"]).select(F.col("id").alias("query_id"), "query")
    met = own.join(best, "query").where(F.col("id") != F.col("query_id"))
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
