"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.sources.shared import checkpointed, remove, shared_folder, written, written_at  # noqa: F401  (for the operators)

#: Words in the corpus contracts: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column of exactly that name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; a lambda that named a computed array would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def boxed(docs: DataFrame, **beside: Column) -> DataFrame:
    """The rows as one struct ``row`` with the given columns beside it, so that no working column meets one of the caller's."""
    row = F.struct(*(named(c) for c in docs.columns)) if docs.columns else F.struct()
    return docs.select(row.alias("row"), *(c.alias(n) for n, c in beside.items()))


def unboxed(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``like`` out of ``row``, some with a new value of their old type; names not in ``like`` are left out."""
    return df.select(*((replaced[c].cast(like.schema[c].dataType) if c in replaced else F.col("row").getField(c)).alias(c) for c in like.columns))


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows: sizes shards and ranges."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


#: A row by what it holds, whatever its partition: there are rows without an id, and ids with several texts.
KEY = ["has_id", "k", "h"]


def key_of(text: str = "text") -> dict[str, Column]:
    return {"has_id": F.col("doc_id").isNotNull(), "k": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64(text)}


def text_runs(texts: list[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, end) runs of rows of about ``most`` bytes of text, or one longer text: what a task holds as words at a time."""
    first, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text or b"") > most:
            yield first, at
            first, held = at, 0
        held += len(text or b"")
    if first < len(texts):
        yield first, len(texts)
