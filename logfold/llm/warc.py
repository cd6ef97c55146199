"""Merkle fixity audit of WARC archives.

Records of an archive file, in offset order, are the leaves of a tree: a leaf is (offset, length, SHA-256 of the
record's bytes), an inner node the SHA-256 over its ``fanout`` children's offset ranges and hashes. Two replicas are
compared from the root down, and only children of mismatching nodes are looked at. At the leaves records are matched by
their id, so a record that was lost or changed length does not make its shifted successors look corrupt.

Defined cases: null bytes count as an empty record; records that repeat an id are told apart by their order in the
file; equal offsets are ordered by id and hash; files that only one replica has are reported record by record; empty
replicas give no rows; extra columns are ignored. A file's records are handled in one window, so a file should hold
what a task can sort; ``archive_records`` cuts pages into files of ``file_records`` ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.llm.common import written

FANOUT = 16


def record_bytes(record_id: Column, url: Column, body: Column) -> Column:
    """A resource record as a string of UTF-8 bytes."""
    payload = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"),
    )


def archive_records(pages: DataFrame, file_records: int = 1000) -> DataFrame:
    """(file, record_id, offset, length, sha): pages laid out as WARC files, one for every ``file_records`` ids.

    Pages without an id are dealt to 64 further files by a hash of their url and body.
    """
    lost = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(64))
    rows = pages.select(F.coalesce(F.floor(F.col("page_id") / file_records), lost).cast("long").alias("file"), F.col("page_id").alias("record_id"), record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("b"))
    leaves = rows.select("file", "record_id", F.octet_length("b").cast("long").alias("length"), F.sha2("b", 256).alias("sha"))
    before = W.partitionBy("file").orderBy("record_id", "sha").rowsBetween(W.unboundedPreceding, -1)
    return leaves.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select("file", "record_id", "offset", "length", "sha")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_id, offset, length, sha) of uncompressed WARC files; ``file`` is the path, one task a file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                at, found = 0, []
                while (end := content.find(b"\r\n\r\n", at)) >= 0:
                    head = content[at:end]
                    size = re.search(rb"(?i)\r\nContent-Length:\s*([0-9]+)", head)
                    stop = end + 4 + int(size[1] if size else 0) + 4
                    own = re.search(rb"(?i)\r\nWARC-Record-ID:\s*(\S+)", head)
                    found.append((name, (own[1] if own else b"").decode(), at, min(stop, len(content)) - at, hashlib.sha256(content[at:stop]).hexdigest()))
                    at = stop
                yield pd.DataFrame(found, columns=["file", "record_id", "offset", "length", "sha"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, record_id string, offset long, length long, sha string")


def tree(records: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """((file, level, node, parent, first, end, hash, record_id, copy), top level): all nodes; level 0 are the records."""
    order = W.partitionBy("file").orderBy("offset", "record_id", "sha")
    same = W.partitionBy("file", "record_id").orderBy("offset", "sha")
    leaf = records.withColumn("node", (F.row_number().over(order) - 1).cast("long")).withColumn("copy", F.row_number().over(same)).select(
        "file", F.lit(0).alias("level"), "node", F.floor(F.col("node") / fanout).alias("parent"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("end"), F.col("sha").alias("hash"), "record_id", "copy",
    )
    leaf = written(leaf)
    most = leaf.agg(F.max("node")).first()[0] or 0
    levels, below, level = [leaf], leaf, 0
    while most:
        most, level = most // fanout, level + 1
        child = F.concat_ws(":", "first", "end", "hash")
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("node", child.alias("c")))), lambda x: x["c"])
        below = below.groupBy("file", F.col("parent").alias("node")).agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sha2(F.concat_ws("|", ordered), 256).alias("hash")).withColumn("parent", F.floor(F.col("node") / fanout))
        levels.append(below.select("file", F.lit(level).alias("level"), "node", "parent", "first", "end", "hash", F.lit(None).cast(leaf.schema["record_id"].dataType).alias("record_id"), F.lit(None).cast("int").alias("copy")))
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return (written(nodes) if level else nodes), level


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, record_id, status, offset, length, sha_primary, sha_replica) of all records that differ.

    ``status`` is changed, missing (from the replica) or extra; offset and length are the primary's where it has the record.
    """
    (ours, top), (theirs, other) = tree(primary, fanout), tree(replica, fanout)
    suspect = ours.select("file").unionByName(theirs.select("file")).distinct().withColumn("parent", F.lit(0).cast("long"))
    for level in range(max(top, other), 0, -1):
        at = lambda nodes: nodes.where(F.col("level") == level).join(suspect, ["file", "parent"], "left_semi").select("file", "node", F.struct("first", "end", "hash").alias("v"))  # noqa: E731, B023
        pair = at(ours).alias("p").join(at(theirs).alias("r"), ["file", "node"], "full_outer")
        differ = pair.where(~F.col("p.v").eqNullSafe(F.col("r.v"))).select("file", F.col("node").alias("parent"))
        suspect = written(differ)
    leaf = lambda nodes: nodes.where("level = 0").join(suspect, ["file", "parent"], "left_semi").select("file", F.col("record_id").alias("id"), "copy", F.struct("first", "end", "hash").alias("v"))
    p, r = leaf(ours).alias("p"), leaf(theirs).alias("r")
    both = p.join(r, (F.col("p.file") == F.col("r.file")) & F.col("p.id").eqNullSafe(F.col("r.id")) & (F.col("p.copy") == F.col("r.copy")), "full_outer")
    status = F.when(F.col("r.v").isNull(), "missing").when(F.col("p.v").isNull(), "extra").when(F.col("p.v.hash") != F.col("r.v.hash"), "changed")
    either = lambda name: F.coalesce(F.col(f"p.v.{name}"), F.col(f"r.v.{name}"))
    return both.select(
        F.coalesce("p.file", "r.file").alias("file"), F.coalesce("p.id", "r.id").alias("record_id"), status.alias("status"), either("first").alias("offset"), (either("end") - either("first")).alias("length"),
        F.col("p.v.hash").alias("sha_primary"), F.col("r.v.hash").alias("sha_replica"),
    ).where("status IS NOT NULL")
