"""Log files and line-oriented tables as event streams: (source_file, line_number, text)."""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logfold.functions.text import clean_line
from logfold.sources.shared import remove, written

#: The columns a catalogue file must have.
CATALOG_COLUMNS = ("ColumnName", "ColumnType", "Class", "Schema", "LogicalType", "ListOfValues", "Aliased", "DynamicType", "ArrayValuesType")
LOG_GLOB = "*.{[lL][oO][gG],[tT][xX][tT]}"


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """(source_file) of every .log and .txt file below ``root``, empty ones included; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # a reader would leave empty files out
    files, names = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        name = files.next().getPath().toUri().toString()
        if name.lower().endswith((".log", ".txt")):
            names.append((name,))
    return spark.createDataFrame(names, "source_file string")


def numbered_lines(spark: SparkSession, root: str) -> DataFrame:
    """All physical lines with 1-based numbers per file, blank ones included.

    Lines are numbered inside each block of a file first; a running sum over the (few) blocks of a file gives each
    block's offset. So a large file is read in parallel and no file is sorted in one task.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", LOG_GLOB).text(root)
    at = lines.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("text"),
    )
    within = W.partitionBy("source_file", "block").orderBy("m")
    counted = at.groupBy("source_file", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = counted.select("source_file", "block", (F.sum("n").over(W.partitionBy("source_file").orderBy("block")) - F.col("n")).alias("before"))
    return at.withColumn("i", F.row_number().over(within)).join(offsets, ["source_file", "block"]).select("source_file", (F.col("i") + F.col("before")).alias("line_number"), "text")


def as_events(lines: DataFrame) -> DataFrame:
    """Drops white-space-only lines and a leading byte-order mark on every line."""
    return lines.withColumn("text", clean_line(F.col("text"))).where(F.col("text").rlike(r"\S"))


def scan_logs(spark: SparkSession, root: str) -> DataFrame:
    return as_events(numbered_lines(spark, root))


def input_counts(events: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, event_count) of all files, those without events too."""
    counts = events.groupBy("source_file").agg(F.count(F.lit(1)).alias("event_count"))
    return files.join(counts, "source_file", "left").select("source_file", F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"))


def first_lines(lines: DataFrame, most: int) -> DataFrame:
    """The first lines by number (a filter: no unordered limit)."""
    return lines.where(F.col("line_number") <= most)


def field_violations(lines: DataFrame, field: str, json_col: str = "text") -> DataFrame:
    """(source_file, line_number, rule): lines of ``json_field`` whose field is missing or blank."""
    value = F.get_json_object(F.col(json_col), f"$.{field}")
    return lines.where(value.isNull() | (F.trim(value) == "")).select("source_file", "line_number", F.when(value.isNull(), "missing_field").otherwise("blank_field").alias("rule"))


def require_events(events: DataFrame) -> DataFrame:
    """The events, or an error if there is none at all."""
    if events.isEmpty():
        raise ValueError("no events in any input")
    return events


def json_field(lines: DataFrame, field: str, json_col: str = "text") -> DataFrame:
    """One string field of JSON lines as the event text, line breaks as spaces; bad or blank fields keep a null text."""
    value = F.regexp_replace(F.get_json_object(F.col(json_col), f"$.{field}"), r"[\r\n]+", " ")
    return lines.withColumn("text", F.when(F.trim(value) != "", value))


def aligned(left: DataFrame, right: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``value`` of ``right`` to ``left`` by position in ``order`` (gold labels kept beside their lines); null without a partner."""
    return left.join(right.select(order, value), order, "left")


def by_position(df: DataFrame, *order: str, range_rows: int = 1 << 18) -> DataFrame:
    """Adds ``position``, the 0-based place in ``order``; ties stand by a hash of their whole rows. The result is written.

    The rows are dealt over ranges of about ``range_rows``, whatever they hold: equal values of ``order`` are parted by the
    hash, and equal rows by a number. Ranges are counted and summed up, then numbered inside.
    """
    held, rest = F.struct(*map(_exact, df.columns)).alias("row"), ["k", "h", "tie"]
    keyed = df.select(held, F.struct(*map(_exact, order)).alias("k"), F.xxhash64(*map(_exact, df.columns)).alias("h")).withColumn("tie", F.monotonically_increasing_id())
    ranges = max(1, -(-df.count() // range_rows))
    dealt = written(keyed.repartitionByRange(ranges, *rest).sortWithinPartitions(*rest).select("row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    placed = dealt.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in df.columns), (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("position"))


def _exact(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def zipped(left: DataFrame, right: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(left with ``value`` of the row at the same position, one row (left_rows, right_rows) if the counts differ)."""
    counts = left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(right.agg(F.count(F.lit(1)).alias("right_rows")))  # one row each
    return left.join(right.select("position", value), "position").drop("position"), counts.where("left_rows <> right_rows")


def aligned_by_row(left: DataFrame, right: DataFrame, left_order: str, right_order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``zipped`` of two tables by their places in an order of their own."""
    return zipped(by_position(left, left_order), by_position(right, right_order), value)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, record, text): the records of CSV files numbered from 1, quoted line breaks as ``\\n``, blank lines left out.

    Files are read in blocks. A line begins a record if an even number of quotes stands before it in its file: quotes are
    summed per block, then over the blocks of a file, and so are the records. A file whose quotes do not close is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("text"))
    marks = F.length("text") - F.length(F.replace("text", F.lit('"'), F.lit("")))
    of_block = W.partitionBy("source_file", "block").orderBy("m")
    of_file = W.partitionBy("source_file").orderBy("block")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = written(lines.withColumn("marks", marks).withColumn("inside", before("marks", of_block)))
    blocks = counted.groupBy("source_file", "block").agg(F.sum("marks").alias("marks"))
    if not blocks.groupBy("source_file").agg(F.sum("marks").alias("marks")).where("marks % 2 = 1").isEmpty():
        raise ValueError("a quote is not closed")
    opened = blocks.select("source_file", "block", before("marks", of_file).alias("base"))
    begun = counted.join(opened, ["source_file", "block"]).withColumn("open", (F.col("base") + F.col("inside")) % 2 == 1)
    begun = begun.where("open OR text RLIKE '\\\\S'").withColumn("begins", (~F.col("open")).cast("int"))
    begun = begun.withColumn("own", F.sum("begins").over(of_block.rowsBetween(W.unboundedPreceding, 0)))
    starts = begun.groupBy("source_file", "block").agg(F.sum("begins").alias("n")).select("source_file", "block", before("n", of_file).alias("records"))
    numbered = begun.join(starts, ["source_file", "block"]).withColumn("record", F.col("records") + F.col("own"))
    parts = F.array_sort(F.collect_list(F.struct("block", "m", "text")))
    return numbered.groupBy("source_file", "record").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def gold_labels(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(position, value): one column of CSV files in the order of their names and records, which is that of the lines they label.

    Every file begins with a header, the same in all; a missing column is an error.
    """
    records = written(csv_records(spark, path))
    headers = [r.text for r in records.where("record = 1").select("text").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError("no header" if not headers else "files with different headers")
    names = [n.strip() for n in next(csv.reader([headers[0].lstrip("\ufeff")]))]
    if column not in names:
        raise ValueError(f"no column {column}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    found = records.where("record > 1").select("source_file", "record", F.from_csv("text", F.lit(schema), {"multiLine": "true", "escape": '"'}).getField(f"c{names.index(column)}").alias("value"))
    sizes = found.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("source_file", (F.sum("n").over(W.orderBy("source_file")) - F.col("n")).alias("before"))  # one row a file
    return found.join(base, "source_file").select((F.col("before") + F.col("record") - 2).alias("position"), "value")


def with_gold(events: DataFrame, gold: DataFrame, *order: str, value: str = "value") -> DataFrame:
    """Events with the gold label of the same place in ``order``; an error if there are more of one than of the other."""
    joined, off = zipped(by_position(events, *order), gold, value)
    if found := off.first():
        raise ValueError(f"{found.left_rows} events and {found.right_rows} labels")
    return joined


def aligned_violations(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """(order, side): rows that only one of the tables has."""
    only = lambda a, b, side: a.select(order).join(b.select(order), order, "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV -> (field, type, class, schema_name, logical_type, allowed_values, aliased, dynamic_type, array_type).

    A file without one of the nine columns is an error.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    lacking = set(CATALOG_COLUMNS) - set(raw.columns)
    if lacking:
        raise ValueError(f"catalogue without columns {sorted(lacking)}")
    blank: Column = F.lit(True)
    for c in raw.columns:
        blank = blank & (F.coalesce(F.trim(c), F.lit("")) == "")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    listed = F.filter(F.transform(F.split(text("ListOfValues"), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    return raw.where(~blank).select(
        text("ColumnName").alias("field"), text("ColumnType").alias("type"), text("Class").alias("class"), text("Schema").alias("schema_name"), text("LogicalType").alias("logical_type"), listed.alias("allowed_values"),
        text("Aliased").alias("aliased"), text("DynamicType").alias("dynamic_type"), text("ArrayValuesType").alias("array_type"),
    )


def catalog_violations(catalog: DataFrame, digest: DataFrame, manifest: DataFrame, common: str = "Common") -> DataFrame:
    """(rule, expected, found): the catalogue against manifest(sha256, field_count, schemas), one row; digest from ``file_digest``."""
    found = catalog.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(F.col("schema_name") != common, F.col("schema_name")))).alias("names")).crossJoin(digest.select(F.col("sha256").alias("sha")))  # one row each
    met = found.crossJoin(manifest)
    text = lambda c: F.array_join(F.array_sort(F.col(c)), ",")
    rule = lambda name, expected, seen: F.struct(F.lit(name).alias("rule"), expected.cast("string").alias("expected"), seen.cast("string").alias("found"))
    rules = F.array(rule("sha256", F.col("sha256"), F.col("sha")), rule("field_count", F.col("field_count"), F.col("n")), rule("schemas", text("schemas"), text("names")))
    return met.select(F.explode(rules).alias("r")).select("r.*").where("expected <> found")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files: integrity against a manifest."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def table_digest(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_rows, fingerprint): count and an order-free fingerprint of all rows.

    The SHA-256 of a row's JSON is cut into four numbers of 60 bits, each summed over the rows, so it merges map-side;
    the fingerprint is the SHA-256 of the four sums.
    """
    sha = F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in by)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(sha, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", *map(part, range(4))), 256).alias("fingerprint"))


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corpora(corpus_id, track, redistribution, ...), violations): corpus manifests, one JSON document a file; ids must differ."""
    found = spark.read.option("multiLine", "true").schema("corpus_id string, track string, redistribution string, source string, revision string").json(path)
    twice = found.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR corpus_id IS NULL")
    return found, twice.select(F.col("corpus_id").alias("id"), F.lit("repeated_corpus").alias("rule"), F.col("n").cast("string").alias("detail"))


_INPUT = "struct<cluster_id string, template string, system string, vendor string, product string, events array<struct<source_file string, line_number long, text string>>, slots array<struct<slot_id string, label string, placeholder string, occurrence int, examples array<string>>>>"
_EXPECTED = "struct<schema_name string, semantics array<struct<semantic_id string, source_kind string, locator string, role string>>, fields array<struct<semantic_id string, field string, constant_value variant>>>"
#: The typed records of an evaluation: name -> (schema, the key that must not repeat).
RECORDS = {
    "cases": (f"case_id string, revision string, disposition string, input {_INPUT}, expected {_EXPECTED}, label_source string", "case_id"),
    "groups": ("case_id string, group_id string", "case_id"),
    "split": ("case_id string, group_id string, partition string, revision string", "case_id"),
    "tasks": (f"case_id string, task_revision string, catalogue_revision string, input_fingerprint string, input {_INPUT}", "case_id"),
    "decisions": (f"decision_id string, kind string, case_id string, reviewer string, task_revision string, catalogue_revision string, input_fingerprint string, source_decisions array<string>, expected {_EXPECTED}", "decision_id"),
}


def read_records(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(records with their typed columns, violations(source_file, line_number, rule, detail)) of JSON lines of a kind in RECORDS.

    Lines that are no JSON object of the schema, that have undeclared keys, or lack or repeat the key are violations;
    only lines without any are records.
    """
    schema, key = RECORDS[kind]
    lines = written(as_events(numbered_lines(spark, path)))
    declared = spark.createDataFrame([], schema).columns
    read = lines.withColumn("r", F.from_json("text", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    extra = F.array_except(F.map_keys(F.from_json("text", "map<string,string>")), F.array(*map(F.lit, declared)))
    rule = (
        F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), F.struct(F.lit("not_a_record").alias("rule"), F.lit("").alias("detail")))
        .when(F.size(extra) > 0, F.struct(F.lit("undeclared_keys").alias("rule"), F.array_join(extra, ",").alias("detail"))).when(F.col(f"r.{key}").isNull(), F.struct(F.lit("no_key").alias("rule"), F.lit(key).alias("detail")))
    )
    judged = read.withColumn("v", rule)
    fine = judged.where("v IS NULL").select("source_file", "line_number", "r.*").drop("_corrupt_record")
    twice = fine.join(fine.groupBy(key).agg(F.min(F.struct("source_file", "line_number")).alias("first")), key).where(F.struct("source_file", "line_number") != F.col("first"))
    bad = judged.where("v IS NOT NULL").select("source_file", "line_number", "v.rule", "v.detail").unionByName(twice.select("source_file", "line_number", F.lit("repeated_key").alias("rule"), F.col(key).alias("detail")))
    return fine.drop("source_file", "line_number").dropDuplicates([key]), bad


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review decisions from JSON lines; unreadable lines keep their text in ``_corrupt_record``."""
    schema = (
        "cluster_id string, reviewer string, status string, schema_name string, parser_name string, vendor string, product string, source_table string, message_field string, "
        "field_mappings array<struct<slot_id string, field string, transform string>>, notes string, _corrupt_record string"
    )
    return spark.read.schema(schema).json(path)


def unknown_keys(spark: SparkSession, path: str, declared: list[str]) -> DataFrame:
    """(line, keys): JSON lines with keys outside the declared ones, which a typed reader would drop silently."""
    keys = F.array_except(F.map_keys(F.from_json("value", "map<string,string>")), F.array(*map(F.lit, declared)))
    return spark.read.text(path).select(F.col("value").alias("line"), keys.alias("keys")).where(F.size("keys") > 0)


def read_review_state(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, label, n_enabled): review-tool state in either shape, an object or a list of [key, value] pairs.

    ``label`` is the one enabled decision, null if none or several are (``n_enabled`` tells).
    """
    state = spark.read.option("wholetext", "true").text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("cluster_id", "a"))
    obj = F.map_entries(F.coalesce(F.from_json("a", "map<string,string>"), F.create_map().cast("map<string,string>")))
    plain = F.transform(obj, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    pairs = F.transform(F.from_json("a", "array<array<string>>"), lambda p: F.struct(F.coalesce(F.get_json_object(p[0], "$.name"), p[0]).alias("name"), p[1].alias("value")))
    either = F.when(F.trim("a").startswith("["), pairs).otherwise(plain)
    enabled = F.transform(F.filter(either, lambda e: F.lower(e["value"]).isin("true", "on", "1")), lambda e: e["name"])
    return state.select("cluster_id", F.when(F.size(enabled) == 1, enabled[0]).alias("label"), F.size(enabled).alias("n_enabled"))


def write_sorted(df: DataFrame, path: str, *keys: str, fmt: str = "parquet") -> None:
    """A table in a deterministic order, written in parallel by ranges of its keys."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").format(fmt).save(path)


def _moved(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} cannot become {target}")


def write_with_manifest(df: DataFrame, path: str, *keys: str, revision: str = "", fmt: str = "parquet") -> DataFrame:
    """Writes the table and, beside it, its manifest: one row (artefact, n_rows, fingerprint, revision), which is returned.

    Both are one commit: the table is written aside, its digest is taken of what was written, the manifest of an older
    table goes first, the table takes its place, and the new manifest comes last. Whatever stops in between leaves a table
    without a manifest, which ``read_with_manifest`` refuses.
    """
    spark, place = df.sparkSession, path.rstrip("/")
    aside, beside = f"{place}.staged-{uuid.uuid4().hex}", f"{place}.manifest"
    write_sorted(df, aside, *keys, fmt=fmt)
    manifest = table_digest(spark.read.format(fmt).schema(df.schema).load(aside)).select(F.lit(place.rsplit("/", 1)[-1]).alias("artefact"), "n_rows", "fingerprint", F.lit(revision).alias("revision"))
    manifest.coalesce(1).write.json(f"{aside}.manifest")
    remove(spark, beside, place)
    _moved(spark, aside, place)
    _moved(spark, f"{aside}.manifest", beside)
    return spark.read.schema(MANIFEST).json(beside)


MANIFEST = "artefact string, n_rows long, fingerprint string, revision string"


def read_with_manifest(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", revision: str | None = None) -> DataFrame:
    """A table of ``write_with_manifest``; an error without its manifest, or if rows, fingerprint or revision are others."""
    place = path.rstrip("/")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{place}.manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise ValueError(f"{place} has no manifest")
    told = spark.read.schema(MANIFEST).json(f"{place}.manifest").first()
    reader = spark.read.format(fmt)
    table = (reader.schema(schema) if schema is not None else reader).load(place)
    found = table_digest(table).first()
    if told is None or (told.n_rows, told.fingerprint) != (found.n_rows, found.fingerprint) or revision not in (None, told.revision):
        raise ValueError(f"{place} is not what its manifest tells")
    return table
