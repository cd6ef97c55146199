"""Approved mappings applied to events: what a compiled parser would do, as one Spark job for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.functions.text import quoted
from logfold.operators.govern import repeated, unresolved
from logfold.operators.templates import SLOT
from logfold.sources.shared import remove

CASTS = {"string": "string", "int": "int", "long": "bigint", "real": "double", "datetime": "timestamp", "bool": "boolean"}


def build_parser_specs(clusters: DataFrame, reviews: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(specs, skipped counts, violations) from clusters(cluster_id, template), reviews(cluster_id, status, schema_name, vendor, product)
    and mappings(cluster_id, slot_id, field, transform)."""
    slots = F.size(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1)))
    ready = clusters.join(reviews.where("status = 'approved'"), "cluster_id")
    listed = mappings.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("slot_id", "field", "transform"))).alias("mappings"))
    joined = ready.join(listed, "cluster_id", "left")
    specs = joined.where("mappings IS NOT NULL").withColumn("pattern", _pattern()).select("cluster_id", "template", "pattern", "schema_name", "vendor", "product", "mappings")
    skipped = reviews.join(listed.select("cluster_id", F.lit(1).alias("m")), "cluster_id", "left").groupBy(F.when(F.col("status") != "approved", F.col("status")).when(F.col("m").isNull(), "awaiting_mapping").alias("reason")).agg(F.count(F.lit(1)).alias("n")).where("reason IS NOT NULL")
    known = mappings.join(clusters.select("cluster_id", slots.alias("n")), "cluster_id")
    no_slot = known.where(F.regexp_extract("slot_id", "[0-9]+", 0).cast("int") > F.col("n")).select(F.concat_ws("/", "cluster_id", "slot_id").alias("id"), F.lit("unknown_slot").alias("rule"), F.lit("").alias("detail"))
    twice = repeated(mappings.select(F.concat_ws("/", "cluster_id", "slot_id").alias("k")), "k", "slot_mapped_twice").unionByName(repeated(mappings.select(F.concat_ws("/", "cluster_id", "field").alias("k")), "k", "field_mapped_twice"))
    bad = repeated(reviews, "cluster_id", "repeated_review").unionByName(unresolved(reviews, "cluster_id", clusters, "cluster_id", "unknown_cluster"))
    return specs, skipped, bad.unionByName(no_slot).unionByName(twice)


def _pattern():
    """Anchored; mapped slots capture, others are matched without a group."""
    literals = F.split("template", "<VAR:[A-Z0-9_]+>", -1)
    plain = F.transform(literals, quoted)
    mapped = F.transform("mappings", lambda m: m["slot_id"])
    pieces = F.transform(plain, lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.when(F.array_contains(mapped, F.concat(F.lit("p"), i.cast("string"))), "(.+?)").otherwise(".*?"), t)))
    return F.concat(F.lit("^"), F.array_join(pieces, ""), F.lit("$"))


def extracted(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """(ord, cluster_id, schema_name, vendor, product, fields map): events joined to their cluster's spec, never to all patterns.

    Works on streams too: the specs are a static side.
    """
    order = F.transform(F.array_sort(F.transform("mappings", lambda m: F.regexp_extract(m["slot_id"], "[0-9]+", 0).cast("int"))), lambda i: F.concat(F.lit("p"), i.cast("string")))
    ready = specs.withColumn("groups", order)
    rows = assigned.select("ord", "text", "cluster_id").join(ready, "cluster_id").where(F.expr("text rlike pattern"))
    value = "map_from_entries(transform(mappings, m -> struct(m.field, regexp_extract(text, pattern, cast(array_position(groups, m.slot_id) AS int)))))"
    return rows.select("ord", "cluster_id", "schema_name", "vendor", "product", F.expr(value).alias("fields"))


def normalize_events(assigned: DataFrame, specs: DataFrame, declared: dict[str, str]) -> DataFrame:
    """One wide row per event: ``declared`` fields by name with their transform (string, int, long, real, datetime, bool).

    A value that does not cast becomes null, as does a field that the event's spec does not map.
    """
    rows = extracted(assigned, specs)
    cols = [F.expr(f"try_cast(fields['{name}'] AS {CASTS[kind]})").alias(name) for name, kind in declared.items()]
    return rows.select("ord", "cluster_id", F.col("schema_name").alias("EventSchema"), F.col("vendor").alias("EventVendor"), F.col("product").alias("EventProduct"), *cols)


#: Why a line gives no row in any schema's table.
REASONS = ("no_template", "no_parser", "no_match", "undeclared_schema")


def routed(assigned: DataFrame, specs: DataFrame, declared: dict[str, dict[str, str]]) -> DataFrame:
    """(ord, text, cluster_id, EventSchema, EventVendor, EventProduct, fields, reason): every line, once.

    ``declared`` has the fields of each schema with their transforms. Lines that no parser takes keep their text and the
    reason, one of REASONS; the others have the captured values by field. Works on streams: the specs are a static side.
    """
    order = F.transform(F.array_sort(F.transform("mappings", lambda m: F.regexp_extract(m["slot_id"], "[0-9]+", 0).cast("int"))), lambda i: F.concat(F.lit("p"), i.cast("string")))
    ready = specs.withColumn("groups", order).select("cluster_id", "pattern", "schema_name", "vendor", "product", "mappings", "groups")
    rows = assigned.select("ord", "text", "cluster_id").join(ready, "cluster_id", "left")
    reason = (
        F.when(F.col("cluster_id").isNull(), "no_template").when(F.col("pattern").isNull(), "no_parser").when(~F.expr("text rlike pattern"), "no_match").when(~F.col("schema_name").isin(*declared), "undeclared_schema")
    )
    value = "map_from_entries(transform(mappings, m -> struct(m.field, regexp_extract(text, pattern, cast(array_position(groups, m.slot_id) AS int)))))"
    taken = lambda c: F.when(F.col("reason").isNull(), c)
    return rows.withColumn("reason", reason).select(
        "ord", "text", "cluster_id", taken(F.col("schema_name")).alias("EventSchema"), taken(F.col("vendor")).alias("EventVendor"), taken(F.col("product")).alias("EventProduct"), taken(F.expr(value)).alias("fields"), "reason",
    )


def schema_table(rows: DataFrame, schema: str, declared: dict[str, str]) -> DataFrame:
    """The table of one schema out of ``routed`` lines: its declared fields with their types, and ``uncast``, the fields whose
    value did not take its type and is null. Mapped fields that the schema does not declare are listed in ``undeclared``."""
    own = rows.where(F.col("EventSchema") == schema)
    cast = {name: F.expr(f"try_cast(fields['{name}'] AS {CASTS[kind]})") for name, kind in declared.items()}
    failed = F.filter(F.array(*(F.when(F.expr(f"fields['{name}'] IS NOT NULL") & c.isNull(), name) for name, c in cast.items())), lambda x: x.isNotNull()) if cast else F.array().cast("array<string>")
    undeclared = F.array_sort(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, declared)).cast("array<string>")))
    return own.select("ord", "cluster_id", "EventVendor", "EventProduct", *(c.alias(name) for name, c in cast.items()), failed.alias("uncast"), undeclared.alias("undeclared"))


def write_schemas(rows: DataFrame, folder: str, declared: dict[str, dict[str, str]], batch: int = 0) -> None:
    """Writes ``routed`` lines as one table for each declared schema, ``<folder>/<schema>``, and the rest with their reasons as
    ``<folder>/unparsed``.

    The lines are parsed in one pass, into a staging table by schema; each table then reads its own part. A batch that is
    written again takes the place of its first write, so a stream that restarts leaves every line once.
    """
    spark = rows.sparkSession
    stage = f"{folder.rstrip('/')}/staging-{batch}"
    rows.withColumn("part", F.coalesce("EventSchema", F.lit(""))).write.mode("overwrite").partitionBy("part").parquet(stage)
    staged = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.StringType())])).parquet(stage)
    for schema, fields in declared.items():
        own = staged.where(F.col("part") == schema)
        schema_table(own, schema, fields).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{schema}/batch={batch}")
    staged.where("reason IS NOT NULL").select("ord", "cluster_id", "text", "reason").write.mode("overwrite").parquet(f"{folder.rstrip('/')}/unparsed/batch={batch}")
    remove(spark, stage)
