"""Target catalogue and schema ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.functions import vocab
from logfold.functions.text import concepts

CATALOG_DDL = "field string, type string, class string, schema_name string, logical_type string, allowed_values array<string>"


def default_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.CATALOG, CATALOG_DDL)


def effective_fields(catalog: DataFrame, common: str = "Common") -> DataFrame:
    """(schema_name, field, ...) of every schema: its own fields and the common ones it does not override."""
    own = catalog.where(F.col("schema_name") != common).withColumn("common_first", F.lit(1))
    shared = catalog.where(F.col("schema_name") == common).drop("schema_name").join(own.select("schema_name").distinct(), how="cross")  # schemas x common fields: bounded by the catalogue
    shared = shared.join(own.select("schema_name", "field"), ["schema_name", "field"], "left_anti").withColumn("common_first", F.lit(0))
    return own.unionByName(shared)


def schema_counts(catalog: DataFrame, common: str = "Common") -> DataFrame:
    return catalog.where(F.col("schema_name") != common).groupBy("schema_name").agg(F.count(F.lit(1)).alias("n_fields"))


def schema_concepts(spark: SparkSession, names: list[str]) -> DataFrame:
    """(schema_name, token): the given concepts, or else the tokens of the schema's name."""
    known = [(s, t) for s in names for t in vocab.SCHEMA_CONCEPTS.get(s, [])]
    listed = spark.createDataFrame(known or [("", "")], "schema_name string, token string").where("schema_name <> ''")
    rest = spark.createDataFrame([(s,) for s in names if s not in vocab.SCHEMA_CONCEPTS] or [("",)], "schema_name string").where("schema_name <> ''")
    return listed.unionByName(rest.select("schema_name", F.explode(concepts(F.col("schema_name"))).alias("token")))


def rank_schemas(texts: DataFrame, id_col: str, text_col: str, concepts_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rankings(id, schema_name, score, confidence, rank, evidence), selections(id, selected_schema, confidence, reason)).

    The schema vocabulary is a small dimension: it is turned into one array column per schema row and met by a cross
    join with the schemas (bounded by the catalogue), so ranking needs no shuffle of the texts' tokens.
    """
    wanted = concepts_of.groupBy("schema_name").agg(F.collect_set("token").alias("wanted"))
    scored = texts.select(id_col, concepts(F.col(text_col)).alias("c")).crossJoin(F.broadcast(wanted)).withColumn("evidence", F.array_sort(F.array_intersect("c", "wanted"))).withColumn("score", F.size("evidence"))
    w = W.partitionBy(id_col)
    order = w.orderBy(F.desc("score"), "schema_name")
    total = F.sum("score").over(w)
    ranked = scored.withColumn("confidence", F.when(total > 0, F.round(F.col("score") / total, 6)).otherwise(0.0)).withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    rankings = ranked.select(id_col, "schema_name", "score", "confidence", "rank", "evidence")
    reason = F.when(F.col("score") == 0, "no_evidence").when(F.col("next") == F.col("score"), "tied_top")
    top = ranked.where("rank = 1").withColumn("reason", reason)
    picked = top.select(id_col, F.when(F.col("reason").isNull(), F.col("schema_name")).alias("selected_schema"), F.when(F.col("reason").isNull(), F.col("confidence")).otherwise(0.0).alias("confidence"), "reason")
    return rankings, picked


def enrich(clusters: DataFrame, selections: DataFrame) -> DataFrame:
    """Clusters with their suggested schema; an abstention is NoFit."""
    return clusters.join(selections, "cluster_id", "left").withColumn("selected_schema", F.coalesce("selected_schema", F.lit("NoFit"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def hint_violations(hints: DataFrame, catalog: DataFrame, id_col: str) -> DataFrame:
    """(id, rule, detail): hints at schemas that the catalogue does not have."""
    return hints.join(catalog.select("schema_name").distinct(), "schema_name", "left_anti").select(F.col(id_col).cast("string").alias("id"), F.lit("unknown_schema").alias("rule"), F.col("schema_name").alias("detail"))


def schema_candidates(rankings: DataFrame, selections: DataFrame, id_col: str, hints: DataFrame | None = None) -> DataFrame:
    """(id, schema_name, score): candidates with evidence, scaled to the best; none after an abstention; a hint is the only one."""
    kept = rankings.join(selections.where("reason IS NULL").select(id_col), id_col, "left_semi").where("score > 0")
    best = F.max("score").over(W.partitionBy(id_col))
    scaled = kept.withColumn("scaled", F.round(F.col("score") / best, 6)).select(id_col, "schema_name", F.col("scaled").alias("score"))
    if hints is None:
        return scaled
    return scaled.join(hints, id_col, "left_anti").unionByName(hints.select(id_col, "schema_name", F.lit(1.0).alias("score")))
