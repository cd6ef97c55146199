"""Evaluation of predictions against gold, for any number of approaches at once.

Long tables carry ``approach`` and ``case_id``. Everything reduces to per-case rows first; the aggregates over cases are
then plain sums and means grouped by approach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logfold.operators.concepts import role_facets


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return F.when(tp + fp + fn == 0, 1.0).otherwise(_ratio(2 * p * r, p + r))


FOLDED = ("locator", "role")


def typed_key(value: Column) -> Column:
    """A VARIANT constant as a string that is equal for equal values: numbers and truth values by what they count (1, 1.0 and
    true are one value, as 2.5 and 25e-1 are), strings apart from numbers, null for a missing value or a JSON null."""
    kind = F.schema_of_variant(value)
    as_double = F.try_variant_get(value, "$", "double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < 9.2e18)
    number = F.when(whole, as_double.cast("bigint").cast("string")).otherwise(as_double.cast("string"))
    return (
        F.when(value.isNull() | F.is_variant_null(value), None).when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "n:1").otherwise("n:0")).when(kind == "BIGINT", F.concat(F.lit("n:"), F.try_variant_get(value, "$", "string")))
        .when(kind.startswith("DECIMAL") & kind.endswith(",0)"), F.concat(F.lit("n:"), F.try_variant_get(value, "$", "decimal(38,0)").cast("string"))).otherwise(F.concat(F.lit("n:"), number))
    )


def folded(df: DataFrame) -> DataFrame:
    """Columns as they are compared: locators and roles in lower case, VARIANT constants by ``typed_key``; field names keep their case."""
    constants = [f.name for f in df.schema.fields if isinstance(f.dataType, T.VariantType)]
    return df.withColumns({c: F.lower(c) for c in FOLDED if c in df.columns} | {c: typed_key(F.col(c)) for c in constants})


#: Rows of ``cases`` for each partition of what is compared case by case.
CASES_A_PART = 20_000


def case_parts(cases: DataFrame) -> int:
    """Partitions for rows that are compared case by case: their number follows the cases, so a task's memory does not."""
    return max(1, -(-cases.count() // CASES_A_PART))


def coverage_violations(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """(approach, rule, detail) of predictions that may not be evaluated together.

    cases(case_id, revision), predictions(approach, version, case_id, revision): each approach answers every case once
    and no other, in one version and for the case's catalogue revision.
    """
    approaches = predictions.select("approach").distinct()
    row = lambda df, rule, detail: df.select("approach", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    missing = approaches.join(cases.select("case_id"), how="cross").join(predictions, ["approach", "case_id"], "left_anti")  # approaches x cases
    return (
        row(missing, "no_prediction", F.col("case_id")).unionByName(row(predictions.join(cases, "case_id", "left_anti"), "unknown_case", F.col("case_id")))
        .unionByName(row(predictions.groupBy("approach", "case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated_prediction", F.col("case_id")))
        .unionByName(row(predictions.groupBy("approach").agg(F.count_distinct("version").alias("n")).where("n > 1"), "several_versions", F.col("n")))
        .unionByName(row(predictions.join(cases.select("case_id", F.col("revision").alias("own")), "case_id").where("NOT revision <=> own"), "other_revision", F.col("case_id")))
    )


def set_scores(cases: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """cases(approach, case_id); gold(case_id, keys); pred(approach, case_id, keys) -> tp, fp, fn and rounded f1 per case.

    Keys are compared null-safely, as sets, locators and roles without regard to case. Gold is joined to the approaches
    through ``cases``. Fields are keyed by (kind, locator, field, constant_value).
    """
    gold, pred, parts = folded(gold), folded(pred), case_parts(cases)
    want = cases.select("approach", "case_id").repartition(parts, "case_id").join(gold.select("case_id", *keys).repartition(parts, "case_id"), "case_id").withColumn("g", F.lit(1))
    got = pred.select("approach", "case_id", *keys).withColumn("p", F.lit(1))
    same = want.unionByName(got, allowMissingColumns=True).repartition(parts, "approach", "case_id").groupBy("approach", "case_id", *keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counted = same.groupBy("approach", "case_id").agg(
        count(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn")
    )
    full = cases.repartition(parts, "approach", "case_id").join(counted, ["approach", "case_id"], "left").fillna(0, ["tp", "fp", "fn"])
    return full.withColumn("f1", F.round(f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 6))


def micro_macro(scores: DataFrame, by: tuple[str, ...] = ("approach",)) -> DataFrame:
    """Micro precision, recall and F1 from summed counts, macro F1 as the mean of case F1."""
    s = scores.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("f1"), 6).alias("macro_f1"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*by, F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(f1_of(tp, fp, fn), 6).alias("f1"), "macro_f1")


def micro_macro_by_family(scores: DataFrame, family: str, by: tuple[str, ...] = ("approach",)) -> DataFrame:
    """``micro_macro`` of all cases, where ``family`` is null, and of each family, from one pass over the case scores.

    Cases without a family count in the whole alone; ``whole`` tells its row from theirs.
    """
    per_case = scores.select(*by, F.col(family).alias(family), "tp", "fp", "fn", "f1")
    sets = per_case.groupingSets([[*by, family], [*by]], *by, family).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.count(F.lit(1)).alias("n"), (F.grouping(family) == 1).alias("whole"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sets.where(F.col("whole") | F.col(family).isNotNull()).select(*by, family, "whole", "n", F.round(_ratio(tp, tp + fp), 6).alias("precision"), F.round(_ratio(tp, tp + fn), 6).alias("recall"), F.round(f1_of(tp, fp, fn), 6).alias("f1"), "macro_f1")


def facet_scores(cases: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(approach, facet, f1): micro F1 of each facet on (kind, locator, facet value)."""
    gold, pred, parts = folded(gold), folded(pred), case_parts(cases)
    facets = ["domain", "relation", "entity", "property"]
    want = cases.select("approach", "case_id").repartition(parts, "case_id").join(role_facets(gold).select("case_id", "kind", "locator", *facets).repartition(parts, "case_id"), "case_id").withColumn("g", F.lit(1))
    got = role_facets(pred).select("approach", "case_id", "kind", "locator", *facets).withColumn("p", F.lit(1))
    rows = want.unionByName(got, allowMissingColumns=True).repartition(parts, "approach", "case_id")
    long = rows.select("approach", "case_id", "kind", "locator", "g", "p", F.expr("stack(4, " + ", ".join(f"'{f}', {f}" for f in facets) + ") AS (facet, value)"))
    same = long.groupBy("approach", "case_id", "kind", "locator", "facet", "value").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = same.groupBy("approach", "facet").agg(F.sum(F.expr("int(g IS NOT NULL AND p IS NOT NULL)")).alias("tp"), F.sum(F.expr("int(g IS NULL)")).alias("fp"), F.sum(F.expr("int(p IS NULL)")).alias("fn"))
    return counts.select("approach", "facet", F.round(f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


def facet_summary(facets: DataFrame, pred: DataFrame) -> DataFrame:
    """(approach, facet_f1, unregistered_rate): the mean of the four facets, the share of predicted roles outside the registry."""
    millionths = facets.groupBy("approach").agg(F.sum(F.round(F.col("f1") * 1_000_000).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    mean = millionths.select("approach", (F.expr("(2 * s + n) div (2 * n)") / 1_000_000).alias("facet_f1"))  # halves go up, in whole numbers
    rate = role_facets(folded(pred)).groupBy("approach").agg(F.round(F.avg(F.when(F.col("registered"), 0.0).otherwise(1.0)), 6).alias("unregistered_rate"))
    return mean.join(rate, "approach", "left").fillna(0.0, ["unregistered_rate"])


def schema_ranks(cases: DataFrame, gold_case: DataFrame, pred_schema: DataFrame) -> DataFrame:
    """Top-1, top-3 and mean reciprocal rank; only gold-mapped cases count."""
    mapped = cases.join(gold_case.where("disposition = 'mapped' AND schema_name IS NOT NULL"), "case_id")
    hit = mapped.join(pred_schema.groupBy("approach", "case_id", "schema_name").agg(F.min("rank").alias("rank")), ["approach", "case_id", "schema_name"], "left")
    share = lambda n: F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6)
    return hit.groupBy("approach").agg(share(1).alias("top1"), share(3).alias("top3"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def field_ranks(cases: DataFrame, gold_case: DataFrame, gold_field: DataFrame, candidates: DataFrame) -> DataFrame:
    """Field MRR (candidates of a locator merged by best score) and candidate recall at 1, 3 and 5 (last prediction wins)."""
    mapped = gold_case.where("disposition = 'mapped'").select("case_id")
    want = cases.join(gold_field.join(mapped, "case_id", "left_semi"), "case_id")
    merged = candidates.groupBy("approach", "case_id", "kind", "locator", "field").agg(F.max("score").alias("score"))
    order = W.partitionBy("approach", "case_id", "kind", "locator").orderBy(F.desc("score"), "field")
    placed = merged.withColumn("place", F.row_number().over(order)).drop("score")
    last = F.max("prediction").over(W.partitionBy("approach", "case_id", "kind", "locator"))
    kept = candidates.withColumn("last", last).where("prediction = last").groupBy("approach", "case_id", "kind", "locator", "field").agg(F.min("rank").alias("rank"))
    keys = ["approach", "case_id", "kind", "locator", "field"]
    hit = want.join(placed, keys, "left").join(kept, keys, "left")
    at = lambda n: F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{n}")
    return hit.groupBy("approach").agg(F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("field_mrr"), at(1), at(3), at(5))


def recall_at_gold(cases: DataFrame, gold_field: DataFrame, candidates: DataFrame) -> DataFrame:
    """(approach, case_id, recall): share of gold fields among the best-scored |gold| predictions; empty gold is 1 if nothing was predicted."""
    keys = ["kind", "locator", "field"]
    size = gold_field.select("case_id", *keys).distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("m"))
    best = candidates.where("rank = 1").groupBy("approach", "case_id", *keys).agg(F.max("score").alias("score"))
    placed = best.withColumn("place", F.row_number().over(W.partitionBy("approach", "case_id").orderBy(F.desc("score"), *keys)))
    hits = placed.join(gold_field.select("case_id", *keys).distinct().withColumn("g", F.lit(1)), ["case_id", *keys], "left").join(size, "case_id", "left")
    agg = hits.groupBy("approach", "case_id").agg(F.sum(F.when((F.col("place") <= F.col("m")) & F.col("g").isNotNull(), 1).otherwise(0)).alias("h"))
    full = cases.join(size, "case_id", "left").join(agg, ["approach", "case_id"], "left")
    return full.select("approach", "case_id", F.round(F.when(F.col("m").isNull(), F.when(F.col("h").isNull(), 1.0).otherwise(0.0)).otherwise(F.coalesce("h", F.lit(0)) / F.col("m")), 6).alias("recall"))


def pair_metrics(df: DataFrame, pred_col: str, gold_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairwise clustering precision, recall, F1 and purity from the contingency table."""
    cell = df.groupBy(*by, pred_col, gold_col).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda g: g.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("v"))
    side = lambda c: cell.groupBy(*by, c).agg(F.sum("n").alias("n"))
    pure = cell.groupBy(*by, pred_col).agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("purity"))
    on = list(by) or ["__one"]
    key = lambda d: d if by else d.withColumn("__one", F.lit(1))
    j = key(pairs(cell)).withColumnRenamed("v", "both").join(key(pairs(side(pred_col))).withColumnRenamed("v", "pred"), on).join(key(pairs(side(gold_col))).withColumnRenamed("v", "gold"), on).join(key(pure), on)
    p, r = _ratio(F.col("both"), F.col("pred")), _ratio(F.col("both"), F.col("gold"))
    return j.select(*by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(_ratio(2 * p * r, p + r), 6).alias("f1"), F.round("purity", 6).alias("purity"))


def baseline_delta(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Delta to a baseline where corpus, approach, metric and fingerprint all match."""
    keys = ["corpus_id", "approach", "metric", "fingerprint"]
    return results.join(baseline.select(*keys, F.col("value").alias("was")), keys, "left").withColumn("baseline_delta", F.round(F.col("value") - F.col("was"), 6)).drop("was")
