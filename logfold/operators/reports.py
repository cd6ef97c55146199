"""Reports that join the parts: exactness and edits, pool statistics, format diagnostics, hint agreement, case contracts, comparison."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.functions.text import ordered_tokens
from logfold.operators import approaches as registry
from logfold.operators import metrics, stats
from logfold.sources.shared import written


def exactness(cases: DataFrame, gold_case: DataFrame, pred_case: DataFrame, field_scores: DataFrame, source_scores: DataFrame) -> DataFrame:
    """(approach, disposition_accuracy, coverage, mapping_exact, full_exact, mean_edits).

    pred_case(approach, case_id, disposition, schema_name); edits are a wrong schema plus the symmetric difference of fields.
    """
    off = lambda s, name: s.select("approach", "case_id", (F.col("fp") + F.col("fn")).alias(name))
    rows = cases.join(gold_case.select("case_id", F.col("disposition").alias("gd"), F.col("schema_name").alias("gs")), "case_id").join(pred_case, ["approach", "case_id"]).join(off(field_scores, "fd"), ["approach", "case_id"]).join(off(source_scores, "sd"), ["approach", "case_id"])
    schema_ok = F.col("schema_name").eqNullSafe(F.col("gs"))
    fields_ok = schema_ok & (F.col("fd") == 0)
    right = F.col("gd") == F.col("disposition")
    mapped = (F.col("gd") == "mapped") & F.col("gs").isNotNull()
    exact = fields_ok & (mapped | right)
    share = lambda c, name: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(name)
    return rows.groupBy("approach").agg(
        share(right, "disposition_accuracy"), share(F.col("disposition") == "mapped", "coverage"), share(exact, "mapping_exact"), share(exact & (F.col("sd") == 0), "full_exact"),
        F.round(F.avg(F.when(schema_ok, 0).otherwise(1) + F.col("fd")), 6).alias("mean_edits"),
    )


def pool_statistics(candidates: DataFrame) -> DataFrame:
    """(approach, reduction, tie_rate) of the top candidates: how much of the schema was never considered, how often the top is tied."""
    top = candidates.where("rank = 1")
    return top.groupBy("approach").agg(F.round(F.avg(1 - F.col("pool_size") / F.col("considered")), 6).alias("reduction"), F.round(F.avg((F.col("tied_with") > 0).cast("double")), 6).alias("tie_rate"))


def format_diagnostics(clusters: DataFrame, by: str) -> DataFrame:
    """(by, cluster_count, slot_rate, fit_rate): share of templates with slots, event-weighted share with a schema."""
    return clusters.groupBy(by).agg(
        F.count(F.lit(1)).alias("cluster_count"), F.round(F.avg(F.when(F.contains("template", F.lit("<VAR:")), 1.0).otherwise(0.0)), 6).alias("slot_rate"),
        F.round(F.sum(F.when(F.col("selected_schema") != "NoFit", F.col("event_count")).otherwise(0)) / F.sum("event_count"), 6).alias("fit_rate"),
    )


def hint_agreement(clusters: DataFrame, hints: DataFrame, by: str) -> DataFrame:
    """(by, by_cluster, by_event): agreement of the selected schema with the corpus' hint."""
    agree = F.col("selected_schema") == F.col("hint")
    return clusters.join(hints, by).groupBy(by).agg(F.round(F.avg(agree.cast("double")), 6).alias("by_cluster"), F.round(F.sum(F.when(agree, F.col("event_count")).otherwise(0)) / F.sum("event_count"), 6).alias("by_event"))


def case_violations(cases: DataFrame, slots: DataFrame, gold_sem: DataFrame, gold_field: DataFrame) -> DataFrame:
    """(case_id, rule, detail): repeated ids, locators without a slot, fields without a semantic, content where none is allowed."""
    twice = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("case_id", F.lit("repeated_case").alias("rule"), F.col("n").cast("string").alias("detail"))
    no_slot = gold_sem.join(slots.select("case_id", "locator").distinct(), ["case_id", "locator"], "left_anti").select("case_id", F.lit("unknown_slot").alias("rule"), F.col("locator").alias("detail"))
    no_sem = gold_field.join(gold_sem.select("case_id", "locator").distinct(), ["case_id", "locator"], "left_anti").select("case_id", F.lit("no_semantic").alias("rule"), F.col("locator").alias("detail"))
    none = cases.where("disposition = 'mapped' AND schema_name IS NULL").select("case_id", F.lit("mapped_without_schema").alias("rule"), F.lit("").alias("detail"))
    some = gold_field.join(cases.where("disposition <> 'mapped'").select("case_id"), "case_id", "left_semi").select("case_id", F.lit("fields_though_not_mapped").alias("rule"), F.col("field").alias("detail"))
    return twice.unionByName(no_slot).unionByName(no_sem).unionByName(none).unionByName(some)


def constant_violations(cases: DataFrame, gold_sem: DataFrame) -> DataFrame:
    """(case_id, rule, detail): template constants whose ordered words the template of cases(case_id, template) does not hold."""
    said = lambda c: F.concat(F.lit(" "), F.array_join(ordered_tokens(F.col(c)), " "), F.lit(" "))
    met = gold_sem.where("kind = 'template_constant'").join(cases.select("case_id", said("template").alias("said")), "case_id")
    return met.where(~F.contains("said", said("locator"))).select("case_id", F.lit("constant_not_in_template").alias("rule"), F.col("locator").alias("detail"))


class Comparison(NamedTuple):
    """Tables with an ``approach`` column, from one metric pass over all approaches."""

    scores: DataFrame
    intervals: DataFrame
    tests: DataFrame
    curve: DataFrame
    warnings: DataFrame
    violations: DataFrame


def compare(cases: DataFrame, pred_case: DataFrame, fields: DataFrame, schemas: DataFrame, gold_field: DataFrame, gold_schema: DataFrame, references: DataFrame, baseline: str | None = None, resamples: int = 1000, split: bool = True, oracle: str = "none", view: str = "full") -> Comparison:
    """Compares any number of approaches on the same cases.

    cases(case_id, grp, revision, system, label_source), pred_case(approach, version, case_id, revision, disposition),
    fields(approach, case_id, kind, locator, field, constant_value, score), schemas(approach, case_id, rank,
    schema_name, score), gold_field(case_id, kind, locator, field, constant_value), gold_schema(case_id, schema_name),
    references(case_id). Every approach is tested against one baseline, by default the first prior of the registry that is
    compared, and references must not be evaluated cases. A baseline that is not compared is an error.
    """
    found = {r.approach for r in pred_case.select("approach").distinct().collect()}  # a handful
    approaches = [a for a in registry.REGISTRY if a in found] + sorted(found - set(registry.REGISTRY))
    priors = registry.priors(approaches)
    baseline = baseline or registry.default_baseline(approaches)
    if baseline not in approaches:
        raise ValueError(f"baseline {baseline} is not among the compared approaches")
    asked = pred_case.select("approach", "case_id").distinct()
    scored = written(metrics.set_scores(asked, gold_field, fields, ["kind", "locator", "field", "constant_value"]))
    totals = metrics.micro_macro(scored)
    groups = written(stats.group_sums(scored.join(cases.select("case_id", "grp"), "case_id"), "grp"))
    tests = stats.paired_permutation(groups, baseline, resamples).withColumn("baseline", F.lit(baseline))
    confident = stats.case_confidence(asked, pred_case, fields, schemas).join(scored.select("approach", "case_id", (1 - F.col("f1")).alias("loss")), ["approach", "case_id"])
    curve = stats.risk_coverage(confident, "confidence", "loss", "approach", "case_id")
    warnings = stats.warning_rows(groups, tests).unionByName(stats.evaluation_warnings(cases, pred_case, totals, priors, split, oracle, view))
    guards = metrics.coverage_violations(cases, pred_case)
    shared = references.join(cases.select("case_id"), "case_id", "left_semi").select(F.lit("case-retrieval").alias("approach"), F.lit("reference_is_evaluated").alias("rule"), F.col("case_id").cast("string").alias("detail"))
    ranks = metrics.schema_ranks(asked, gold_schema.withColumn("disposition", F.lit("mapped")), schemas)
    return Comparison(totals.join(ranks, "approach", "left").join(stats.risk_area(curve, "approach"), "approach", "left"), stats.group_bootstrap(groups, resamples), tests, curve, warnings, guards.unionByName(shared))


def compare_named(names: list[str], requests: registry.Requests, references: registry.References, cases: DataFrame, gold_field: DataFrame, gold_schema: DataFrame, **options) -> Comparison:
    """``compare`` of registered approaches: each is run on the requests, its best field of every locator is scored."""
    run = registry.predict_all(names, requests, references)
    top = run.fields.where("rank = 1").withColumnRenamed("source_kind", "kind").drop("rank")
    return compare(cases, run.cases.drop("oracle"), top, run.schemas, gold_field, gold_schema, references.cases.select("case_id"), oracle=requests.oracle, **options)
