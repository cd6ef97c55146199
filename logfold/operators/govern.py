"""Contracts, splits, annotation and redistribution as jobs that report violations instead of stopping at the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CLASSES = ["none", "metrics", "derived", "content"]


def repeated(df: DataFrame, key: str, rule: str) -> DataFrame:
    """(id, rule, detail): ids that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).cast("string").alias("id"), F.lit(rule).alias("rule"), F.col("n").cast("string").alias("detail"))


def unresolved(df: DataFrame, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """(id, rule, detail): references that lead nowhere."""
    return df.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("id"), F.lit(rule).alias("rule"), F.lit("").alias("detail")).distinct()


def require_clean(violations: DataFrame) -> None:
    first = violations.limit(5).collect()
    if first:
        raise ValueError(f"violations: {[tuple(r) for r in first]}")


def prediction_violations(candidates: DataFrame) -> DataFrame:
    """(id, rule, detail): candidate lists whose scores rise, whose fields repeat or whose ranks have gaps."""
    keys = ["approach", "case_id", "locator"]
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    rising = candidates.withColumn("before", F.lag("score").over(W.partitionBy(*keys).orderBy("rank"))).where("score > before").select(name.alias("id"), F.lit("scores_rise").alias("rule"), F.col("rank").cast("string").alias("detail"))
    twice = candidates.groupBy(*keys, "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name.alias("id"), F.lit("field_repeats").alias("rule"), F.col("field").alias("detail"))
    gaps = candidates.groupBy(*keys).agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n")).where("m <> n").select(name.alias("id"), F.lit("rank_gap").alias("rule"), F.col("m").cast("string").alias("detail"))
    return rising.unionByName(twice).unionByName(gaps)


def head_violations(pred_case: DataFrame, pred_schema: DataFrame, pred_field: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, rule, detail): selections that do not head their ranking, contents that a disposition does not allow, repeated keys.

    pred_case(approach, case_id, disposition), pred_schema(approach, case_id, ...), pred_field(approach, case_id, kind,
    locator, field, score), candidates(approach, case_id, kind, locator, rank, field, score).
    """
    keys = ["approach", "case_id", "kind", "locator"]
    case_name = F.concat_ws("/", "approach", F.col("case_id").cast("string"))
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    row = lambda df, i, rule, detail: df.select(i.alias("id"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    top = pred_field.join(candidates.where("rank = 1").select(*keys, F.col("field").alias("top"), F.col("score").alias("top_score")), keys, "left")
    other_head, other_score = row(top.where("NOT field <=> top"), name, "not_the_head", F.col("field")), row(top.where("field = top AND NOT score <=> top_score"), name, "score_not_the_heads", F.col("field"))
    some = lambda df, flag: df.select("approach", "case_id").distinct().withColumn(flag, F.lit(True))
    about = pred_case.join(some(pred_schema, "has_schema"), ["approach", "case_id"], "left").join(some(pred_field, "has_field"), ["approach", "case_id"], "left")
    mapped, aside = about.where("disposition = 'mapped'"), about.where("disposition = 'not_applicable'")
    twice = pred_field.groupBy("approach", "case_id", "kind", F.lower("locator").alias("locator"), "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        other_head.unionByName(other_score).unionByName(row(mapped.where("has_schema IS NULL"), case_name, "mapped_without_schema", F.lit("")))
        .unionByName(row(mapped.where("has_field IS NULL"), case_name, "mapped_without_field", F.lit("")))
        .unionByName(row(aside.where("has_schema OR has_field"), case_name, "content_though_not_applicable", F.lit(""))).unionByName(row(twice, name, "field_key_repeats", F.col("field")))
    )


def leaks(entries: DataFrame) -> DataFrame:
    """(group_id, partitions): groups with cases in more than one partition."""
    return entries.groupBy("group_id").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def split_violations(cases: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, rule, detail): leaking groups, cases without an entry, entries without a case, repeated ids."""
    bad = leaks(entries).select(F.col("group_id").cast("string").alias("id"), F.lit("leak").alias("rule"), F.col("partitions").cast("string").alias("detail"))
    return bad.unionByName(unresolved(cases, "case_id", entries, "case_id", "not_split")).unionByName(unresolved(entries, "case_id", cases, "case_id", "unknown_case")).unionByName(repeated(entries, "case_id", "repeated_entry"))


def split_contract(cases: DataFrame, entries: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, rule, detail): more than one revision, cases of another revision, partitions whose counts are not the declared ones.

    cases(case_id, revision), entries(case_id, partition, revision), expected(partition, n).
    """
    several = entries.agg(F.count_distinct("revision").alias("n")).where("n > 1").select(F.lit("").alias("id"), F.lit("several_revisions").alias("rule"), F.col("n").cast("string").alias("detail"))
    other = cases.join(entries.select("case_id", F.col("revision").alias("split_revision")), "case_id").where("NOT revision <=> split_revision").select(F.col("case_id").cast("string").alias("id"), F.lit("other_revision").alias("rule"), F.col("revision").alias("detail"))
    found = entries.groupBy("partition").agg(F.count(F.lit(1)).alias("found"))
    off = expected.join(found, "partition", "full_outer").where("NOT n <=> found").select(F.col("partition").alias("id"), F.lit("partition_count").alias("rule"), F.coalesce("found", F.lit(0)).cast("string").alias("detail"))
    return several.unionByName(other).unionByName(off)


def frozen_changes(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """(case_id, was, now): cases whose frozen group or partition has changed or gone."""
    now = current.select("case_id", F.concat_ws("/", "group_id", "partition").alias("now"))
    return frozen.select("case_id", F.concat_ws("/", "group_id", "partition").alias("was")).join(now, "case_id", "left").where("NOT was <=> now")


def select_split(cases: DataFrame, entries: DataFrame, partition: str, reference: tuple[str, ...] = ("train",)) -> tuple[DataFrame, DataFrame]:
    if partition in reference:
        raise ValueError("the evaluation partition may not be a reference")
    pick = lambda which: cases.join(entries.where(F.col("partition").isin(*which)).select("case_id"), "case_id", "left_semi")
    return pick([partition]), pick(list(reference))


def blinded(events: DataFrame, by: str = "cluster_id", name: str = "source_file") -> DataFrame:
    """File names per cluster become source-001, source-002, ... by sorted distinct name."""
    place = F.dense_rank().over(W.partitionBy(by).orderBy(name))
    return events.withColumn(name, F.format_string("source-%03d", place))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds a stable sha256 over the named columns in sorted order, nulls included."""
    return df.withColumn("input_fingerprint", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def build_queue(clusters: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks of approved clusters, counts by status with unreviewed, violations)."""
    status = clusters.select("cluster_id").join(reviews.select("cluster_id", "status"), "cluster_id", "left").groupBy(F.coalesce("status", F.lit("unreviewed")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    tasks = clusters.join(reviews.where("status = 'approved'").select("cluster_id").distinct(), "cluster_id", "left_semi")
    return tasks, status, repeated(reviews, "cluster_id", "repeated_review").unionByName(unresolved(reviews, "cluster_id", clusters, "cluster_id", "unknown_cluster"))


def promote(tasks: DataFrame, decisions: DataFrame, allow_single: bool = False) -> DataFrame:
    """(case_id, outcome, decision_id): an adjudication wins; else a single review, if allowed; else why the case waits.

    decisions(decision_id, kind, case_id, input_fingerprint, reviewer); stale ones (another fingerprint) do not count.
    """
    fresh = tasks.select("case_id", "input_fingerprint").join(decisions, ["case_id", "input_fingerprint"])
    per = fresh.groupBy("case_id").agg(
        F.min(F.when(F.col("kind") == "adjudication", F.col("decision_id"))).alias("adjudicated"), F.min(F.when(F.col("kind") == "annotation", F.col("decision_id"))).alias("annotated"),
        F.count_distinct(F.when(F.col("kind") == "annotation", F.col("reviewer"))).alias("reviewers"),
    )
    single = F.lit(allow_single) & (F.col("reviewers") == 1)
    outcome = F.when(F.col("adjudicated").isNotNull(), "promoted").when(F.col("annotated").isNull(), "unsubmitted").when(single, "promoted_single").otherwise("awaiting_adjudication")
    joined = tasks.select("case_id").join(per, "case_id", "left")
    return joined.select("case_id", outcome.alias("outcome"), F.when(F.col("adjudicated").isNotNull(), F.col("adjudicated")).when(single, F.col("annotated")).alias("decision_id"))


def decision_violations(tasks: DataFrame, decisions: DataFrame, labels: DataFrame, fields: DataFrame, revision: str) -> DataFrame:
    """(id, rule, detail) of decisions that must not be promoted.

    tasks(case_id, input_fingerprint, task_revision, catalogue_revision), decisions likewise with decision_id, kind,
    reviewer and schema_name; labels(decision_id, field, constant_value, constant_kind), a kind being string, bool, int
    or real; fields(schema_name, field, type, allowed_values), the effective catalogue.
    """
    row = lambda df, rule, detail: df.select(F.col("decision_id").cast("string").alias("id"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    ours = tasks.select("case_id", F.col("input_fingerprint").alias("own_input"), F.col("task_revision").alias("own_task"))
    met = decisions.join(ours, "case_id", "left")
    lost = row(met.where("own_input IS NULL"), "unknown_case", F.col("case_id"))
    stale = row(met.where("input_fingerprint <> own_input"), "stale_input", F.col("case_id")).unionByName(row(met.where("task_revision <> own_task"), "stale_task", F.col("case_id")))
    old = row(decisions.where(F.col("catalogue_revision") != revision), "other_catalogue", F.col("catalogue_revision"))
    old_tasks = tasks.where(F.col("catalogue_revision") != revision).select(F.col("case_id").cast("string").alias("id"), F.lit("task_of_other_catalogue").alias("rule"), F.col("catalogue_revision").alias("detail"))
    again = decisions.where("kind = 'annotation'").groupBy("case_id", "reviewer").agg(F.count(F.lit(1)).alias("n"), F.min("decision_id").alias("decision_id")).where("n > 1")
    told = labels.join(decisions.select("decision_id", "schema_name"), "decision_id")
    bare = row(told.where("schema_name IS NULL").select("decision_id").distinct(), "fields_without_schema", F.lit(""))
    named = decisions.where("schema_name IS NOT NULL").join(fields.select("schema_name").distinct(), "schema_name", "left_anti")
    catalogue = fields.select("schema_name", "field", F.lower("type").alias("type"), "allowed_values", F.lit(True).alias("known"))
    typed = told.join(fields.select("schema_name").distinct(), "schema_name", "left_semi").join(catalogue, ["schema_name", "field"], "left")
    fits = F.when(F.col("type").isin("string", "datetime", "dynamic"), F.col("constant_kind") == "string").when(F.col("type") == "bool", F.col("constant_kind") == "bool").when(F.col("type").isin("int", "long"), F.col("constant_kind") == "int").when(F.col("type").isin("real", "double"), F.col("constant_kind").isin("int", "real")).otherwise(False)
    constant = typed.where("known AND constant_value IS NOT NULL")
    outside = constant.where(fits & (F.size("allowed_values") > 0) & ~F.array_contains("allowed_values", F.col("constant_value")))
    return (
        lost.unionByName(stale).unionByName(old).unionByName(old_tasks).unionByName(row(again, "annotated_twice", F.col("reviewer"))).unionByName(bare).unionByName(row(named, "unknown_schema", F.col("schema_name")))
        .unionByName(row(typed.where("known IS NULL"), "unknown_field", F.col("field"))).unionByName(row(constant.where(~fits), "constant_type", F.col("field"))).unionByName(row(outside, "constant_not_allowed", F.col("field")))
    )


def artefact_violations(manifest: DataFrame, found: DataFrame, ids: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, rule, detail): promoted tables that are not what their manifest says.

    manifest(artefact, fingerprint, n_rows, revision) and found likewise as computed from the tables; ids(artefact, id)
    and listed(artefact, id), the ids in the tables and in the manifest.
    """
    both = manifest.alias("m").join(found.alias("f"), "artefact", "full_outer")
    off = lambda c: both.where(F.col(f"m.{c}").isNotNull() & F.col(f"f.{c}").isNotNull() & (F.col(f"m.{c}") != F.col(f"f.{c}"))).select(F.col("artefact").alias("id"), F.lit(f"{c}_differs").alias("rule"), F.col(f"f.{c}").cast("string").alias("detail"))
    lone = both.where("m.fingerprint IS NULL OR f.fingerprint IS NULL").select(F.col("artefact").alias("id"), F.when(F.col("m.fingerprint").isNull(), "not_in_manifest").otherwise("missing").alias("rule"), F.lit("").alias("detail"))
    side = lambda a, b, rule: a.join(b, ["artefact", "id"], "left_anti").select(F.col("artefact").alias("id"), F.lit(rule).alias("rule"), F.col("id").cast("string").alias("detail"))
    return off("fingerprint").unionByName(off("n_rows")).unionByName(off("revision")).unionByName(lone).unionByName(side(ids, listed, "id_not_listed")).unionByName(side(listed, ids, "id_missing"))


def adjudication_violations(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, rule, detail): sources(decision_id, ref) must be annotations of the same case by two reviewers or more."""
    adjudicated = decisions.where("kind = 'adjudication'")
    refs = adjudicated.select("decision_id", "case_id").join(sources, "decision_id")
    of = decisions.select(F.col("decision_id").alias("ref"), F.col("kind").alias("ref_kind"), F.col("case_id").alias("ref_case"), F.col("reviewer").alias("ref_reviewer"))
    met = refs.join(of, "ref", "left")
    row = lambda df, rule, detail: df.select(F.col("decision_id").cast("string").alias("id"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    lost = row(met.where("ref_kind IS NULL"), "unknown_reference", F.col("ref"))
    wrong = row(met.where("ref_kind <> 'annotation' OR ref_case <> case_id"), "not_an_annotation_of_the_case", F.col("ref"))
    few = met.groupBy("decision_id").agg(F.count_distinct("ref_reviewer").alias("k")).where("k < 2")
    return lost.unionByName(wrong).unionByName(row(few, "fewer_than_two_reviewers", F.col("k"))).unionByName(repeated(adjudicated, "case_id", "adjudicated_twice"))


def governing_class(corpora: DataFrame, by: str) -> DataFrame:
    """(by, redistribution): the strictest class of a release's corpora; none if it has no class."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("redistribution")), F.lit(1))
    least = corpora.groupBy(by).agg(F.min(rank).alias("r"))
    return least.select(by, F.element_at(F.array(*map(F.lit, CLASSES)), F.col("r").cast("int")).alias("redistribution"))


def redact(rows: DataFrame, redistribution: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be given on, one row with ``withheld``): case rows need class derived or higher; none refuses.

    Nothing is computed here; the count is a job of its own when it is asked for.
    """
    if redistribution == "none":
        raise ValueError("class none may not be redistributed")
    free = CLASSES.index(redistribution) >= CLASSES.index("derived")
    kept, gone = (rows, rows.limit(0)) if free else (rows.limit(0), rows)
    return kept, gone.agg(F.count(F.lit(1)).alias("withheld"))
