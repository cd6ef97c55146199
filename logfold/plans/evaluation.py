"""Queries over an evaluation derived from the documents table: cases are documents, groups are sources, three approaches
with errors placed by arithmetic. The derived tables are one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.functions import vocab
from logfold.functions.sql import sql_list, sql_map
from logfold.operators import govern, metrics, parse, perturb, stats
from logfold.plans import logs, mapping

_AP = "(VALUES ('a1', 4), ('a2', 7), ('a3', 100)) AS ap(approach, k)"
_IDX = "(VALUES (0), (1), (2), (3)) AS idx(i)"
_ROLE = "CASE (case_id + i{shift}) % 3 WHEN 0 THEN 'network.source.address' WHEN 1 THEN 'network.destination.port' ELSE 'identity.actor.user' END"
_DOC = "(SELECT doc_id AS case_id, lang, source, n_chars FROM {documents}) d"
TABLES = {
    "cases": f"SELECT approach, case_id FROM {_DOC} CROSS JOIN {_AP}",
    "gold_case": f"SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'unresolved' ELSE 'mapped' END AS disposition, CASE WHEN case_id % 11 <> 0 THEN lang END AS schema_name FROM {_DOC}",
    "gold_field": f"SELECT case_id, 'slot' AS kind, concat('p', i) AS locator, concat('F', (case_id * 7 + i) % 5) AS field, CASE WHEN i = 2 THEN 'Success' END AS constant_value FROM {_DOC} CROSS JOIN {_IDX} WHERE i < case_id % 4 AND case_id % 11 <> 0",
    "pred_field": f"""SELECT approach, case_id, 'slot' AS kind, concat(CASE WHEN case_id % 2 = 0 THEN 'P' ELSE 'p' END, i) AS locator, concat('F', (case_id * 7 + i + CASE WHEN case_id % k = 1 THEN 1 ELSE 0 END) % 5) AS field, CASE WHEN i = 2 AND case_id % k = 3 THEN 'Failure' WHEN i = 2 THEN 'Success' END AS constant_value, CAST(1 AS DOUBLE) / (1 + case_id % 3) AS score
 FROM {_DOC} CROSS JOIN {_AP} CROSS JOIN {_IDX} WHERE i < (case_id + CASE WHEN case_id % k = 2 THEN 1 ELSE 0 END) % 4""",
    "asked": f"SELECT approach, case_id, CASE WHEN approach = 'a2' AND case_id % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN case_id % 47 = 0 THEN 'r0' ELSE 'r1' END AS revision FROM {_DOC} CROSS JOIN {_AP} CROSS JOIN (VALUES (0), (1)) AS tw(t) WHERE case_id % 41 <> 0 AND (t = 0 OR case_id % 43 = 0)",
    "gold_sem": f"SELECT case_id, 'slot' AS kind, concat('p', i) AS locator, {_ROLE.format(shift='')} AS role FROM {_DOC} CROSS JOIN {_IDX} WHERE i < case_id % 4 AND case_id % 11 <> 0",
    "cand": f"""SELECT approach, case_id, 'slot' AS kind, concat('p', i) AS locator, 1 AS prediction, r AS rank, concat('F', (case_id * 7 + i + r - 1 + CASE WHEN case_id % k = 1 THEN 1 ELSE 0 END) % 5) AS field, CAST(1 AS DOUBLE) / r AS score
 FROM {_DOC} CROSS JOIN {_AP} CROSS JOIN {_IDX} CROSS JOIN (VALUES (1), (2), (3)) AS rk(r) WHERE i < (case_id + CASE WHEN case_id % k = 2 THEN 1 ELSE 0 END) % 4""",
    "pred_sem": f"SELECT approach, case_id, 'slot' AS kind, concat('P', i) AS locator, CASE WHEN case_id % 2 = 0 THEN upper({_ROLE.format(shift=' + CASE WHEN case_id % k = 1 THEN 1 ELSE 0 END')}) ELSE {_ROLE.format(shift=' + CASE WHEN case_id % k = 1 THEN 1 ELSE 0 END')} END AS role FROM {_DOC} CROSS JOIN {_AP} CROSS JOIN {_IDX} WHERE i < (case_id + CASE WHEN case_id % k = 2 THEN 1 ELSE 0 END) % 4",
    "pred_schema": f"SELECT approach, case_id, r AS rank, CASE WHEN (r = 1) = (case_id % k <> 1) THEN lang ELSE 'xx' END AS schema_name FROM {_DOC} CROSS JOIN {_AP} CROSS JOIN (VALUES (1), (2)) AS rk(r)",
    "entries": f"SELECT case_id, source AS group_id, CASE WHEN source = 'src3' AND case_id % 2 = 0 THEN 'test' WHEN length(source) % 2 = 0 THEN 'train' ELSE 'dev' END AS partition FROM {_DOC} WHERE case_id % 50 <> 7",
}


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return [spark.sql(TABLES[n], documents=docs) for n in names]


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n].replace('{documents}', 'documents')})" for n in names)


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"(CASE WHEN {tp} + {fp} + {fn} = 0 THEN 1.0 WHEN {tp} = 0 THEN 0.0 ELSE 2 * (CAST({tp} AS DOUBLE) / ({tp} + {fp})) * (CAST({tp} AS DOUBLE) / ({tp} + {fn})) / (CAST({tp} AS DOUBLE) / ({tp} + {fp}) + CAST({tp} AS DOUBLE) / ({tp} + {fn})) END)"


def _scores_sql(gold_t: str, pred: str, keys: str) -> str:
    return f"""w AS (SELECT DISTINCT c.approach, case_id, {keys}, 1 AS g FROM cases c JOIN {gold_t} USING (case_id)), p AS (SELECT DISTINCT approach, case_id, {keys}, 1 AS p FROM {pred}),
 j AS (SELECT approach, case_id, g, p FROM w FULL JOIN p USING (approach, case_id, {keys})),
 c0 AS (SELECT approach, case_id, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY ALL),
 c1 AS (SELECT approach, case_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM cases LEFT JOIN c0 USING (approach, case_id)),
 cs AS (SELECT *, round({_f1('tp', 'fp', 'fn')}, 6) AS f1 FROM c1)"""


_MICRO = f"""SELECT approach, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fp), 6) AS precision, round(CAST(sum(tp) AS DOUBLE) / sum(tp + fn), 6) AS recall, round({_f1('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) AS f1, round(avg(f1), 6) AS macro_f1 FROM cs GROUP BY approach"""
_TOP = "(SELECT * FROM cand WHERE rank = 1)"


def _field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, gold, pred = _t(spark, sf_dir, "cases", "gold_field", "pred_field")
    return metrics.set_scores(cases, gold, pred, ["kind", "locator", "field", "constant_value"])


def _constant(k: str) -> str:
    """JSON constants of every type, by a number from 0 to 7, in SQL that both engines read alike."""
    return f"CASE {k} WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '\"1\"' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN '2.5' WHEN 6 THEN '\"true\"' END"


_CONSTANT_OF = {"gold_field": "case_id % 8", "pred_field": "(case_id + case_id % 5) % 8"}


def met_typed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field scores with typed constants: 1, 1.0 and true are one value, "1" and "true" are strings, null and none are no value."""
    cases, gold, pred = _t(spark, sf_dir, "cases", "gold_field", "pred_field")
    typed = lambda df, name: df.withColumn("constant_value", F.try_parse_json(F.expr(_constant(_CONSTANT_OF[name]))))
    return metrics.set_scores(cases, typed(gold, "gold_field"), typed(pred, "pred_field"), ["kind", "locator", "field", "constant_value"])


def met_family_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field F1 of each approach over all cases and over those of each source, in one pass."""
    family = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("case_id"), F.col("source").alias("family"))
    return metrics.micro_macro_by_family(_field_scores(spark, sf_dir).join(family, "case_id"), "family")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("case_id"), stats.group_key("source", "lang", F.lit(None)).alias("grp"))
    return _field_scores(spark, sf_dir).join(source, "case_id")


def met_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _field_scores(spark, sf_dir)


def met_field_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro_macro(_field_scores(spark, sf_dir))


def met_source_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, gold, pred = _t(spark, sf_dir, "cases", "gold_sem", "pred_sem")
    return metrics.micro_macro(metrics.set_scores(cases, gold, pred, ["kind", "locator", "role"]))


def met_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.facet_scores(*_t(spark, sf_dir, "cases", "gold_sem", "pred_sem"))


def met_schema_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.schema_ranks(*_t(spark, sf_dir, "cases", "gold_case", "pred_schema"))


def met_field_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.field_ranks(*_t(spark, sf_dir, "cases", "gold_case", "gold_field", "cand"))


def met_recall_at_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at_gold(*_t(spark, sf_dir, "cases", "gold_field", "cand"))


def met_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") % 3).alias("part"), (F.col("vec_id") * 7 % 5 + F.col("label")).alias("pred"), "label")
    return metrics.pair_metrics(vectors, "pred", "label", ("part",))


def met_template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_metrics(logs.mined(spark, sf_dir)[1].withColumn("one", F.lit("svc")), "cluster_id", "event_type", ("one",))


def met_baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs.groupBy(F.col("source").alias("corpus_id"), F.col("lang").alias("approach")).agg(F.round(F.avg("n_chars"), 6).alias("value")).withColumn("metric", F.lit("length")).withColumn("fingerprint", F.lit("f1"))
    was = docs.where("doc_id % 2 = 0").groupBy(F.col("source").alias("corpus_id"), F.col("lang").alias("approach")).agg(F.round(F.avg("n_chars"), 6).alias("value")).withColumn("metric", F.lit("length")).withColumn("fingerprint", F.when(F.col("corpus_id") == "src1", "f0").otherwise("f1"))
    return metrics.baseline_delta(now, was).select("corpus_id", "approach", "value", "baseline_delta")


def sta_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_sums(_grouped(spark, sf_dir), "grp").select("approach", "grp", "g", "tp", "fp", "fn", F.round("f1_sum", 6).alias("f1_sum"), "n")


def sta_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample_adequacy(stats.group_sums(_grouped(spark, sf_dir), "grp"))


def sta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_bootstrap(stats.group_sums(_grouped(spark, sf_dir), "grp"))


def sta_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_permutation(stats.group_sums(_grouped(spark, sf_dir), "grp"), "a3")


def sta_detectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.detectable_effect(_grouped(spark, sf_dir), "a3", "grp")


def sta_risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = labels.select(F.lit("q").alias("approach"), "doc_id", (F.col("doc_id") * 37 % 101).cast("double").alias("conf"), F.col("quality").cast("double").alias("loss"))
    return stats.risk_coverage(scored, "conf", "loss", "approach", "doc_id")


def sta_risk_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.risk_area(sta_risk_coverage(spark, sf_dir), "approach")


def sta_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, gold_case, pred, schemas = _t(spark, sf_dir, "cases", "gold_case", "pred_field", "pred_schema")
    pred_case = cases.join(gold_case.select("case_id", "disposition"), "case_id")
    return stats.case_confidence(cases, pred_case, pred, schemas.withColumn("score", 1 / (F.col("rank") + F.col("case_id") % 2))).withColumn("confidence", F.round("confidence", 6))


def met_facet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, gold, pred = _t(spark, sf_dir, "cases", "gold_sem", "pred_sem")
    return metrics.facet_summary(metrics.facet_scores(cases, gold, pred), pred)


def met_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_case, asked = _t(spark, sf_dir, "gold_case", "asked")
    return metrics.coverage_violations(gold_case.where("case_id % 53 <> 0").select("case_id", F.lit("r1").alias("revision")), asked)


def spl_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_case, entries = _t(spark, sf_dir, "gold_case", "entries")
    declared = spark.createDataFrame([("train", 1), ("none", 0), ("gone", 5)], "partition string, n long")
    return govern.split_contract(gold_case.select("case_id", F.lit("r1").alias("revision")), entries.withColumn("revision", F.when(F.col("case_id") % 61 == 0, "r0").otherwise("r1")), declared)


def val_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cand,) = _t(spark, sf_dir, "cand")
    broken = cand.withColumn("score", F.when((F.col("case_id") % 13 == 0) & (F.col("rank") == 2), 2.0).otherwise(F.col("score"))).where("NOT (case_id % 17 = 0 AND rank = 1)")
    return govern.prediction_violations(broken)


def spl_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, entries = _t(spark, sf_dir, "gold_case", "entries")
    return govern.split_violations(cases.where("case_id % 31 <> 4"), entries)


def spl_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    (entries,) = _t(spark, sf_dir, "entries")
    moved = entries.withColumn("partition", F.when(F.col("case_id") % 23 == 0, "moved").otherwise(F.col("partition"))).where("case_id % 29 <> 1")
    return govern.frozen_changes(entries, moved)


def spl_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, entries = _t(spark, sf_dir, "gold_case", "entries")
    evaluation, reference = govern.select_split(cases, entries, "dev")
    return evaluation.withColumn("side", F.lit("evaluation")).unionByName(reference.withColumn("side", F.lit("reference"))).select("case_id", "side")


def ann_blinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("cluster_id"), F.col("source").alias("source_file"))
    return govern.blinded(docs)


_DECISIONS = "SELECT conv_id * 100 + turn AS decision_id, conv_id AS case_id, CASE WHEN turn % 4 = 3 THEN 'adjudication' ELSE 'annotation' END AS kind, role AS reviewer, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'old' ELSE 'now' END AS input_fingerprint FROM {conversations}"


def ann_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    decisions = spark.sql(_DECISIONS, conversations=turns)
    return govern.promote(turns.select(F.col("conv_id").alias("case_id"), F.lit("now").alias("input_fingerprint")).distinct(), decisions, allow_single=True).fillna(-1, ["decision_id"])


def ann_adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = spark.sql(_DECISIONS, conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    own = decisions.where("kind = 'adjudication'").select("decision_id")
    sources = own.select("decision_id", F.explode(F.array(F.col("decision_id") - 1, F.col("decision_id") - 2, F.when(F.col("decision_id") % 5 == 0, F.col("decision_id") + 50).otherwise(F.col("decision_id") - 1))).alias("ref")).distinct()
    return govern.adjudication_violations(decisions, sources)


def red_governing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.element_at(F.array(*map(F.lit, govern.CLASSES[::-1])), (F.length("lang") + F.col("doc_id") % 3).cast("int") - 1).alias("redistribution"))
    return govern.governing_class(docs, "source")


def _per_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.cases(spark, sf_dir).withColumn("constants", F.split(F.lit("connection allowed denied login failed succeeded"), " "))


def per_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _per_cases(spark, sf_dir)
    parts = [perturb.perturb(cases, n).select("case_id", "template") for n in ("abbreviated", "uppercase", "decoy-slot", "swapped-direction")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def per_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.perturb(_per_cases(spark, sf_dir), "compound").select("case_id", "template")


def per_opaque_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.opaque_labels(mapping.requests(spark, sf_dir)[1]).select("case_id", "slot_id", "label")


def per_decoy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of every case with the decoy's text behind them."""
    assigned = logs.mined(spark, sf_dir)[1]
    place = F.row_number().over(W.partitionBy("case_id").orderBy("ord")) - 1
    events = assigned.select(F.concat("cluster_id", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("case_id"), "ord", "text").withColumn("i", place).where("i < 3")
    return perturb.with_decoy(mapping.requests(spark, sf_dir)[1], events)[1].select("case_id", "i", "text")


def per_swapped_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.swap_roles(mapping.gold(spark, mapping.cases(spark, sf_dir))[1])


def per_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    (cand,) = _t(spark, sf_dir, "cand")
    variants = cand.where("rank = 1").crossJoin(spark.createDataFrame([("uppercase", 6), ("decoy-slot", 9)], "perturbation string, m int"))
    variants = variants.withColumn("field", F.when(F.col("case_id") % F.col("m") == 0, "F9").otherwise(F.col("field")))
    return perturb.robustness(cand.where("rank = 1"), variants)


def per_robustness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and perturbed F1, stability and verdict of three perturbations of the derived predictions."""
    cases, gold, cand = _t(spark, sf_dir, "cases", "gold_field", "cand")
    top = cand.where("rank = 1").select("approach", "case_id", "kind", "locator", "field")
    kinds = spark.createDataFrame([("uppercase", 6), ("decoy-slot", 1 << 40), ("swapped-direction", 9)], "perturbation string, m long")
    variants = top.crossJoin(kinds).withColumn("field", F.when(F.col("case_id") % F.col("m") == 5, "F9").otherwise(F.col("field"))).withColumn("approach", F.concat_ws("|", "approach", "perturbation"))  # three kinds
    keys = ["kind", "locator", "field"]
    base = metrics.micro_macro(metrics.set_scores(cases, gold, top, keys)).select("approach", "f1")
    varied = cases.crossJoin(kinds.select("perturbation")).select(F.concat_ws("|", "approach", "perturbation").alias("approach"), "case_id")
    parts = F.split("approach", r"\|")
    split = lambda df: df.withColumn("perturbation", parts[1]).withColumn("approach", parts[0])
    after = split(metrics.micro_macro(metrics.set_scores(varied, gold, variants, keys)).select("approach", "f1"))
    return perturb.robustness_rows(base, after, perturb.robustness(top, split(variants.drop("perturbation"))))


_SPECS = [("view", "NetworkSession", [("p1", "SrcIpAddr", "string"), ("p3", "DstPortNumber", "int")]), ("error", "Authentication", [("p1", "TargetUsername", "string"), ("p2", "SrcIpAddr", "string")]), ("purchase", "AuditEvent", [("p1", "ActorUsername", "string"), ("p2", "PolicyName", "string")])]


def _specs(spark: SparkSession, sf_dir: str):
    clusters, assigned = logs.mined(spark, sf_dir)
    kinds = assigned.groupBy("cluster_id").agg(F.min("event_type").alias("event_type"))
    status = F.when(F.col("event_type").isin(*(e for e, *_ in _SPECS)), "approved").when(F.col("event_type") == "click", "rejected").otherwise("needs_work")
    schema = F.when(F.col("event_type") == "view", "NetworkSession").when(F.col("event_type") == "error", "Authentication").otherwise("AuditEvent")
    reviews = kinds.select("cluster_id", status.alias("status"), schema.alias("schema_name"), F.lit("v").alias("vendor"), F.lit("p").alias("product"))
    table = spark.createDataFrame([(e, *m) for e, _, ms in _SPECS for m in ms], "event_type string, slot_id string, field string, transform string")
    return assigned, parse.build_parser_specs(clusters, reviews, kinds.join(table, "event_type").drop("event_type"))


def par_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, (specs, _, _) = _specs(spark, sf_dir)
    return parse.normalize_events(assigned, specs, {"SrcIpAddr": "string", "DstPortNumber": "int", "TargetUsername": "string", "ActorUsername": "string", "PolicyName": "string"}).fillna(-1, ["DstPortNumber"])


_DECLARED = {"NetworkSession": {"SrcIpAddr": "string", "DstPortNumber": "int"}, "Authentication": {"TargetUsername": "string", "SrcIpAddr": "string"}, "AuditEvent": {"ActorUsername": "string", "PolicyName": "string"}}


def par_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the schema whose table takes it and the values that go there, or the reason why none does."""
    assigned, (specs, _, _) = _specs(spark, sf_dir)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return parse.routed(assigned, specs, _DECLARED).select("ord", "EventSchema", F.coalesce(shown, F.lit("")).alias("shown"), "reason")


def par_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir)[1][1]


QUERIES = [
    met_case_scores, met_typed_scores, met_family_f1, met_field_f1, met_source_f1, met_facets, met_schema_ranks, met_field_ranks, met_recall_at_gold, met_pairs, met_template_pairs, met_baseline_delta, sta_groups, sta_adequacy, sta_bootstrap, sta_permutation, sta_detectable,
    sta_risk_coverage, sta_risk_area, sta_confidence, met_facet_summary, met_guards, spl_contract, val_predictions, spl_violations, spl_frozen, spl_selected, ann_blinded, ann_promotion, ann_adjudications, red_governing,
    per_variants, per_compound, per_opaque_labels, per_decoy_events, per_swapped_roles, per_robustness, per_robustness_rows, par_normalized, par_routed, par_skipped,
]

def _typed_sql(name: str, columns: str) -> str:
    key = "CASE json_type(j) WHEN 'NULL' THEN chr(0) WHEN 'VARCHAR' THEN 's:' || (j ->> '$') WHEN 'BOOLEAN' THEN CASE j ->> '$' WHEN 'true' THEN 'n:1' ELSE 'n:0' END ELSE 'n:' || CASE WHEN CAST(j AS DOUBLE) = floor(CAST(j AS DOUBLE)) THEN CAST(CAST(CAST(j AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(j AS DOUBLE) AS VARCHAR) END END"
    return f"(SELECT {columns}, coalesce({key}, chr(0)) AS constant_value FROM (SELECT *, CAST({_constant(_CONSTANT_OF[name])} AS JSON) AS j FROM {name}))"


_CS = f"{_with('cases', 'gold_field', 'pred_field')}, {_scores_sql('(SELECT case_id, kind, locator, field, coalesce(constant_value, chr(0)) AS constant_value FROM gold_field)', '(SELECT approach, case_id, kind, lower(locator) AS locator, field, coalesce(constant_value, chr(0)) AS constant_value FROM pred_field)', 'kind, locator, field, constant_value')}"
LOW_SEM = "(SELECT approach, case_id, kind, lower(locator) AS locator, lower(role) AS role FROM pred_sem)"
_GRP = f"""{_CS}, gr0 AS (SELECT approach, regexp_replace(lower(source || ':' || lang || ':'), ':+$', '') AS grp, cs.* EXCLUDE (approach) FROM cs JOIN documents ON doc_id = case_id),
 gr AS (SELECT approach, grp, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, sum(f1) AS f1_sum, count(*) AS n, CAST(row_number() OVER (PARTITION BY approach ORDER BY grp) - 1 AS INTEGER) AS g FROM gr0 GROUP BY approach, grp)"""
_DRAW = "CAST(('0x' || substr(md5('s:' || b || ':' || {i}), 1, 8)) AS BIGINT)"
_TYPED = sql_map({k: [v] for k, v in vocab.ROLE_WORDS.items()})


def _facet_sql() -> str:
    toks = f"list_transform(string_split(role, '.'), lambda x: coalesce({_TYPED}[x][1], x))"
    pick = lambda v: f"list_filter(t, lambda x: list_contains({sql_list(v)}, x))[1]"
    value = {"domain": f"coalesce({pick(vocab.DOMAINS)}, 'other')", "relation": f"coalesce({pick(vocab.RELATIONS)}, 'unknown')", "entity": f"coalesce({pick(vocab.ENTITIES)}, {sql_map({k: [v] for k, v in vocab.IMPLIED_ENTITY.items()})}[{pick(vocab.DOMAINS)}][1], 'other')", "property": f"coalesce({pick(vocab.PROPERTIES)}, 'other')"}
    long = lambda src, ids: " UNION ".join(f"SELECT {ids}, kind, locator, '{f}' AS facet, {v} AS value FROM (SELECT *, {toks} AS t FROM {src})" for f, v in value.items())
    return f"""{_with('cases', 'gold_sem', 'pred_sem')}, gl AS ({long('gold_sem', 'case_id')}), pl AS ({long(LOW_SEM, 'approach, case_id')}), w AS (SELECT approach, case_id, kind, locator, facet, value, 1 AS g FROM cases JOIN gl USING (case_id)), p AS (SELECT *, 1 AS p FROM pl),
 j AS (SELECT approach, facet, g, p FROM w FULL JOIN p USING (approach, case_id, kind, locator, facet, value)), c AS (SELECT approach, facet, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY ALL)
 SELECT approach, facet, round({_f1('tp', 'fp', 'fn')}, 6) AS f1 FROM c"""


def _pairs_sql(source: str, by: str, pred: str, gold_c: str) -> str:
    return f"""src AS ({source}), cell AS (SELECT {by}, {pred} AS a, {gold_c} AS b, count(*) AS n FROM src GROUP BY ALL), x AS (SELECT {by}, sum(n * (n - 1) / 2.0) AS v FROM cell GROUP BY {by}), y AS (SELECT {by}, sum(n * (n - 1) / 2.0) AS v FROM (SELECT {by}, a, sum(n) AS n FROM cell GROUP BY {by}, a) GROUP BY {by}),
 z AS (SELECT {by}, sum(n * (n - 1) / 2.0) AS v FROM (SELECT {by}, b, sum(n) AS n FROM cell GROUP BY {by}, b) GROUP BY {by}), u AS (SELECT {by}, CAST(sum(m) AS DOUBLE) / sum(n) AS purity FROM (SELECT {by}, a, max(n) AS m, sum(n) AS n FROM cell GROUP BY {by}, a) GROUP BY {by}), q AS (SELECT {by}, x.v / y.v AS p, x.v / z.v AS r, purity FROM x JOIN y USING ({by}) JOIN z USING ({by}) JOIN u USING ({by}))
 SELECT {by}, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(purity, 6) AS purity FROM q"""


_DEC = "dec AS (" + _DECISIONS.replace("{conversations}", "conversations") + ")"
_SHORT = sql_map({k: [v] for k, v in perturb.SHORT.items()})
_SWAP = sql_map({"from": ["to"], "to": ["from"], "source": ["destination"], "destination": ["source"], "src": ["dst"], "dst": ["src"]})
_WORDS = "string_split_regex(template, '\\s+')"
_PERW = lambda change: f"array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN regexp_matches(w, '^<[^>]+>$') THEN w ELSE {change} END), ' ')"
ORACLE = {
    "met_case_scores": f"{_CS} SELECT * FROM cs",
    "met_field_f1": f"{_CS} {_MICRO}",
    "met_source_f1": f"{_with('cases', 'gold_sem', 'pred_sem')}, {_scores_sql('gold_sem', LOW_SEM, 'kind, locator, role')} {_MICRO}",
    "met_facets": _facet_sql(),
    "met_schema_ranks": f"{_with('cases', 'gold_case', 'pred_schema')}, h AS (SELECT c.approach, p.rank FROM cases c JOIN gold_case g USING (case_id) LEFT JOIN (SELECT approach, case_id, schema_name, min(rank) AS rank FROM pred_schema GROUP BY ALL) p ON p.approach = c.approach AND p.case_id = c.case_id AND p.schema_name = g.schema_name WHERE disposition = 'mapped') SELECT approach, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM h GROUP BY 1",
    "met_field_ranks": f"""{_with('cases', 'gold_case', 'gold_field', 'cand')}, m AS (SELECT approach, case_id, kind, locator, field, row_number() OVER (PARTITION BY approach, case_id, kind, locator ORDER BY max(score) DESC, field) AS place, min(rank) AS rank FROM cand GROUP BY approach, case_id, kind, locator, field),
 h AS (SELECT c.approach, place, rank FROM cases c JOIN gold_field USING (case_id) LEFT JOIN m USING (approach, case_id, kind, locator, field)) SELECT approach, round(avg(coalesce(1.0 / place, 0.0)), 6) AS field_mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5 FROM h GROUP BY 1""",
    "met_recall_at_gold": f"""{_with('cases', 'gold_field', 'cand')}, s AS (SELECT case_id, count(*) AS m FROM gold_field GROUP BY 1), b AS (SELECT approach, case_id, kind, locator, field, row_number() OVER (PARTITION BY approach, case_id ORDER BY score DESC, kind, locator, field) AS place FROM cand WHERE rank = 1),
 h AS (SELECT b.approach, b.case_id, sum(CASE WHEN place <= m AND g.case_id IS NOT NULL THEN 1 ELSE 0 END) AS h FROM b LEFT JOIN s USING (case_id) LEFT JOIN gold_field g ON g.case_id = b.case_id AND g.locator = b.locator AND g.field = b.field GROUP BY 1, 2)
 SELECT approach, case_id, round(CASE WHEN m IS NULL THEN CASE WHEN h IS NULL THEN 1.0 ELSE 0.0 END ELSE CAST(coalesce(h, 0) AS DOUBLE) / m END, 6) AS recall FROM cases LEFT JOIN s USING (case_id) LEFT JOIN h USING (approach, case_id)""",
    "met_pairs": "WITH " + _pairs_sql("SELECT vec_id % 3 AS part, vec_id * 7 % 5 + label AS pred, label FROM embeddings", "part", "pred", "label"),
    "met_family_f1": f"""{_CS} SELECT * FROM (SELECT approach, source AS family, grouping(source) = 1 AS whole, count(*) AS n, CASE WHEN sum(tp + fp) = 0 THEN 0.0 ELSE round(CAST(sum(tp) AS DOUBLE) / sum(tp + fp), 6) END AS precision, CASE WHEN sum(tp + fn) = 0 THEN 0.0 ELSE round(CAST(sum(tp) AS DOUBLE) / sum(tp + fn), 6) END AS recall, round({_f1('sum(tp)', 'sum(fp)', 'sum(fn)')}, 6) AS f1, round(avg(f1), 6) AS macro_f1
 FROM cs JOIN documents ON doc_id = case_id GROUP BY GROUPING SETS ((approach, source), (approach))) WHERE whole OR family IS NOT NULL""",
    "met_typed_scores": f"{_with('cases', 'gold_field', 'pred_field')}, {_scores_sql(_typed_sql('gold_field', 'case_id, kind, locator, field'), _typed_sql('pred_field', 'approach, case_id, kind, lower(locator) AS locator, field'), 'kind, locator, field, constant_value')} SELECT * FROM cs",
    "met_template_pairs": f"WITH {logs.ASSIGNED_CTE}, " + _pairs_sql("SELECT 'svc' AS one, cluster_id, event_type FROM a", "one", "cluster_id", "event_type"),
    "met_baseline_delta": "WITH n AS (SELECT source AS corpus_id, lang AS approach, round(avg(n_chars), 6) AS value FROM documents GROUP BY ALL), w AS (SELECT source AS corpus_id, lang AS approach, round(avg(n_chars), 6) AS was FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY ALL) SELECT corpus_id, approach, value, round(value - was, 6) AS baseline_delta FROM n LEFT JOIN w USING (corpus_id, approach)",
    "sta_groups": f"{_GRP} SELECT approach, grp, g, tp, fp, fn, round(f1_sum, 6) AS f1_sum, n FROM gr",
    "sta_adequacy": f"{_GRP} SELECT approach, count(*) AS groups, round(least(1.0, 1.4 / sqrt(count(*))), 6) AS detectable FROM gr GROUP BY 1",
    "sta_bootstrap": f"""{_GRP}, sz AS (SELECT approach, count(*) AS gs FROM gr GROUP BY 1), dr AS (SELECT approach, b, {_DRAW.format(i='i')} % gs AS g FROM sz, range(0, 1000) t(b), range(0, 1000) u(i) WHERE i < gs),
 sm AS (SELECT approach, b, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(f1_sum) / sum(n) AS macro FROM dr JOIN gr USING (approach, g) GROUP BY 1, 2), v AS (SELECT approach, {_f1('tp', 'fp', 'fn')} AS micro, macro FROM sm)
 SELECT approach, round(quantile_cont(micro, 0.025), 6) AS micro_low, round(quantile_cont(micro, 0.975), 6) AS micro_high, round(quantile_cont(macro, 0.025), 6) AS macro_low, round(quantile_cont(macro, 0.975), 6) AS macro_high FROM v GROUP BY 1""",
    "sta_permutation": f"""{_GRP}, pr AS (SELECT x.approach, x.g, x.tp, x.fp, x.fn, y.tp AS btp, y.fp AS bfp, y.fn AS bfn FROM gr x JOIN gr y USING (grp) WHERE x.approach <> 'a3' AND y.approach = 'a3'), sw AS (SELECT *, b > 0 AND {_DRAW.format(i='g')} % 2 = 1 AS s FROM pr, range(0, 1001) t(b)),
 sm AS (SELECT approach, b, sum(CASE WHEN s THEN btp ELSE tp END) AS tp, sum(CASE WHEN s THEN bfp ELSE fp END) AS fp, sum(CASE WHEN s THEN bfn ELSE fn END) AS fn, sum(CASE WHEN s THEN tp ELSE btp END) AS xtp, sum(CASE WHEN s THEN fp ELSE bfp END) AS xfp, sum(CASE WHEN s THEN fn ELSE bfn END) AS xfn FROM sw GROUP BY 1, 2),
 dl AS (SELECT approach, b, {_f1('tp', 'fp', 'fn')} - {_f1('xtp', 'xfp', 'xfn')} AS delta FROM sm), ob AS (SELECT approach, delta AS observed FROM dl WHERE b = 0), ex AS (SELECT approach, observed, sum(CASE WHEN abs(delta) >= abs(observed) - 1e-12 THEN 1 ELSE 0 END) AS e FROM dl JOIN ob USING (approach) WHERE b > 0 GROUP BY 1, 2)
 SELECT approach, round(observed, 6) AS delta, round((e + 1) / 1001.0, 6) AS p_value, (e + 1) / 1001.0 < 0.05 AS significant FROM ex""",
    "sta_detectable": f"{_GRP}, m AS (SELECT x.approach, x.grp, avg(y.f1 - x.f1) AS d FROM gr0 x JOIN gr0 y USING (case_id) WHERE x.approach <> 'a3' AND y.approach = 'a3' GROUP BY 1, 2) SELECT approach, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE 2.8 * stddev_samp(d) / sqrt(count(*)) END, 6) AS mde FROM m GROUP BY 1",
    "sta_risk_coverage": "WITH s AS (SELECT doc_id, doc_id * 37 % 101 AS conf, CAST(quality AS DOUBLE) AS loss FROM labels) SELECT 'q' AS approach, doc_id, round(CAST(row_number() OVER w AS DOUBLE) / count(*) OVER (), 6) AS coverage, round(sum(loss) OVER w / row_number() OVER w, 6) AS risk FROM s WINDOW w AS (ORDER BY conf DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "sta_risk_area": "WITH s AS (SELECT doc_id, doc_id * 37 % 101 AS conf, CAST(quality AS DOUBLE) AS loss FROM labels), c AS (SELECT round(sum(loss) OVER w / row_number() OVER w, 6) AS risk FROM s WINDOW w AS (ORDER BY conf DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT 'q' AS approach, round(avg(risk), 6) AS area FROM c",
    "sta_confidence": f"""{_with('cases', 'gold_case', 'pred_field')}, m AS (SELECT approach, case_id, avg(score) AS f FROM pred_field GROUP BY ALL)
 SELECT c.approach, c.case_id, round(coalesce(CASE WHEN disposition = 'mapped' THEN f / (1 + c.case_id % 2) END, 0.0), 6) AS confidence FROM cases c JOIN gold_case USING (case_id) LEFT JOIN m ON m.approach = c.approach AND m.case_id = c.case_id""",
    "met_facet_summary": f"SELECT approach, ((2 * sum(CAST(round(f1 * 1000000) AS BIGINT)) + count(*)) // (2 * count(*))) / 1000000 AS facet_f1, 0.0 AS unregistered_rate FROM ({_facet_sql()}) GROUP BY 1",
    "met_guards": f"""{_with('gold_case', 'asked')}, c AS (SELECT case_id FROM gold_case WHERE case_id % 53 <> 0), ap AS (SELECT DISTINCT approach FROM asked)
 SELECT approach, 'no_prediction' AS rule, CAST(case_id AS VARCHAR) AS detail FROM ap, c WHERE case_id % 41 = 0 UNION ALL SELECT approach, 'unknown_case', CAST(case_id AS VARCHAR) FROM asked WHERE case_id % 53 = 0
 UNION ALL SELECT approach, 'repeated_prediction', CAST(case_id AS VARCHAR) FROM asked GROUP BY approach, case_id HAVING count(*) > 1 UNION ALL SELECT approach, 'several_versions', CAST(count(DISTINCT version) AS VARCHAR) FROM asked GROUP BY approach HAVING count(DISTINCT version) > 1
 UNION ALL SELECT approach, 'other_revision', CAST(case_id AS VARCHAR) FROM asked JOIN c USING (case_id) WHERE revision <> 'r1'""",
    "spl_contract": f"""{_with('entries')}, e AS (SELECT *, CASE WHEN case_id % 61 = 0 THEN 'r0' ELSE 'r1' END AS revision FROM entries), n AS (SELECT partition, count(*) AS k FROM e GROUP BY 1), d AS (SELECT * FROM (VALUES ('train', 1), ('none', 0), ('gone', 5)) t(partition, n))
 SELECT '' AS id, 'several_revisions' AS rule, '2' AS detail WHERE (SELECT count(DISTINCT revision) FROM e) > 1 UNION ALL SELECT CAST(case_id AS VARCHAR), 'other_revision', 'r1' FROM e WHERE revision = 'r0' UNION ALL SELECT partition, 'partition_count', CAST(coalesce(k, 0) AS VARCHAR) FROM d FULL JOIN n USING (partition) WHERE n IS DISTINCT FROM k""",
    "per_compound": rf"""WITH {mapping.CASES_CTE}, w AS (SELECT case_id, list_filter(string_split_regex(template, '\s+'), lambda w: w <> '') AS ws FROM cases),
 g AS (SELECT *, list_transform(ws, lambda w: regexp_matches(w, '{perturb.PLACEHOLDER}')) AS slot, list_transform(ws, lambda w: NOT regexp_matches(w, '{perturb.PLACEHOLDER}') AND lower(w) NOT IN ('connection', 'allowed', 'denied', 'login', 'failed', 'succeeded')) AS plain FROM w),
 s AS (SELECT *, list_transform(range(1, len(ws) + 1), lambda i: coalesce(plain[i] AND plain[i + 1] AND slot[i + 2], false)) AS first FROM g),
 o AS (SELECT case_id || '.compound' AS case_id, array_to_string(ws, ' ') AS before, array_to_string(list_filter(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN first[i] THEN lower(ws[i]) || upper(ws[i + 1][1:1]) || lower(ws[i + 1][2:]) WHEN i > 1 AND first[i - 1] THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL), ' ') AS template FROM s)
 SELECT case_id, template FROM o WHERE template <> before""",
    "per_opaque_labels": f"WITH {mapping.CASES_CTE} SELECT case_id || '.opaque-labels' AS case_id, slot_id, 'f' || pos AS label FROM cases JOIN sl USING (cluster_id)",
    "per_decoy_events": f"""WITH {mapping.CASES_CTE}, e AS (SELECT cluster_id || '/' || (user_id % 20) AS case_id, text, CAST(row_number() OVER (PARTITION BY cluster_id, user_id % 20 ORDER BY ord) - 1 AS INTEGER) AS i FROM a) SELECT case_id || '.decoy-slot' AS case_id, i, text || ' correlation id ' || (4815 + i) AS text FROM e WHERE i < 3""",
    "per_robustness_rows": f"""{_with('cases', 'gold_field', 'cand')}, k AS (SELECT * FROM (VALUES ('uppercase', 6), ('decoy-slot', 1099511627776), ('swapped-direction', 9)) t(perturbation, m)), tp AS (SELECT approach, case_id, kind, locator, field FROM cand WHERE rank = 1),
 v AS (SELECT approach, perturbation, case_id, kind, locator, CASE WHEN case_id % m = 5 THEN 'F9' ELSE field END AS field FROM tp, k), gb AS (SELECT DISTINCT approach, case_id, kind, locator, field, 1 AS g FROM cases JOIN gold_field USING (case_id)), gv AS (SELECT gb.*, perturbation FROM gb, k),
 bj AS (SELECT approach, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM gb FULL JOIN (SELECT DISTINCT *, 1 AS p FROM tp) USING (approach, case_id, kind, locator, field) GROUP BY 1),
 vj AS (SELECT approach, perturbation, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM gv FULL JOIN (SELECT DISTINCT *, 1 AS p FROM v) USING (approach, perturbation, case_id, kind, locator, field) GROUP BY 1, 2),
 st AS (SELECT approach, perturbation, count(DISTINCT case_id) AS n, round(1 - CAST(count(DISTINCT CASE WHEN case_id % m = 5 THEN case_id END) AS DOUBLE) / count(DISTINCT case_id), 6) AS stable FROM tp, k GROUP BY 1, 2),
 r AS (SELECT approach, perturbation, n, stable, round({_f1('bj.tp', 'bj.fp', 'bj.fn')}, 6) AS base_f1, round({_f1('vj.tp', 'vj.fp', 'vj.fn')}, 6) AS perturbed_f1 FROM st JOIN bj USING (approach) JOIN vj USING (approach, perturbation))
 SELECT approach, perturbation, CASE perturbation WHEN 'swapped-direction' THEN 'label-changing' ELSE 'label-preserving' END AS family, n, base_f1, perturbed_f1, round(perturbed_f1 - base_f1, 6) AS delta, stable, perturbed_f1 >= base_f1 AND CASE perturbation WHEN 'swapped-direction' THEN stable < 1 ELSE stable = 1 END AS passed FROM r""",
    "val_predictions": f"""{_with('cand')}, b AS (SELECT approach || '/' || case_id || '/' || locator AS id, rank, field, CASE WHEN case_id % 13 = 0 AND rank = 2 THEN 2.0 ELSE score END AS score FROM cand WHERE NOT (case_id % 17 = 0 AND rank = 1)), l AS (SELECT *, lag(score) OVER (PARTITION BY id ORDER BY rank) AS before FROM b)
 SELECT id, 'scores_rise' AS rule, CAST(rank AS VARCHAR) AS detail FROM l WHERE score > before UNION ALL SELECT id, 'field_repeats', field FROM b GROUP BY id, field HAVING count(*) > 1 UNION ALL SELECT id, 'rank_gap', CAST(max(rank) AS VARCHAR) FROM b GROUP BY id HAVING max(rank) <> count(*)""",
    "spl_violations": f"""{_with('gold_case', 'entries')}, c AS (SELECT case_id FROM gold_case WHERE case_id % 31 <> 4) SELECT group_id AS id, 'leak' AS rule, CAST(count(DISTINCT partition) AS VARCHAR) AS detail FROM entries GROUP BY 1 HAVING count(DISTINCT partition) > 1
 UNION ALL SELECT CAST(case_id AS VARCHAR), 'not_split', '' FROM c WHERE case_id NOT IN (SELECT case_id FROM entries) UNION ALL SELECT CAST(case_id AS VARCHAR), 'unknown_case', '' FROM entries WHERE case_id NOT IN (SELECT case_id FROM c)""",
    "spl_frozen": f"{_with('entries')} SELECT case_id, group_id || '/' || partition AS was, CASE WHEN case_id % 29 = 1 THEN NULL WHEN case_id % 23 = 0 THEN group_id || '/moved' END AS now FROM entries WHERE case_id % 29 = 1 OR case_id % 23 = 0",
    "spl_selected": f"{_with('gold_case', 'entries')} SELECT case_id, CASE partition WHEN 'dev' THEN 'evaluation' ELSE 'reference' END AS side FROM gold_case JOIN entries USING (case_id) WHERE partition IN ('dev', 'train')",
    "ann_blinded": "SELECT doc_id, lang AS cluster_id, printf('source-%03d', dense_rank() OVER (PARTITION BY lang ORDER BY source)) AS source_file FROM documents",
    "ann_promotion": f"""WITH {_DEC}, f AS (SELECT * FROM dec WHERE input_fingerprint = 'now'), p AS (SELECT case_id, min(decision_id) FILTER (kind = 'adjudication') AS adj, min(decision_id) FILTER (kind = 'annotation') AS ann, count(DISTINCT reviewer) FILTER (kind = 'annotation') AS r FROM f GROUP BY 1)
 SELECT case_id, CASE WHEN adj IS NOT NULL THEN 'promoted' WHEN ann IS NULL THEN 'unsubmitted' WHEN r = 1 THEN 'promoted_single' ELSE 'awaiting_adjudication' END AS outcome, coalesce(CASE WHEN adj IS NOT NULL THEN adj WHEN r = 1 THEN ann END, -1) AS decision_id FROM (SELECT DISTINCT conv_id AS case_id FROM conversations) LEFT JOIN p USING (case_id)""",
    "ann_adjudications": f"""WITH {_DEC}, a AS (SELECT * FROM dec WHERE kind = 'adjudication'), s AS (SELECT DISTINCT decision_id, case_id, ref FROM (SELECT decision_id, case_id, unnest([decision_id - 1, decision_id - 2, CASE WHEN decision_id % 5 = 0 THEN decision_id + 50 ELSE decision_id - 1 END]) AS ref FROM a)),
 m AS (SELECT s.*, d.kind AS k, d.case_id AS rc, d.reviewer AS rr FROM s LEFT JOIN dec d ON d.decision_id = s.ref) SELECT CAST(decision_id AS VARCHAR) AS id, 'unknown_reference' AS rule, CAST(ref AS VARCHAR) AS detail FROM m WHERE k IS NULL UNION ALL SELECT CAST(decision_id AS VARCHAR), 'not_an_annotation_of_the_case', CAST(ref AS VARCHAR) FROM m WHERE k <> 'annotation' OR rc <> case_id
 UNION ALL SELECT CAST(decision_id AS VARCHAR), 'fewer_than_two_reviewers', CAST(count(DISTINCT rr) AS VARCHAR) FROM m GROUP BY decision_id HAVING count(DISTINCT rr) < 2 UNION ALL SELECT CAST(case_id AS VARCHAR), 'adjudicated_twice', CAST(count(*) AS VARCHAR) FROM a GROUP BY case_id HAVING count(*) > 1""",
    "red_governing": "WITH d AS (SELECT source, ['content', 'derived', 'metrics', 'none'][length(lang) + doc_id % 3 - 1] AS c, doc_id FROM documents), r AS (SELECT source, min(list_position(['none', 'metrics', 'derived', 'content'], c)) AS r FROM d GROUP BY 1) SELECT source, ['none', 'metrics', 'derived', 'content'][r] AS redistribution FROM r",
    "per_variants": f"""WITH {mapping.CASES_CTE}, v AS (SELECT case_id || '.abbreviated' AS case_id, template, {_PERW(f"CASE WHEN lower(w) IN ('connection', 'allowed', 'denied', 'login', 'failed', 'succeeded') THEN w ELSE coalesce({_SHORT}[lower(w)][1], w) END")} AS t FROM cases
 UNION ALL SELECT case_id || '.uppercase', template, {_PERW('upper(w)')} FROM cases UNION ALL SELECT case_id || '.decoy-slot', template, CASE WHEN contains(template, '<VAR:') THEN template || ' correlation id <VAR:NUMBER>' ELSE template END FROM cases UNION ALL SELECT case_id || '.swapped-direction', template, {_PERW(f'coalesce({_SWAP}[lower(w)][1], w)')} FROM cases)
 SELECT case_id, t AS template FROM v WHERE t <> template""",
    "per_swapped_roles": f"""WITH {mapping.CASES_CTE}, {mapping.GOLD_CTE} SELECT case_id, slot_id, CASE role WHEN 'network.source.address' THEN 'network.destination.address' WHEN 'network.destination.address' THEN 'network.source.address' ELSE role END AS role, CASE field WHEN 'SrcIpAddr' THEN 'DstIpAddr' WHEN 'DstIpAddr' THEN 'SrcIpAddr' ELSE field END AS field FROM gf JOIN cases USING (case_id) WHERE event_type IN ('view', 'click')""",
    "per_robustness": f"""{_with('cand')}, s AS (SELECT approach, case_id, list(DISTINCT locator || '|' || field ORDER BY locator || '|' || field) AS s FROM cand WHERE rank = 1 GROUP BY 1, 2), v AS (SELECT approach, case_id, perturbation, list(DISTINCT locator || '|' || f ORDER BY locator || '|' || f) AS v FROM (SELECT *, CASE WHEN case_id % m = 0 THEN 'F9' ELSE field END AS f FROM cand, (VALUES ('uppercase', 6), ('decoy-slot', 9)) t(perturbation, m) WHERE rank = 1) GROUP BY ALL)
 SELECT approach, perturbation, count(*) AS n, round(avg(CASE WHEN s = v THEN 1.0 ELSE 0.0 END), 6) AS stable FROM v JOIN s USING (approach, case_id) GROUP BY 1, 2""",
    "par_normalized": f"""WITH {logs.ASSIGNED_CTE}, w AS (SELECT *, string_split(text, ' ')[2:] AS w FROM a WHERE event_type IN ('view', 'error', 'purchase')) SELECT ord, cluster_id, CASE event_type WHEN 'view' THEN 'NetworkSession' WHEN 'error' THEN 'Authentication' ELSE 'AuditEvent' END AS EventSchema, 'v' AS EventVendor, 'p' AS EventProduct,
 CASE event_type WHEN 'view' THEN w[7] WHEN 'error' THEN w[10] END AS SrcIpAddr, CASE event_type WHEN 'view' THEN CAST(w[12] AS INTEGER) ELSE -1 END AS DstPortNumber, CASE event_type WHEN 'error' THEN w[8] END AS TargetUsername,
 CASE event_type WHEN 'purchase' THEN w[5] END AS ActorUsername, CASE event_type WHEN 'purchase' THEN w[8] END AS PolicyName FROM w""",
    "par_routed": f"""WITH {logs.ASSIGNED_CTE}, w AS (SELECT *, string_split(text, ' ')[2:] AS w FROM a) SELECT ord, CASE event_type WHEN 'view' THEN 'NetworkSession' WHEN 'error' THEN 'Authentication' WHEN 'purchase' THEN 'AuditEvent' END AS EventSchema,
 CASE event_type WHEN 'view' THEN 'DstPortNumber=' || w[12] || ',SrcIpAddr=' || w[7] WHEN 'error' THEN 'SrcIpAddr=' || w[10] || ',TargetUsername=' || w[8] WHEN 'purchase' THEN 'ActorUsername=' || w[5] || ',PolicyName=' || w[8] ELSE '' END AS shown,
 CASE WHEN event_type NOT IN ('view', 'error', 'purchase') THEN 'no_parser' END AS reason FROM w""",
    "par_skipped": f"WITH {logs.ASSIGNED_CTE}, k AS (SELECT cluster_id, min(event_type) AS e FROM a GROUP BY 1) SELECT CASE e WHEN 'click' THEN 'rejected' ELSE 'needs_work' END AS reason, count(*) AS n FROM k WHERE e NOT IN ('view', 'error', 'purchase') GROUP BY 1",
}
