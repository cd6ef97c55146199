"""Queries of the joined reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.operators import approaches as registry
from logfold.operators import govern, metrics, reports, robustness, schemas, stats
from logfold.plans import evaluation as ev
from logfold.plans import logs, mapping
from logfold.sources.shared import written

_PRED_CASE = "SELECT approach, case_id, CASE WHEN case_id % k = 3 THEN 'unresolved' ELSE 'mapped' END AS disposition, CASE WHEN case_id % k = 1 THEN 'xx' ELSE lang END AS schema_name FROM (SELECT doc_id AS case_id, lang FROM {documents}) d CROSS JOIN (VALUES ('a1', 4), ('a2', 7), ('a3', 100)) AS ap(approach, k)"


def met_exactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, gold_case, gold_field, gold_sem, cand, pred_sem = ev._t(spark, sf_dir, "cases", "gold_case", "gold_field", "gold_sem", "cand", "pred_sem")
    pred = spark.sql(_PRED_CASE, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    fields = metrics.set_scores(cases, gold_field, cand.where("rank = 1"), ["kind", "locator", "field"])  # without constants
    return reports.exactness(cases, gold_case, pred, fields, metrics.set_scores(cases, gold_sem, pred_sem, ["kind", "locator", "role"]))


def met_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pool_statistics(mapping.map_direct_lexical(spark, sf_dir))


def met_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.format_diagnostics(mapping.build_ranked_templates(spark, sf_dir).withColumn("corpus_id", F.lit("svc")), "corpus_id")


def met_hint_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = mapping.build_ranked_templates(spark, sf_dir).withColumn("corpus_id", F.when(F.contains("template", F.lit("policy")), "audit").otherwise("net"))
    hints = spark.createDataFrame([("audit", "AuditEvent"), ("net", "NetworkSession")], "corpus_id string, hint string")
    return reports.hint_agreement(ranked, hints, "corpus_id")


def val_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold_case, gold_field, gold_sem, cand = ev._t(spark, sf_dir, "gold_case", "gold_field", "gold_sem", "cand")
    slots = cand.where("approach = 'a1'").select("case_id", "locator").distinct()
    broken = gold_case.withColumn("disposition", F.when(F.col("case_id") % 19 == 0, "unresolved").otherwise(F.col("disposition"))).withColumn("schema_name", F.when(F.col("case_id") % 37 == 1, None).otherwise(F.col("schema_name")))
    return reports.case_violations(broken, slots, gold_sem, gold_field)


def ann_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    clusters = turns.select(F.col("conv_id").alias("cluster_id")).distinct()
    reviews = turns.where("turn = 0 AND conv_id % 3 < 2").select(F.col("conv_id").alias("cluster_id"), F.when(F.col("role") == "user", "approved").otherwise("rejected").alias("status"))
    return govern.build_queue(clusters, reviews)[1]


def ann_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    return govern.fingerprint(nation, ["c_custkey", "c_name", "c_nationkey"]).select("c_custkey", "input_fingerprint")


def sta_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stats.group_sums(ev._grouped(spark, sf_dir), "grp")
    return stats.warning_rows(groups, stats.paired_permutation(groups, "a3"), 5000)


def _requests(spark: SparkSession, sf_dir: str) -> tuple[registry.Requests, DataFrame, DataFrame]:
    """(requests of all cases, gold schemas, gold slots)."""
    ready, slots, fields, _ = mapping.requests(spark, sf_dir)
    told, told_slots = mapping.gold(spark, ready)
    _, rankings, picked = mapping._ranked(spark, sf_dir)
    of_cluster = schemas.schema_candidates(rankings, picked, "cluster_id")
    by_score = W.partitionBy("case_id").orderBy(F.desc("score"), "schema_name")
    ranked = ready.select("case_id", "cluster_id").join(of_cluster, "cluster_id").withColumn("rank", F.row_number().over(by_score)).select("case_id", "rank", "schema_name", "score")
    cases = ready.select("case_id", F.lit("r1").alias("revision"), "template", "schema_name", F.concat_ws(" ", "template", "grp").alias("text"), "grp")
    return registry.Requests(cases, slots, mapping._slot_profiles(slots), fields, written(ranked)), told, told_slots


def cmp_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three approaches by name on the slots of all cases."""
    asked, _, told_slots = _requests(spark, sf_dir)
    run = registry.predict_all(["direct-lexical", "semantic-frame", "matcher-ensemble"], asked)
    top = run.fields.where("rank = 1 AND source_kind = 'slot'").select("approach", "case_id", "locator", "field")
    told = told_slots.select("case_id", F.col("slot_id").alias("locator"), "field")
    return metrics.micro_macro(metrics.set_scores(run.cases.select("approach", "case_id"), told, top, ["locator", "field"]))


def map_oracle_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and constants of the semantic frame where gold schemas and gold roles are both told; the rows carry the condition."""
    asked, told, told_slots = _requests(spark, sf_dir)
    told_roles = told_slots.select("case_id", F.col("slot_id").alias("locator"), "role")
    run = registry.predict("semantic-frame", registry.told(asked, "both", told, told_roles))
    return run.semantics.join(run.cases.select("case_id", "oracle"), "case_id").select("case_id", "source_kind", "locator", "role", "oracle")


def _everything(spark: SparkSession, sf_dir: str) -> reports.Comparison:
    """All seven approaches on the groups g0 to g9, with the cases of the other groups as references."""
    asked, told, told_slots = _requests(spark, sf_dir)
    evaluated = F.substring("grp", 2, 9).cast("int") < 10
    chosen, others = asked.cases.where(evaluated), asked.cases.where(~evaluated)
    of = lambda df, some: df.join(some.select("case_id"), "case_id", "left_semi")
    requests = asked._replace(cases=chosen, slots=of(asked.slots, chosen), profiles=of(asked.profiles, chosen), schemas=of(asked.schemas, chosen))
    constants = mapping.told_constants(asked.cases).withColumnRenamed("ref_id", "case_id")
    ref_slots = of(asked.slots, others).select("case_id", "slot_id", "context").join(told_slots.select("case_id", "slot_id", "role", "field", F.lit(None).cast("string").alias("constant_value")), ["case_id", "slot_id"])
    references = registry.References(others.select("case_id", "revision", "text").join(told, "case_id"), ref_slots, of(constants, others))
    gold_field = told_slots.select("case_id", F.lit("slot").alias("kind"), F.col("slot_id").alias("locator"), "field", F.lit(None).cast("string").alias("constant_value")).unionByName(constants.select("case_id", F.lit("template_constant").alias("kind"), "locator", "field", "constant_value"))
    cases = chosen.select("case_id", "grp", F.lit("r1").alias("revision"), F.lit("svc").alias("system"), F.lit("synthetic").alias("label_source"))
    return reports.compare_named(list(registry.REGISTRY), requests, references, cases, of(gold_field, chosen), of(told, chosen))


def cmp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _everything(spark, sf_dir).scores


def cmp_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of every approach, and its test against the null prior."""
    report = _everything(spark, sf_dir)
    return report.intervals.join(report.tests, "approach", "left")


def cmp_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _everything(spark, sf_dir)
    return report.warnings.unionByName(report.violations.select("approach", F.col("rule").alias("code")))


def per_approaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three approaches run on all cases and on all their variants of every perturbation."""
    asked, _, told_slots = _requests(spark, sf_dir)
    constants = mapping.told_constants(asked.cases).withColumnRenamed("ref_id", "case_id")
    labels = told_slots.select("case_id", F.lit("slot").alias("kind"), F.col("slot_id").alias("locator"), "role", "field", F.lit(None).cast("string").alias("constant_value"))
    labels = labels.unionByName(constants.select("case_id", F.lit("template_constant").alias("kind"), "locator", "role", "field", "constant_value"))
    return robustness.run(["direct-lexical", "semantic-frame", "matcher-ensemble"], asked, labels).rows


#: Predictions with selections that are not the head, scores that are not the head's, and keys that repeat in another case.
_PF = """SELECT approach, case_id, kind, CASE WHEN t = 1 THEN upper(locator) ELSE locator END AS locator, CASE WHEN case_id % 13 = 5 THEN 'F9' ELSE field END AS field, CASE WHEN case_id % 17 = 3 THEN score / 2 ELSE score END AS score
 FROM {cand} CROSS JOIN (VALUES (0), (1)) AS tw(t) WHERE rank = 1 AND (t = 0 OR case_id % 29 = 4)"""
_PC = "SELECT approach, case_id, CASE WHEN case_id % 31 = 7 THEN 'not_applicable' WHEN case_id % 5 = 1 THEN 'unresolved' ELSE 'mapped' END AS disposition FROM {cases}"


def val_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, cand, ranked = ev._t(spark, sf_dir, "cases", "cand", "pred_schema")
    return govern.head_violations(spark.sql(_PC, cases=cases), ranked.where("case_id % 23 <> 2"), spark.sql(_PF, cand=cand), cand)


#: Annotation tasks of documents, decisions about them (some stale, some of unknown cases) and their labels.
_TASKS = "SELECT doc_id AS case_id, concat('i', n_chars) AS input_fingerprint, CASE WHEN doc_id % 43 = 1 THEN 't2' ELSE 't1' END AS task_revision, CASE WHEN doc_id % 53 = 0 THEN 'r0' ELSE 'r1' END AS catalogue_revision FROM {documents}"
_VERDICTS = """SELECT doc_id * 2 + t AS decision_id, CASE WHEN doc_id % 7 = 0 THEN 'adjudication' ELSE 'annotation' END AS kind, CASE WHEN doc_id % 61 = 9 THEN -doc_id ELSE doc_id END AS case_id, CASE WHEN doc_id % 37 = 2 THEN 'x' ELSE concat('x', t) END AS reviewer,
 concat('i', n_chars + CASE WHEN doc_id % 47 = 5 THEN 1 ELSE 0 END) AS input_fingerprint, 't1' AS task_revision, CASE WHEN doc_id % 59 = 3 THEN 'r0' ELSE 'r1' END AS catalogue_revision,
 CASE doc_id % 6 WHEN 0 THEN 'Nowhere' WHEN 1 THEN NULL WHEN 2 THEN 'Authentication' ELSE 'NetworkSession' END AS schema_name FROM {documents} CROSS JOIN (VALUES (0), (1)) AS tw(t)"""
_LABELS = """SELECT doc_id * 2 + t AS decision_id, CASE (doc_id + t) % 4 WHEN 0 THEN 'EventResult' WHEN 1 THEN 'DstPortNumber' WHEN 2 THEN 'SrcIpAddr' ELSE 'NoSuchField' END AS field,
 CASE doc_id % 5 WHEN 0 THEN 'Success' WHEN 1 THEN 'success' WHEN 2 THEN '443' ELSE NULL END AS constant_value, CASE doc_id % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'string' WHEN 2 THEN 'int' ELSE NULL END AS constant_kind FROM {documents} CROSS JOIN (VALUES (0), (1)) AS tw(t)"""


def ann_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    tasks, decisions, labels = (spark.sql(x, documents=docs) for x in (_TASKS, _VERDICTS, _LABELS))
    return govern.decision_violations(tasks, decisions, labels, schemas.effective_fields(schemas.default_catalog(spark)), "r1")


#: A promoted table of each source as listed, and as found after rows were lost, one source was lost and one revision moved on.
_LISTED = "SELECT source AS artefact, doc_id AS id, n_chars FROM {documents} WHERE source IS NOT NULL AND source <> 'src2'"
_FOUND = "SELECT source AS artefact, CASE WHEN doc_id % 101 = 3 THEN -doc_id ELSE doc_id END AS id, n_chars FROM {documents} WHERE source IS NOT NULL AND source <> 'src4' AND (source <> 'src1' OR doc_id % 50 <> 7)"
_PRINTED = "SELECT artefact, sha256(concat(count(*), ':', sum(id), ':', sum(n_chars))) AS fingerprint, count(*) AS n_rows, CASE WHEN artefact = '{moved}' THEN 'r2' ELSE 'r1' END AS revision FROM {ids} GROUP BY artefact"


def ann_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    listed, found = (spark.sql(x, documents=docs) for x in (_LISTED, _FOUND))
    printed = lambda ids, moved: spark.sql(_PRINTED.replace("{moved}", moved).replace("sha256(", "sha2(").replace(")) AS fingerprint", "), 256) AS fingerprint"), ids=ids)
    return govern.artefact_violations(printed(listed, "none"), printed(found, "src3"), found.select("artefact", "id"), listed.select("artefact", "id"))


def red_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many case rows each class that may be given on at all lets through and withholds."""
    (cases,) = ev._t(spark, sf_dir, "cases")
    out = None
    for name in govern.CLASSES[1:]:
        kept, withheld = govern.redact(cases, name)
        row = kept.agg(F.count(F.lit(1)).alias("kept")).join(withheld, how="cross").select(F.lit(name).alias("redistribution"), "kept", "withheld")  # single rows
        out = row if out is None else out.unionByName(row)
    return out


def cat_default_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default catalogue's fields that the events' templates can be mapped to, with how many events choose the schema."""
    counts = mapping.build_ranked_templates(spark, sf_dir).groupBy(F.col("selected_schema").alias("schema_name")).agg(F.sum("event_count").alias("events"))
    return schemas.effective_fields(schemas.default_catalog(spark)).join(counts, "schema_name").select("schema_name", "field", "events")


QUERIES = [met_exactness, met_pools, met_diagnostics, met_hint_agreement, val_cases, ann_queue, ann_fingerprints, sta_warnings, cmp_approaches, map_oracle_both, cmp_scores, cmp_tests, cmp_warnings, cat_default_fields, per_approaches, val_heads, ann_decisions, ann_integrity, red_withheld]

_SOURCE = ev._scores_sql("gold_sem", ev.LOW_SEM, "kind, locator, role").replace("cs AS", "ss AS").replace("w AS", "w2 AS").replace("p AS (SELECT DISTINCT", "p2 AS (SELECT DISTINCT").replace("FROM w FULL JOIN p ", "FROM w2 FULL JOIN p2 ").replace("j AS", "j2 AS").replace("FROM j ", "FROM j2 ").replace("c0", "d0").replace("c1", "d1")
_RANKED = mapping.ORACLE["build_ranked_templates"]
ORACLE = {
    "met_exactness": f"""{ev._with('cases', 'gold_case', 'gold_field', 'gold_sem', 'cand', 'pred_sem')}, {ev._scores_sql('gold_field', ev._TOP, 'kind, locator, field')}, {_SOURCE}, pc AS ({_PRED_CASE.replace('{documents}', 'documents')}),
 x AS (SELECT approach, case_id, g.disposition AS gd, g.schema_name AS gs, pc.disposition AS pd, pc.schema_name AS ps, cs.fp + cs.fn AS fd, ss.fp + ss.fn AS sd FROM cases JOIN gold_case g USING (case_id) JOIN pc USING (approach, case_id) JOIN cs USING (approach, case_id) JOIN ss USING (approach, case_id)),
 y AS (SELECT *, ps IS NOT DISTINCT FROM gs AS so, gd = pd AS r, (ps IS NOT DISTINCT FROM gs) AND fd = 0 AND ((gd = 'mapped' AND gs IS NOT NULL) OR gd = pd) AS e FROM x)
 SELECT approach, round(avg(CASE WHEN r THEN 1.0 ELSE 0.0 END), 6) AS disposition_accuracy, round(avg(CASE WHEN pd = 'mapped' THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN e THEN 1.0 ELSE 0.0 END), 6) AS mapping_exact, round(avg(CASE WHEN e AND sd = 0 THEN 1.0 ELSE 0.0 END), 6) AS full_exact, round(avg(CASE WHEN so THEN 0 ELSE 1 END + fd), 6) AS mean_edits FROM y GROUP BY 1""",
    "met_pools": f"SELECT approach, round(avg(1 - CAST(pool_size AS DOUBLE) / considered), 6) AS reduction, round(avg(CASE WHEN tied_with > 0 THEN 1.0 ELSE 0.0 END), 6) AS tie_rate FROM ({mapping.ORACLE['map_direct_lexical']}) WHERE rank = 1 GROUP BY 1",
    "met_diagnostics": f"SELECT 'svc' AS corpus_id, count(*) AS cluster_count, round(avg(CASE WHEN contains(template, '<VAR:') THEN 1.0 ELSE 0.0 END), 6) AS slot_rate, round(CAST(sum(CASE WHEN selected_schema <> 'NoFit' THEN event_count ELSE 0 END) AS DOUBLE) / sum(event_count), 6) AS fit_rate FROM ({_RANKED})",
    "met_hint_agreement": f"WITH x AS (SELECT *, CASE WHEN contains(template, 'policy') THEN 'audit' ELSE 'net' END AS corpus_id FROM ({_RANKED})), y AS (SELECT *, selected_schema = CASE corpus_id WHEN 'audit' THEN 'AuditEvent' ELSE 'NetworkSession' END AS ok FROM x) SELECT corpus_id, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS by_cluster, round(CAST(sum(CASE WHEN ok THEN event_count ELSE 0 END) AS DOUBLE) / sum(event_count), 6) AS by_event FROM y GROUP BY 1",
    "val_cases": f"""{ev._with('gold_case', 'gold_field', 'gold_sem', 'cand')}, b AS (SELECT case_id, CASE WHEN case_id % 19 = 0 THEN 'unresolved' ELSE disposition END AS disposition, CASE WHEN case_id % 37 <> 1 THEN schema_name END AS schema_name FROM gold_case), s AS (SELECT DISTINCT case_id, locator FROM cand WHERE approach = 'a1')
 SELECT case_id, 'unknown_slot' AS rule, locator AS detail FROM gold_sem ANTI JOIN s USING (case_id, locator) UNION ALL SELECT case_id, 'mapped_without_schema', '' FROM b WHERE disposition = 'mapped' AND schema_name IS NULL UNION ALL SELECT case_id, 'fields_though_not_mapped', field FROM gold_field SEMI JOIN (SELECT case_id FROM b WHERE disposition <> 'mapped') USING (case_id)""",
    "ann_queue": "WITH r AS (SELECT conv_id, CASE role WHEN 'user' THEN 'approved' ELSE 'rejected' END AS status FROM conversations WHERE turn = 0 AND conv_id % 3 < 2) SELECT coalesce(status, 'unreviewed') AS status, count(*) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN r USING (conv_id) GROUP BY 1",
    "ann_fingerprints": """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS input_fingerprint FROM customer""",
    "sta_warnings": f"SELECT approach, 'few_cases' AS code FROM ({ev.ORACLE['sta_groups']}) GROUP BY 1 HAVING sum(n) < 5000 UNION ALL SELECT approach, 'single_group' FROM ({ev.ORACLE['sta_groups']}) GROUP BY 1 HAVING count(*) = 1 UNION ALL SELECT approach, 'unresolved_difference' FROM ({ev.ORACLE['sta_permutation']}) WHERE NOT significant AND abs(delta) > 0",
    "map_oracle_both": f"""WITH {mapping.REQUEST_CTE}, {mapping.GOLD_CTE} SELECT case_id, 'slot' AS source_kind, slot_id AS locator, role, 'both' AS oracle FROM gf UNION ALL SELECT case_id, 'template_constant', locator, role, 'both' FROM ({mapping._STATIC_SQL.replace("FROM rc WHERE", "FROM (SELECT r.case_id, r.template, gc.schema_name FROM rc r JOIN gc USING (case_id)) WHERE")})""",
    "cmp_approaches": f"""WITH {mapping.CASES_CTE}, {mapping.GOLD_CTE}, top AS ({" UNION ALL ".join(f"SELECT approach, case_id, locator, field FROM ({mapping.ORACLE[n]}) WHERE rank = 1 AND source_kind = 'slot'" for n in ("map_direct_lexical", "map_semantic_frame", "map_matcher_ensemble"))}),
 w AS (SELECT approach, case_id, slot_id AS locator, field, 1 AS g FROM gf CROSS JOIN (VALUES ('direct-lexical'), ('semantic-frame'), ('matcher-ensemble')) t(approach)), p AS (SELECT DISTINCT *, 1 AS p FROM top), j AS (SELECT approach, case_id, g, p FROM w FULL JOIN p USING (approach, case_id, locator, field)),
 c AS (SELECT approach, case_id, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY ALL), cs AS (SELECT *, round({ev._f1('tp', 'fp', 'fn')}, 6) AS f1 FROM c) {ev._MICRO}""",
    "cat_default_fields": f"WITH {mapping.CATALOG_CTE} SELECT schema_name, field, events FROM ef JOIN (SELECT selected_schema AS schema_name, CAST(sum(event_count) AS BIGINT) AS events FROM ({_RANKED}) GROUP BY 1) USING (schema_name)",
    "val_heads": f"""{ev._with('cases', 'cand', 'pred_schema')}, pc AS ({_PC.replace('{cases}', 'cases')}), pf AS ({_PF.replace('{cand}', 'cand')}), ps AS (SELECT DISTINCT approach, case_id FROM pred_schema WHERE case_id % 23 <> 2), hf AS (SELECT DISTINCT approach, case_id FROM pf),
 h AS (SELECT approach, case_id, kind, locator, field AS top, score AS top_score FROM cand WHERE rank = 1), x AS (SELECT *, approach || '/' || case_id || '/' || kind || '/' || locator AS id FROM pf LEFT JOIN h USING (approach, case_id, kind, locator))
 SELECT id, 'not_the_head' AS rule, field AS detail FROM x WHERE field IS DISTINCT FROM top UNION ALL SELECT id, 'score_not_the_heads', field FROM x WHERE field = top AND score IS DISTINCT FROM top_score
 UNION ALL SELECT approach || '/' || case_id, 'mapped_without_schema', '' FROM pc ANTI JOIN ps USING (approach, case_id) WHERE disposition = 'mapped' UNION ALL SELECT approach || '/' || case_id, 'mapped_without_field', '' FROM pc ANTI JOIN hf USING (approach, case_id) WHERE disposition = 'mapped'
 UNION ALL SELECT approach || '/' || case_id, 'content_though_not_applicable', '' FROM pc SEMI JOIN (SELECT * FROM ps UNION SELECT * FROM hf) USING (approach, case_id) WHERE disposition = 'not_applicable'
 UNION ALL SELECT approach || '/' || case_id || '/' || kind || '/' || lower(locator), 'field_key_repeats', field FROM pf GROUP BY approach, case_id, kind, lower(locator), field HAVING count(*) > 1""",
    "ann_decisions": f"""WITH t AS ({_TASKS.replace('{documents}', 'documents')}), d AS ({_VERDICTS.replace('{documents}', 'documents')}), l AS ({_LABELS.replace('{documents}', 'documents')}), {mapping.CATALOG_CTE}, sn AS (SELECT DISTINCT schema_name FROM ef),
 dt AS (SELECT d.*, t.input_fingerprint AS own_input, t.task_revision AS own_task FROM d LEFT JOIN t USING (case_id)), ld AS (SELECT l.*, d.schema_name FROM l JOIN d USING (decision_id)),
 y AS (SELECT ld.*, ef.field IS NOT NULL AS known, allowed_values, CASE WHEN lower(ef.type) IN ('string', 'datetime', 'dynamic') THEN constant_kind = 'string' WHEN lower(ef.type) = 'bool' THEN constant_kind = 'bool' WHEN lower(ef.type) IN ('int', 'long') THEN constant_kind = 'int' WHEN lower(ef.type) IN ('real', 'double') THEN constant_kind IN ('int', 'real') ELSE false END AS fits
  FROM ld SEMI JOIN sn USING (schema_name) LEFT JOIN ef USING (schema_name, field))
 SELECT CAST(decision_id AS VARCHAR) AS id, 'unknown_case' AS rule, CAST(case_id AS VARCHAR) AS detail FROM dt WHERE own_input IS NULL UNION ALL SELECT CAST(decision_id AS VARCHAR), 'stale_input', CAST(case_id AS VARCHAR) FROM dt WHERE input_fingerprint <> own_input UNION ALL SELECT CAST(decision_id AS VARCHAR), 'stale_task', CAST(case_id AS VARCHAR) FROM dt WHERE task_revision <> own_task
 UNION ALL SELECT CAST(decision_id AS VARCHAR), 'other_catalogue', catalogue_revision FROM d WHERE catalogue_revision <> 'r1' UNION ALL SELECT CAST(case_id AS VARCHAR), 'task_of_other_catalogue', catalogue_revision FROM t WHERE catalogue_revision <> 'r1'
 UNION ALL SELECT CAST(min(decision_id) AS VARCHAR), 'annotated_twice', reviewer FROM d WHERE kind = 'annotation' GROUP BY case_id, reviewer HAVING count(*) > 1 UNION ALL SELECT DISTINCT CAST(decision_id AS VARCHAR), 'fields_without_schema', '' FROM ld WHERE schema_name IS NULL
 UNION ALL SELECT CAST(decision_id AS VARCHAR), 'unknown_schema', schema_name FROM d ANTI JOIN sn USING (schema_name) WHERE schema_name IS NOT NULL UNION ALL SELECT CAST(decision_id AS VARCHAR), 'unknown_field', field FROM y WHERE NOT known
 UNION ALL SELECT CAST(decision_id AS VARCHAR), 'constant_type', field FROM y WHERE known AND constant_value IS NOT NULL AND NOT fits UNION ALL SELECT CAST(decision_id AS VARCHAR), 'constant_not_allowed', field FROM y WHERE known AND constant_value IS NOT NULL AND fits AND len(allowed_values) > 0 AND NOT list_contains(allowed_values, constant_value)""",
    "ann_integrity": f"""WITH li AS ({_LISTED.replace('{documents}', 'documents')}), fo AS ({_FOUND.replace('{documents}', 'documents')}), m AS ({_PRINTED.replace('{moved}', 'none').replace('{ids}', 'li')}), f AS ({_PRINTED.replace('{moved}', 'src3').replace('{ids}', 'fo')}), b AS (SELECT artefact, m.fingerprint AS mf, f.fingerprint AS ff, m.n_rows AS mn, f.n_rows AS fn, m.revision AS mr, f.revision AS fr FROM m FULL JOIN f USING (artefact))
 SELECT artefact AS id, 'fingerprint_differs' AS rule, ff AS detail FROM b WHERE mf <> ff UNION ALL SELECT artefact, 'n_rows_differs', CAST(fn AS VARCHAR) FROM b WHERE mn <> fn UNION ALL SELECT artefact, 'revision_differs', fr FROM b WHERE mr <> fr
 UNION ALL SELECT artefact, CASE WHEN mf IS NULL THEN 'not_in_manifest' ELSE 'missing' END, '' FROM b WHERE mf IS NULL OR ff IS NULL UNION ALL SELECT artefact, 'id_not_listed', CAST(id AS VARCHAR) FROM fo ANTI JOIN li USING (artefact, id) UNION ALL SELECT artefact, 'id_missing', CAST(id AS VARCHAR) FROM li ANTI JOIN fo USING (artefact, id)""",
    "red_withheld": f"{ev._with('cases')} SELECT redistribution, count(*) FILTER (redistribution <> 'metrics') AS kept, count(*) FILTER (redistribution = 'metrics') AS withheld FROM cases CROSS JOIN (VALUES ('metrics'), ('derived'), ('content')) AS c(redistribution) GROUP BY 1",
}
