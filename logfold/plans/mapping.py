"""Queries over cases (template x user group) of the rendered logs: concepts, schemas, profiles, mapping approaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.functions import vocab
from logfold.functions.sql import catalog_values, concept_ctes, has_phrase_expr, sql_list, sql_map
from logfold.operators import concepts, mapping, profiles, schemas, templates
from logfold.plans import logs
from logfold.sources.shared import written

#: Gold labels by event type: schema, then (slot, role, field); constants by phrase.
GOLD = {
    "view": ("NetworkSession", [("p1", "network.source.address", "SrcIpAddr"), ("p2", "network.destination.address", "DstIpAddr"), ("p3", "network.destination.port", "DstPortNumber")]),
    "click": ("NetworkSession", [("p1", "network.source.address", "SrcIpAddr"), ("p2", "network.destination.address", "DstIpAddr"), ("p3", "network.destination.port", "DstPortNumber")]),
    "signup": ("Authentication", [("p1", "identity.target.user", "TargetUsername"), ("p2", "network.source.address", "SrcIpAddr")]),
    "error": ("Authentication", [("p1", "identity.target.user", "TargetUsername"), ("p2", "network.source.address", "SrcIpAddr")]),
    "purchase": ("AuditEvent", [("p1", "identity.actor.user", "ActorUsername"), ("p2", "event.event.action", "PolicyName")]),
}
CASES_CTE = f"{logs.VALUES_CTE}, cases AS (SELECT DISTINCT cluster_id || '/' || (user_id % 20) AS case_id, cluster_id, template, event_type, 'g' || (user_id % 20) AS grp FROM a)"


def cases(spark: SparkSession, sf_dir: str, assigned: DataFrame | None = None) -> DataFrame:
    assigned = logs.mined(spark, sf_dir)[1] if assigned is None else assigned
    group = (F.col("user_id") % 20).cast("string")
    return assigned.select(F.concat("cluster_id", F.lit("/"), group).alias("case_id"), "cluster_id", "template", "event_type", F.concat(F.lit("g"), group).alias("grp")).distinct()


def gold(spark: SparkSession, of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gold_case(case_id, schema_name), gold_slot(case_id, slot_id, role, field))."""
    schema = spark.createDataFrame([(e, s) for e, (s, _) in GOLD.items()], "event_type string, schema_name string")
    slot = spark.createDataFrame([(e, *x) for e, (_, xs) in GOLD.items() for x in xs], "event_type string, slot_id string, role string, field string")
    of = of.select("case_id", "event_type")
    return of.join(schema, "event_type").select("case_id", "schema_name"), of.join(slot, "event_type").select("case_id", "slot_id", "role", "field")


GOLD_CTE = "gs AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{s}')" for e, (s, _) in GOLD.items()) + ") t(event_type, schema_name)), gsl AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{i}', '{r}', '{f}')" for e, (_, xs) in GOLD.items() for i, r, f in xs) + ") t(event_type, slot_id, role, field)), gc AS (SELECT case_id, schema_name FROM cases JOIN gs USING (event_type)), gf AS (SELECT case_id, slot_id, role, field FROM cases JOIN gsl USING (event_type))"


def requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cases with their selected schema, slots with contexts and examples, effective fields, mined clusters)."""
    clusters, assigned = logs.mined(spark, sf_dir)
    examples = templates.slot_values(assigned, clusters=clusters).groupBy("cluster_id", "slot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("examples"))
    slots = templates.extract_slots(clusters).join(examples, ["cluster_id", "slot_id"])
    contexts = concepts.slot_contexts(clusters, slots)
    catalog = schemas.default_catalog(spark)
    names = sorted({r[3] for r in vocab.CATALOG} - {"Common"})
    _, picked = schemas.rank_schemas(clusters, "cluster_id", "template", schemas.schema_concepts(spark, names))
    all_cases = cases(spark, sf_dir, assigned)
    # cases are templates times groups: small tables that every approach reads several times, so they are written once
    ready = written(all_cases.join(picked.select("cluster_id", F.col("selected_schema").alias("schema_name")), "cluster_id"))
    of_cases = written(ready.select("case_id", "cluster_id").join(contexts.drop("template"), "cluster_id"))
    return ready, of_cases, schemas.effective_fields(catalog), clusters


CONTEXT_CTE = rf"""cx0 AS (SELECT s.*, replace(array_to_string(string_split(template, placeholder)[1:occurrence], chr(1)), chr(1), placeholder) AS before, replace(array_to_string(string_split(template, placeholder)[occurrence + 1:], chr(1)), chr(1), placeholder) AS after FROM sl s),
 cx1 AS (SELECT *, list_filter(string_split_regex(before, '\s+'), lambda w: w <> '') AS b, list_filter(string_split_regex(after, '\s+'), lambda w: w <> '')[1:2] AS f, regexp_extract(before, '{concepts.STRUCTURED_KEY.replace("'", "''")}', 1) AS k FROM cx0),
 cx AS (SELECT cluster_id, slot_id, label, CASE WHEN k <> '' THEN k || ' ' || label WHEN lower(b[-1]) IN ('from', 'to', 'client', 'server') THEN b[-1] || ' ' || label WHEN lower(b[-1]) = 'port' THEN array_to_string(list_append(b[-2:], label), ' ')
  ELSE array_to_string(list_concat(list_append(b[-3:], label), f), ' ') END AS context FROM cx1)"""
CATALOG_CTE = f"""cat AS (SELECT * FROM {catalog_values()}), own AS (SELECT * FROM cat WHERE schema_name <> 'Common'),
 ef AS (SELECT schema_name, field, type, class, logical_type, allowed_values, 1 AS common_first FROM own UNION ALL
  SELECT s.schema_name, c.field, c.type, c.class, c.logical_type, c.allowed_values, 0 FROM cat c CROSS JOIN (SELECT DISTINCT schema_name FROM own) s WHERE c.schema_name = 'Common' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.schema_name = s.schema_name AND o.field = c.field))"""
RANK_CTE = concept_ctes("tc", "cl", "cluster_id, template", "template") + ", wanted AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {sql_list(t)})" for s, t in vocab.SCHEMA_CONCEPTS.items()) + """) t(schema_name, w)),
 sc0 AS (SELECT cluster_id, template, schema_name, list_sort(list_intersect(concepts, w)) AS evidence FROM tc CROSS JOIN wanted),
 sc1 AS (SELECT *, CAST(len(evidence) AS INTEGER) AS score FROM sc0),
 sc AS (SELECT *, CASE WHEN sum(score) OVER (PARTITION BY cluster_id) > 0 THEN round(score / sum(score) OVER (PARTITION BY cluster_id), 6) ELSE 0.0 END AS confidence, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, schema_name) AS rank,
  lead(score) OVER (PARTITION BY cluster_id ORDER BY score DESC, schema_name) AS next FROM sc1),
 pick AS (SELECT cluster_id, template, CASE WHEN score > 0 AND next IS DISTINCT FROM score THEN schema_name END AS selected_schema, CASE WHEN score > 0 AND next IS DISTINCT FROM score THEN confidence ELSE 0.0 END AS confidence,
  CASE WHEN score = 0 THEN 'no_evidence' WHEN next = score THEN 'tied_top' END AS reason FROM sc WHERE rank = 1)"""
REQUEST_CTE = f"{CASES_CTE}, {CONTEXT_CTE}, {CATALOG_CTE}, {RANK_CTE}, rc AS (SELECT case_id, cases.cluster_id, cases.template, event_type, grp, selected_schema AS schema_name FROM cases JOIN pick USING (cluster_id))"
FIELD_TERMS = concept_ctes("ft", "(SELECT * FROM ef WHERE class <> 'Alias')", "schema_name, field", "field || ' ' || logical_type")


def pool_ctes(queries: str) -> str:
    """CTEs that rank ``queries``(qid, schema_name, query): pool, then rf(qid, rank, field, score, ...)."""
    return f"""{concept_ctes("qc", queries, "qid, schema_name", "query")}, {FIELD_TERMS},
 pool0 AS (SELECT q.qid, q.schema_name, f.field, len(list_intersect(q.concepts, f.concepts)) AS o, len(f.concepts) AS nf, len(q.concepts) AS nq FROM qc q JOIN ft f USING (schema_name)),
 pool AS (SELECT qid, schema_name, field, 0.35 * (CAST(o AS DOUBLE) / nf) + 0.65 * (CAST(o AS DOUBLE) / nq) AS lexical FROM pool0 WHERE o > 0),
 rf0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lexical DESC, field) AS rank, round(lexical / max(lexical) OVER (PARTITION BY qid), 6) AS score, count(*) OVER (PARTITION BY qid, lexical) - 1 AS tied_with, count(*) OVER (PARTITION BY qid) AS pool_size FROM pool),
 rf AS (SELECT qid, CAST(rank AS INTEGER) AS rank, field, score, CAST(tied_with AS INTEGER) AS tied_with, CAST(pool_size AS INTEGER) AS pool_size, (SELECT CAST(count(*) AS INTEGER) FROM ef WHERE ef.schema_name = rf0.schema_name) AS considered FROM rf0 WHERE rank <= 5)"""


def nrm_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.concept_tokens(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id"], "url")


def nrm_line_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.concept_tokens(logs.rendered(spark, sf_dir), ["ord"], "text").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def nrm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.match_phrases(logs.rendered(spark, sf_dir), ["ord"], "text", [p for p, *_ in mapping.STATIC])


def nrm_slot_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir)[1].select("case_id", "slot_id", "label", "context")


def nrm_role_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = gold(spark, cases(spark, sf_dir))[1].select("case_id", "slot_id", "role")
    return concepts.role_facets(roles).select("case_id", "slot_id", "canonical", "registered", "domain", "relation", "entity", "property", "custom")


def cat_effective_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as schemas: nation names are fields, overriding the common ones of region 0."""
    nation, region = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(F.lit("N"), (F.col("n_nationkey") % 7).cast("string")).alias("field"), F.lit("string").alias("type"), F.lit("Optional").alias("class"), F.when(F.col("r_regionkey") == 0, "Common").otherwise(F.col("r_name")).alias("schema_name")).distinct()
    return schemas.effective_fields(named).select("schema_name", "field", "common_first")


def cat_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = spark.read.parquet(f"{sf_dir}/region.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    return schemas.schema_counts(nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("schema_name")), "AFRICA")


def _ranked(spark: SparkSession, sf_dir: str):
    clusters = logs.mined(spark, sf_dir)[0]
    return clusters, *schemas.rank_schemas(clusters, "cluster_id", "template", schemas.schema_concepts(spark, list(vocab.SCHEMA_CONCEPTS)))


def sch_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)[1].withColumn("evidence", F.array_join("evidence", ","))


def sch_url_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against schemas: mostly without evidence, so abstentions and their reasons are exercised."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.concat_ws(" ", "url", F.element_at(F.array(*map(F.lit, ("session policy", "login", "audit", "flow update"))), (F.col("page_id") % 4 + 1).cast("int")))
    return schemas.rank_schemas(pages.select("page_id", text.alias("t")), "page_id", "t", schemas.schema_concepts(spark, list(vocab.SCHEMA_CONCEPTS)))[1]


def build_ranked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _, picked = _ranked(spark, sf_dir)
    return schemas.enrich(clusters, picked).select("cluster_id", "template", "event_count", "selected_schema", "confidence")


def sch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, rankings, picked = _ranked(spark, sf_dir)
    hints = clusters.where(F.contains("template", F.lit("policy"))).select("cluster_id", F.lit("AuditEvent").alias("schema_name"))
    return schemas.schema_candidates(rankings, picked, "cluster_id", hints)


_PROFILED = [
    ("customer", "c_name"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("pages", "url"), ("events", "event_type"), ("part", "p_type"), ("part", "p_brand"), ("orders", "o_orderpriority"), ("documents", "source"),
    ("orders", "o_orderkey"), ("events", "user_id"), ("lineitem", "l_suppkey"), ("part", "p_size"), ("events", "props"),
]


def prf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(f"{t}.{c}").alias("col"), F.col(c).cast("string").alias("v")) for t, c in _PROFILED]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return profiles.profile_values(rows, ["col"], "v")


def prf_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, assigned = logs.mined(spark, sf_dir)
    return profiles.profile_values(templates.captured(assigned, clusters), ["cluster_id", "slot_id"], "value")


def _profile_sql(source: str, keys: str) -> str:
    shares = ", ".join(f"avg(CASE WHEN regexp_matches(v, '{p}') THEN 1.0 ELSE 0.0 END) AS s_{n}" for n, p in vocab.SHAPES)
    best = "greatest(" + ", ".join(f"s_{n}" for n, _ in vocab.SHAPES) + ")"
    shape = "CASE WHEN " + best + " = 0 THEN 'text' " + " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n, _ in vocab.SHAPES) + " END"
    return rf"""pv AS (SELECT {keys}, regexp_replace(v, '^\s+|\s+$', '', 'g') AS v FROM {source}), pf AS (SELECT * FROM pv WHERE v <> ''),
 pa AS (SELECT {keys}, {shares}, count(*) AS sample_count, count(DISTINCT v) AS distinct_count, CAST(min(length(v)) AS INTEGER) AS min_length, CAST(max(length(v)) AS INTEGER) AS max_length, min(try_cast(v AS DOUBLE)) AS lo, max(try_cast(v AS DOUBLE)) AS hi,
  bool_or(regexp_matches(v, '[A-Za-z\p{{L}}]')) AS has_letters, bool_or(regexp_matches(v, '[0-9]')) AS has_digits, bool_or(regexp_matches(v, '[^\p{{L}}\p{{N}}\s]')) AS has_punctuation FROM pf GROUP BY {keys}),
 pt AS (SELECT *, {shape} AS physical_type, CASE WHEN {best} > 0 THEN round({best}, 6) ELSE 1.0 END AS type_confidence FROM pa),
 ch AS (SELECT {keys}, c, count(*) AS n FROM (SELECT {keys}, unnest(string_split(v, '')) AS c FROM pf) GROUP BY ALL),
 en AS (SELECT {keys}, round(log2(CAST(sum(n) AS DOUBLE)) - sum(n * log2(CAST(n AS DOUBLE))) / sum(n), 6) AS character_entropy FROM ch GROUP BY {keys}),
 pr AS (SELECT {keys}, sample_count, distinct_count, min_length, max_length, has_letters, has_digits, has_punctuation, physical_type, type_confidence, round(CAST(distinct_count AS DOUBLE) / sample_count, 6) AS uniqueness,
  CASE WHEN physical_type IN ('integer', 'float') THEN lo END AS numeric_min, CASE WHEN physical_type IN ('integer', 'float') THEN hi END AS numeric_max, physical_type = 'integer' AND lo >= 0 AND hi <= 65535 AS port_plausible, character_entropy FROM pt JOIN en USING ({keys}))"""


def _slot_profiles(slots: DataFrame) -> DataFrame:
    return profiles.profile_values(slots.select("case_id", "slot_id", F.explode("examples").alias("v")), ["case_id", "slot_id"], "v")


def sig_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, fields, _ = requests(spark, sf_dir)
    pairs = slots.join(_slot_profiles(slots), ["case_id", "slot_id"]).join(ready.select("case_id", "schema_name"), "case_id").join(fields, "schema_name")
    return profiles.match_signals(pairs).select("case_id", "slot_id", "field", F.round("character_ngram", 6).alias("character_ngram"), "type_compatibility", F.round("type_affinity", 6).alias("type_affinity"), "value_enumeration", "range_plausibility")


def map_direct_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, fields, _ = requests(spark, sf_dir)
    return mapping.direct_lexical(ready, slots, fields).drop("constant_value")


def map_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, _, _ = requests(spark, sf_dir)
    return mapping.infer_roles(ready, slots).select("case_id", "slot_id", "role")


def map_semantic_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, fields, _ = requests(spark, sf_dir)
    return mapping.semantic_frame(ready, slots, fields)[0]


def map_oracle_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles told by the gold frames replace the inferred ones."""
    ready, slots, fields, _ = requests(spark, sf_dir)
    told = gold(spark, ready)[1].select("case_id", F.lit("slot").alias("source_kind"), F.col("slot_id").alias("locator"), "role")
    return mapping.semantic_frame(ready, slots, fields, told)[1]


def map_matcher_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, fields, _ = requests(spark, sf_dir)
    return mapping.matcher_ensemble(ready, slots, _slot_profiles(slots), fields).drop("constant_value")


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ready, slots, _, _ = requests(spark, sf_dir)
    about = ready.select("case_id", F.lit("r1").alias("revision"), F.concat_ws(" ", "template", "grp").alias("text"))
    return mapping.neighbours(about, about), ready, slots


def map_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0].withColumn("similarity", F.round("similarity", 9))


def map_url_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("case_id"), F.lit("r1").alias("revision"), F.col("url").alias("text"))
    return mapping.neighbours(pages, pages).withColumn("similarity", F.round("similarity", 9))


def map_schema_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, ready, _ = _near(spark, sf_dir)
    return mapping.schema_votes(near, gold(spark, ready)[0])


def map_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, ready, slots = _near(spark, sf_dir)
    fields = schemas.effective_fields(schemas.default_catalog(spark))
    told = gold(spark, ready)[1].select(F.col("case_id").alias("ref_id"), F.col("slot_id").alias("ref_slot"), "role", "field")
    refs = slots.select(F.col("case_id").alias("ref_id"), F.col("slot_id").alias("ref_slot"), "context").join(told.drop("field"), ["ref_id", "ref_slot"])
    valid = ready.select("case_id", "schema_name").join(fields.select("schema_name", "field"), "schema_name").select("case_id", "field")
    return mapping.transfer_slots(near, slots, refs, told.drop("role"), valid).drop("constant_value")


def map_schema_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = cases(spark, sf_dir)
    return mapping.schema_prior(ready, gold(spark, ready)[0])


def map_field_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, fields, _ = requests(spark, sf_dir)
    told, told_slots = gold(spark, ready)
    return mapping.field_prior(mapping.schema_prior(ready, told), slots, told_slots.select("case_id", "field"), fields)


def map_null_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case_id", F.lit("null-prior").alias("approach"), F.lit("unresolved").alias("disposition"))


def map_context_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, slots, _, _ = requests(spark, sf_dir)
    ready = ready.withColumn("system", F.lit("svc"))
    views = [mapping.context_view(ready, slots, v)[0].select("case_id", F.lit(v).alias("view"), "template", "system") for v in ("v0", "v1", "v2", "v3", "full")]
    return reduce(DataFrame.unionByName, views)


def told_constants(ready: DataFrame) -> DataFrame:
    """(ref_id, i, locator, role, field, constant_value): gold template constants, those of the phrases that a template holds."""
    order = F.array_position(F.array(*(F.lit(" ".join(p)) for p, *_ in mapping.STATIC)), F.col("locator"))
    return mapping.template_constants(ready).select(F.col("case_id").alias("ref_id"), order.alias("i"), "locator", "role", F.lit("EventResult").alias("field"), "constant_value")


def map_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants of the neighbours whose gold schema is the case's, for phrases that the case's template holds."""
    near, ready, _ = _near(spark, sf_dir)
    fields = schemas.effective_fields(schemas.default_catalog(spark))
    same = near.join(ready.select("case_id", "schema_name"), "case_id").join(gold(spark, ready)[0].select(F.col("case_id").alias("ref_id"), "schema_name"), ["ref_id", "schema_name"])
    valid = ready.select("case_id", "schema_name").join(fields.select("schema_name", "field"), "schema_name").select("case_id", "field")
    return mapping.transfer_constants(same, ready, told_constants(ready), valid)[1].select("case_id", "locator", "field", "constant_value")


QUERIES = [
    nrm_concepts, nrm_line_concepts, nrm_phrases, nrm_slot_contexts, nrm_role_facets, cat_effective_fields, cat_schema_counts, sch_rankings, sch_url_rankings, build_ranked_templates, sch_candidates, prf_columns, prf_slots, sig_signals,
    map_direct_lexical, map_roles, map_semantic_frame, map_oracle_frame, map_matcher_ensemble, map_neighbours, map_url_neighbours, map_schema_votes, map_transfer, map_schema_prior, map_field_prior, map_null_prior, map_context_views, map_constants,
]

_LEX_Q = "lq AS (SELECT case_id || '/' || slot_id AS qid, case_id, rc.schema_name, slot_id AS locator, context AS query FROM rc JOIN cx USING (cluster_id) WHERE schema_name IS NOT NULL)"
_ROLE_CTE = f"""{concept_ctes("rx", "cx", "cluster_id, slot_id, label, context", "context")}, {concept_ctes("lx", "cx", "cluster_id, slot_id", "label")},
 ro0 AS (SELECT rx.cluster_id, rx.slot_id, rx.label, rx.concepts AS c, list_has_any(lx.concepts, ['ip', 'address']) AS addr, list_has_any(tc.concepts, ['login', 'logon', 'authentication']) AS login FROM rx JOIN lx USING (cluster_id, slot_id) JOIN tc USING (cluster_id)),
 ro AS (SELECT cluster_id, slot_id, label, CASE WHEN list_contains(c, 'port') THEN CASE WHEN list_contains(c, 'source') THEN 'network.source.port' WHEN list_contains(c, 'destination') THEN 'network.destination.port' END
  WHEN addr AND list_contains(c, 'source') THEN 'network.source.address' WHEN addr AND list_contains(c, 'destination') THEN 'network.destination.address'
  WHEN list_contains(c, 'user') THEN CASE WHEN login THEN 'authentication.target.user' ELSE 'event.actor.user' END END AS role FROM ro0)"""
_STATIC_SQL = " UNION ALL ".join(f"SELECT case_id, schema_name, '{' '.join(p)}' AS locator, '{r}' AS role, '{q}' AS query, '{v}' AS constant_value FROM rc WHERE schema_name IS NOT NULL AND {has_phrase_expr('template', p)}" for p, r, q, v in mapping.STATIC)
_FRAME_Q = f"""fq AS (SELECT case_id || '/' || slot_id AS qid, case_id, schema_name, 'slot' AS source_kind, slot_id AS locator, role || ' ' || label AS query, CAST(NULL AS VARCHAR) AS constant_value, role FROM rc JOIN ro USING (cluster_id) WHERE role IS NOT NULL AND schema_name IS NOT NULL
 UNION ALL SELECT case_id || '/' || locator, case_id, schema_name, 'template_constant', locator, query, constant_value, role FROM ({_STATIC_SQL}))"""
_TRI = lambda c: f"CASE WHEN len({c}) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length(array_to_string(list_sort({c}), ' ')) - 2, 1) + 1), lambda i: substr(array_to_string(list_sort({c}), ' '), i, 3))) END"
_EXAMPLES = "ex AS (SELECT cluster_id, slot_id, list(value ORDER BY rank) AS examples FROM sv GROUP BY ALL), pin AS (SELECT cluster_id, slot_id, unnest(examples) AS v FROM ex)"
_SIGNAL_CTE = f"""{_EXAMPLES}, {_profile_sql("pin", "cluster_id, slot_id")}, {concept_ctes("xc", "cx", "cluster_id, slot_id", "context")}, {concept_ctes("fn", "ef", "schema_name, field, type, logical_type, allowed_values, class", "field")}, {concept_ctes("fl", "ef", "schema_name, field", "logical_type")},
 sg0 AS (SELECT rc.case_id, x.slot_id, f.*, pr.physical_type, pr.port_plausible, pr.numeric_max, ex.examples, {_TRI("x.concepts")} AS gx, {_TRI("f.concepts")} AS gf, list_distinct(list_concat(f.concepts, fl.concepts)) AS terms, coalesce({sql_map(vocab.COMPATIBLE)}[pr.physical_type], []) AS allowed,
  CASE WHEN pr.port_plausible THEN list_append(coalesce({sql_map(vocab.AFFINITY)}[pr.physical_type], []), 'port') ELSE coalesce({sql_map(vocab.AFFINITY)}[pr.physical_type], []) END AS expected
  FROM rc JOIN xc x USING (cluster_id) JOIN fn f ON f.schema_name = rc.schema_name JOIN fl ON fl.schema_name = f.schema_name AND fl.field = f.field JOIN pr ON pr.cluster_id = rc.cluster_id AND pr.slot_id = x.slot_id JOIN ex ON ex.cluster_id = rc.cluster_id AND ex.slot_id = x.slot_id),
 sg AS (SELECT *, CASE WHEN len(gx) = 0 OR len(gf) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(gx, gf)) / (len(gx) + len(gf)) END AS character_ngram, CASE WHEN physical_type = 'text' OR len(allowed) = 0 THEN 0.5 WHEN list_contains(allowed, lower(type)) THEN 1.0 ELSE 0.0 END AS type_compatibility,
  CASE WHEN len(expected) = 0 THEN 0.0 ELSE CAST(len(list_intersect(expected, terms)) AS DOUBLE) / len(expected) END AS type_affinity,
  CASE WHEN len(allowed_values) > 0 AND len(examples) > 0 THEN CAST(len(list_filter(examples, lambda v: list_contains(list_transform(allowed_values, lambda a: lower(a)), lower(trim(v))))) AS DOUBLE) / len(examples) ELSE 0.0 END AS value_enumeration,
  CASE WHEN numeric_max IS NULL OR NOT (lower(logical_type) IN ('port number', 'port') OR list_contains(concepts, 'port')) THEN 0.5 WHEN port_plausible THEN 1.0 ELSE 0.0 END AS range_plausibility FROM sg0)"""
_NEAR_CTE = f"""{concept_ctes("nc", "(SELECT case_id, template || ' ' || grp AS t FROM rc)", "case_id", "t")},
 ne0 AS (SELECT x.case_id, y.case_id AS ref_id, len(list_intersect(x.concepts, y.concepts)) AS c, len(x.concepts) AS n, len(y.concepts) AS m FROM nc x JOIN nc y ON x.case_id <> y.case_id),
 ne AS (SELECT * FROM (SELECT case_id, ref_id, CAST(c AS DOUBLE) / (n + m - c) AS similarity, row_number() OVER (PARTITION BY case_id ORDER BY CAST(c AS DOUBLE) / (n + m - c) DESC, ref_id) AS rank FROM ne0 WHERE c > 0) WHERE rank <= 3)"""
_FACET = lambda values: f"list_filter(t, lambda x: list_contains({sql_list(values)}, x))[1]"
_PRIOR_CTE = "pc AS (SELECT schema_name, count(*) AS n FROM gc GROUP BY 1), pw AS (SELECT o.case_id, pc.schema_name, pc.n - CASE WHEN o.schema_name = pc.schema_name THEN 1 ELSE 0 END AS n FROM gc o CROSS JOIN pc), sp AS (SELECT case_id, schema_name, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY case_id), 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY n DESC, schema_name) AS INTEGER) AS rank FROM pw WHERE n > 0)"
_CAND = "rank, field, score, tied_with, pool_size, considered"
ORACLE = {
    "nrm_concepts": f"WITH {concept_ctes('u', 'pages', 'page_id', 'url')} SELECT page_id, unnest(concepts) AS token FROM u",
    "nrm_line_concepts": f"WITH {logs.EVENTS_CTE}, {concept_ctes('u', 'ev', 'ord', 'text')}, x AS (SELECT unnest(concepts) AS token FROM u) SELECT token, count(*) AS n FROM x GROUP BY 1",
    "nrm_phrases": f"WITH {logs.EVENTS_CTE} " + " UNION ALL ".join(f"SELECT ord, '{' '.join(p)}' AS phrase FROM ev WHERE {has_phrase_expr('text', p)}" for p, *_ in mapping.STATIC),
    "nrm_slot_contexts": f"WITH {REQUEST_CTE} SELECT case_id, slot_id, label, context FROM cases JOIN cx USING (cluster_id)",
    "nrm_role_facets": f"""WITH {CASES_CTE}, {GOLD_CTE}, r AS (SELECT case_id, slot_id, role AS canonical, true AS registered, list_transform(string_split(role, '.'), lambda x: coalesce({sql_map({k: [v] for k, v in vocab.ROLE_WORDS.items()})}[x][1], x)) AS t FROM gf)
 SELECT case_id, slot_id, canonical, registered, coalesce({_FACET(vocab.DOMAINS)}, 'other') AS domain, coalesce({_FACET(vocab.RELATIONS)}, 'unknown') AS relation, coalesce({_FACET(vocab.ENTITIES)}, {sql_map({k: [v] for k, v in vocab.IMPLIED_ENTITY.items()})}[{_FACET(vocab.DOMAINS)}][1], 'other') AS entity, coalesce({_FACET(vocab.PROPERTIES)}, 'other') AS property, CAST(NULL AS VARCHAR) AS custom FROM r""",
    "cat_effective_fields": """WITH n AS (SELECT DISTINCT 'N' || (n_nationkey % 7) AS field, CASE WHEN r_regionkey = 0 THEN 'Common' ELSE r_name END AS schema_name FROM nation JOIN region ON n_regionkey = r_regionkey), own AS (SELECT * FROM n WHERE schema_name <> 'Common')
 SELECT schema_name, field, 1 AS common_first FROM own UNION ALL SELECT s.schema_name, c.field, 0 FROM n c CROSS JOIN (SELECT DISTINCT schema_name FROM own) s WHERE c.schema_name = 'Common' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.schema_name = s.schema_name AND o.field = c.field)""",
    "cat_schema_counts": "SELECT r_name AS schema_name, count(*) AS n_fields FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA' GROUP BY 1",
    "sch_rankings": f"WITH {logs.CLUSTERS_CTE}, {RANK_CTE} SELECT cluster_id, schema_name, score, confidence, CAST(rank AS INTEGER) AS rank, array_to_string(evidence, ',') AS evidence FROM sc",
    "sch_url_rankings": "WITH cl AS (SELECT page_id AS cluster_id, url || ' ' || ['session policy', 'login', 'audit', 'flow update'][page_id % 4 + 1] AS template FROM pages), " + RANK_CTE + " SELECT cluster_id AS page_id, selected_schema, confidence, reason FROM pick",
    "build_ranked_templates": f"WITH {logs.CLUSTERS_CTE}, {RANK_CTE} SELECT cluster_id, cl.template, event_count, coalesce(selected_schema, 'NoFit') AS selected_schema, confidence FROM cl JOIN pick USING (cluster_id)",
    "sch_candidates": f"WITH {logs.CLUSTERS_CTE}, {RANK_CTE} SELECT cluster_id, schema_name, round(score / max(score) OVER (PARTITION BY cluster_id), 6) AS score FROM sc SEMI JOIN (SELECT cluster_id FROM pick WHERE reason IS NULL) USING (cluster_id) WHERE score > 0 AND template NOT LIKE '%policy%' UNION ALL SELECT cluster_id, 'AuditEvent', 1.0 FROM cl WHERE template LIKE '%policy%'",
    "prf_columns": "WITH src AS (" + " UNION ALL ".join(f"SELECT '{t}.{c}' AS col, CAST({c} AS VARCHAR) AS v FROM {t}" for t, c in _PROFILED) + f"), {_profile_sql('src', 'col')} SELECT * FROM pr",
    "prf_slots": f"WITH {logs.VALUES_CTE}, src AS (SELECT cluster_id, slot_id, value AS v FROM cap), {_profile_sql('src', 'cluster_id, slot_id')} SELECT * FROM pr",
    "sig_signals": f"WITH {REQUEST_CTE}, {_SIGNAL_CTE} SELECT case_id, slot_id, field, round(character_ngram, 6) AS character_ngram, type_compatibility, round(type_affinity, 6) AS type_affinity, value_enumeration, range_plausibility FROM sg",
    "map_direct_lexical": f"WITH {REQUEST_CTE}, {_LEX_Q}, {pool_ctes('lq')} SELECT case_id, 'direct-lexical' AS approach, 'slot' AS source_kind, locator, {_CAND} FROM rf JOIN lq USING (qid)",
    "map_roles": f"WITH {REQUEST_CTE}, {_ROLE_CTE} SELECT case_id, slot_id, role FROM rc JOIN ro USING (cluster_id)",
    "map_semantic_frame": f"WITH {REQUEST_CTE}, {_ROLE_CTE}, {_FRAME_Q}, {pool_ctes('fq')} SELECT case_id, 'semantic-frame' AS approach, source_kind, locator, constant_value, {_CAND} FROM rf JOIN fq USING (qid)",
    "map_oracle_frame": f"WITH {REQUEST_CTE}, {GOLD_CTE} SELECT case_id, 'slot' AS source_kind, slot_id AS locator, role FROM gf UNION ALL SELECT case_id, 'template_constant', locator, role FROM ({_STATIC_SQL})",
    "map_matcher_ensemble": f"""WITH {REQUEST_CTE}, {_LEX_Q}, {pool_ctes('lq')}, {_SIGNAL_CTE},
 en0 AS (SELECT s.case_id, s.slot_id, s.schema_name, s.field, round(least((0.45 * coalesce(p.lexical / p.top, 0.0) + 0.15 * character_ngram + 0.20 * value_enumeration + 0.20 * type_affinity) * (0.5 + 0.5 * type_compatibility), 1.0), 6) AS combined
  FROM sg s LEFT JOIN (SELECT *, max(lexical) OVER (PARTITION BY qid) AS top FROM pool) p ON p.qid = s.case_id || '/' || s.slot_id AND p.field = s.field WHERE class <> 'Alias' AND type_compatibility > 0 AND range_plausibility > 0),
 en1 AS (SELECT *, row_number() OVER (PARTITION BY case_id, slot_id ORDER BY combined DESC, field) AS rank, count(*) OVER (PARTITION BY case_id, slot_id) AS pool_size FROM en0 WHERE combined >= 0.20)
 SELECT case_id, 'matcher-ensemble' AS approach, 'slot' AS source_kind, slot_id AS locator, CAST(rank AS INTEGER) AS rank, field, round(combined / max(combined) OVER (PARTITION BY case_id, slot_id), 6) AS score, CAST(count(*) OVER (PARTITION BY case_id, slot_id, combined) - 1 AS INTEGER) AS tied_with, CAST(pool_size AS INTEGER) AS pool_size,
  (SELECT CAST(count(*) AS INTEGER) FROM ef WHERE ef.schema_name = en1.schema_name AND class <> 'Alias') AS considered FROM en1 WHERE rank <= 5""",
    "map_neighbours": f"WITH {REQUEST_CTE}, {_NEAR_CTE} SELECT case_id, ref_id, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM ne",
    "map_url_neighbours": f"""WITH rc AS (SELECT CAST(page_id AS VARCHAR) AS case_id, url AS template, '' AS grp FROM pages), {_NEAR_CTE} SELECT case_id, ref_id, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM ne""",
    "map_schema_votes": f"WITH {REQUEST_CTE}, {GOLD_CTE}, {_NEAR_CTE}, v AS (SELECT ne.case_id, gc.schema_name, sum(similarity) AS s FROM ne JOIN gc ON gc.case_id = ne.ref_id GROUP BY ALL) SELECT case_id, schema_name, round(s / max(s) OVER (PARTITION BY case_id), 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY s DESC, schema_name) AS INTEGER) AS rank FROM v",
    "map_transfer": f"""WITH {REQUEST_CTE}, {GOLD_CTE}, {_NEAR_CTE}, {concept_ctes("sx", "(SELECT case_id, slot_id, context FROM rc JOIN cx USING (cluster_id))", "case_id, slot_id", "context")},
 tr0 AS (SELECT x.case_id, x.slot_id, y.case_id AS ref_id, y.slot_id AS ref_slot, g.role, g.field, similarity * len(list_intersect(x.concepts, y.concepts)) / (len(x.concepts) + len(y.concepts) - len(list_intersect(x.concepts, y.concepts))) AS s FROM sx x JOIN ne USING (case_id) JOIN sx y ON y.case_id = ne.ref_id JOIN gf g ON g.case_id = y.case_id AND g.slot_id = y.slot_id WHERE len(list_intersect(x.concepts, y.concepts)) > 0),
 tr1 AS (SELECT *, first_value(role) OVER (PARTITION BY case_id, slot_id ORDER BY s DESC, ref_id, ref_slot) AS best FROM tr0)
 SELECT t.case_id, t.slot_id, t.role, t.field, round(sum(s), 6) AS score FROM tr1 t JOIN rc ON rc.case_id = t.case_id JOIN ef ON ef.schema_name = rc.schema_name AND ef.field = t.field WHERE t.role = best GROUP BY ALL""",
    "map_schema_prior": f"WITH {CASES_CTE}, {GOLD_CTE}, {_PRIOR_CTE} SELECT case_id, schema_name, score, rank FROM sp",
    "map_field_prior": f"""WITH {REQUEST_CTE}, {GOLD_CTE}, {_PRIOR_CTE}, fc AS (SELECT field, count(*) AS n FROM gf GROUP BY 1), fo AS (SELECT case_id, field, count(*) AS own FROM gf GROUP BY ALL),
 fp AS (SELECT sp.case_id, fc.field, fc.n - coalesce(own, 0) AS n FROM sp JOIN ef USING (schema_name) JOIN fc USING (field) LEFT JOIN fo ON fo.case_id = sp.case_id AND fo.field = fc.field WHERE sp.rank = 1),
 fr AS (SELECT case_id, field, round(CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY case_id), 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY n DESC, field) AS INTEGER) AS rank FROM fp WHERE n > 0)
 SELECT case_id, slot_id AS locator, rank, field, score FROM fr JOIN rc USING (case_id) JOIN sl USING (cluster_id) WHERE rank <= 5""",
    "map_null_prior": f"WITH {CASES_CTE} SELECT case_id, 'null-prior' AS approach, 'unresolved' AS disposition FROM cases",
    "map_constants": f"""WITH {REQUEST_CTE}, {GOLD_CTE}, {_NEAR_CTE}, cst AS ({_STATIC_SQL}) SELECT n.case_id, c.locator, 'EventResult' AS field, arg_min(c.constant_value, n.rank) AS constant_value
 FROM ne n JOIN rc ON rc.case_id = n.case_id JOIN gc ON gc.case_id = n.ref_id AND gc.schema_name = rc.schema_name JOIN cst c ON c.case_id = n.ref_id JOIN cst own ON own.case_id = n.case_id AND own.locator = c.locator JOIN ef ON ef.schema_name = rc.schema_name AND ef.field = 'EventResult' GROUP BY ALL""",
    "map_context_views": rf"""WITH {CASES_CTE}, w AS (SELECT case_id, template, string_split_regex(template, '\s+') AS w FROM cases), s AS (SELECT *, list_filter(list_transform(w, lambda x, i: CASE WHEN contains(x, '<VAR:') THEN i END), lambda x: x IS NOT NULL) AS s FROM w)
 SELECT case_id, view, template, 'svc' AS system FROM cases, (VALUES ('full'), ('v3')) v(view) UNION ALL SELECT case_id, 'v2', template, '' FROM cases UNION ALL SELECT case_id, 'v0', regexp_replace(array_to_string(regexp_extract_all(template, '<VAR:[A-Z0-9_]+>'), ' '), '<VAR:[A-Z0-9_]+>', '<VAR:VALUE>', 'g'), 'svc' FROM cases
 UNION ALL SELECT case_id, 'v1', regexp_replace(array_to_string(list_transform(w, lambda x, i: CASE WHEN len(list_filter(s, lambda p: i >= p - 3 AND i <= p + 2)) > 0 THEN x ELSE '...' END), ' '), '(\.\.\.)( \.\.\.)+', '...', 'g'), 'svc' FROM s""",
}
