"""Slot-to-field mapping: candidate pools, rankings and the approaches, each a function from tables to tables.

Requests: cases(case_id, template, schema_name) and slots(case_id, slot_id, label, context, examples, ...). Every
approach gives candidates(case_id, approach, source_kind, locator, rank, field, score, tied_with, pool_size, considered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.functions.text import concepts, has_phrase, ordered_tokens
from logfold.operators import setsim
from logfold.operators.profiles import match_signals

#: Phrases that are constants of a template, their role, query and value.
STATIC = [
    (["connection", "allowed"], "network.connection.allowed", "event result", "Success"),
    (["connection", "denied"], "network.connection.denied", "event result", "Failure"),
    (["login", "failed"], "authentication.login.failed", "event result", "Failure"),
    (["login", "succeeded"], "authentication.login.succeeded", "event result", "Success"),
]
WEIGHTS = {"lexical": 0.45, "character_ngram": 0.15, "value_enumeration": 0.20, "type_affinity": 0.20}
FLOOR = 0.20


def _terms(field: str = "field") -> Column:
    return F.array_union(concepts(F.col(field)), concepts(F.coalesce("logical_type", F.lit(""))))


def candidate_pool(queries: DataFrame, fields: DataFrame) -> DataFrame:
    """queries(qid, schema_name, query) x fields -> (qid, field, lexical): fields that share a token with the query.

    An inverted index: tokens of both sides meet in an equi-join on (schema, token); sizes ride along.
    """
    index = fields.where(F.col("class") != "Alias").withColumn("t", _terms()).select("schema_name", "field", F.size("t").alias("field_size"), F.explode("t").alias("token"))
    asked = queries.withColumn("t", concepts(F.col("query"))).select("qid", "schema_name", F.size("t").alias("query_size"), F.explode("t").alias("token"))
    hit = asked.join(index, ["schema_name", "token"]).groupBy("qid", "schema_name", "field", "field_size", "query_size").agg(F.count(F.lit(1)).alias("overlap"))
    return hit.select("qid", "schema_name", "field", (0.35 * (F.col("overlap") / F.col("field_size")) + 0.65 * (F.col("overlap") / F.col("query_size"))).alias("lexical"))


def rank_fields(queries: DataFrame, fields: DataFrame, limit: int = 5) -> DataFrame:
    """(qid, rank, field, score, tied_with, pool_size, considered): the best of each pool; ties counted before the cut."""
    pool = candidate_pool(queries, fields)
    w = W.partitionBy("qid")
    ranked = pool.withColumn("rank", F.row_number().over(w.orderBy(F.desc("lexical"), "field"))).withColumn("score", F.round(F.col("lexical") / F.max("lexical").over(w), 6))
    ranked = ranked.withColumn("tied_with", (F.count(F.lit(1)).over(W.partitionBy("qid", "lexical")) - 1).cast("int")).withColumn("pool_size", F.count(F.lit(1)).over(w).cast("int"))
    considered = fields.groupBy("schema_name").agg(F.count(F.lit(1)).cast("int").alias("considered"))
    return ranked.where(F.col("rank") <= limit).join(considered, "schema_name").select("qid", "rank", "field", "score", "tied_with", "pool_size", "considered")


def _named(ranked: DataFrame, queries: DataFrame, approach: str) -> DataFrame:
    about = queries.select("qid", "case_id", "source_kind", "locator", *(["constant_value"] if "constant_value" in queries.columns else []))
    rows = ranked.join(about, "qid").withColumn("approach", F.lit(approach))
    if "constant_value" not in rows.columns:
        rows = rows.withColumn("constant_value", F.lit(None).cast("string"))
    return rows.select("case_id", "approach", "source_kind", "locator", "rank", "field", "constant_value", "score", "tied_with", "pool_size", "considered")


def _slot_queries(cases: DataFrame, slots: DataFrame, query: Column) -> DataFrame:
    rows = slots.join(cases.select("case_id", "schema_name").where("schema_name IS NOT NULL"), "case_id")
    return rows.select(F.concat_ws("/", "case_id", "slot_id").alias("qid"), "case_id", "schema_name", F.lit("slot").alias("source_kind"), F.col("slot_id").alias("locator"), query.alias("query"))


def direct_lexical(cases: DataFrame, slots: DataFrame, fields: DataFrame) -> DataFrame:
    queries = _slot_queries(cases, slots, F.col("context"))
    return _named(rank_fields(queries, fields), queries, "direct-lexical")


def infer_roles(cases: DataFrame, slots: DataFrame, oracle: DataFrame | None = None) -> DataFrame:
    """slots with ``role``: the oracle's where there is one, else by rules over context, label and template; null without."""
    rows = slots.join(cases.select("case_id", "template", "schema_name"), "case_id").withColumn("__c", concepts(F.col("context"))).withColumn("__l", concepts(F.col("label")))
    has = lambda col, t: F.array_contains(col, t)
    address = has("__l", "ip") | has("__l", "address")
    port = F.when(has("__c", "source"), "network.source.port").when(has("__c", "destination"), "network.destination.port")
    login = F.arrays_overlap(concepts(F.col("template")), F.array(F.lit("login"), F.lit("logon"), F.lit("authentication")))
    role = (
        F.when(has("__c", "port"), port).when(address & has("__c", "source"), "network.source.address").when(address & has("__c", "destination"), "network.destination.address")
        .when(has("__c", "user"), F.when(login, "authentication.target.user").otherwise("event.actor.user"))
    )
    if oracle is None:
        return rows.withColumn("role", role).drop("__c", "__l")
    told = oracle.select("case_id", F.col("locator").alias("slot_id"), F.col("role").alias("__told"))
    return rows.join(told, ["case_id", "slot_id"], "left").withColumn("role", F.coalesce("__told", role)).drop("__c", "__l", "__told")


def template_constants(cases: DataFrame) -> DataFrame:
    """(case_id, schema_name, locator, role, query, constant_value) of the fixed phrases a template holds."""
    found = F.filter(F.array(*(F.when(has_phrase(F.col("template"), p), F.struct(F.lit(" ".join(p)).alias("locator"), F.lit(r).alias("role"), F.lit(q).alias("query"), F.lit(v).alias("constant_value"))) for p, r, q, v in STATIC)), lambda x: x.isNotNull())
    return cases.where("schema_name IS NOT NULL").select("case_id", "schema_name", F.explode(found).alias("s")).select("case_id", "schema_name", "s.*")


def semantic_frame(cases: DataFrame, slots: DataFrame, fields: DataFrame, oracle: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, semantics(case_id, source_kind, locator, role)): roles first, then fields for them."""
    roles = infer_roles(cases, slots, oracle).where("role IS NOT NULL AND schema_name IS NOT NULL")
    of_slots = roles.select(F.concat_ws("/", "case_id", "slot_id").alias("qid"), "case_id", "schema_name", F.lit("slot").alias("source_kind"), F.col("slot_id").alias("locator"), F.concat_ws(" ", "role", "label").alias("query"), F.lit(None).cast("string").alias("constant_value"), "role")
    fixed = template_constants(cases)
    constants = fixed.select(F.concat_ws("/", "case_id", "locator").alias("qid"), "case_id", "schema_name", F.lit("template_constant").alias("source_kind"), "locator", "query", "constant_value", "role")
    queries = of_slots.unionByName(constants)
    return _named(rank_fields(queries, fields), queries, "semantic-frame"), queries.select("case_id", "source_kind", "locator", "role")


def matcher_ensemble(cases: DataFrame, slots: DataFrame, profiles: DataFrame, fields: DataFrame, limit: int = 5) -> DataFrame:
    """Weighs lexical, n-gram, enumeration and affinity signals; a type or range that cannot fit vetoes a field.

    Slots meet the fields of their own schema only (an equi-join; the catalogue bounds the fan-out).
    """
    queries = _slot_queries(cases, slots, F.col("context"))
    lexical = candidate_pool(queries, fields).withColumn("lexical", F.col("lexical") / F.max("lexical").over(W.partitionBy("qid"))).select("qid", "field", "lexical")
    real = fields.where(F.col("class") != "Alias")
    about = slots.join(profiles, ["case_id", "slot_id"], "left").withColumn("qid", F.concat_ws("/", "case_id", "slot_id")).select("qid", "context", "examples", "physical_type", "port_plausible", "numeric_max")
    pairs = queries.select("qid", "schema_name").join(real, "schema_name").join(about, "qid").join(lexical, ["qid", "field"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    scored = match_signals(pairs).where("type_compatibility > 0 AND range_plausibility > 0")
    base = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumn("combined", F.round(F.least(base * (0.5 + 0.5 * F.col("type_compatibility")), F.lit(1.0)), 6)).where(F.col("combined") >= FLOOR)
    w = W.partitionBy("qid")
    ranked = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("combined"), "field"))).withColumn("pool_size", F.count(F.lit(1)).over(w).cast("int"))
    kept = ranked.where(F.col("rank") <= limit).withColumn("tied_with", (F.count(F.lit(1)).over(W.partitionBy("qid", "combined")) - 1).cast("int")).withColumn("score", F.round(F.col("combined") / F.max("combined").over(w), 6))
    considered = real.groupBy("schema_name").agg(F.count(F.lit(1)).cast("int").alias("considered"))
    return _named(kept.join(considered, "schema_name"), queries, "matcher-ensemble")


def neighbours(requests: DataFrame, references: DataFrame, k: int = 3, hot: int = 128) -> DataFrame:
    """(case_id, ref_id, similarity, rank): the k most alike references by Jaccard of concepts, itself excluded.

    requests(case_id, revision, text), references likewise with mapped cases only. See ``setsim`` for the search.
    """
    tokens = lambda df: df.select("case_id", F.col("revision").alias("rev"), F.array_sort(concepts(F.col("text"))).alias("t"))
    return setsim.top_k(tokens(requests), tokens(references), k, hot)


def schema_votes(near: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, schema_name, score, rank): neighbours vote for their schemas by similarity; scores are scaled to the best."""
    votes = near.join(gold.select(F.col("case_id").alias("ref_id"), "schema_name"), "ref_id").groupBy("case_id", "schema_name").agg(F.sum("similarity").alias("votes"))
    w = W.partitionBy("case_id")
    return votes.withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "schema_name"))).withColumn("score", F.round(F.col("votes") / F.max("votes").over(w), 6)).select("case_id", "schema_name", "score", "rank")


def transfer_slots(near: DataFrame, slots: DataFrame, ref_slots: DataFrame, gold_fields: DataFrame, valid: DataFrame) -> DataFrame:
    """(case_id, slot_id, role, field, constant_value, score): what neighbours' slots give, by case similarity x context Jaccard.

    near(case_id, ref_id, similarity) of the chosen schema, ref_slots(ref_id, ref_slot, context, role),
    gold_fields(ref_id, ref_slot, field[, constant_value]), valid(case_id, field). The best slot fixes the role; field
    scores are summed over slots of that role, the constant is that of the best of them, and only catalogue-valid fields count.
    """
    own = slots.withColumn("t", concepts(F.col("context"))).select("case_id", "slot_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    theirs = ref_slots.withColumn("t", concepts(F.col("context"))).select("ref_id", "ref_slot", "role", F.size("t").alias("m"), F.explode("t").alias("token"))
    met = own.join(near.select("case_id", "ref_id", "similarity"), "case_id").join(theirs, ["ref_id", "token"]).groupBy("case_id", "slot_id", "ref_id", "ref_slot", "role", "similarity", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    scored = met.withColumn("s", F.col("similarity") * F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    best = W.partitionBy("case_id", "slot_id").orderBy(F.desc("s"), "ref_id", "ref_slot")
    role = scored.withColumn("i", F.row_number().over(best)).where("i = 1").select("case_id", "slot_id", "role")
    if "constant_value" not in gold_fields.columns:
        gold_fields = gold_fields.withColumn("constant_value", F.lit(None).cast("string"))
    given = scored.join(role, ["case_id", "slot_id", "role"]).join(gold_fields, ["ref_id", "ref_slot"]).join(valid, ["case_id", "field"], "left_semi")
    first = F.min_by("constant_value", F.struct((-F.col("s")).alias("s"), "ref_id", "ref_slot"))
    return given.groupBy("case_id", "slot_id", "role", "field").agg(first.alias("constant_value"), F.round(F.sum("s"), 6).alias("score"))


def transfer_constants(near: DataFrame, templates: DataFrame, ref_constants: DataFrame, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(semantics(case_id, locator, role, score), fields(case_id, locator, field, constant_value, score)) of template constants.

    near(case_id, ref_id, similarity, rank) of the chosen schema, templates(case_id, template), ref_constants(ref_id, i,
    locator, role, field, constant_value), i their order. A neighbour's phrase counts if the template holds its ordered
    tokens in a row; of several neighbours the first gives a role to a locator and a value to a locator's field.
    """
    phrases = ref_constants.withColumn("phrase", F.concat(F.lit(" "), F.array_join(ordered_tokens(F.col("locator")), " "), F.lit(" ")))
    told = templates.select("case_id", F.concat(F.lit(" "), F.array_join(ordered_tokens(F.col("template")), " "), F.lit(" ")).alias("said"))
    met = near.join(phrases, "ref_id").join(told, "case_id").where(F.contains("said", F.col("phrase"))).withColumn("locator", F.lower("locator"))
    order = F.struct("rank", "i")
    semantics = met.groupBy("case_id", "locator", F.lower("role").alias("role_key")).agg(F.min_by(F.struct("role", "similarity"), order).alias("v"))
    fields = met.join(valid, ["case_id", "field"], "left_semi").groupBy("case_id", "locator", "field").agg(F.min_by(F.struct("constant_value", "similarity"), order).alias("v"))
    return (
        semantics.select("case_id", "locator", F.col("v.role").alias("role"), F.round("v.similarity", 6).alias("score")),
        fields.select("case_id", "locator", "field", F.col("v.constant_value").alias("constant_value"), F.lit(1.0).alias("score")),
    )


def schema_prior(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, schema_name, score): the most frequent schema of all *other* cases: global counts minus the case's own."""
    counts = gold.groupBy("schema_name").agg(F.count(F.lit(1)).alias("n"))
    own = cases.select("case_id").join(gold.select("case_id", F.col("schema_name").alias("own")), "case_id", "left")
    left = own.crossJoin(F.broadcast(counts)).withColumn("n", F.col("n") - F.coalesce((F.col("own") == F.col("schema_name")).cast("long"), F.lit(0))).where("n > 0")
    w = W.partitionBy("case_id")
    ranked = left.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "schema_name"))).withColumn("score", F.round(F.col("n") / F.max("n").over(w), 6))
    return ranked.select("case_id", "schema_name", "score", "rank")


def field_prior(schemas: DataFrame, slots: DataFrame, gold_fields: DataFrame, fields: DataFrame, limit: int = 5) -> DataFrame:
    """Every slot gets the most frequent fields of the other cases that are valid in its majority schema."""
    counts = gold_fields.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    own = gold_fields.groupBy("case_id", "field").agg(F.count(F.lit(1)).alias("own"))
    top = schemas.where("rank = 1").select("case_id", "schema_name")
    pool = top.join(fields.select("schema_name", "field"), "schema_name").join(counts, "field").join(own, ["case_id", "field"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    w = W.partitionBy("case_id")
    ranked = pool.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "field"))).withColumn("score", F.round(F.col("n") / F.max("n").over(w), 6)).where(F.col("rank") <= limit)
    return slots.select("case_id", F.col("slot_id").alias("locator")).join(ranked.select("case_id", "rank", "field", "score"), "case_id")


def context_view(cases: DataFrame, slots: DataFrame, view: str) -> tuple[DataFrame, DataFrame]:
    """Takes parts of the input away: v0 template and labels, v1 all but windows around slots, v2 metadata; v3 and full keep all."""
    blank = F.lit("")
    if view == "v0":
        bare = F.regexp_extract_all("template", F.lit("<VAR:[A-Z0-9_]+>"), F.lit(0))
        return cases.withColumn("template", F.regexp_replace(F.array_join(bare, " "), "<VAR:[A-Z0-9_]+>", "<VAR:VALUE>")), slots.withColumn("label", F.lit("VALUE")).withColumn("placeholder", F.lit("<VAR:VALUE>")).withColumn("occurrence", F.substring("slot_id", 2, 9).cast("int"))
    if view == "v1":
        words = F.split("template", r"\s+")
        spots = F.filter(F.transform("__w", lambda w, i: F.when(F.contains(w, F.lit("<VAR:")), i)), lambda i: i.isNotNull())
        near = F.transform("__w", lambda w, i: F.when(F.exists("__s", lambda s: (i >= s - 3) & (i <= s + 2)), w).otherwise("..."))
        joined = F.regexp_replace(F.array_join("__n", " "), r"(\.\.\.)( \.\.\.)+", "...")
        rows = cases.withColumn("__w", words).withColumn("__s", spots).withColumn("__n", near).withColumn("template", joined).drop("__w", "__s", "__n")
        return rows, slots
    if view == "v2":
        return cases.withColumns({c: blank for c in ("system", "vendor", "product") if c in cases.columns}), slots
    if view in ("v3", "full"):
        return cases, slots
    raise ValueError(f"no such view: {view}")
