"""Mapping approaches by name: callables from request tables to prediction tables with a declared schema.

``predict(name, requests, references)`` runs one, ``predict_all`` several in the order of the registry. Every result is
checked against ``SCHEMAS`` while the plan is made, before any row is computed. ``register`` adds an approach.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logfold.operators import mapping
from logfold.sources.shared import written


class Requests(NamedTuple):
    """cases(case_id, revision, template, schema_name, text), slots(case_id, slot_id, label, context, examples, ...),
    profiles of the slots, effective fields, schemas(case_id, rank, schema_name, score), and roles(case_id, locator, role)
    told by an oracle, whose condition is ``oracle``."""

    cases: DataFrame
    slots: DataFrame
    profiles: DataFrame
    fields: DataFrame
    schemas: DataFrame
    roles: DataFrame | None = None
    oracle: str = "none"


class References(NamedTuple):
    """Labelled cases(case_id, revision, schema_name, text), slots(case_id, slot_id, context, role, field, constant_value)
    and constants(case_id, i, locator, role, field, constant_value)."""

    cases: DataFrame
    slots: DataFrame
    constants: DataFrame


class Predictions(NamedTuple):
    """Long tables of any number of approaches, as in ``SCHEMAS``."""

    cases: DataFrame
    schemas: DataFrame
    semantics: DataFrame
    fields: DataFrame


class Approach(NamedTuple):
    predict: Callable[[Requests, References | None], dict[str, DataFrame]]
    version: str
    prior: bool
    retrieves: bool


#: Columns of every prediction table; ``case_id`` keeps the type that the requests have.
SCHEMAS = {
    "schemas": {"rank": "int", "schema_name": "string", "score": "double"},
    "semantics": {"source_kind": "string", "locator": "string", "role": "string"},
    "fields": {"source_kind": "string", "locator": "string", "rank": "int", "field": "string", "constant_value": "string", "score": "double"},
}
REGISTRY: dict[str, Approach] = {}
ORACLES = ("none", "schema", "source-frame", "both")


def register(name: str, version: str, prior: bool = False, retrieves: bool = False):
    """Registers a function (requests, references) -> some of the tables of ``SCHEMAS`` under a new name."""

    def add(run: Callable[[Requests, References | None], dict[str, DataFrame]]):
        if name in REGISTRY:
            raise ValueError(f"approach {name} is registered already")
        REGISTRY[name] = Approach(run, version, prior, retrieves)
        return run

    return add


def priors(names: list[str]) -> list[str]:
    return [n for n in REGISTRY if n in names and REGISTRY[n].prior]


def default_baseline(names: list[str]) -> str:
    """The first prior of the registry that is among the names, else the first name."""
    return (priors(names) or list(names))[0]


def told(requests: Requests, condition: str, gold_schema: DataFrame, gold_roles: DataFrame) -> Requests:
    """The requests under an oracle condition: gold schemas, gold roles or both take the place of what would be inferred."""
    if condition not in ORACLES:
        raise ValueError(f"no such oracle condition: {condition}")
    if condition in ("schema", "both"):
        hints = gold_schema.select("case_id", "schema_name")
        ranked = hints.join(requests.cases.select("case_id"), "case_id", "left_semi").select("case_id", F.lit(1).alias("rank"), "schema_name", F.lit(1.0).alias("score"))
        requests = requests._replace(cases=requests.cases.drop("schema_name").join(hints, "case_id", "left").select(*requests.cases.columns), schemas=ranked)
    if condition in ("source-frame", "both"):
        requests = requests._replace(roles=gold_roles.select("case_id", "locator", "role"))
    return requests._replace(oracle=condition)


def _checked(name: str, kind: str, df: DataFrame | None, requests: Requests) -> DataFrame:
    case = requests.cases.schema["case_id"].dataType
    want = {"case_id": case, **{c: T._parse_datatype_string(t) for c, t in SCHEMAS[kind].items()}}
    if df is None:
        df = requests.cases.sparkSession.createDataFrame([], T.StructType([T.StructField(c, t) for c, t in want.items()]))
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{c} {t.simpleString()}" for c, t in want.items() if have.get(c) != t]
    if wrong:
        raise TypeError(f"{name} must give {kind} with {', '.join(wrong)}; it has {df.schema.simpleString()}")
    return df.select(F.lit(name).alias("approach"), *want)


def predict(name: str, requests: Requests, references: References | None = None) -> Predictions:
    """The prediction bundle of one approach. Unknown names, missing references and undeclared columns are errors."""
    if name not in REGISTRY:
        raise ValueError(f"no such approach: {name}")
    approach = REGISTRY[name]
    if references is None and (approach.retrieves or approach.prior and name != "null-prior"):
        raise ValueError(f"{name} needs references")
    found = approach.predict(requests, references)
    tables = {kind: _checked(name, kind, found.get(kind), requests) for kind in SCHEMAS}
    mapped = tables["fields"].select("case_id", F.lit("mapped").alias("m")).distinct()
    cases = requests.cases.select("case_id", "revision").join(mapped, "case_id", "left").select(
        F.lit(name).alias("approach"), F.lit(approach.version).alias("version"), "case_id", "revision", F.coalesce("m", F.lit("unresolved")).alias("disposition"), F.lit(requests.oracle).alias("oracle"))
    return Predictions(cases, tables["schemas"], tables["semantics"], tables["fields"])


def predict_all(names: list[str], requests: Requests, references: References | None = None) -> Predictions:
    """The bundles of several approaches as one, each table written once; in the order of the registry."""
    unknown = sorted(set(names) - set(REGISTRY))
    if unknown or not names:
        raise ValueError(f"no such approaches: {unknown}" if unknown else "no approaches")
    bundles = [predict(n, requests, references) for n in REGISTRY if n in names]
    whole = {kind: written(reduce(DataFrame.unionByName, [getattr(b, kind) for b in bundles])) for kind in SCHEMAS}
    mapped = whole["fields"].select("approach", "case_id", F.lit("mapped").alias("m")).distinct()
    asked = reduce(DataFrame.unionByName, [requests.cases.select(F.lit(n).alias("approach"), F.lit(REGISTRY[n].version).alias("version"), "case_id", "revision") for n in REGISTRY if n in names])
    cases = asked.join(mapped, ["approach", "case_id"], "left").select("approach", "version", "case_id", "revision", F.coalesce("m", F.lit("unresolved")).alias("disposition"), F.lit(requests.oracle).alias("oracle"))
    return Predictions(cases, **whole)


# --- the approaches of the library, priors first ------------------------------------------------------------------------

def _best_schemas(requests: Requests) -> DataFrame:
    return requests.schemas.select("case_id", "rank", "schema_name", "score")


@register("null-prior", "1", prior=True)
def _null(requests: Requests, references: References | None) -> dict[str, DataFrame]:
    return {}


def _frequent_schemas(requests: Requests, references: References) -> DataFrame:
    return mapping.schema_prior(requests.cases, references.cases.select("case_id", "schema_name"))


@register("majority-schema-prior", "1", prior=True)
def _majority(requests: Requests, references: References) -> dict[str, DataFrame]:
    return {"schemas": _frequent_schemas(requests, references)}


@register("field-frequency-prior", "1", prior=True)
def _frequent(requests: Requests, references: References) -> dict[str, DataFrame]:
    schemas = _frequent_schemas(requests, references)
    found = mapping.field_prior(schemas, requests.slots, references.slots.select("case_id", "field"), requests.fields)
    return {"schemas": schemas, "fields": found.select("case_id", F.lit("slot").alias("source_kind"), "locator", "rank", "field", F.lit(None).cast("string").alias("constant_value"), "score")}


@register("direct-lexical", "3")
def _lexical(requests: Requests, references: References | None) -> dict[str, DataFrame]:
    return {"schemas": _best_schemas(requests), "fields": mapping.direct_lexical(requests.cases, requests.slots, requests.fields)}


@register("semantic-frame", "3")
def _frame(requests: Requests, references: References | None) -> dict[str, DataFrame]:
    fields, semantics = mapping.semantic_frame(requests.cases, requests.slots, requests.fields, requests.roles)
    return {"schemas": _best_schemas(requests), "semantics": semantics, "fields": fields}


@register("matcher-ensemble", "1")
def _ensemble(requests: Requests, references: References | None) -> dict[str, DataFrame]:
    return {"schemas": _best_schemas(requests), "fields": mapping.matcher_ensemble(requests.cases, requests.slots, requests.profiles, requests.fields)}


@register("case-retrieval", "2", retrieves=True)
def _retrieval(requests: Requests, references: References) -> dict[str, DataFrame]:
    """Neighbours vote for a schema; those of the chosen one give their slots' fields and their constants."""
    near = written(mapping.neighbours(requests.cases.select("case_id", "revision", "text"), references.cases.select("case_id", "revision", "text")))
    votes = requests.schemas if requests.oracle in ("schema", "both") else mapping.schema_votes(near, references.cases)
    chosen = votes.where("rank = 1").select("case_id", "schema_name")
    same = near.join(chosen, "case_id").join(references.cases.select(F.col("case_id").alias("ref_id"), "schema_name"), ["ref_id", "schema_name"])
    valid = chosen.join(requests.fields.select("schema_name", "field"), "schema_name").select("case_id", "field")
    ref = lambda df: df.withColumnRenamed("case_id", "ref_id")
    slots = ref(references.slots).withColumnRenamed("slot_id", "ref_slot")
    given = mapping.transfer_slots(same, requests.slots, slots.select("ref_id", "ref_slot", "context", "role"), slots.select("ref_id", "ref_slot", "field", "constant_value"), valid)
    place = F.row_number().over(W.partitionBy("case_id", "slot_id").orderBy(F.desc("score"), "field"))
    of_slots = given.select("case_id", F.lit("slot").alias("source_kind"), F.col("slot_id").alias("locator"), place.alias("rank"), "field", "constant_value", F.least("score", F.lit(1.0)).alias("score"))
    roles, fixed = mapping.transfer_constants(same, requests.cases, ref(references.constants), valid)
    of_text = fixed.select("case_id", F.lit("template_constant").alias("source_kind"), "locator", F.lit(1).alias("rank"), "field", "constant_value", "score")
    semantics = given.select("case_id", F.lit("slot").alias("source_kind"), F.col("slot_id").alias("locator"), "role").distinct().unionByName(roles.select("case_id", F.lit("template_constant").alias("source_kind"), "locator", "role"))
    return {"schemas": votes.select("case_id", "rank", "schema_name", "score"), "semantics": semantics, "fields": of_slots.unionByName(of_text)}
