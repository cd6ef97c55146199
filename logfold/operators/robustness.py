"""Approaches run on perturbed cases: seeds and all their variants are one request table, so each approach is asked once.

Requests and gold labels carry string ids; a variant's id is its seed's with the perturbation behind it. Schemas of a
seed hold for its variants, slot contexts and profiles are derived anew from the changed templates and labels.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.operators import approaches, concepts, metrics, perturb, profiles
from logfold.sources.shared import written

#: Perturbations of the template alone; the others also change slots or labels.
OF_TEXT = ("abbreviated", "compound", "uppercase", "swapped-direction")
NAMES = ("abbreviated", "compound", "uppercase", "opaque-labels", "decoy-slot", "swapped-direction")
SLOT_COLUMNS = ("case_id", "slot_id", "label", "placeholder", "occurrence", "examples")
KEYS = ("kind", "locator", "field", "constant_value")


class Report(NamedTuple):
    """rows as ``perturb.robustness_rows``; warnings(perturbation, warning) for perturbations without any variant."""

    rows: DataFrame
    warnings: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _renamed(df: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of every seed once for each of its variants ``of(seed, case_id, ...)``, under the variant's id."""
    return df.withColumnRenamed("case_id", "seed").join(of.select("seed", "case_id"), "seed").select(*df.columns)


def variants(requests: approaches.Requests, gold: DataFrame, names: tuple[str, ...] = NAMES) -> tuple[approaches.Requests, DataFrame, DataFrame]:
    """(requests of seeds and variants, gold likewise, asked(case_id, seed, perturbation), null for seeds).

    gold(case_id, kind, locator, role, field, constant_value). The words of its template constants are protected; the
    direction is swapped only where exactly one pair of source and destination has the same property, and the labels of
    that pair change with it. A case to which a perturbation does nothing has no variant of it.
    """
    unknown = sorted(set(names) - set(NAMES))
    if unknown:
        raise ValueError(f"no such perturbations: {unknown}")
    words = gold.where("kind = 'template_constant'").select("case_id", F.explode(F.split(F.lower(F.trim("locator")), r"\s+")).alias("w"))
    protected = words.groupBy("case_id").agg(F.collect_set("w").alias("constants"))
    none = F.array().cast("array<string>")
    seeds = requests.cases.withColumn("seed", F.col("case_id")).join(protected, "case_id", "left").withColumn("constants", F.coalesce("constants", none))
    with_slots = requests.slots.select("case_id").distinct()
    labels = gold.where("kind = 'slot'").withColumnRenamed("locator", "slot_id").drop("kind")
    swapped = perturb.swap_roles(labels)

    def changed(name: str) -> DataFrame:
        able = seeds
        if name in ("opaque-labels", "decoy-slot"):
            able = seeds.join(with_slots, "case_id", "left_semi")
        if name == "swapped-direction":
            able = seeds.join(swapped.select("case_id").distinct(), "case_id", "left_semi")
        new = able.withColumn("case_id", F.concat("case_id", F.lit(f".{name}"))) if name == "opaque-labels" else perturb.perturb(able, name)
        return new.withColumn("perturbation", F.lit(name))

    whole = written(_union([seeds.withColumn("perturbation", F.lit(None).cast("string")), *map(changed, names)]).drop("constants"))
    asked = whole.select("case_id", "seed", "perturbation")
    of = lambda *some: asked.where(F.col("perturbation").isin(*some))
    own = lambda df: df.join(asked.select("case_id"), "case_id", "left_semi")
    slots = requests.slots.select(*SLOT_COLUMNS)
    all_slots = _union([slots, _renamed(slots, of(*OF_TEXT)), own(perturb.opaque_labels(slots)), own(perturb.decoy_slots(slots))])
    clustered = concepts.slot_contexts(whole.select(F.col("case_id").alias("cluster_id"), "template"), all_slots.withColumnRenamed("case_id", "cluster_id"))
    ready = written(clustered.drop("template").withColumnRenamed("cluster_id", "case_id"))
    described = profiles.profile_values(ready.select("case_id", "slot_id", F.explode("examples").alias("v")), ["case_id", "slot_id"], "v")
    same = asked.where("perturbation IS NULL OR perturbation <> 'swapped-direction'")
    turned = swapped.withColumnRenamed("slot_id", "locator").withColumn("kind", F.lit("slot")).unionByName(gold.where("kind <> 'slot'"))
    labelled = _renamed(gold, same).unionByName(_renamed(turned, of("swapped-direction")).select(*gold.columns))
    perturbed = requests._replace(cases=whole.drop("seed", "perturbation"), slots=ready, profiles=described, schemas=_renamed(requests.schemas, asked), roles=None, oracle="none")
    return perturbed, labelled, asked


def run(names: list[str], requests: approaches.Requests, gold: DataFrame, perturbations: tuple[str, ...] = NAMES) -> Report:
    """Runs approaches by name on seeds and variants and compares them: F1 over all seeds with F1 over the variants there
    are, and the share of variants whose answers are those of the seed, none at all included."""
    perturb.check_approaches(names)
    perturbed, labelled, asked = variants(requests, gold, perturbations)
    answers = approaches.predict_all(names, perturbed)
    top = answers.fields.where("rank = 1").withColumnRenamed("source_kind", "kind").select("approach", "case_id", *KEYS)
    about = answers.cases.select("approach", "case_id").join(asked, "case_id")
    scored = metrics.set_scores(answers.cases.select("approach", "case_id"), labelled.select("case_id", *KEYS), top, list(KEYS))
    kinds = F.coalesce("perturbation", F.lit("")).alias("perturbation")
    sums = written(scored.join(asked.select("case_id", kinds), "case_id").groupBy("approach", "perturbation").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    micro = sums.select("approach", "perturbation", F.round(metrics.f1_of(*map(F.col, ("tp", "fp", "fn"))), 6).alias("f1"))
    base, after = micro.where("perturbation = ''").select("approach", "f1"), micro.where("perturbation <> ''")
    of_variants = about.where("perturbation IS NOT NULL")
    told = top.join(of_variants, ["approach", "case_id"]).select("approach", F.col("seed").alias("case_id"), "perturbation", *KEYS)
    stable = perturb.robustness(top, told, KEYS, of_variants.select("approach", F.col("seed").alias("case_id"), "perturbation"))
    spark = asked.sparkSession
    listed = spark.createDataFrame([(n,) for n in perturbations], "perturbation string")
    warnings = listed.join(asked.select("perturbation").distinct(), "perturbation", "left_anti").select("perturbation", F.lit("no_variant").alias("warning"))
    return Report(perturb.robustness_rows(base, after, stable), warnings)
