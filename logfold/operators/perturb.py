"""Controlled perturbations of cases, and how approaches hold up under them.

Cases carry case_id, template and an array ``constants`` of words that stand in template-constant locators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions.text import lookup, split_words
from logfold.operators.approaches import REGISTRY

# Words and their short forms.
SHORT = {"address": "addr", "destination": "dst", "device": "dvc", "gateway": "gw", "source": "src", "user": "usr"}
LABEL_CHANGING = ("swapped-direction",)
PLACEHOLDER = "^<[^>]+>$"


def _per_word(template: Column, change) -> Column:
    return F.array_join(F.transform(split_words(template), lambda w: F.when(w.rlike(PLACEHOLDER), w).otherwise(change(w))), " ")


def _abbreviated(protected: Column):
    return lambda w: F.when(F.array_contains(protected, F.lower(w)), w).otherwise(F.coalesce(lookup(SHORT)[F.lower(w)], w))


def compounded(template: Column, protected: Column) -> Column:
    """Joins the two words before a placeholder, left to right without overlap, as one camel-case word."""
    plain = lambda w: ~w.rlike(PLACEHOLDER) & ~F.array_contains(protected, F.lower(w))

    def step(done: Column, w: Column) -> Column:
        n = F.size(done)
        a, b = F.get(done, n - 2), F.get(done, n - 1)
        # a word with a placeholder behind it has been taken already if the piece before is a joined one, marked by a leading tab
        free = (n >= 2) & w.rlike(PLACEHOLDER) & plain(a) & plain(b) & ~a.startswith("\t") & ~b.startswith("\t")
        joined = F.concat(F.lit("\t"), F.lower(a), F.initcap(b))
        return F.when(free, F.concat(F.slice(done, 1, n - 2), F.array(joined, w))).otherwise(F.concat(done, F.array(w)))

    return F.array_join(F.transform(F.aggregate(split_words(template), F.array().cast("array<string>"), step), lambda w: F.replace(w, F.lit("\t"), F.lit(""))), " ")


def perturb(cases: DataFrame, name: str) -> DataFrame:
    """Variants of the cases to which the perturbation applies; ids gain a suffix, cases that would not change go."""
    t = F.col("template")
    if name == "abbreviated":
        new = _per_word(t, _abbreviated(F.col("constants")))
    elif name == "compound":
        new = compounded(t, F.col("constants"))
    elif name == "uppercase":
        new = _per_word(t, F.upper)
    elif name == "decoy-slot":
        new = F.when(F.contains(t, F.lit("<VAR:")), F.concat(t, F.lit(" correlation id <VAR:NUMBER>"))).otherwise(t)
    elif name == "swapped-direction":
        swap = lookup({"from": "to", "to": "from", "source": "destination", "destination": "source", "src": "dst", "dst": "src"})
        new = _per_word(t, lambda w: F.coalesce(swap[F.lower(w)], w))
    else:
        raise ValueError(f"no such perturbation: {name}")
    before = F.array_join(split_words(t), " ")
    return cases.withColumn("__new", new).where(F.col("__new") != before).withColumn("template", F.col("__new")).withColumn("case_id", F.concat("case_id", F.lit(f".{name}"))).drop("__new")


def applicability(cases: DataFrame, names: list[str]) -> DataFrame:
    """(perturbation, n, warning): the variants there are of each perturbation; one without any is a warning, not a pass."""
    spark = cases.sparkSession
    counts = [perturb(cases, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("perturbation"), "n") for n in names]
    found = counts[0] if counts else spark.createDataFrame([], "perturbation string, n long")
    for more in counts[1:]:
        found = found.unionByName(more)
    return found.withColumn("warning", F.when(F.col("n") == 0, "no_variant"))


def opaque_labels(slots: DataFrame) -> DataFrame:
    """Slot labels say nothing any more: f1, f2, ... by position."""
    return slots.withColumn("label", F.concat(F.lit("f"), F.regexp_extract("slot_id", "[0-9]+", 0))).withColumn("case_id", F.concat("case_id", F.lit(".opaque-labels")))


def decoy_slots(slots: DataFrame) -> DataFrame:
    """slots(case_id, slot_id, label, placeholder, occurrence, examples) of decoy-slot variants: one more NUMBER slot behind the others."""
    number = "<VAR:NUMBER>"
    last = slots.groupBy("case_id").agg(F.max(F.substring("slot_id", 2, 9).cast("int")).alias("n"), F.sum((F.col("placeholder") == number).cast("int")).alias("numbers"))
    decoy = last.select("case_id", F.concat(F.lit("p"), (F.col("n") + 1).cast("string")).alias("slot_id"), F.lit("NUMBER").alias("label"), F.lit(number).alias("placeholder"), (F.col("numbers") + 1).cast("int").alias("occurrence"), F.array(F.lit("4815"), F.lit("162342")).alias("examples"))
    columns = ["case_id", "slot_id", "label", "placeholder", "occurrence", "examples"]
    return slots.select(*columns).unionByName(decoy).withColumn("case_id", F.concat("case_id", F.lit(".decoy-slot")))


def with_decoy(slots: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots, events) of decoy-slot variants: the slots of ``decoy_slots``, and the decoy's text behind every event.

    events(case_id, i, text), i from 0.
    """
    longer = events.join(slots.select("case_id").distinct(), "case_id", "left_semi").withColumn("text", F.concat("text", F.lit(" correlation id "), (4815 + F.col("i")).cast("string")))
    return decoy_slots(slots), longer.withColumn("case_id", F.concat("case_id", F.lit(".decoy-slot")))


def swap_roles(gold: DataFrame) -> DataFrame:
    """Source and destination change places in roles and fields of cases with exactly one pair of the same property."""
    kept = [c for c in gold.columns if c not in ("case_id", "slot_id", "role", "field")]
    side = F.regexp_extract("role", r"\.(source|destination)\.", 1)
    rows = gold.withColumn("side", side).withColumn("prop", F.substring_index("role", ".", -1))
    pair = rows.where("side <> ''").groupBy("case_id", "prop").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides")).where("n = 2 AND sides = 2")
    only = pair.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"), F.min("prop").alias("prop")).where("k = 1").select("case_id", "prop", F.lit(True).alias("hit"))
    other = rows.join(only, ["case_id", "prop"]).where("side <> ''").select("case_id", "prop", F.when(F.col("side") == "source", "destination").otherwise("source").alias("side"), F.col("role").alias("new_role"), F.col("field").alias("new_field"))
    return rows.join(only.select("case_id"), "case_id", "left_semi").join(other, ["case_id", "prop", "side"], "left").select("case_id", "slot_id", F.coalesce("new_role", "role").alias("role"), F.coalesce("new_field", "field").alias("field"), *kept)


def robustness(base: DataFrame, variants: DataFrame, keys: tuple[str, ...] = ("locator", "field"), asked: DataFrame | None = None) -> DataFrame:
    """(approach, perturbation, n, stable): share of variants with the same set of predictions as their seed.

    base(approach, case_id, keys), variants(approach, case_id, perturbation, keys) with the seed's id. ``asked(approach,
    case_id, perturbation)`` names all variants, so that those without any prediction count too.
    """
    sets = lambda df, by: df.groupBy(*by).agg(F.array_sort(F.collect_set(F.to_json(F.struct(*keys)))).alias("s"))
    found = sets(variants, ["approach", "case_id", "perturbation"])
    if asked is not None:
        found = asked.join(found, ["approach", "case_id", "perturbation"], "left")
    both = found.join(sets(base, ["approach", "case_id"]).withColumnRenamed("s", "seed"), ["approach", "case_id"], "left")
    return both.groupBy("approach", "perturbation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("s").eqNullSafe(F.col("seed")), 1.0).otherwise(0.0)), 6).alias("stable"))


def robustness_rows(base_f1: DataFrame, variant_f1: DataFrame, stable: DataFrame, label_changing: tuple[str, ...] = LABEL_CHANGING) -> DataFrame:
    """(approach, perturbation, family, n, base_f1, perturbed_f1, delta, stable, passed).

    base_f1(approach, f1) over all seeds, variant_f1(approach, perturbation, f1) over the variants there are, ``stable``
    from ``robustness``. A change of form must leave every answer as it is and cost nothing; a change of meaning must
    move an answer and cost nothing.
    """
    both = stable.join(variant_f1.withColumnRenamed("f1", "perturbed_f1"), ["approach", "perturbation"]).join(base_f1.withColumnRenamed("f1", "base_f1"), "approach")
    changing = F.col("perturbation").isin(*label_changing)
    kept = F.col("perturbed_f1") >= F.col("base_f1")
    passed = F.when(changing, kept & (F.col("stable") < 1)).otherwise(kept & (F.col("stable") == 1))
    return both.select("approach", "perturbation", F.when(changing, "label-changing").otherwise("label-preserving").alias("family"), "n", "base_f1", "perturbed_f1", F.round(F.col("perturbed_f1") - F.col("base_f1"), 6).alias("delta"), "stable", passed.alias("passed"))


def check_approaches(names: list[str]) -> None:
    refused = [n for n in names if n not in REGISTRY or REGISTRY[n].prior or REGISTRY[n].retrieves]
    if refused:
        raise ValueError(f"robustness needs registered approaches that read the case alone (no priors, no retrieval), not {refused}")
