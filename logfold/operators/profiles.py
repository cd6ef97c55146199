"""Value profiles of slots or columns, and the signals that match them with target fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import vocab
from logfold.functions.text import concepts, let, lookup, trigrams

MAX_PORT = 65535


_SUMS, _LEAST, _MOST, _ANY = [f"is_{name}" for name, _ in vocab.SHAPES], ["min_length", "low"], ["max_length", "high"], ["has_letters", "has_digits", "has_punctuation"]


def value_counts(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """(keys, v, n): the distinct trimmed values of every key with their counts, blanks as "". Adds up: counts of parts, summed
    by (keys, v), are the counts of the whole. All further work is on distinct values."""
    values = df.select(*keys, F.coalesce(F.regexp_replace(value_col, r"^\s+|\s+$", ""), F.lit("")).alias("v"))
    return values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def profile_states(counts: DataFrame, keys: list[str], distinct: str = "exact") -> DataFrame:
    """One row per key that holds all that a profile needs: matches of each shape, count, lengths, range, flags, characters and
    the number of distinct values, ``exact`` or as a mergeable ``sketch``."""
    filled = F.col("v") != ""
    weighed = lambda c: F.coalesce(F.sum(F.when(filled & c, F.col("n"))), F.lit(0))
    number, flag = F.expr("try_cast(v AS double)"), lambda p: F.coalesce(F.bool_or(filled & F.col("v").rlike(p)), F.lit(False))
    seen = F.count(F.when(filled, 1)) if distinct == "exact" else F.hll_sketch_agg(F.when(filled, F.col("v")))
    flat = counts.groupBy(*keys).agg(
        *(weighed(F.col("v").rlike(p)).alias(f"is_{name}") for name, p in vocab.SHAPES), weighed(F.lit(True)).alias("sample_count"), seen.alias("distinct"),
        F.min(F.when(filled, F.length("v"))).alias("min_length"), F.max(F.when(filled, F.length("v"))).alias("max_length"), F.min(F.when(filled, number)).alias("low"), F.max(F.when(filled, number)).alias("high"),
        flag(r"[A-Za-z\p{L}]").alias("has_letters"), flag("[0-9]").alias("has_digits"), flag(r"[^\p{L}\p{N}\s]").alias("has_punctuation"),
    )
    # a value gives a row for each of its distinct characters, with how often it has it times how often the value occurs
    each = F.transform(F.array_distinct(F.filter(F.split("v", ""), lambda c: c != "")), lambda c: F.struct(c.alias("ch"), ((F.length("v") - F.length(F.replace("v", c, F.lit("")))) * F.col("n")).alias("times")))
    chars = counts.where(filled).select(*keys, F.explode(each).alias("c")).groupBy(*keys, "c.ch").agg(F.sum("c.times").alias("times"))
    return flat.join(_characters(chars, keys), keys, "left")


def _characters(chars: DataFrame, keys: list[str]) -> DataFrame:
    return chars.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ch", "times")))).alias("characters"))


def merged_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states (with sketches) of parts of a table as those of the whole."""
    flat = states.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in (*_SUMS, "sample_count")), F.hll_union_agg("distinct").alias("distinct"), *(F.min(c).alias(c) for c in _LEAST), *(F.max(c).alias(c) for c in _MOST), *(F.bool_or(c).alias(c) for c in _ANY),
    )
    chars = states.select(*keys, F.explode("characters").alias("ch", "times")).groupBy(*keys, "ch").agg(F.sum("times").alias("times"))
    return flat.join(_characters(chars, keys), keys, "left").select(*states.columns)


def profiles_of(states: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: shape, counts, lengths, range, entropy and flags; a key without values is an uninformative text."""
    n = F.col("sample_count")
    distinct = F.hll_sketch_estimate("distinct") if dict(states.dtypes)["distinct"] == "binary" else F.col("distinct")
    best = F.greatest(*map(F.col, _SUMS))
    shape = F.lit("text")
    for name, _ in reversed(vocab.SHAPES):
        shape = F.when((F.col(f"is_{name}") == best) & (best > 0), name).otherwise(shape)
    typed = states.withColumn("physical_type", shape).withColumn("distinct_count", distinct.cast("bigint"))
    numeric = F.col("physical_type").isin("integer", "float")
    # -sum(p log p) with p = n / N is log N - sum(n log n) / N
    times = F.map_values("characters")
    total = F.aggregate(times, F.lit(0).cast("bigint"), lambda a, x: a + x)
    entropy = let(F.struct(times.alias("t"), total.alias("s")), lambda c: F.log2(c["s"].cast("double")) - F.aggregate(c["t"], F.lit(0.0), lambda a, x: a + x * F.log2(x.cast("double"))) / c["s"])
    low, high = F.when(numeric, F.col("low")), F.when(numeric, F.col("high"))
    share = lambda c: F.when(n > 0, F.round(c / n, 6)).otherwise(0.0)
    return typed.select(
        *keys, "sample_count", "distinct_count", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("min_length", "max_length")), *_ANY, "physical_type", F.when(n == 0, 0.0).when(best > 0, F.round(best / n, 6)).otherwise(1.0).alias("type_confidence"),
        share(F.col("distinct_count")).alias("uniqueness"), low.alias("numeric_min"), high.alias("numeric_max"), F.coalesce((F.col("physical_type") == "integer") & (low >= 0) & (high <= MAX_PORT), F.lit(False)).alias("port_plausible"),
        F.coalesce(F.round(entropy, 6), F.lit(0.0)).alias("character_entropy"),
    )


def profile_values(df: DataFrame, keys: list[str], value_col: str) -> DataFrame:
    """The profile of every key's non-blank values, exact."""
    return profiles_of(profile_states(value_counts(df, keys, value_col), keys), keys)


def dice(left: Column, right: Column) -> Column:
    return let(left, lambda x: let(right, lambda y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))))


def match_signals(pairs: DataFrame) -> DataFrame:
    """Adds the signals to rows with a slot (context, physical_type, port_plausible, numeric_max, examples) and a field
    (field, type, logical_type, allowed_values)."""
    shape = F.coalesce("physical_type", F.lit("text"))
    field_terms = F.array_union(concepts(F.col("field")), concepts(F.coalesce("logical_type", F.lit(""))))
    rows = pairs.withColumn("__terms", field_terms).withColumn("character_ngram", dice(trigrams(concepts(F.col("context"))), trigrams(concepts(F.col("field")))))
    allowed = lookup(vocab.COMPATIBLE)[shape]
    rows = rows.withColumn("type_compatibility", F.when((shape == "text") | (F.size(allowed) == 0), 0.5).when(F.array_contains(allowed, F.lower("type")), 1.0).otherwise(0.0))
    expected = F.coalesce(lookup(vocab.AFFINITY)[shape], F.array().cast("array<string>"))
    expected = F.when(F.col("port_plausible"), F.array_union(expected, F.array(F.lit("port")))).otherwise(expected)
    rows = rows.withColumn("type_affinity", F.when(F.size(expected) == 0, 0.0).otherwise(F.size(F.array_intersect(expected, "__terms")) / F.size(expected)))
    permitted = F.transform("allowed_values", lambda v: F.lower(v))
    inside = F.filter("examples", lambda v: F.array_contains(permitted, F.lower(F.trim(v))))
    rows = rows.withColumn("value_enumeration", F.when((F.size("allowed_values") > 0) & (F.size("examples") > 0), F.size(inside) / F.size("examples")).otherwise(0.0))
    port = F.lower(F.coalesce("logical_type", F.lit(""))).isin("port number", "port") | F.array_contains(concepts(F.col("field")), "port")
    return rows.withColumn("range_plausibility", F.when(F.col("numeric_max").isNull() | ~port, 0.5).when(F.col("port_plausible"), 1.0).otherwise(0.0)).drop("__terms")
