"""Group-wise statistics: bootstrap, permutation, detectable effects, risk and coverage.

Cases are reduced to sufficient statistics per group first; a resample then touches groups, never cases. Draws come from
a hash of (seed, resample, draw), so reruns agree and the same statement runs in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.operators.metrics import f1_of
from logfold.sources.shared import written


def draw(*parts: Column | str) -> Column:
    """A uniform 32-bit number from a hash of the parts."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def group_key(system: str, vendor: str, product: str) -> Column:
    return F.regexp_replace(F.lower(F.concat_ws(":", F.coalesce(system, F.lit("")), F.coalesce(vendor, F.lit("")), F.coalesce(product, F.lit("")))), ":+$", "")


def grouped_cases(cases: DataFrame, frozen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases with ``grp``, violations(id, rule, detail)): the group of a frozen split(case_id, group_id), else of the source.

    cases(case_id, system, vendor, product). With a frozen split a case without a group is a violation.
    """
    if frozen is None:
        return cases.withColumn("grp", group_key("system", "vendor", "product")), cases.select(F.col("case_id").cast("string").alias("id"), F.lit("").alias("rule"), F.lit("").alias("detail")).limit(0)
    joined = cases.join(frozen.select("case_id", F.col("group_id").alias("grp")), "case_id", "left")
    return joined.where("grp IS NOT NULL"), joined.where("grp IS NULL").select(F.col("case_id").cast("string").alias("id"), F.lit("no_group").alias("rule"), F.lit("").alias("detail"))


def case_confidence(cases: DataFrame, pred_case: DataFrame, fields: DataFrame, schemas: DataFrame) -> DataFrame:
    """(approach, case_id, confidence): mean score of the predicted fields times the top schema's; 0 where nothing was mapped.

    cases(approach, case_id), pred_case(approach, case_id, disposition), fields(approach, case_id, score) one row a field,
    schemas(approach, case_id, rank, score).
    """
    mean = fields.groupBy("approach", "case_id").agg(F.avg("score").alias("f"))
    top = schemas.where("rank = 1").select("approach", "case_id", F.col("score").alias("s"))
    mapped = pred_case.where("disposition = 'mapped'").select("approach", "case_id")
    known = mapped.join(mean, ["approach", "case_id"]).join(top, ["approach", "case_id"], "left").select("approach", "case_id", (F.col("f") * F.coalesce("s", F.lit(0.0))).alias("c"))
    return cases.join(known, ["approach", "case_id"], "left").select("approach", "case_id", F.coalesce("c", F.lit(0.0)).alias("confidence"))


def group_sums(scores: DataFrame, group_col: str) -> DataFrame:
    """(approach, grp, g, tp, fp, fn, f1_sum, n): per-group sufficient statistics; g numbers the groups of an approach from 0."""
    s = scores.groupBy("approach", F.col(group_col).alias("grp")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("f1").alias("f1_sum"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("g", F.row_number().over(W.partitionBy("approach").orderBy("grp")) - 1)


def sample_adequacy(groups: DataFrame) -> DataFrame:
    """(approach, groups, detectable): the difference that a sample of so many groups can resolve at all."""
    n = groups.groupBy("approach").agg(F.count(F.lit(1)).alias("groups"))
    return n.withColumn("detectable", F.round(F.least(F.lit(1.0), 2.8 * 0.5 / F.sqrt(F.col("groups"))), 6))


def group_bootstrap(groups: DataFrame, resamples: int = 1000, level: float = 0.95, seed: str = "s", most_sent: int = 1 << 20) -> DataFrame:
    """(approach, micro_low, micro_high, macro_low, macro_high): groups redrawn with replacement, percentile intervals."""
    groups = written(groups)
    size = groups.groupBy("approach").agg(F.count(F.lit(1)).alias("G"))
    sized = groups.join(size, "approach")
    if groups.count() <= most_sent:  # some 50 MB: a resample's draws then meet the groups where they arise, and only sums are shuffled
        sized = F.broadcast(sized)
    rounds = groups.sparkSession.range(resamples).select(F.col("id").alias("b"))
    drawn = size.select("G").distinct().join(F.broadcast(rounds), how="cross").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("G").cast("int") - 1)))  # resamples x groups, alike for all approaches
    drawn = drawn.withColumn("g", (draw(seed, F.col("b"), F.col("i")) % F.col("G")).cast("int"))
    sums = drawn.join(sized, ["G", "g"]).groupBy("approach", "b").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "f1_sum", "n")))
    values = sums.select("approach", f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro"), (F.col("f1_sum") / F.col("n")).alias("macro"))
    at = [(1 - level) / 2, 1 - (1 - level) / 2]
    q = lambda c, k, name: F.round(F.percentile(c, at[k]), 6).alias(name)
    return values.groupBy("approach").agg(q("micro", 0, "micro_low"), q("micro", 1, "micro_high"), q("macro", 0, "macro_low"), q("macro", 1, "macro_high"))


def paired_permutation(groups: DataFrame, baseline: str, resamples: int = 1000, seed: str = "s") -> DataFrame:
    """(approach, delta, p_value, significant): micro F1 against the baseline; whole groups swap sides with chance one half."""
    own, base = groups.where(F.col("approach") != baseline), groups.where(F.col("approach") == baseline)
    cols = ("tp", "fp", "fn")
    pairs = own.select("approach", "grp", "g", *cols).join(base.select("grp", *(F.col(c).alias(f"b_{c}") for c in cols)), "grp")
    rounds = groups.sparkSession.range(resamples + 1).select(F.col("id").alias("b"))
    spread = pairs.join(F.broadcast(rounds), how="cross")  # groups x resamples
    swap = (F.col("b") > 0) & (draw(seed, F.col("b"), F.col("g")) % 2 == 1)
    x = [F.sum(F.when(swap, F.col(f"b_{c}")).otherwise(F.col(c))).alias(c) for c in cols]
    y = [F.sum(F.when(swap, F.col(c)).otherwise(F.col(f"b_{c}"))).alias(f"b_{c}") for c in cols]
    delta = f1_of(*map(F.col, cols)) - f1_of(*(F.col(f"b_{c}") for c in cols))
    values = spread.groupBy("approach", "b").agg(*x, *y).select("approach", "b", delta.alias("delta"))
    seen = values.where("b = 0").select("approach", F.col("delta").alias("observed"))
    tested = values.where("b > 0").join(seen, "approach").groupBy("approach", "observed").agg(F.sum(F.when(F.abs("delta") >= F.abs("observed") - 1e-12, 1).otherwise(0)).alias("extreme"))
    p = (F.col("extreme") + 1) / (resamples + 1)
    return tested.select("approach", F.round("observed", 6).alias("delta"), F.round(p, 6).alias("p_value"), (p < 0.05).alias("significant"))


def detectable_effect(scores: DataFrame, baseline: str, group_col: str) -> DataFrame:
    """(approach, mde): 2.8 standard errors of the group means of case loss differences; the worst case below two groups."""
    own = scores.where(F.col("approach") != baseline).select("approach", "case_id", F.col(group_col).alias("grp"), "f1")
    base = scores.where(F.col("approach") == baseline).select("case_id", F.col("f1").alias("b_f1"))
    means = own.join(base, "case_id").groupBy("approach", "grp").agg(F.avg(F.col("b_f1") - F.col("f1")).alias("d"))
    agg = means.groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("d").alias("sd"))
    return agg.select("approach", F.round(F.when(F.col("n") < 2, F.lit(1.0)).otherwise(2.8 * F.col("sd") / F.sqrt(F.col("n"))), 6).alias("mde"))


def risk_coverage(scored: DataFrame, conf_col: str, loss_col: str, by: str, id_col: str, range_rows: int = 1 << 18) -> DataFrame:
    """(by, id, coverage, risk): mean loss of all cases at least as confident, ties by id.

    A prefix sum in two steps: the rows are dealt over ranges of (by, falling confidence, id), about ``range_rows`` each, so
    equal confidences are parted by their ids; the sums of a curve's ranges are added up in order, and inside a range a
    window adds its own cases.
    """
    keys = [F.col("by"), F.desc("confidence"), F.col("id")]
    rows = scored.select(F.col(by).alias("by"), F.col(conf_col).alias("confidence"), F.col(id_col).alias("id"), F.col(loss_col).alias("own"))
    ranges = max(1, -(-scored.count() // range_rows))
    dealt = written(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    sums = dealt.groupBy("by", "part").agg(F.sum("own").alias("s"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("by").orderBy("part")
    heads = sums.select("by", "part", (F.sum("s").over(before) - F.col("s")).alias("s0"), (F.sum("n").over(before) - F.col("n")).alias("n0"), F.sum("n").over(W.partitionBy("by")).alias("total"))
    inside = W.partitionBy("by", "part").orderBy("at")
    placed = dealt.join(heads, ["by", "part"]).withColumn("k", F.row_number().over(inside) + F.col("n0")).withColumn("loss", F.sum("own").over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col("s0"))
    return placed.select(F.col("by").alias(by), F.col("id").alias(id_col), F.round(F.col("k") / F.col("total"), 6).alias("coverage"), F.round(F.col("loss") / F.col("k"), 6).alias("risk"))


def risk_area(curve: DataFrame, by: str) -> DataFrame:
    return curve.groupBy(by).agg(F.round(F.avg("risk"), 6).alias("area"))


def warning_rows(groups: DataFrame, tests: DataFrame, fewest_cases: int = 20) -> DataFrame:
    """(approach, code): small samples, a single group, unresolved differences."""
    size = groups.groupBy("approach").agg(F.sum("n").alias("cases"), F.count(F.lit(1)).alias("groups"))
    few = size.where(F.col("cases") < fewest_cases).select("approach", F.lit("few_cases").alias("code"))
    one = size.where("groups = 1").select("approach", F.lit("single_group").alias("code"))
    return few.unionByName(one).unionByName(tests.where("NOT significant AND abs(delta) > 0").select("approach", F.lit("unresolved_difference").alias("code")))


def evaluation_warnings(cases: DataFrame, pred_case: DataFrame, scores: DataFrame, priors: list[str], split: bool = True, oracle: str = "none", view: str = "full") -> DataFrame:
    """(approach, code): what limits the reading of an evaluation.

    cases(case_id, system, label_source), pred_case(approach, case_id, disposition), scores(approach, f1) micro F1s.
    """
    about = cases.agg(F.count_distinct("system").alias("systems"), F.max((F.col("label_source") == "synthetic").cast("int")).alias("synthetic"))
    seen = pred_case.groupBy("approach").agg(F.max((F.col("disposition") == "mapped").cast("int")).alias("mapped")).crossJoin(about)  # one row
    floor = scores.agg(F.max(F.when(F.col("approach").isin(priors), F.col("f1"))).alias("floor"))
    below = scores.where(~F.col("approach").isin(priors)).crossJoin(floor)  # one row
    codes = F.filter(F.array(
        F.when(F.col("systems") < 2, F.lit("single_system")), F.when(F.col("synthetic") == 1, F.lit("synthetic_labels")), F.when(F.col("mapped") == 0, F.lit("nothing_mapped")),
        F.when(F.lit(not split) & (F.col("approach") == "case-retrieval"), F.lit("no_grouped_split")), F.when(F.lit(oracle != "none"), F.lit("oracle_condition")), F.when(F.lit(view != "full"), F.lit("context_ablation")),
    ), lambda c: c.isNotNull())
    rows = seen.select("approach", F.explode(codes).alias("code"))
    return rows.unionByName(below.where("floor IS NULL").select("approach", F.lit("no_prior").alias("code"))).unionByName(below.where("f1 <= floor").select("approach", F.lit("at_prior_floor").alias("code")))
