"""Template mining: masked lines, distinct patterns, leader clusters, typed slots and their values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logfold.functions.text import quoted, split_words
from logfold.operators import setsim
from logfold.sources.shared import written

#: Masks in order, most specific first: (label, pattern).
MASKS = [("IPV4", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), ("NUMBER", r"\b[0-9]+\b")]
SLOT = "<VAR:([A-Z0-9_]+)>"
ANY = "<*>"


def masked(text: Column, masks: list[tuple[str, str]] = MASKS) -> Column:
    for label, pattern in masks:
        text = F.regexp_replace(text, pattern, f"<VAR:{label}>")
    return text


def distinct_patterns(events: DataFrame, masks: list[tuple[str, str]] = MASKS) -> DataFrame:
    """(masked, n, first): all further work is on distinct masked lines. Partial aggregates make hot lines cheap."""
    return _counted(events.select(masked(F.col("text"), masks).alias("masked"), "ord"))


def _counted(lines: DataFrame) -> DataFrame:
    return lines.groupBy("masked").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def _alike(similarity: float, length: int) -> int:
    """Places at which two patterns of that many words must agree to be alike."""
    return max(1, int(np.ceil(similarity * length - 1e-9)))


def _merge_bucket(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(masked, leader) of one narrow bucket: the rule of ``cluster_patterns`` on arrays."""
    names = rows.sort_values("id")["masked"].to_numpy()
    tokens: dict[str, int] = {}
    words = np.array([[tokens.setdefault(t, len(tokens)) for t in m.split()] for m in names], np.int64).reshape(len(names), -1)
    least, leader, left = _alike(similarity, words.shape[1]), np.arange(len(names)), np.arange(len(names))
    while len(left) > 1:
        nearest, agree = np.arange(len(left)), np.zeros(len(left), np.int64)
        for i, p in enumerate(words[left]):
            same = (words[left] == p).sum(axis=1)
            same[i] = -1
            nearest[i], agree[i] = same.argmax(), same.max()  # the first, and so heaviest, of equals
        linked = agree >= least
        if not linked.any():
            break
        group = np.arange(len(left))
        while True:  # the least place of everything that links hold together
            spread = group.copy()
            np.minimum.at(spread, np.flatnonzero(linked), group[nearest[linked]])
            np.minimum.at(spread, nearest[linked], spread[linked])
            spread = spread[spread]
            if (spread == group).all():
                break
            group = spread
        onto = np.arange(len(names))
        onto[left] = left[group]
        leader = onto[leader]
        left = np.unique(leader)
    return pd.DataFrame({"masked": names, "leader": names[leader]})


def _rooted(links: DataFrame) -> DataFrame:
    """(id, root): links (id, to) to nearest neighbours hold no ring but pairs, so doubling the steps finds the end of every path."""
    back = links.select(F.col("to").alias("id"), F.col("id").alias("to"), F.lit(True).alias("mutual"))
    ends = links.join(back, ["id", "to"], "left").select("id", F.when(F.col("mutual") & (F.col("id") < F.col("to")), F.col("id")).otherwise(F.col("to")).alias("to"))
    now = written(ends)
    while True:
        onward = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        then = written(now.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        if then.join(now, ["id", "to"], "left_anti").isEmpty():
            return then.select("id", F.col("to").alias("root"))
        now = then


def _merge_wide(rows: DataFrame, similarity: float) -> DataFrame:
    """(masked, leader) of wide buckets (bucket, id, masked): the same rule in joins, whatever a bucket holds."""
    words = split_words(F.col("masked"))
    items = F.array_sort(F.transform(words, lambda t, i: F.concat_ws(":", i.cast("string"), t)))
    at_places = written(rows.select(F.col("id").alias("case_id"), F.col("bucket").alias("rev"), items.alias("t")))
    size = F.size("t")
    overlap = F.round(F.col("similarity") * 2 * size / (1 + F.col("similarity")))  # of sets of one size
    now, left = written(rows.select("id", F.col("id").alias("leader"))), at_places
    while True:
        near = setsim.top_k(left, left, 1, 128).join(left, "case_id").where(overlap >= F.greatest(F.lit(1), F.ceil(similarity * size - 1e-9)))
        links = written(near.select(F.col("case_id").alias("id"), F.col("ref_id").alias("to")))
        if links.isEmpty():
            return now.join(rows.select("id", "masked"), "id").join(rows.select(F.col("id").alias("leader"), F.col("masked").alias("name")), "leader").select("masked", F.col("name").alias("leader"))
        rooted = _rooted(links)
        heaviest = rooted.groupBy("root").agg(F.least(F.min("id"), F.col("root")).alias("onto"))
        onto = rooted.join(heaviest, "root").select("id", "onto").unionByName(heaviest.select(F.col("root").alias("id"), "onto")).distinct()
        now = written(now.join(onto.select(F.col("id").alias("leader"), "onto"), "leader", "left").select("id", F.coalesce("onto", "leader").alias("leader")))
        left = written(left.join(now.select(F.col("leader").alias("case_id")).distinct(), "case_id", "left_semi"))


def cluster_patterns(patterns: DataFrame, depth: int = 5, similarity: float = 0.4, batch: int = 2000) -> DataFrame:
    """(masked, leader): distinct patterns of one length and head that are alike share a leader pattern.

    In every round each leader is linked with the one most like it in its bucket (of equals the heaviest: more lines, then
    first seen, then by text), if they agree in enough places; all that links hold together becomes one cluster, led by its
    heaviest pattern. Rounds end when no two leaders are alike. A round at least halves the leaders that have a like, so
    their number is logarithmic, and the result depends on the patterns alone. Buckets of at most ``batch`` patterns are
    done on arrays, a bucket a group; wider ones in joins by the same rule, so ``batch`` changes the cost and nothing else.
    At a similarity of 1 every pattern leads itself.
    """
    if similarity >= 1:
        return patterns.select("masked", F.col("masked").alias("leader"))
    words = split_words(F.col("masked"))
    head = F.transform(F.slice(words, 1, depth - 2), lambda t: F.when(t.rlike("[0-9]"), ANY).otherwise(t))
    order = F.concat_ws("/", F.lpad((F.lit((1 << 62) - 1) - F.col("n")).cast("string"), 20, "0"), F.lpad(F.col("first").cast("string"), 20, "0"), "masked")
    rows = patterns.select("masked", order.alias("id"), F.concat_ws("\u0001", F.size(words).cast("string"), head).alias("bucket"))
    rows = written(rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")), "bucket"))
    alone = rows.where("held = 1").select("masked", F.col("masked").alias("leader"))
    narrow = rows.where(F.col("held").between(2, batch)).drop("held").groupBy("bucket").applyInPandas(lambda r: _merge_bucket(r, similarity), "masked string, leader string")
    done, wide = alone.unionByName(narrow), rows.where((F.col("held") > 1) & (F.col("held") > batch)).drop("held")
    return done if wide.isEmpty() else done.unionByName(_merge_wide(written(wide), similarity))


def templates_of(clustered: DataFrame) -> DataFrame:
    """(leader, template): a position is constant, or the one mask label seen there, or TEXT."""
    tokens = clustered.select("leader", F.posexplode(split_words(F.col("masked"))).alias("pos", "token"))
    label = F.regexp_extract("token", SLOT, 1)
    at = tokens.groupBy("leader", "pos").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.min(F.when(label != "", label)).alias("l1"), F.max(F.when(label != "", label)).alias("l2"))
    typed = F.when(F.col("low") == F.col("high"), F.replace("low", F.lit(ANY), F.lit("<VAR:TEXT>"))).when(F.col("l1") == F.col("l2"), F.concat(F.lit("<VAR:"), "l1", F.lit(">"))).otherwise("<VAR:TEXT>")
    rows = at.select("leader", F.struct("pos", typed.alias("t")).alias("p")).groupBy("leader").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return rows.select("leader", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("template"))


def cluster_id(system: str, template: Column) -> Column:
    return F.concat(F.lit("cluster-"), F.substring(F.sha2(F.concat(F.lit(system), F.char(F.lit(0)), template), 256), 1, 16))


def pattern_templates(patterns: DataFrame, system: str, depth: int = 5, similarity: float = 0.4) -> DataFrame:
    """(masked, template, cluster_id) of distinct patterns: what a line is matched by once it is masked."""
    clustered = written(cluster_patterns(patterns, depth, similarity))
    return clustered.join(templates_of(clustered), "leader").select("masked", "template", cluster_id(system, F.col("template")).alias("cluster_id"))


def mine_templates(events: DataFrame, system: str, masks: list[tuple[str, str]] = MASKS, depth: int = 5, similarity: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """events(ord, text, ...) -> (clusters(cluster_id, template, event_count, first), assignments(cluster_id, template + the events' columns)).

    Masked events, distinct patterns and their templates are written once; both results are joins of them.
    """
    events = written(events.withColumn("masked", masked(F.col("text"), masks)))
    patterns = written(_counted(events))
    named = written(pattern_templates(patterns, system, depth, similarity))
    clusters = patterns.join(named, "masked").groupBy("cluster_id", "template").agg(F.sum("n").alias("event_count"), F.min("first").alias("first"))
    assigned = events.join(named, "masked").drop("masked")
    return clusters, assigned


def sample_evenly(df: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """Per group: all rows if at most ``limit``, the first if it is 1, else evenly spaced ones (half-even rounding)."""
    w = W.partitionBy(*by)
    placed = df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__last", F.count(F.lit(1)).over(w) - 1)
    if limit == 1:
        chosen = F.col("__i") == 0
    else:
        spots = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * F.col("__last") / (limit - 1)).cast("long"))
        chosen = (F.col("__last") < limit) | F.array_contains(spots, F.col("__i").cast("long"))
    return placed.where(chosen).drop("__i", "__last")


def extract_slots(clusters: DataFrame) -> DataFrame:
    """(cluster_id, slot_id, pos, label, placeholder, occurrence) of every placeholder of a template."""
    slots = clusters.select("cluster_id", F.posexplode(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1))).alias("pos", "label"))
    occurrence = F.row_number().over(W.partitionBy("cluster_id", "label").orderBy("pos"))
    return slots.select("cluster_id", F.concat(F.lit("p"), (F.col("pos") + 1).cast("string")).alias("slot_id"), (F.col("pos") + 1).alias("pos"), "label", F.concat(F.lit("<VAR:"), "label", F.lit(">")).alias("placeholder"), occurrence.alias("occurrence"))


def capture_pattern(template: Column, group: str = "(.+?)") -> Column:
    """The anchored pattern of a template: literals quoted, a group for every slot."""
    literals = F.split(template, "<VAR:[A-Z0-9_]+>", -1)
    return F.concat(F.lit("^"), F.array_join(F.transform(literals, lambda t: quoted(t)), group), F.lit("$"))


def captured(assigned: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(cluster_id, ord, slot_id, value): what every event holds in each slot of its template.

    Patterns are made once a template and joined to the events. Templates come from ``clusters`` (template), where given;
    else they are gathered from the events, which reads these once more.
    """
    known = (assigned if clusters is None else clusters).select("template").distinct()
    patterns = written(known.select("template", capture_pattern(F.col("template")).alias("pattern"), F.size(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1))).alias("n")).where("n > 0"))
    met = assigned.select("cluster_id", "template", "ord", "text").join(patterns, "template").where(F.expr("text rlike pattern"))
    values = F.expr("transform(sequence(1, n), i -> struct(concat('p', i) AS slot_id, regexp_extract(text, pattern, i) AS value))")
    return met.select("cluster_id", "ord", F.explode(values).alias("s")).select("cluster_id", "ord", "s.slot_id", "s.value")


def slot_values(assigned: DataFrame, k: int = 5, clusters: DataFrame | None = None) -> DataFrame:
    """(cluster_id, slot_id, rank, value): the first ``k`` distinct values of every slot, by first appearance."""
    firsts = captured(assigned, clusters).groupBy("cluster_id", "slot_id", "value").agg(F.min("ord").alias("first"))
    rank = F.row_number().over(W.partitionBy("cluster_id", "slot_id").orderBy("first", "value"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= k).select("cluster_id", "slot_id", "rank", "value")


def build_summary(clusters: DataFrame, masks: list[tuple[str, str]] = MASKS) -> DataFrame:
    """(event_count, cluster_count, slot_clusters, masks): one row, the masks as "LABEL=pattern" in order."""
    slots = F.size(F.regexp_extract_all("template", F.lit(SLOT), F.lit(1))) > 0
    named = F.lit(";".join(f"{label}={pattern}" for label, pattern in masks))
    return clusters.agg(F.sum("event_count").alias("event_count"), F.count(F.lit(1)).alias("cluster_count"), F.sum(slots.cast("long")).alias("slot_clusters")).withColumn("masks", named)
