"""Concepts, phrases, slot contexts and role facets of tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.functions import vocab
from logfold.functions.text import concepts, has_phrase, lookup, split_words

# Fixed value: a key and its sign before a placeholder.
STRUCTURED_KEY = r"""(?:^|[\s,;|{])['"]?([A-Za-z][A-Za-z0-9_.-]*)['"]?\s*(?:=|:)\s*['"]?$"""


def concept_tokens(df: DataFrame, ids: list[str], text_col: str) -> DataFrame:
    """(ids, token): the concepts of every text, one row each."""
    return df.select(*ids, F.explode(concepts(F.col(text_col))).alias("token"))


def match_phrases(df: DataFrame, ids: list[str], text_col: str, phrases: list[list[str]]) -> DataFrame:
    """(ids, phrase): phrases found as contiguous ordered tokens (given in normal form)."""
    found = F.filter(F.array(*(F.when(has_phrase(F.col(text_col), p), F.lit(" ".join(p))) for p in phrases)), lambda x: x.isNotNull())
    return df.select(*ids, F.explode(found).alias("phrase"))


def structured_key(before: Column) -> Column:
    """The key that directly owns a placeholder, from the text before it; empty if there is none."""
    return F.regexp_extract(before, STRUCTURED_KEY, 1)


def slot_contexts(clusters: DataFrame, slots: DataFrame) -> DataFrame:
    """slots(cluster_id, slot_id, label, placeholder, occurrence, examples) -> the same with ``context``."""
    pieces = F.split("template", F.concat(F.lit("\\Q"), F.col("placeholder"), F.lit("\\E")), -1)
    rows = slots.join(clusters.select("cluster_id", "template"), "cluster_id").withColumn("pieces", pieces)
    before = F.array_join(F.slice("pieces", 1, F.col("occurrence")), "\u0000")
    before = F.replace(before, F.lit("\u0000"), F.col("placeholder"))
    after = F.array_join(F.slice("pieces", F.col("occurrence") + 1, F.size("pieces")), "\u0000")
    after = F.replace(after, F.lit("\u0000"), F.col("placeholder"))
    rows = rows.withColumn("before", before).withColumn("b", split_words(F.col("before"))).withColumn("a", F.slice(split_words(after), 1, 2)).withColumn("key", structured_key(F.col("before")))
    last = F.lower(F.try_element_at("b", F.lit(-1)))
    tail = lambda n: F.slice("b", F.greatest(F.size("b") - n + 1, F.lit(1)), n)
    label = F.array("label")
    local = (
        F.when(F.col("occurrence") >= F.size("pieces"), F.concat_ws(" ", F.concat(label, "examples")))
        .when(F.col("key") != "", F.concat_ws(" ", "key", "label"))
        .when(last.isin("from", "to", "client", "server"), F.concat_ws(" ", F.concat(tail(1), label)))
        .when(last == "port", F.concat_ws(" ", F.concat(tail(2), label)))
        .otherwise(F.concat_ws(" ", F.concat(tail(3), label, F.col("a"))))
    )
    return rows.withColumn("context", local).drop("pieces", "before", "b", "a", "key")


def role_facets(df: DataFrame, role_col: str = "role") -> DataFrame:
    """Adds canonical, domain, relation, entity, property, custom and registered to a table of roles."""
    trimmed = F.trim(F.col(role_col))
    registry = lookup({**{r: r for r in vocab.ROLES}, **vocab.ROLE_ALIASES})
    df = df.withColumn("canonical", F.coalesce(registry[F.lower(trimmed)], trimmed)).withColumn("registered", registry[F.lower(trimmed)].isNotNull())
    tokens = F.transform(F.filter(F.split(F.lower("canonical"), r"[.:_/\s-]+"), lambda t: t != ""), lambda t: F.coalesce(lookup(vocab.ROLE_WORDS)[t], t))
    df = df.withColumn("__t", tokens)
    first = lambda values: F.get(F.filter("__t", lambda t: t.isin(*values)), F.lit(0))
    domain, relation = first(vocab.DOMAINS), first(vocab.RELATIONS)
    df = df.withColumn("entity", F.coalesce(first(vocab.ENTITIES), lookup(vocab.IMPLIED_ENTITY)[domain], F.lit("other"))).withColumn("property", F.coalesce(first(vocab.PROPERTIES), F.lit("other")))
    df = df.withColumn("custom", F.when(domain.isNull() & relation.isNull(), F.trim("canonical")))
    return df.withColumn("domain", F.coalesce(domain, F.lit("other"))).withColumn("relation", F.coalesce(relation, F.lit("unknown"))).drop("__t")
