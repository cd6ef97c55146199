"""Work per row of the steps that grow with the events."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from logfold.functions import text, vocab
from logfold.operators import setsim, templates


def test_concepts_look_at_the_order_of_tokens_only_where_a_phrase_can_be(spark, monkeypatch):
    texts = ["signed in", "Signed 5 in", "user SIGNED-in from 10.0.0.1", "dst src1 srcIp auth", "", None, "in signed", "assigned in"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.c and set(r.c) for r in rows.select(text.concepts(F.col("t")).alias("c")).collect()]
    assert ["signedin" in c if c is not None else None for c in found] == [True, False, True, False, False, None, False, False]
    assert found[3] == {"dst", "src1", "src", "1", "srcip", "ip", "auth", "destination", "source", "authentication"}
    # a phrase whose words never meet in a text is not looked for: its look would fail
    monkeypatch.setattr(vocab, "PHRASES", {("never", "there"): ["x"]})
    monkeypatch.setattr(text, "has_phrase", lambda t, p: F.raise_error(F.lit("looked")).isNotNull())
    assert {"signed", "in"} <= set(rows.limit(1).select(text.concepts(F.col("t")).alias("c")).first().c)


def test_mining_reads_the_events_once_and_makes_a_pattern_once_a_template(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    lines = [(i, f"port {i} user {w}" if i % 2 else f"down (x) {i} C:\\Q{i}") for i, w in enumerate(["ann", "bob", "eve", "ann"] * 5)]
    events = spark.createDataFrame(lines, "ord long, text string").mapInPandas(counted, "ord long, text string")
    clusters, assigned = templates.mine_templates(events, "s")
    values = {(r.cluster_id, r.ord, r.slot_id, r.value) for r in templates.captured(assigned, clusters).collect()}
    assert assigned.count() == len(lines) and clusters.count() == 2 and read.value == len(lines)
    assert {v for _, o, _, v in values if o == 3} == {"ann", "3"} and len(values) == 10 * 2 + 10 * 2
    assert values == {(r.cluster_id, r.ord, r.slot_id, r.value) for r in templates.captured(assigned).collect()}


def test_parts_of_case_scores_follow_the_cases(spark, monkeypatch):
    from logfold.operators import metrics

    cases = spark.range(40).selectExpr("'a' AS approach", "id AS case_id")
    gold = spark.range(40).selectExpr("id AS case_id", "'slot' AS kind", "'p0' AS locator", "'identity.actor.user' AS role")
    pred = gold.selectExpr("'a' AS approach", "case_id", "kind", "upper(locator) AS locator", "CASE WHEN case_id < 10 THEN 'network.source.address' ELSE role END AS role")
    twice = lambda df: df.unionByName(df)  # noqa: E731  sets: repeated rows count once
    shown = lambda: (sorted(map(tuple, metrics.facet_scores(cases, twice(gold), twice(pred)).collect())), sorted(map(tuple, metrics.set_scores(cases, twice(gold), twice(pred), ["kind", "locator", "role"]).collect())))
    one = shown()
    assert ("a", "domain", 0.75) in one[0] and ("a", 0, 0, 1, 1, 0.0) in [(r[0], r[1], *r[2:]) for r in one[1]]
    monkeypatch.setattr(metrics, "CASES_A_PART", 4)
    assert metrics.case_parts(cases) == 10 and shown() == one
    assert metrics.set_scores(cases, gold, pred, ["kind", "locator", "role"]).rdd.getNumPartitions() == 10


def url_like(n: int) -> dict[str, set]:
    """Sets as those of page addresses: a number of their own, all other tokens common, neighbours that differ in a token or two."""
    rnd = random.Random(n)
    ends = ([], ["html"], ["top"], ["utm", "source", "feed"], ["page", "2", "ref", "x"])
    return {f"c{i:04}": {"example", rnd.choice(["http", "https"]), *rnd.choice([[], ["m"], ["www"], ["blog"]]), f"d{rnd.randrange(3)}", rnd.choice(["com", "net"]), rnd.choice(["en", "fr"]), str(1000 + i), *rnd.choice(ends)} for i in range(n)}


def nearest(sets: dict[str, set], k: int) -> list[tuple]:
    found = []
    for q, a in sets.items():
        near = sorted((-len(a & b) / len(a | b), r) for r, b in sets.items() if r != q and a & b)[:k]
        found += [(q, r, -s, at + 1) for at, (s, r) in enumerate(near)]
    return sorted(found)


def test_neighbours_that_differ_in_a_token_or_two_need_few_keys(spark, monkeypatch):
    """What the search writes follows the sets; before, all runs of their common tokens were written at every depth."""
    sets, kept, plain = url_like(400), [], setsim.written

    def counted(df):
        out = plain(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(setsim, "written", counted)
    rows = spark.createDataFrame([(c, "r", sorted(s)) for c, s in sets.items()], "case_id string, rev string, t array<string>")
    assert sorted(map(tuple, setsim.top_k(rows, rows, 3, 16).collect())) == nearest(sets, 3)
    assert sum(kept) < 20 * len(sets)


def test_neighbours_that_the_rests_of_shapes_leave_open(spark, monkeypatch):
    """Shapes longer than ``REACH`` go to the search by keys, shorter ones meet; the rows are those of all pairs."""
    sets = url_like(120) | {f"l{i}": {f"w{(7 * i + j * j) % 31}" for j in range(9)} for i in range(20)}
    rows = spark.createDataFrame([(c, "r", sorted(s)) for c, s in sets.items()], "case_id string, rev string, t array<string>")
    asked, groups = rows.select("rev", "t").distinct(), rows.groupBy("rev", "t").agg(F.collect_set("case_id").alias("ids"))
    monkeypatch.setattr(setsim, "REACH", {1: 7})
    left = setsim.closest(asked, groups, 4, 4)[1].count()
    assert 0 < left < asked.count()
    assert sorted(map(tuple, setsim.top_k(rows, rows, 3, 4).collect())) == nearest(sets, 3)
