"""Approaches on perturbed cases, against variants written by hand and scored by plain loops."""

import pytest
from pyspark.sql import functions as F

from logfold.operators import approaches, concepts, perturb, profiles, robustness, schemas

NAMES = ["direct-lexical", "semantic-frame", "matcher-ensemble"]
IP, NUMBER, TEXT = "<VAR:IPV4>", "<VAR:NUMBER>", "<VAR:TEXT>"
SEEDS = {
    "c.1": ("NetworkSession", f"Device connection allowed from {IP} to {IP} port {NUMBER}", [("IPV4", IP, 1), ("IPV4", IP, 2), ("NUMBER", NUMBER, 1)]),
    "c.2": ("Authentication", f"login failed for user {TEXT}", [("TEXT", TEXT, 1)]),
}
GOLD = [
    ("c.1", "slot", "p1", "network.source.address", "SrcIpAddr", None), ("c.1", "slot", "p2", "network.destination.address", "DstIpAddr", None),
    ("c.1", "slot", "p3", "network.destination.port", "DstPortNumber", None), ("c.1", "template_constant", "connection allowed", "network.connection.allowed", "EventResult", "Success"),
    ("c.2", "slot", "p1", "authentication.target.user", "TargetUsername", None), ("c.2", "template_constant", "login failed", "authentication.login.failed", "EventResult", "Failure"),
]
BY_HAND = {
    ("c.1", "abbreviated"): f"dvc connection allowed from {IP} to {IP} port {NUMBER}", ("c.2", "abbreviated"): f"login failed for usr {TEXT}",
    ("c.2", "compound"): f"login failed forUser {TEXT}",
    ("c.1", "uppercase"): f"DEVICE CONNECTION ALLOWED FROM {IP} TO {IP} PORT {NUMBER}", ("c.2", "uppercase"): f"LOGIN FAILED FOR USER {TEXT}",
    ("c.1", "opaque-labels"): SEEDS["c.1"][1], ("c.2", "opaque-labels"): SEEDS["c.2"][1],
    ("c.1", "decoy-slot"): f"{SEEDS['c.1'][1]} correlation id {NUMBER}", ("c.2", "decoy-slot"): f"{SEEDS['c.2'][1]} correlation id {NUMBER}",
    ("c.1", "swapped-direction"): f"Device connection allowed to {IP} from {IP} port {NUMBER}",
}
GOLD_SCHEMA = "case_id string, kind string, locator string, role string, field string, constant_value string"


def requests(spark, rows):
    """rows: (case_id, schema, template, slots); examples depend on the label alone."""
    seen = {"IPV4": ["10.0.0.1", "10.0.0.2"], "NUMBER": ["443", "80"], "TEXT": ["ann", "bob"]}
    cases = spark.createDataFrame([(i, "r1", t, s, t) for i, s, t, _ in rows], "case_id string, revision string, template string, schema_name string, text string")
    flat = [(i, f"p{k}", x[0], x[1], x[2], x[3] if len(x) > 3 else seen[x[0]]) for i, _, _, xs in rows for k, x in enumerate(xs, 1)]
    slots = spark.createDataFrame(flat, "cluster_id string, slot_id string, label string, placeholder string, occurrence int, examples array<string>")
    told = concepts.slot_contexts(cases.select(F.col("case_id").alias("cluster_id"), "template"), slots).drop("template").withColumnRenamed("cluster_id", "case_id")
    described = profiles.profile_values(told.select("case_id", "slot_id", F.explode("examples").alias("v")), ["case_id", "slot_id"], "v")
    ranked = spark.createDataFrame([(i, 1, s, 1.0) for i, s, _, _ in rows], "case_id string, rank int, schema_name string, score double")
    return approaches.Requests(cases, told, described, schemas.effective_fields(schemas.default_catalog(spark)), ranked)


def f1(pairs):
    tp, got, want = (sum(f(g, p) for g, p in pairs) for f in (lambda g, p: len(g & p), lambda g, p: len(p), lambda g, p: len(g)))
    return 0.0 if tp == 0 else 2 * (tp / got) * (tp / want) / (tp / got + tp / want)


def test_approaches_hold_up_as_plain_loops_say(spark):
    seeds = [(i, *SEEDS[i]) for i in SEEDS]
    report = robustness.run(NAMES, requests(spark, seeds), spark.createDataFrame(GOLD, GOLD_SCHEMA))
    found = {(r.approach, r.perturbation): (r.n, r.base_f1, r.perturbed_f1, r.stable, r.passed) for r in report.rows.collect()}
    assert report.warnings.count() == 0

    by_hand = []
    for (seed, name), template in BY_HAND.items():
        schema, _, slots = SEEDS[seed]
        if name == "opaque-labels":
            slots = [(f"f{k}", p, o, {"IPV4": ["10.0.0.1", "10.0.0.2"], "NUMBER": ["443", "80"], "TEXT": ["ann", "bob"]}[s]) for k, (s, p, o) in enumerate(slots, 1)]
        if name == "decoy-slot":
            slots = [*slots, ("NUMBER", NUMBER, 2 if seed == "c.1" else 1, ["4815", "162342"])]
        by_hand.append((f"{seed}.{name}", schema, template, slots))
    answers = approaches.predict_all(NAMES, requests(spark, seeds + by_hand))
    got = {}
    for r in answers.fields.where("rank = 1").collect():
        got.setdefault((r.approach, r.case_id), set()).add((r.source_kind, r.locator, r.field, r.constant_value))
    gold = {i: {(k, loc, f, v) for c, k, loc, _, f, v in GOLD if c == i} for i in SEEDS}
    turn = {"SrcIpAddr": "DstIpAddr", "DstIpAddr": "SrcIpAddr"}
    turned = {(k, loc, turn.get(f, f), v) for k, loc, f, v in gold["c.1"]}
    for a in NAMES:
        base = f1([(gold[i], got.get((a, i), set())) for i in SEEDS])
        for name in robustness.NAMES:
            ids = [i for i in SEEDS if (i, name) in BY_HAND]
            after = f1([(turned if name == "swapped-direction" else gold[i], got.get((a, f"{i}.{name}"), set())) for i in ids])
            stable = sum(got.get((a, i), set()) == got.get((a, f"{i}.{name}"), set()) for i in ids) / len(ids)
            passed = round(after, 6) >= round(base, 6) and (stable < 1 if name == "swapped-direction" else stable == 1)
            assert found[a, name] == (len(ids), pytest.approx(base, abs=1e-6), pytest.approx(after, abs=1e-6), stable, passed), (a, name)
    assert len(found) == len(NAMES) * len(robustness.NAMES)


def test_a_perturbation_without_variants_is_a_warning(spark):
    """The only pair of words before a placeholder is protected, so there is nothing to compound; no row, one warning."""
    report = robustness.run(["direct-lexical"], requests(spark, [("c.1", *SEEDS["c.1"])]), spark.createDataFrame(GOLD[:4], GOLD_SCHEMA), ("compound", "uppercase"))
    assert [(r.perturbation, r.warning) for r in report.warnings.collect()] == [("compound", "no_variant")]
    assert [r.perturbation for r in report.rows.collect()] == ["uppercase"]


def test_variants_without_predictions_count(spark):
    some = "approach string, case_id string, perturbation string, locator string, field string"
    base = spark.createDataFrame([("a", "x", "p1", "F")], "approach string, case_id string, locator string, field string")
    after = spark.createDataFrame([("a", "x", "uppercase", "p1", "F")], some)
    asked = spark.createDataFrame([("a", c, "uppercase") for c in "xyz"] + [("a", "x", "compound")], "approach string, case_id string, perturbation string")
    assert {r.perturbation: (r.n, r.stable) for r in perturb.robustness(base, after, asked=asked).collect()} == {"uppercase": (3, 1.0), "compound": (1, 0.0)}


@pytest.mark.parametrize("name", ["null-prior", "field-frequency-prior", "case-retrieval", "nobody"])
def test_priors_retrieval_and_strangers_are_refused(name):
    with pytest.raises(ValueError, match=name):
        perturb.check_approaches(["direct-lexical", name])


def test_unknown_perturbations_are_refused(spark):
    with pytest.raises(ValueError, match="lowercase"):
        robustness.variants(requests(spark, [("c.2", *SEEDS["c.2"])]), spark.createDataFrame(GOLD[4:], GOLD_SCHEMA), ("lowercase",))
