"""Profiles, metrics, statistics, perturbations, governance and parsing on small facts."""

import pytest
from pyspark.sql import functions as F

from logfold.operators import govern, metrics, parse, perturb, profiles, stats
from logfold.operators import mapping, reports
from logfold.operators.templates import distinct_patterns, pattern_templates
from logfold.streaming.parse import normalize_stream


@pytest.mark.parametrize(("value", "shape"), [
    ("10.0.0.1", "ipv4"), ("fe80::1", "ipv6"), ("aa:bb:cc:dd:ee:ff", "mac"), ("42", "integer"), ("4.5", "float"), ("2024-01-02T03:04:05Z", "timestamp"), ("a@b.org", "email"), ("http://x/y", "url"), ("/etc/x", "path"),
    ("01234567-89ab-cdef-0123-456789abcdef", "guid"), ("true", "boolean"), ("host.example.org", "hostname"), ("some words", "text"),
])
def test_shapes(spark, value, shape):
    row = profiles.profile_values(spark.createDataFrame([("k", value)], "k string, v string"), ["k"], "v").first()
    assert row.physical_type == shape


def test_blank_key_and_port(spark):
    df = spark.createDataFrame([("a", " "), ("b", "443"), ("b", "70000"), ("c", "80")], "k string, v string")
    rows = {r.k: r for r in profiles.profile_values(df, ["k"], "v").collect()}
    assert rows["a"].sample_count == 0 and rows["a"].physical_type == "text" and not rows["b"].port_plausible and rows["c"].port_plausible


def test_profiles_of_parts_add_up(spark):
    """States with sketches of any parts, merged, profile as the whole does; so do summed value counts."""
    rows = [(f"k{i % 3}", v) for i, v in enumerate(["10", "443", " 443 ", "x-1", "", None, "ab c", "1.5", "é!", "10"] * 9 + [f"h{i}.example.org" for i in range(40)])] + [("blank", " "), ("blank", None)]
    whole = spark.createDataFrame(rows, "key string, value string")
    parts = [spark.createDataFrame(rows[i::4], "key string, value string") for i in range(4)]
    keys = ["key"]
    exact = profiles.profile_values(whole, keys, "value")
    sketched = [profiles.profile_states(profiles.value_counts(p, keys, "value"), keys, "sketch") for p in parts]
    union = sketched[0].unionByName(sketched[1]).unionByName(sketched[2]).unionByName(sketched[3])
    merged = profiles.profiles_of(profiles.merged_states(union, keys), keys)
    shown = lambda df: sorted(map(str, df.select(exact.columns).collect()))
    assert shown(merged) == shown(exact)  # sketches of so few values are exact
    counts = [profiles.value_counts(p, keys, "value") for p in parts]
    summed = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).groupBy("key", "v").agg(F.sum("n").alias("n"))
    assert shown(profiles.profiles_of(profiles.profile_states(summed, keys), keys)) == shown(exact)


def test_pair_metrics_example(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], "p int, g string")
    assert tuple(metrics.pair_metrics(df, "p", "g").first()) == (0.333333, 0.5, 0.4, 0.75)


def test_set_scores_one_of_four_and_empty(spark):
    cases = spark.createDataFrame([("a", 1), ("a", 2)], "approach string, case_id int")
    gold = spark.createDataFrame([(1, f"f{i}") for i in range(4)], "case_id int, field string")
    pred = spark.createDataFrame([("a", 1, "f0")], "approach string, case_id int, field string")
    scores = metrics.set_scores(cases, gold, pred, ["field"])
    assert {r.case_id: r.f1 for r in scores.collect()} == {1: 0.4, 2: 1.0}
    row = metrics.micro_macro(scores).first()
    assert (row.precision, row.recall, row.f1, row.macro_f1) == (1.0, 0.25, 0.4, 0.7)


def test_locators_fold_and_constants_count(spark):
    cases = spark.createDataFrame([("a", 1)], "approach string, case_id int")
    gold = spark.createDataFrame([(1, "slot", "p1", "F", None), (1, "slot", "p2", "F", "x")], "case_id int, kind string, locator string, field string, constant_value string")
    pred = spark.createDataFrame([("a", 1, "slot", "P1", "F", None), ("a", 1, "slot", "P2", "F", "X")], "approach string, case_id int, kind string, locator string, field string, constant_value string")
    row = metrics.set_scores(cases, gold, pred, ["kind", "locator", "field", "constant_value"]).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 1)


def test_neighbours_with_a_token_in_all_texts(spark):
    """One token that every text has: the result is that of all pairs, the joined rows stay near the number of texts."""
    rows = [(f"c{i:03}", "r1", f"everywhere word{i % 40} thing{i % 7} extra{i}" if i % 9 else "everywhere") for i in range(200)]
    frame = spark.createDataFrame(rows, "case_id string, revision string, text string")
    sets = {r.case_id: set(r.c) for r in frame.select("case_id", mapping.concepts(F.col("text")).alias("c")).collect()}
    want = {}
    for q in sets:
        near = sorted((-len(sets[q] & sets[r]) / len(sets[q] | sets[r]), r) for r in sets if r != q and sets[q] & sets[r])[:3]
        want[q] = [(k + 1, r, -s) for k, (s, r) in enumerate(near)]
    for hot in (2000, 20, 1):
        got = {}
        for r in mapping.neighbours(frame, frame, hot=hot).orderBy("rank").collect():
            got.setdefault(r.case_id, []).append((r["rank"], r.ref_id, r.similarity))
        assert got == want


def test_constants_first_neighbour_wins(spark):
    near = spark.createDataFrame([("c", "r1", 0.9, 1), ("c", "r2", 0.5, 2)], "case_id string, ref_id string, similarity double, rank int")
    texts = spark.createDataFrame([("c", "gateway login failed for <VAR:TEXT>")], "case_id string, template string")
    told = spark.createDataFrame([("r1", 1, "Login Failed", "a.b", "EventResult", "Failure"), ("r2", 1, "login failed", "a.c", "EventResult", "Success"), ("r2", 2, "failed login", "x", "EventResult", "n"), ("r2", 3, "login failed", "a.b", "Other", "n")], "ref_id string, i int, locator string, role string, field string, constant_value string")
    semantics, fields = mapping.transfer_constants(near, texts, told, spark.createDataFrame([("c", "EventResult")], "case_id string, field string"))
    assert sorted((r.locator, r.role, r.score) for r in semantics.collect()) == [("login failed", "a.b", 0.9), ("login failed", "a.c", 0.5)]
    assert [tuple(r) for r in fields.collect()] == [("c", "login failed", "EventResult", "Failure", 1.0)]


def test_guards_groups_and_warnings(spark):
    cases = spark.createDataFrame([(1, "r"), (2, "r")], "case_id int, revision string")
    pred = spark.createDataFrame([("a", "1", 1, "r"), ("a", "2", 1, "x"), ("a", "1", 9, "r")], "approach string, version string, case_id int, revision string")
    assert {r.rule for r in metrics.coverage_violations(cases, pred).collect()} == {"no_prediction", "repeated_prediction", "several_versions", "other_revision", "unknown_case"}
    about = spark.createDataFrame([(1, "S", "V", ""), (2, "s", "v", None)], "case_id int, system string, vendor string, product string")
    assert {r.grp for r in stats.grouped_cases(about)[0].collect()} == {"s:v"}
    kept, bad = stats.grouped_cases(about, spark.createDataFrame([(1, "g")], "case_id int, group_id string"))
    assert kept.first().grp == "g" and [r.id for r in bad.collect()] == ["2"]
    told = spark.createDataFrame([(1, "s", "synthetic")], "case_id int, system string, label_source string")
    made = spark.createDataFrame([("null-prior", 1, "unresolved"), ("case-retrieval", 1, "mapped")], "approach string, case_id int, disposition string")
    scores = spark.createDataFrame([("null-prior", 0.0), ("case-retrieval", 0.0)], "approach string, f1 double")
    codes = {(r.approach, r.code) for r in stats.evaluation_warnings(told, made, scores, ["null-prior"], split=False, view="v1").collect()}
    assert {("null-prior", "nothing_mapped"), ("case-retrieval", "no_grouped_split"), ("case-retrieval", "at_prior_floor"), ("case-retrieval", "context_ablation"), ("null-prior", "single_system"), ("null-prior", "synthetic_labels")} <= codes


def test_whole_comparison(spark):
    cases = spark.createDataFrame([(i, f"g{i % 4}", "r", f"s{i % 2}", "human_review") for i in range(24)], "case_id int, grp string, revision string, system string, label_source string")
    pred = spark.createDataFrame([(a, "1", i, "r", "mapped" if a != "null-prior" else "unresolved") for a in ("good", "bad", "null-prior") for i in range(24)], "approach string, version string, case_id int, revision string, disposition string")
    gold = spark.createDataFrame([(i, "slot", "p1", "F", None) for i in range(24)], "case_id int, kind string, locator string, field string, constant_value string")
    fields = spark.createDataFrame([(a, i, "slot", "P1", "F" if a == "good" or i % 6 == 0 else "X", None, 1.0 - i / 100) for a in ("good", "bad") for i in range(24)], "approach string, case_id int, kind string, locator string, field string, constant_value string, score double")
    ranked = spark.createDataFrame([(a, i, 1, "S", 1.0) for a in ("good", "bad") for i in range(24)], "approach string, case_id int, rank int, schema_name string, score double")
    refs = spark.createDataFrame([(3,), (99,)], "case_id int")
    report = reports.compare(cases, pred, fields, ranked, gold, cases.select("case_id", F.lit("S").alias("schema_name")), refs, resamples=100)
    scores = {r.approach: r for r in report.scores.collect()}
    assert scores["good"].f1 == 1.0 and scores["bad"].f1 == 0.166667 and scores["null-prior"].f1 == 0.0 and scores["good"].top1 == 1.0 and scores["good"].area == 0.0
    assert {r.approach: (r.micro_low, r.micro_high) for r in report.intervals.collect()}["good"] == (1.0, 1.0)
    assert {r.approach for r in report.tests.collect()} == {"good", "bad"} and {r.baseline for r in report.tests.collect()} == {"null-prior"}
    assert report.curve.where("approach = 'good'").count() == 24 and ("null-prior", "nothing_mapped") in {(r.approach, r.code) for r in report.warnings.collect()}
    assert [r.rule for r in report.violations.collect()] == ["reference_is_evaluated"]


def test_robustness_verdicts_and_decoys(spark):
    base = spark.createDataFrame([("a", 0.8)], "approach string, f1 double")
    after = spark.createDataFrame([("a", "uppercase", 0.8), ("a", "compound", 0.7), ("a", "swapped-direction", 0.9)], "approach string, perturbation string, f1 double")
    stable = spark.createDataFrame([("a", "uppercase", 5, 1.0), ("a", "compound", 5, 1.0), ("a", "swapped-direction", 5, 0.2)], "approach string, perturbation string, n long, stable double")
    assert {r.perturbation: (r.passed, r.delta) for r in perturb.robustness_rows(base, after, stable).collect()} == {"uppercase": (True, 0.0), "compound": (False, -0.1), "swapped-direction": (True, 0.1)}
    slots = spark.createDataFrame([("c", "p1", "NUMBER", "<VAR:NUMBER>", 1, ["1"]), ("c", "p2", "TEXT", "<VAR:TEXT>", 1, ["x"])], "case_id string, slot_id string, label string, placeholder string, occurrence int, examples array<string>")
    more, events = perturb.with_decoy(slots, spark.createDataFrame([("c", 0, "a"), ("c", 1, "b"), ("d", 0, "z")], "case_id string, i int, text string"))
    assert {(r.slot_id, r.occurrence) for r in more.where("label = 'NUMBER'").collect()} == {("p1", 1), ("p3", 2)}
    assert sorted(r.text for r in events.collect()) == ["a correlation id 4815", "b correlation id 4816"]


def test_decisions_against_catalogue_and_tasks(spark):
    tasks = spark.createDataFrame([("a", "i1", "t1", "r1"), ("b", "i2", "t1", "r0")], "case_id string, input_fingerprint string, task_revision string, catalogue_revision string")
    decisions = spark.createDataFrame([("d1", "annotation", "a", "x", "i1", "t1", "r1", "S"), ("d2", "annotation", "a", "x", "i0", "t0", "r0", "No"), ("d3", "annotation", "z", "y", "i", "t", "r1", None)], "decision_id string, kind string, case_id string, reviewer string, input_fingerprint string, task_revision string, catalogue_revision string, schema_name string")
    labels = spark.createDataFrame([("d1", "Res", "Success", "string"), ("d1", "Res", "success", "string"), ("d1", "Num", "5", "string"), ("d1", "Zzz", None, None), ("d3", "Res", None, None)], "decision_id string, field string, constant_value string, constant_kind string")
    fields = spark.createDataFrame([("S", "Res", "string", ["Success"]), ("S", "Num", "int", [])], "schema_name string, field string, type string, allowed_values array<string>")
    found = sorted((r.id, r.rule) for r in govern.decision_violations(tasks, decisions, labels, fields, "r1").collect())
    assert found == sorted([("b", "task_of_other_catalogue"), ("d1", "annotated_twice"), ("d1", "constant_not_allowed"), ("d1", "constant_type"), ("d1", "unknown_field"), ("d2", "other_catalogue"), ("d2", "stale_input"), ("d2", "stale_task"), ("d2", "unknown_schema"), ("d3", "fields_without_schema"), ("d3", "unknown_case")])


def test_artefacts_against_their_manifest(spark):
    schema, pair = "artefact string, fingerprint string, n_rows long, revision string", "artefact string, id string"
    manifest = spark.createDataFrame([("cases", "f", 2, "r"), ("groups", "g", 1, "r")], schema)
    found = spark.createDataFrame([("cases", "x", 3, "r"), ("more", "m", 1, "r")], schema)
    bad = govern.artefact_violations(manifest, found, spark.createDataFrame([("cases", "1"), ("cases", "3")], pair), spark.createDataFrame([("cases", "1"), ("cases", "2")], pair))
    assert sorted((r.id, r.rule) for r in bad.collect()) == [("cases", "fingerprint_differs"), ("cases", "id_missing"), ("cases", "id_not_listed"), ("cases", "n_rows_differs"), ("groups", "missing"), ("more", "not_in_manifest")]


def test_prediction_heads_and_dispositions(spark):
    case = spark.createDataFrame([("a", 1, "mapped"), ("a", 2, "mapped"), ("a", 3, "not_applicable")], "approach string, case_id int, disposition string")
    schema = spark.createDataFrame([("a", 1, "S"), ("a", 3, "S")], "approach string, case_id int, schema_name string")
    fields = spark.createDataFrame([("a", 1, "slot", "p1", "F", 1.0), ("a", 1, "slot", "P1", "F", 1.0), ("a", 1, "slot", "p2", "G", 0.5)], "approach string, case_id int, kind string, locator string, field string, score double")
    ranked = spark.createDataFrame([("a", 1, "slot", "p1", 1, "F", 0.9), ("a", 1, "slot", "P1", 1, "F", 1.0), ("a", 1, "slot", "p2", 1, "H", 0.5)], "approach string, case_id int, kind string, locator string, rank int, field string, score double")
    assert sorted(r.rule for r in govern.head_violations(case, schema, fields, ranked).collect()) == ["content_though_not_applicable", "field_key_repeats", "mapped_without_field", "mapped_without_schema", "not_the_head", "score_not_the_heads"]


def test_constants_must_occur_and_hints_must_be_known(spark):
    cases = spark.createDataFrame([(1, "login failed for x")], "case_id int, template string")
    gold = spark.createDataFrame([(1, "template_constant", "login failed"), (1, "template_constant", "failed login")], "case_id int, kind string, locator string")
    assert [r.detail for r in reports.constant_violations(cases, gold).collect()] == ["failed login"]


def test_bootstrap_of_equal_groups_collapses(spark):
    groups = spark.createDataFrame([("a", f"g{i}", i, 1, 1, 0, 0.5, 1) for i in range(9)], "approach string, grp string, g int, tp int, fp int, fn int, f1_sum double, n int")
    row = stats.group_bootstrap(groups, 50).first()
    assert row.micro_low == row.micro_high == 0.666667
    assert 0.4 < stats.sample_adequacy(groups).first().detectable < 0.5


def test_single_group_is_never_significant(spark):
    groups = spark.createDataFrame([("a", "g", 0, 9, 0, 0, 9.0, 9), ("b", "g", 0, 0, 9, 9, 0.0, 9)], "approach string, grp string, g int, tp int, fp int, fn int, f1_sum double, n int")
    assert not stats.paired_permutation(groups, "b", 60).first().significant


def test_risk_curve_matches_a_plain_sum(spark):
    rows = [("q", i, float(i * 7 % 10), float(i % 3 == 0)) for i in range(200)]
    got = {r.i: r.risk for r in stats.risk_coverage(spark.createDataFrame(rows, "q string, i int, c double, l double"), "c", "l", "q", "i", 8).collect()}
    total = 0.0
    for k, (_, i, _, loss) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1])), 1):
        total += loss
        assert abs(got[i] - total / k) < 1e-6


def test_perturbations(spark):
    cases = spark.createDataFrame([("c", "Demo gateway source from <VAR:IPV4> login ok user <VAR:TEXT>", ["login"])], "case_id string, template string, constants array<string>")
    get = lambda n: [r.template for r in perturb.perturb(cases, n).collect()]
    assert get("abbreviated") == ["Demo gw src from <VAR:IPV4> login ok usr <VAR:TEXT>"]
    assert get("compound") == ["Demo gateway sourceFrom <VAR:IPV4> login okUser <VAR:TEXT>"]
    assert get("swapped-direction") == ["Demo gateway destination to <VAR:IPV4> login ok user <VAR:TEXT>"]
    assert perturb.perturb(cases.withColumn("template", F.lit("A B")), "uppercase").count() == 0
    with pytest.raises(ValueError, match="priors|not"):
        perturb.check_approaches(["null-prior"])


def test_swap_needs_exactly_one_pair(spark):
    gold = spark.createDataFrame([("c", "p1", "network.source.address", "S"), ("c", "p2", "network.destination.address", "D"), ("c", "p3", "network.destination.port", "P")], "case_id string, slot_id string, role string, field string")
    assert {r.slot_id: r.field for r in perturb.swap_roles(gold).collect()} == {"p1": "D", "p2": "S", "p3": "P"}


def test_splits_and_release(spark):
    entries = spark.createDataFrame([(1, "g", "train"), (2, "g", "test"), (3, "h", "dev")], "case_id int, group_id string, partition string")
    assert [r.group_id for r in govern.leaks(entries).collect()] == ["g"]
    with pytest.raises(ValueError, match="reference"):
        govern.select_split(entries, entries, "train")
    corpora = spark.createDataFrame([("r", "content"), ("r", "metrics"), ("s", None)], "release string, redistribution string")
    assert {r.release: r.redistribution for r in govern.governing_class(corpora, "release").collect()} == {"r": "metrics", "s": "none"}
    kept, withheld = govern.redact(entries, "metrics")
    assert kept.count() == 0 and withheld.first().withheld == 3
    with pytest.raises(ValueError, match="violations"):
        govern.require_clean(govern.repeated(corpora, "release", "twice"))


def test_parser_skips_and_stream(spark, tmp_path):
    lines = spark.createDataFrame([(1, "portal login of u from 10.0.0.1 (code 7)"), (2, "portal login of v from 10.0.0.2 (code 8)")], "ord long, text string")
    named = pattern_templates(distinct_patterns(lines), "s")
    cid, template = named.select("cluster_id", "template").distinct().first()
    assert template == "portal login of <VAR:TEXT> from <VAR:IPV4> (code <VAR:NUMBER>)"
    clusters = spark.createDataFrame([(cid, template), ("k2", "x")], "cluster_id string, template string")
    reviews = spark.createDataFrame([(cid, "approved", "A", "v", "p"), ("k2", "approved", "A", "v", "p"), ("k9", "rejected", "A", "v", "p")], "cluster_id string, status string, schema_name string, vendor string, product string")
    mappings = spark.createDataFrame([(cid, "p3", "Code", "int"), (cid, "p1", "User", "string")], "cluster_id string, slot_id string, field string, transform string")
    specs, skipped, bad = parse.build_parser_specs(clusters, reviews, mappings)
    assert {r.reason: r.n for r in skipped.collect()} == {"awaiting_mapping": 1, "rejected": 1}
    assert [r.rule for r in bad.collect()] == ["unknown_cluster"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ord": 1, "text": "portal login of u from 10.0.0.1 (code 77)"}\n{"ord": 2, "text": "other"}\n{"ord": 3, "text": "portal login of v from 10.9.9.9 (code 5)"}\n')
    stream = spark.readStream.schema("ord long, text string").json(str(tmp_path / "in"))
    wide = normalize_stream(stream, spark.createDataFrame(specs.collect(), specs.schema), {"User": "string", "Code": "int"}, spark.createDataFrame(named.collect(), named.schema))
    query = wide.writeStream.format("memory").queryName("parsed").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.ord, r.User, r.Code) for r in spark.sql("SELECT * FROM parsed").collect()) == [(1, "u", 77), (3, "v", 5)]


def test_perturbations_without_variants_are_warnings(spark):
    cases = spark.createDataFrame([("a", "words without any slot", [])], "case_id string, template string, constants array<string>")
    assert {(r.perturbation, r.n, r.warning) for r in perturb.applicability(cases, ["uppercase", "decoy-slot", "swapped-direction"]).collect()} == {("uppercase", 1, None), ("decoy-slot", 0, "no_variant"), ("swapped-direction", 0, "no_variant")}


def test_typed_constants_compare_as_values(spark):
    """1, 1.0 and true are one value, "1" and "true" are strings, null is no value; keys keep large whole numbers apart."""
    texts = ["1", "1.0", "true", '"1"', '"true"', "null", "0", "false", "2.5", "25e-1", "9007199254740993", "9007199254740992", "12345678901234567890123"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", metrics.typed_key(F.parse_json("t")).alias("k")).collect()
    keys = {r.t: r.k for r in rows}
    assert keys["1"] == keys["1.0"] == keys["true"] == "n:1" and keys["0"] == keys["false"] and keys["2.5"] == keys["25e-1"]
    assert keys["null"] is None and keys['"1"'] == "s:1" and keys['"true"'] == "s:true" and len({keys[t] for t in texts[10:]}) == 3


def test_approaches_by_name(spark):
    """Undeclared columns, unknown names, missing references and baselines are errors before any row is read; the registry's
    first prior is the baseline."""
    from logfold.operators import approaches as registry

    cases = spark.createDataFrame([(1, "r", "login failed for user <VAR:TEXT>", "Authentication", "login failed")], "case_id int, revision string, template string, schema_name string, text string")
    slots = spark.createDataFrame([(1, "p1", "TEXT", "for user TEXT", ["u"])], "case_id int, slot_id string, label string, context string, examples array<string>")
    fields = spark.createDataFrame([("Authentication", "TargetUser", "string", "Optional", "User", [], 1)], "schema_name string, field string, type string, class string, logical_type string, allowed_values array<string>, common_first int")
    ranked = spark.createDataFrame([(1, 1, "Authentication", 1.0)], "case_id int, rank int, schema_name string, score double")
    asked = registry.Requests(cases, slots, profiles.profile_values(slots.select("case_id", "slot_id", F.explode("examples").alias("v")), ["case_id", "slot_id"], "v"), fields, ranked)
    run = registry.predict_all(["direct-lexical", "null-prior"], asked)
    assert {(r.approach, r.disposition, r.oracle) for r in run.cases.collect()} == {("null-prior", "unresolved", "none"), ("direct-lexical", "mapped", "none")}
    assert [(r.locator, r.field) for r in run.fields.collect()] == [("p1", "TargetUser")]
    told = registry.told(asked, "both", spark.createDataFrame([(1, "Other")], "case_id int, schema_name string"), spark.createDataFrame([(1, "p1", "identity.actor.user")], "case_id int, locator string, role string"))
    framed = registry.predict("semantic-frame", told)
    assert framed.cases.first().oracle == "both" and framed.schemas.first().schema_name == "Other" and {r.role for r in framed.semantics.collect() if r.source_kind == "slot"} == {"identity.actor.user"}
    for wrong, error in ((lambda: registry.predict("nothing", asked), "no such approach"), (lambda: registry.predict("case-retrieval", asked), "needs references"), (lambda: registry.told(asked, "all", cases, cases), "no such oracle")):
        with pytest.raises(ValueError, match=error):
            wrong()
    registry.register("odd", "1")(lambda requests, references: {"fields": cases.select("case_id")})
    try:
        with pytest.raises(TypeError, match="source_kind string"):
            registry.predict("odd", asked)
        with pytest.raises(ValueError, match="already"):
            registry.register("odd", "2")(lambda requests, references: {})
    finally:
        del registry.REGISTRY["odd"]
    assert registry.default_baseline(["direct-lexical", "field-frequency-prior", "majority-schema-prior"]) == "majority-schema-prior" and registry.default_baseline(["direct-lexical"]) == "direct-lexical"


def test_curves_of_equal_confidence_are_dealt_by_id(spark):
    """Nine of ten cases have no confidence at all: many ranges share them, and the curve is that of a plain sum."""
    rows = [(0, i, 0.0 if i % 10 else i / 3000, float(i % 3)) for i in range(3000)]
    curve = stats.risk_coverage(spark.createDataFrame(rows, "approach int, case_id int, conf double, loss double").repartition(5), "conf", "loss", "approach", "case_id", range_rows=200)
    got = {r.case_id: (r.coverage, r.risk) for r in curve.collect()}
    total = 0.0
    for k, (_, i, _, loss) in enumerate(sorted(rows, key=lambda r: (-r[2], r[1]))):
        total += loss
        assert got[i] == (round((k + 1) / 3000, 6), pytest.approx(total / (k + 1), abs=1e-6))
