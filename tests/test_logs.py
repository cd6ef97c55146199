"""Sources, templates, concepts and schema ranking against hand-made facts."""

import pytest
from pyspark.sql import functions as F

from logfold.functions.text import concepts, has_phrase, ordered_tokens
from logfold.operators import concepts as C
from logfold.operators import schemas, templates
from logfold.sources import logs

#: Three lines of each of three templates; the templates fix the ids that the tests look for.
SAMPLE = "\n".join(
    [f"Demo gateway auth event login failed for user {u} from 172.16.{i}.7 using password" for i, u in enumerate(("mira", "jonas", "wei"))]
    + [f"Demo gateway network event connection allowed from 172.16.{i}.9 to 198.51.100.{i} destination port {p}" for i, p in enumerate((22, 8080, 25))]
    + [f"Demo gateway audit event administrator {u} updated policy {p}" for u, p in (("mira", "GuestWifi"), ("jonas", "NightBackup"), ("wei", "MailQuota"))]
)


@pytest.fixture(scope="module")
def mined(spark):
    events = spark.createDataFrame(list(enumerate(SAMPLE.split("\n"))), "ord long, text string")
    clusters, assigned = templates.mine_templates(events, "demo")
    return clusters.cache(), assigned.cache()


def test_golden_cluster_ids(mined):
    found = {r.cluster_id: r for r in mined[0].collect()}
    assert set(found) == {"cluster-734d3840beb93179", "cluster-b6bb82554265d920", "cluster-8bf80cd72a3678ad"}
    assert all(r.event_count == 3 for r in found.values())
    assert found["cluster-b6bb82554265d920"].template == "Demo gateway auth event login failed for user <VAR:TEXT> from <VAR:IPV4> using password"


def test_mining_does_not_depend_on_partitions(spark, mined):
    events = spark.createDataFrame(list(enumerate(SAMPLE.split("\n"))), "ord long, text string").repartition(7)
    again = templates.mine_templates(events, "demo")[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mined[0].collect()))


def test_slots_and_values(mined):
    values = {(r.cluster_id, r.slot_id, r["rank"]): r.value for r in templates.slot_values(mined[1]).collect()}
    assert values["cluster-b6bb82554265d920", "p1", 2] == "jonas"
    assert values["cluster-734d3840beb93179", "p3", 2] == "8080"
    slots = templates.extract_slots(mined[0]).where("cluster_id = 'cluster-734d3840beb93179'").orderBy("pos").collect()
    assert [(s.slot_id, s.label, s.occurrence) for s in slots] == [("p1", "IPV4", 1), ("p2", "IPV4", 2), ("p3", "NUMBER", 1)]


def test_schema_ranking_of_the_sample(spark, mined):
    wanted = schemas.schema_concepts(spark, ["Authentication", "NetworkSession", "AuditEvent"])
    _, picked = schemas.rank_schemas(mined[0], "cluster_id", "template", wanted)
    assert {r.cluster_id: r.selected_schema for r in picked.collect()} == {"cluster-734d3840beb93179": "NetworkSession", "cluster-b6bb82554265d920": "Authentication", "cluster-8bf80cd72a3678ad": "AuditEvent"}


def test_scan_numbers_blank_lines_and_strips_marks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("﻿one\r\n\r\nthree\rfour\n".encode())
    (tmp_path / "sub/b.LOG").write_text("x\n\n﻿y\n")
    (tmp_path / "c.csv").write_text("no\n")
    (tmp_path / "d.log").write_text("")
    rows = {(r.source_file.rsplit("/", 1)[1], r.line_number): r.text for r in logs.scan_logs(spark, str(tmp_path)).collect()}
    assert rows == {("a.txt", 1): "one", ("a.txt", 3): "three", ("a.txt", 4): "four", ("b.LOG", 1): "x", ("b.LOG", 3): "y"}
    counts = logs.input_counts(logs.scan_logs(spark, str(tmp_path)).withColumn("source_file", F.regexp_extract("source_file", "[^/]+$", 0)), logs.log_files(spark, str(tmp_path)).withColumn("source_file", F.regexp_extract("source_file", "[^/]+$", 0)))
    assert {r.source_file: r.event_count for r in counts.collect()} == {"a.txt": 3, "b.LOG": 2, "d.log": 0}


def test_catalog_override_and_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "ColumnName,ColumnType,Class,Schema,LogicalType,ListOfValues,Aliased,DynamicType,ArrayValuesType\nEventResult,string,Mandatory,Common,Enumerated,Success|Failure,,,\n"
        "EventType,string,Mandatory,Common,,,,,\nEventType,string,Mandatory,Net,,,,,\n,,,,,,,,\nSrcIpAddr,string,Recommended,Net,IP address,,,,\n"
    )
    catalog = logs.read_catalog(spark, str(tmp_path / "c.csv"))
    assert catalog.count() == 4 and catalog.where("field = 'EventResult'").first().allowed_values == ["Success", "Failure"]
    assert {(r.schema_name, r.field, r.common_first) for r in schemas.effective_fields(catalog).collect()} == {("Net", "EventType", 1), ("Net", "SrcIpAddr", 1), ("Net", "EventResult", 0)}


@pytest.mark.parametrize(("text", "has"), [("SrcIpAddr", {"source", "ip", "address", "src"}), ("userSigned_in", {"signed", "signedin", "authentication"}), ("logout from client", {"logoff", "source"}), ("IPv4", {"ip", "address", "ipv4"})])
def test_concepts(spark, text, has):
    assert has <= set(spark.range(1).select(concepts(F.lit(text))).first()[0])


def test_phrases_keep_order(spark):
    row = spark.range(1).select(has_phrase(F.lit("connectionAllowed now"), ["connection", "allowed"]).alias("a"), has_phrase(F.lit("allowed connection"), ["connection", "allowed"]).alias("b"), ordered_tokens(F.lit("dstPort updated")).alias("c")).first()
    assert row.a and not row.b and row.c == ["destination", "port", "update"]


def test_structured_key_owns_its_slot(spark):
    clusters = spark.createDataFrame([("c", 'msg user="<VAR:TEXT>" from <VAR:IPV4> port <VAR:NUMBER>')], "cluster_id string, template string")
    slots = templates.extract_slots(clusters).withColumn("examples", F.array(F.lit("v")))
    assert {r.slot_id: r.context for r in C.slot_contexts(clusters, slots).collect()} == {"p1": "user TEXT", "p2": "from IPV4", "p3": "<VAR:IPV4> port NUMBER"}


def test_even_sampling(spark):
    picked = templates.sample_evenly(spark.range(11).select(F.lit(1).alias("g"), "id"), ["g"], "id", 5)
    assert sorted(r.id for r in picked.collect()) == [0, 2, 5, 8, 10]  # 2.5 and 7.5 round half-even


def test_review_state_in_two_shapes(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"c1": {"approved": "true", "rejected": "false"}, "c2": [[{"name": "rejected"}, "true"], [{"name": "approved"}, "true"]]}'.replace("\n", ""))
    rows = {r.cluster_id: (r.label, r.n_enabled) for r in logs.read_review_state(spark, str(tmp_path / "s.json")).collect()}
    assert rows["c1"] == ("approved", 1) and rows["c2"] == (None, 2)


def test_table_digest_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    assert logs.table_digest(df).first() == logs.table_digest(df.orderBy(F.desc("id")).repartition(3)).first()
    assert logs.table_digest(df.withColumn("x", F.col("x") + 1)).first() != logs.table_digest(df).first()


def test_catalog_needs_its_columns_and_its_manifest(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ColumnName,ColumnType\na,string\n")
    with pytest.raises(ValueError, match="Aliased"):
        logs.read_catalog(spark, str(tmp_path / "c.csv"))
    (tmp_path / "d.csv").write_text(",".join(logs.CATALOG_COLUMNS) + "\nA,string,Optional,Net,,,B,record,int\nB,string,Optional,Common,,,,,\n")
    catalog, digest = logs.read_catalog(spark, str(tmp_path / "d.csv")), logs.file_digest(spark, str(tmp_path / "d.csv"))
    assert tuple(catalog.where("field = 'A'").select("aliased", "dynamic_type", "array_type").first()) == ("B", "record", "int")
    sha = digest.first().sha256
    manifest = lambda *v: spark.createDataFrame([v], "sha256 string, field_count int, schemas array<string>")
    assert logs.catalog_violations(catalog, digest, manifest(sha, 2, ["Net"])).count() == 0
    assert {r.rule for r in logs.catalog_violations(catalog, digest, manifest("x", 3, ["Net", "Web"])).collect()} == {"sha256", "field_count", "schemas"}


def test_typed_records_and_their_violations(spark, tmp_path):
    (tmp_path / "g.txt").write_text('{"case_id": "a", "group_id": "g"}\n\n{"case_id": "b"}\nnot json\n{"case_id": "c", "group": "x"}\n{"group_id": "g"}\n{"case_id": "a", "group_id": "h"}\n')
    rows, bad = logs.read_records(spark, str(tmp_path), "groups")
    assert sorted((r.case_id, r.group_id) for r in rows.collect()) in ([("a", "g"), ("b", None)],) or {r.case_id for r in rows.collect()} == {"a", "b"}
    assert sorted((r.line_number, r.rule) for r in bad.collect()) == [(4, "not_a_record"), (5, "undeclared_keys"), (6, "no_key"), (7, "repeated_key")]
    (tmp_path / "cases").mkdir()
    (tmp_path / "cases/c.txt").write_text('{"case_id": "a", "revision": "r", "disposition": "mapped", "input": {"template": "t <VAR:TEXT>", "slots": [{"slot_id": "p1", "occurrence": 1}]}, "expected": {"schema_name": "S", "fields": [{"semantic_id": "s", "field": "F"}]}}\n')
    case = logs.read_records(spark, str(tmp_path / "cases"), "cases")[0].first()
    assert case.input.slots[0].slot_id == "p1" and case.expected.fields[0].field == "F"


def test_row_alignment_and_counts(spark):
    left = spark.createDataFrame([(i, f"e{i}") for i in range(50)], "n long, e string").repartition(5)
    right = spark.createDataFrame([(f"k{i:03}", i % 3) for i in range(50)], "k string, label int").repartition(3)
    joined, off = logs.aligned_by_row(left, right, "n", "k", "label")
    assert {(r.n, r.label) for r in joined.collect()} == {(i, i % 3) for i in range(50)} and off.count() == 0
    assert tuple(logs.aligned_by_row(left, right.where("label > 0"), "n", "k", "label")[1].first()) == (50, 33)
    assert logs.aligned(left, left.where("n < 9"), "n", "e").count() == 50
    with pytest.raises(ValueError, match="no events"):
        logs.require_events(left.limit(0))


def test_gold_labels_stand_in_file_order(spark, tmp_path):
    """Quoted line breaks over many blocks, several files, blank lines and a byte-order mark; counts must agree."""
    rows = [(f"E{i}", f"text {i}" + ('\n"quoted" line, with comma\n\nend' if i % 3 == 0 else "")) for i in range(400)]
    write = lambda name, some, mark="": (tmp_path / name).write_text(mark + 'Content,EventId\n' + "\n".join('"' + t.replace('"', '""') + f'",{e}' + ("\n" if i % 50 == 0 else "") for i, (e, t) in enumerate(some)))
    write("a.csv", rows[:250], "\ufeff")
    write("b.csv", rows[250:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        gold = logs.gold_labels(spark, str(tmp_path), "EventId")
        got = sorted(map(tuple, gold.collect()))
        texts = sorted(map(tuple, logs.gold_labels(spark, str(tmp_path), "Content").collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, e) for i, (e, _) in enumerate(rows)] and texts == [(i, t) for i, (_, t) in enumerate(rows)]
    events = spark.createDataFrame([("f", i + 1, f"line {i}") for i in range(400)], "source_file string, line_number long, text string").repartition(5)
    assert {(r.line_number, r.value) for r in logs.with_gold(events, gold, "source_file", "line_number").collect()} == {(i + 1, f"E{i}") for i in range(400)}
    with pytest.raises(ValueError, match="399 events and 400 labels"):
        logs.with_gold(events.where("line_number > 1"), gold, "source_file", "line_number")
    with pytest.raises(ValueError, match="no column"):
        logs.gold_labels(spark, str(tmp_path), "Label")
    (tmp_path / "c.csv").write_text('Content,EventId\n"open,E1\n')
    with pytest.raises(ValueError, match="not closed"):
        logs.gold_labels(spark, str(tmp_path), "EventId")


def test_positions_of_equal_values_are_dealt_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit(7).alias("k"), (F.col("id") % 15_000).alias("position_"))
    placed = logs.by_position(rows, "k", range_rows=1000)
    assert sorted(r.position for r in placed.collect()) == list(range(20_000))
    sizes = [spark.read.parquet(f).count() for f in placed.inputFiles()]
    assert len(sizes) > 10 and max(sizes) < 4000
    again = {(r.position, r.position_) for r in logs.by_position(rows.repartition(7), "k", range_rows=3000).collect()}
    assert again == {(r.position, r.position_) for r in placed.collect()}


def test_sink_with_manifest_and_reviews(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    manifest = logs.write_with_manifest(df, str(tmp_path / "out"), "id", revision="r1").first()
    assert (manifest.artefact, manifest.n_rows, manifest.revision) == ("out", 10, "r1") and manifest.fingerprint == logs.table_digest(df).first().fingerprint
    (tmp_path / "r.json").write_text('{"cluster_id": "c", "status": "approved", "field_mappings": [{"slot_id": "p1", "field": "F", "transform": "int"}]}\nbroken\n')
    rows = logs.read_reviews(spark, str(tmp_path / "r.json")).collect()
    assert rows[0].field_mappings[0].field == "F" and rows[1]._corrupt_record == "broken"
    for name, body in (("a", '{"corpus_id": "x", "track": "parsing"}'), ("b", '{"corpus_id": "x"}'), ("c", '{"corpus_id": "y"}')):
        (tmp_path / f"m/{name}.json").parent.mkdir(exist_ok=True)
        (tmp_path / f"m/{name}.json").write_text(body)
    assert [r.id for r in logs.read_manifests(spark, str(tmp_path / "m"))[1].collect()] == ["x"]


@pytest.mark.parametrize("stop", range(4))
def test_table_and_manifest_are_one_commit(spark, tmp_path, monkeypatch, stop):
    """Whatever step is the last one, a reader gets the old table, the new one, or an error, never a mixture."""
    place = str(tmp_path / "t")
    old, new = spark.range(5), spark.range(9)
    logs.write_with_manifest(old, place, "id", revision="r1")
    steps = iter(range(4))

    def limited(run):
        def step(*a, **k):
            if next(steps) == stop:
                raise RuntimeError("lost")
            return run(*a, **k)
        return step

    for name in ("write_sorted", "remove", "_moved"):
        monkeypatch.setattr(logs, name, limited(getattr(logs, name)))
    with pytest.raises(RuntimeError, match="lost"):
        logs.write_with_manifest(new, place, "id", revision="r2")
    monkeypatch.undo()
    if stop < 2:
        assert logs.read_with_manifest(spark, place, revision="r1").count() == 5
    else:
        with pytest.raises(ValueError, match="no manifest"):
            logs.read_with_manifest(spark, place)
    assert logs.write_with_manifest(new, place, "id", revision="r2").first().n_rows == 9 and logs.read_with_manifest(spark, place, revision="r2").count() == 9
    with pytest.raises(ValueError, match="not what"):
        logs.read_with_manifest(spark, place, revision="r1")


def test_a_scope_removes_what_was_written_inside(spark):
    from logfold.sources import shared

    outside = shared.written_at(spark.range(2))[0]
    with shared.scope(spark):
        inner, path = shared.written_at(spark.range(3))
        with pytest.raises(KeyError), shared.scope(spark):
            deeper = shared.written_at(spark.range(4))[1]
            raise KeyError
        place = spark._jvm.org.apache.hadoop.fs.Path
        there = lambda p: place(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(place(p))
        assert inner.count() == 3 and there(path) and not there(deeper)
    assert not there(path) and outside.count() == 2
