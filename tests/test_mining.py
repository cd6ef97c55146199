"""Template clusters and set similarity against plain loops; literals of any kind in templates."""

import random

import pytest
from pyspark.sql import functions as F

from logfold.operators import parse, setsim, templates
from logfold.streaming.parse import normalize_stream, stream_schemas


def plain_leaders(patterns: list[tuple[str, int, int]], similarity: float, depth: int = 5) -> dict[str, str]:
    """The rule of mining in loops: (masked, n, first) -> leader of each."""
    import re

    order = sorted(patterns, key=lambda p: (-p[1], p[2], p[0]))
    leader = {p[0]: p[0] for p in order}
    bucket = lambda m: (len(m.split()), tuple("<*>" if re.search("[0-9]", t) else t for t in m.split()[: depth - 2]))
    agree = lambda a, b: sum(x == y for x, y in zip(a.split(), b.split(), strict=True))
    while True:
        left, links = [p[0] for p in order if leader[p[0]] == p[0]], []
        for a in left:
            near = [(-agree(a, b), i, b) for i, b in enumerate(left) if b != a and bucket(a) == bucket(b)]
            if near and -min(near)[0] >= max(1, -int(-(similarity * len(a.split()) - 1e-9) // 1)):
                links.append((a, min(near)[2]))
        if not links:
            return leader
        group = {p: {p} for p in left}
        for a, b in links:
            group[a] |= group[b]
            for x in group[a]:
                group[x] = group[a]
        onto = {p: min(group[p], key=left.index) for p in left}
        leader = {m: onto[x] for m, x in leader.items()}


@pytest.fixture(scope="module")
def patterns(spark):
    rnd, lines = random.Random(3), []
    for _ in range(9):
        words = [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(9)]
        for _ in range(rnd.randint(1, 10)):
            line = ["svc", "job", "run", *words]
            for at in rnd.sample(range(3, 12), rnd.randint(0, 7)):
                line[at] = rnd.choice("pqrstu") + rnd.choice("lmn")
            lines += [" ".join(line)] * rnd.randint(1, 3)
    lines += ["job4 a b c", "job5 a b c", "alone"]
    return templates.distinct_patterns(spark.createDataFrame(list(enumerate(lines)), "ord long, text string")).cache()


@pytest.mark.parametrize(("batch", "parts"), [(2000, 3), (1, 5)])
def test_clusters_do_not_depend_on_batches_or_partitions(patterns, batch, parts):
    want = plain_leaders([tuple(r) for r in patterns.select("masked", "n", "first").collect()], 0.4)
    got = dict(map(tuple, templates.cluster_patterns(patterns.repartition(parts), batch=batch).collect()))
    assert got == want and 3 < len(set(want.values())) < len(want)


def test_every_pattern_leads_itself_at_full_likeness(patterns):
    assert all(m == x for m, x in templates.cluster_patterns(patterns, similarity=1.0).collect())
    assert templates.cluster_patterns(patterns.limit(0)).count() == 0


def test_unlike_patterns_take_as_many_jobs_as_few(spark):
    """Patterns that are unlike all others end after one round, however many they are."""
    def jobs(n: int) -> int:
        rows = [(" ".join(["a", "b", "c", *(f"w{i}x{j}" for j in range(9))]), 1, i) for i in range(n)]
        df = spark.createDataFrame(rows, "masked string, n long, first long").cache()
        df.count()
        spark.sparkContext.setJobGroup(f"unlike{n}", "")
        assert templates.cluster_patterns(df, batch=1).where("masked <> leader").count() == 0
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"unlike{n}"))

    assert abs(jobs(150) - jobs(450)) <= 4


def plain_neighbours(sets: dict[str, set], k: int) -> dict[str, list]:
    out = {}
    for q, a in sets.items():
        near = sorted((-len(a & b) / len(a | b), r) for r, b in sets.items() if r != q and a & b)[:k]
        if near:
            out[q] = [(i + 1, r, -s) for i, (s, r) in enumerate(near)]
    return out


def neighbours(spark, sets: dict[str, set], k: int, hot: int) -> dict[str, list]:
    rows, got = spark.createDataFrame([(c, "r", sorted(s)) for c, s in sets.items()], "case_id string, rev string, t array<string>"), {}
    for r in setsim.top_k(rows, rows, k, hot).orderBy("rank").collect():
        got.setdefault(r.case_id, []).append((r["rank"], r.ref_id, r.similarity))
    return got


def kinds_of_sets() -> dict[str, dict[str, set]]:
    rnd = random.Random(7)
    words, steady = [f"w{i}" for i in range(30)], [f"s{i}" for i in range(12)]
    return {
        "all tokens common": {f"c{i:03}": set(rnd.sample(words, 7)) for i in range(150)},
        "two templates": {f"c{i:03}": {*(steady[:6] if i % 2 else steady[6:]), rnd.choice(words), f"id{i}"} for i in range(150)},
        "one set in all, ties and empty sets": {f"c{i:03}": {"x"} if i % 3 else (set() if i % 2 else {"x", f"y{i % 5}"}) for i in range(150)},
    }


@pytest.mark.parametrize("kind", kinds_of_sets())
def test_neighbours_are_those_of_all_pairs(spark, kind):
    sets = kinds_of_sets()[kind]
    assert neighbours(spark, sets, 3, 8) == plain_neighbours(sets, 3)


def test_compared_sets_grow_slower_than_pairs(spark):
    rnd, words, made = random.Random(5), [f"w{i}" for i in range(52)], []
    for n in (200, 800):
        sets = spark.createDataFrame([("r", sorted(rnd.sample(words, 8)), [f"c{i:04}"]) for i in range(n)], "rev string, t array<string>, ids array<string>")
        made.append(setsim.candidates(sets.select("rev", "t"), sets, 4, 16).count())
    assert made[1] < 10 * made[0]  # pairs grow 16 times


def test_literals_of_any_kind(spark, tmp_path):
    r"""Signs that patterns use, \E and \Q among them, are text in slots and parsers, in batch and stream."""
    body = r"copy D:\Exports\Q\E (a|b) [c] ^done$ {x} * + ? file"
    events = spark.createDataFrame([(i, f"{body} {n} end.") for i, n in enumerate((7, 8, 9))], "ord long, text string")
    clusters, assigned = templates.mine_templates(events, "s")
    assert [(r.slot_id, r.value) for r in templates.slot_values(assigned).orderBy("rank").collect()] == [("p1", "7"), ("p1", "8"), ("p1", "9")]
    reviews = clusters.select("cluster_id", F.lit("approved").alias("status"), F.lit("S").alias("schema_name"), F.lit("v").alias("vendor"), F.lit("p").alias("product"))
    mappings = clusters.select("cluster_id", F.lit("p1").alias("slot_id"), F.lit("N").alias("field"), F.lit("int").alias("transform"))
    specs = parse.build_parser_specs(clusters, reviews, mappings)[0]
    assert sorted(r.N for r in parse.normalize_events(assigned, specs, {"N": "int"}).collect()) == [7, 8, 9]
    events.write.json(str(tmp_path / "in"))
    named = templates.pattern_templates(templates.distinct_patterns(events), "s")
    stream = normalize_stream(spark.readStream.schema("ord long, text string").json(str(tmp_path / "in")), specs.cache(), {"N": "int"}, named.cache())
    query = stream.writeStream.format("memory").queryName("literals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.N for r in spark.table("literals").collect()) == [7, 8, 9]


def test_a_table_for_every_schema_in_batch_and_stream(spark, tmp_path):
    """Each schema has its own fields and types, lines without a parser keep their reason, a repeated batch changes nothing."""
    lines = [*(f"net conn from 10.0.0.{i} port {i}" for i in range(4)), *(f"auth user u{i} failed now" for i in range(3)), "disk full on sda1", "net conn from 10.0.0.9 port 99999999999", "never mined before"]
    events = spark.createDataFrame(list(enumerate(lines)), "ord long, text string")
    named = templates.pattern_templates(templates.distinct_patterns(events.where("ord < 9"), [*templates.MASKS, ("TEXT", r"\bu[0-9]+\b")]), "s").cache()
    masks = [*templates.MASKS, ("TEXT", r"\bu[0-9]+\b")]
    clusters = named.select("cluster_id", "template").distinct()
    kind = F.when(F.col("template").startswith("net"), "Net").when(F.col("template").startswith("auth"), "Auth").otherwise("Odd")
    reviews = clusters.select("cluster_id", F.when(F.col("template").startswith("disk"), "rejected").otherwise("approved").alias("status"), kind.alias("schema_name"), F.lit("v").alias("vendor"), F.lit("p").alias("product"))
    rows = [("Net", "p1", "Src", "string"), ("Net", "p2", "Port", "int"), ("Auth", "p1", "User", "string"), ("Auth", "p1", "Other", "string")][:3]
    table = spark.createDataFrame(rows, "schema_name string, slot_id string, field string, transform string")
    specs = parse.build_parser_specs(clusters, reviews, reviews.join(table, "schema_name").select("cluster_id", "slot_id", "field", "transform"))[0].cache()
    declared = {"Net": {"Src": "string", "Port": "int"}, "Auth": {"User": "string"}}
    assigned = events.withColumn("masked", templates.masked(F.col("text"), masks)).join(named.select("masked", "cluster_id"), "masked", "left")
    for _ in range(2):
        parse.write_schemas(parse.routed(assigned, specs, declared), str(tmp_path / "batch"), declared)
    events.repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ord long, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream_schemas(stream, specs, declared, named, str(tmp_path / "stream"), str(tmp_path / "marks"), masks).awaitTermination()
    read = lambda where, name: sorted(map(str, spark.read.parquet(str(tmp_path / where / name)).drop("batch").collect()))
    for name in ("Net", "Auth", "unparsed"):
        assert read("batch", name) == read("stream", name)
    net = {r.ord: r for r in spark.read.parquet(str(tmp_path / "batch/Net")).collect()}
    assert net[2].Port == 2 and net[8].Port is None and net[8].uncast == ["Port"] and set(net) == {0, 1, 2, 3, 8}
    assert "User" in spark.read.parquet(str(tmp_path / "batch/Auth")).columns and "Port" not in spark.read.parquet(str(tmp_path / "batch/Auth")).columns
    assert {(r.ord, r.reason) for r in spark.read.parquet(str(tmp_path / "batch/unparsed")).collect()} == {(7, "no_parser"), (9, "no_template")}
    assert sum(len(read("batch", n)) for n in ("Net", "Auth", "unparsed")) == len(lines)
    odd = parse.routed(assigned.where("ord < 3"), specs, {"Auth": {"User": "string"}})
    assert {r.reason for r in odd.collect()} == {"undeclared_schema"}
