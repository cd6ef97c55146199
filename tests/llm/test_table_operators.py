"""SimHash, mixing, top-k, WARC, components and the pipeline against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from logfold.llm import mixing, simhash, vafile, warc
from logfold.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- components ----------------------------------------------------------------------------------------------------

def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 200)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    want = roots(400, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == r for n, r in got.items()) and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash -------------------------------------------------------------------------------------------------------

def plain_simhash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_tables_decode_within_three_bits():
    own, near = simhash.golay_tables()
    rng = np.random.default_rng(0)
    for v in rng.integers(0, 1 << 16, 200):
        for bit in range(16):
            assert own[v ^ (1 << bit)] in near[v]
        assert 1 <= (near[v] >= 0).sum() <= 6


def test_all_pairs_within_three_bits_share_a_key(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), k)) for s in seeds for k in (0, 0, 1, 2, 3, 3, 4, 6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for hot in (4096, 2):
        found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, hot)
        at = {f: i for i, f in enumerate(signed)}
        got = roots(len(fps), [(at[r.a], at[r.b]) for r in found.collect()])
        assert got == roots(len(fps), [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3])


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(120)) for _ in range(12)]
    texts = [*base, *(b.replace("alpha1 ", "ALPHA1\t") for b in base), *(b + " tail" for b in base), None, "", " \n", "one", "two words", "É é", "x " * 5000]
    want = [plain_simhash(t or "") for t in texts]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i][0] for i in range(len(texts))] == want
    assert [got[i][1] for i in range(len(texts))] == roots(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if (want[i] ^ want[j]).bit_count() <= 3])


def jaccard(a, b, k=5):
    s = [{" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


@pytest.mark.parametrize("block", [4])
def test_similar_groups_match_brute_force(spark, block):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(10):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(max(1, len(base) // 110)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[0], "", None, " ", "short one", "Short  one"]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i] or "", texts[j] or "") >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts), set_block=block).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)


def test_similar_groups_find_tails_and_few_words(spark):
    """Pairs whose sets of words differ in many bits of a fingerprint: tails appended or replaced, few words and a list of new ones."""
    rng, texts = random.Random(5), []

    def fresh(n):
        return [f"x{rng.randrange(10**12)}" for _ in range(n)]

    for size, vocabulary, cut, added in [(1000, 10**9, 0, 240), (1000, 150, 0, 240), (300, 10**9, 0, 70), (300, 10**9, 30, 30), (60, 10**9, 0, 13), (9, 10**9, 0, 1)] * 12:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
        texts += [" ".join(base), " ".join(base[: size - cut] + fresh(added))]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


@pytest.mark.parametrize("block", [1])
def test_similar_groups_of_one_dense_template(spark, block):
    """Copies of one template on both sides of the threshold meet in runs of many rows, with and without rounds of heads."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.choice(["a", "b", f"v{rng.randrange(99)}"]) if rng.random() < 0.015 * (i % 3) else w for w in base) for i in range(150)]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts), set_block=block).collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), links)


def test_texts_of_one_template_below_the_threshold_do_not_leave_the_join_as_pairs(spark, monkeypatch):
    texts = [" ".join(f"x{i}.{j}" if j % 48 == i % 48 and j < 192 else f"w{j}" for j in range(200)) for i in range(5, 44)]  # likeness of 0.66 to 0.78
    kept, proposed = simhash.written_at, []

    def counted(df):
        out, at = kept(df)
        if out.columns == ["a", "b"]:
            proposed.append(out.count())
        return out, at

    monkeypatch.setattr(simhash, "written_at", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert all(got[i] == i for i in range(39))
    assert len(proposed) == 4 and max(proposed) < 100, proposed  # of 741 pairs


def test_a_dense_group_is_linked_by_heads_before_all_its_pairs_meet(spark, monkeypatch):
    """Each of 160 texts is alike to all others: most of the 12,720 pairs would say nothing new."""
    texts = [" ".join(f"x{i}" if j == i else f"w{j}" for j in range(165)) for i in range(160)]
    kept, proposed = simhash.written_at, []

    def counted(df):
        out, at = kept(df)
        if out.columns == ["a", "b"]:
            proposed.append(out.count())
        return out, at

    monkeypatch.setattr(simhash, "written_at", counted)
    assert {r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()} == {0}
    assert max(proposed) < 6000, proposed


def test_no_text_is_lost_when_ids_repeat(spark):
    rows = [(1, "t u v"), (2, "t u v"), (2, "another text of its own"), (2, "another text of its own"), (None, "T  u v"), (None, "only here"), (3, None), (4, "")]
    table = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node string, row int")
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "only here"), (1, "t u v"), (2, "another text of its own"), (3, "")]


# --- mixing --------------------------------------------------------------------------------------------------------

def plain_targets(sizes, cap=3.0):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(2)
    sources = [rng.choice(["b", "b", "b", "b", "a", "é", None, "zz"]) if i else "tiny" for i in range(400)]
    texts = [" ".join("w" for _ in range(rng.randrange(0, 900))) for _ in sources]
    texts[5], texts[6] = None, ""
    table = docs(spark, texts, sources)
    rows = mixing.mix(table, block=16).collect()
    again = mixing.mix(table.repartition(5), block=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    size, taken = {}, {}
    for r in rows:
        s = sources[r.doc_id]
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken <= 3 * r["size"]
        size[s], taken[s] = size.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
    want = plain_targets(size)
    for r in rows:
        assert abs(r.target - want[sources[r.doc_id]]) < 1e-6 and r.source_size == size[sources[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 17 for s in size)
    assert mixing.mix(table.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs(spark, ["", None])).collect()} == {0}


def test_shard_counts_are_a_multinomial_draw(spark):
    sources = spark.createDataFrame([("a", 0, 6_400_000, 3_200_000.0), ("b", 1, 3_200_000, 1_920_000.0), ("c", 2, 640_000, 1_280_000.0)], "source string, sid int, source_size long, target double")
    due, counts = mixing.shard_counts(sources, 64, 500, 7)
    share = {0: 0.5, 1: 0.3, 2: 0.2}
    per = {}
    for r in counts.collect():
        per.setdefault(r.shard, {})[r.sid] = r.n
    assert len(per) == 200 and all(sum(c.values()) == 500 for c in per.values())
    chi = sum((c.get(s, 0) - 500 * p) ** 2 / (500 * p) for c in per.values() for s, p in share.items())
    assert 300 < chi < 510  # 400 degrees of freedom: mean 400, deviation 28; an exact deal of shares would give 0
    slots = mixing.slots(sources, 64, 500, 7)
    assert {r.sid: r.n for r in slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()} == {r.sid: r.due for r in due.collect()}
    most = slots.groupBy("sid", "block", "epoch").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most == 1 and slots.groupBy("shard").count().agg(F.min("count"), F.max("count")).first() == (500, 500)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000])
def test_permutation_is_one(spark, n):
    df = mixing.permuted(spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.lit(3).alias("k")), "id", "n", "k", 5, "y")
    assert sorted(r.y for r in df.collect()) == list(range(n))


def test_mixture_takes_what_the_plan_says(spark):
    rng = random.Random(4)
    texts = [" ".join(f"d{i}_{k}" for k in range(rng.randrange(1, 400))) for i in range(60)]
    sources = ["a" if i % 5 else "b" for i in range(60)]
    table = docs(spark, texts, sources)
    plan = {r.doc_id: r.taken for r in mixing.mix(table, block=32).collect()}
    rows = mixing.mixture(table, block=32).collect()
    seen = {}
    for r in rows:
        w = r.text.split()
        assert all(x.startswith(f"d{r.doc_id}_") for x in w) and r.n_chars == len(r.text)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + len(w)
    assert seen == {d: t for d, t in plan.items() if t}


# --- top-k ---------------------------------------------------------------------------------------------------------

def test_top_k_is_exact(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(300, 12)).round(2)
    vectors[50:120] = vectors[0]
    data = [(int(i), [float(x) for x in v], "x") for i, v in enumerate(vectors)] + [(900, None, "x"), (901, [None] * 12, "x"), (902, [float("nan")] * 12, "x"), (903, [1.0, 2.0], "x"), (904, [3.0, -1.0], "x")]
    ready = vafile.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>, id string"), "vec_id", "embedding", 256.0)
    got = {}
    for r in vafile.top_k(ready, ready.where("id % 50 = 0 OR id = 903"), 5, block_rows=64, query_rows=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = np.floor(256 * vectors).astype(int)
    for q in range(0, 300, 50):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got[903] == [(1, 904, 256 * 3 * 256 - 512 * 256)]
    few = vafile.top_k(ready, ready.where("id % 50 = 0"), 5, block_rows=64, first_reads=1)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in few.collect()} == {(q, *x) for q in got if q != 903 for x in got[q]}
    with pytest.raises(ValueError, match="64 bits"):
        vafile.top_k(vafile.quantised(spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 256.0), ready, 5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_top_k_of_repeated_ids(spark, seed):
    """Ids with equal and unlike vectors, as queries and as candidates, and more own rows than results."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [int(x) for x in rng.integers(-4, 5, 3)]) for i in rng.integers(0, 14, 40)]
    rows += [(0, [9, 0, 0]), (0, [0, 9, 0]), (0, [0, 0, 9]), (0, [9, 9, 9]), (1, [9, 9, 0]), (1, [9, 9, 0]), (60, [9, 0, 0])]
    if seed == 3:
        rows = [(0, [k, 9, 0]) for k in range(12)] + [(i, [i, 1, 0]) for i in range(1, 5)]
    frame = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = {}
    for r in vafile.top_k(frame, frame.where("id % 5 = 0"), 4, block_rows=8, query_rows=2, first_reads=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    for q in {i for i, _ in distinct if i % 5 == 0}:
        pairs = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, a in distinct if i == q for j, b in distinct if j != q)[:4]
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(pairs)]


# --- WARC ----------------------------------------------------------------------------------------------------------

def test_fixity_audit_finds_exactly_the_damage(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 7 else "b" * (i % 50)) for i in range(700)] + [(None, "u", "lost"), (3, "twice", "again")], "page_id long, url string, html string")
    ours = warc.archive_records(pages, 100)
    changed = pages.where("page_id IS NULL OR page_id <> 450").withColumn("html", F.when(F.col("page_id") == 123, "other").when(F.col("page_id") == 333, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    extra = changed.unionByName(spark.createDataFrame([(9999, "n", "n")], pages.schema))
    got = {r.record_id: r.status for r in warc.audit(ours, warc.archive_records(extra, 100)).collect()}
    assert got == {123: "changed", 333: "changed", 450: "missing", 9999: "extra"}
    assert warc.audit(ours, warc.archive_records(pages.repartition(3), 100)).count() == 0
    assert warc.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_read_warc(spark, tmp_path):
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: u{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    parts = [record(1, b"a\r\n\r\nb"), record(2, b"")]
    (tmp_path / "f.warc").write_bytes(b"".join(parts))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.record_id, r.offset, r.length, r.sha) for r in rows] == [("<urn:page:1>", 0, len(parts[0]), hashlib.sha256(parts[0]).hexdigest()), ("<urn:page:2>", len(parts[0]), len(parts[1]), hashlib.sha256(parts[1]).hexdigest())]


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [table]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
    assert all(d.columns == table.columns for d in seen[1:-1])
    kept = {r.doc_id: r.text for r in seen[1].collect()}
    assert 0.7 < len(kept) / table.count() < 1 and {r.doc_id: r.text for r in table.collect() if r.doc_id in kept} == kept
    assert seen[2].count() == len(kept)
    before, after = {r.doc_id: r.text for r in seen[2].collect()}, {r.doc_id: r.text for r in seen[3].collect()}
    ids = sorted(before)
    links = [(i, j) for i, j in combinations(range(len(ids)), 2) if before[ids[i]] == before[ids[j]] or (abs(len(before[ids[i]]) - len(before[ids[j]])) < 0.4 * len(before[ids[i]]) and jaccard(before[ids[i]], before[ids[j]]) >= 0.8)]
    assert sorted(after) == [ids[i] for i, r in enumerate(roots(len(ids), links)) if i == r]
    words = sum(len(r.text.split()) for r in seen[4].collect())
    assert abs(words - sum(len(t.split()) for t in after.values())) < 0.1 * words
    packed = seen[5].toPandas()
    sizes = packed.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | sizes.isin([1 << k for k in range(12)])).all()
