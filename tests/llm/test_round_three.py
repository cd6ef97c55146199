"""Winnowed decontamination, the midstate manifest and ranked search against brute force; defined cases of each."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logfold.llm import manifest, search, winnowing

LOW = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"word{i % 5000} next{i}" for i in range(60_000))
#: Working names of the operators, and others that callers might use.
CLASHING = ["row", "h", "k", "has_id", "n", "at", "tree", "leaf", "now", "part", "number", "hits", "n_words", "item", "items", "spans", "shard", "ids", "terms", "df", "score", "rank", "a.b", "with space"]


def with_extras(df):
    return df.select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, ids with several texts, clashing names."""
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, LONG + " " + passage, "en", "s", 9), (3, LONG + " " + passage, "en", "s", 9), (4, "one two three", "de", None, 1), (4, "another text with one two", "de", "s", 1),
        (5, "A-b C; " + passage.upper() + " tail", None, "s", 2), (None, "no id " + passage, "fr", "s", 3), (None, "no id " + passage, "fr", "s", 3), (None, None, None, None, None), (6, "Ärger über ÉTÉ 42", "é", "s", 5), (35, "ends " + " ".join(passage.split()[:9]), "en", "s", 7),
    ]
    return with_extras(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).cache()


@pytest.fixture(scope="module")
def items(spark):
    passage = " ".join(f"bench{i}" for i in range(14))
    rows = [(1, passage), (1, "two three"), (2, passage + " and more"), (3, None), (4, ""), (5, "one two"), (5, "one two"), (None, "ärger"), (7, "unseen words only here"), (8, "(!)")]
    return with_extras(spark.createDataFrame(rows, "item_id long, text string")).cache()


# --- decontamination -----------------------------------------------------------------------------------------------

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def plain_overlaps(docs, items, window):
    known = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    lengths, out = {len(k) for k in known}, []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if of := known.get(tuple(w[s : s + n])):
                    hit, found = hit | set(range(s, s + n)), found | of
        out.append((str(doc_id), len(w), len(hit), sorted(found)))
    return sorted(out)


def overlaps(docs, items, **kw):
    found = winnowing.overlaps(docs, items, **kw).collect()
    assert all(sum(s.end - s.first for s in r.spans) == r.n_hit and all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False)) for r in found)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found)


def test_overlaps_of_odd_rows(odd, items):
    want = plain_overlaps(odd.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 10)
    assert overlaps(odd, items) == want and [r for r in want if r[0] == "5"][0][2] == 14
    assert overlaps(odd.limit(0), items) == [] and all(r[2] == 0 for r in overlaps(odd, items.limit(0)))
    got = winnowing.digest(winnowing.overlaps(odd, items)).collect()
    assert {(str(r.doc_id), r.n_items, r.items_sha256) for r in got} == {(d, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for d, _, _, i in want}


@pytest.mark.parametrize(("window", "gram"), [(10, 6), (4, 2), (1, 1)])
def test_overlaps_of_random_words(spark, window, gram):
    rng = np.random.default_rng(window)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 6, n))
    items = [(i, text(int(rng.integers(0, 14)))) for i in range(25)]
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(30)]
    docs += [(30 + i, text(7) + " " + t + " " + text(7)) for i, t in items]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert overlaps(frame, spark.createDataFrame(items, "item_id long, text string"), window=window, gram=gram) == plain_overlaps(docs, items, window)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=10, max_size=10), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_texts_that_share_a_window_keep_a_common_gram(a, shared, b, c):
    """The guarantee of winnowing, for every place of the shared words."""
    def kept(words):
        known = winnowing._Hashes()
        hashes = np.array([known[b"%d" % w] for w in words], np.uint64)
        return {(int(g), int(p)) for p, g in zip(*winnowing.winnowed(hashes, np.zeros(len(words), int), 10, 6), strict=True)}

    one, two = kept([*a, *shared, *b]), kept([*c, *shared])
    assert {(g, p - len(a)) for g, p in one if 0 <= p - len(a) <= 4} & {(g, p - len(c)) for g, p in two if 0 <= p - len(c) <= 4}


def test_clean_keeps_rows_and_columns(odd, items):
    left = winnowing.clean(odd, items.where("item_id = 2"))
    assert left.columns == odd.columns and all(r[c] == f"x{k}" for r in left.collect() for k, c in enumerate(CLASHING))
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "4", "4", "None", "6", "35"])


# --- manifest ------------------------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_manifest(rows, fanout):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(one(r[c]) for c in manifest.FIELDS))
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rs in trees.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    levels = {t: plain_levels([leaf(r) for r in trees[t]], fanout) for t in names}
    top, out = plain_levels([levels[t][-1][0] for t in names], fanout), []
    for ti, t in enumerate(names):
        for i, r in enumerate(trees[t]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            now, siblings = leaf({**r, "n_chars": r["n_chars"] + 1} if tampered else r), ""
            for tree, at in ((levels[t], i), (top, ti)):
                for level in tree[:-1]:
                    first = at - at % fanout
                    run = level[first : first + fanout]
                    left, right = run[: at - first], run[at - first + 1 :]
                    siblings, now, at = siblings + "".join(left + right), sha("".join([*left, now, *right])), at // fanout
            out.append((str(r["doc_id"]), leaf(r), levels[t][-1][0], top[-1][0], sha(siblings), now))
    return sorted(out)


def folded(docs, fanout=2, block=4096):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaves = manifest.leaves_of(docs, n_chars=F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded) for r in manifest.fold(manifest.build(leaves, fanout, block)).collect())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=64, max_size=64), min_size=1, max_size=6), st.integers(0, 5))
def test_states_resume_as_the_digest_of_the_whole(blocks, at):
    """A state copied behind any number of blocks goes on to the digest that the standard library gives."""
    words = lambda b: np.frombuffer(b, ">u4").astype(np.uint32)[:, None]
    state = manifest._constants()[0]
    for b in blocks[:at]:
        state = manifest.compressed(state, words(b))
    copied = manifest._lanes(manifest._bytes(state))
    for b in blocks[at:]:
        copied = manifest.compressed(copied, words(b))
    assert manifest._bytes(manifest.closed(copied, len(blocks))).hex() == hashlib.sha256(b"".join(blocks)).hexdigest()


@pytest.mark.parametrize(("fanout", "block"), [(2, 4096), (2, 4), (3, 9)])
def test_manifest_matches_plain_trees(spark, fanout, block):
    rows = [(i * 3 % 151, f"text {i}" * (i % 5), [None, "en", "de", "é"][min(3, i % 13)], "s" if i % 4 else None, i if i % 6 else None) for i in range(151)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = plain_manifest([r.asDict() for r in frame.collect()], fanout)
    assert folded(frame.repartition(5), fanout, block) == want
    assert 0 < sum(w[5] != w[3] for w in want) < len(want)


def test_manifest_of_odd_rows(odd):
    assert folded(odd) == plain_manifest([r.asDict() for r in odd.select(*manifest.FIELDS).collect()], 2)
    assert folded(odd.limit(0)) == []
    assert folded(odd.where("doc_id = 2"))[0][4] == sha("")  # a lone leaf has no siblings


def test_proof_alone_tells_an_unchanged_leaf(spark):
    """What the manifest keeps for a leaf, states and siblings, gives the root back; another leaf does not."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    same = manifest.fold(manifest.build(manifest.leaves_of(docs))).collect()
    assert all(r.folded == r.root for r in same)
    other = manifest.fold(manifest.build(manifest.leaves_of(docs, text=F.when(F.col("doc_id") == 4, "changed").otherwise(F.col("text"))))).collect()
    assert {r.doc_id for r in other if r.folded != r.root} == {4} and {r.root for r in same} == {r.root for r in other}


# --- ranked search -------------------------------------------------------------------------------------------------

def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def plain_search(docs, items, k):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n, length, df = len(found), sum(s for *_, s in found), Counter(t for _, c, _ in found for t in c)
    asked, out = {}, []
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    for item, terms in asked.items():
        scored = []
        for d, c, own in found:
            m = 100 - 50 + (50 * own * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0, d, score))
        out += [(str(item), i + 1, str(d), s) for i, (*_, d, s) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out)


def ranked(docs, items, k, **kw):
    return sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in search.search(search.index_of(docs, **kw), items, k).collect())


@pytest.mark.parametrize(("k", "shard"), [(3, 8192), (3, 7), (50, 16)])
def test_search_matches_brute_force(spark, k, shard):
    rng = np.random.default_rng(k)
    text = lambda n: " ".join(f"t{int(x)}" for x in rng.zipf(1.4, n) % 60)
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in rng.integers(0, 120, 150)] + [(900 + i, "t1 t2 t3") for i in range(20)]
    items = [(i, text(int(rng.integers(0, 9)))) for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ranked(frame, spark.createDataFrame(items, "item_id long, text string"), k, shard_docs=shard) == plain_search(docs, items, k)


def test_search_of_odd_rows(odd, items):
    assert ranked(odd, items, 5) == plain_search(odd.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 5)
    assert ranked(odd.limit(0), items, 5) == [] and ranked(odd, items.limit(0), 5) == []


def test_no_accumulator_is_made_once_bounds_are_too_low():
    """A common term last cannot lift a new document over the k-th partial score: only the documents met before are updated."""
    rare, common = b"rare", b"common"
    found = [{rare: 3, common: 1}] * 3 + [{common: 5}] * 400
    row = search._shard(0, list(range(len(found))), found)[0]
    length = sum(sum(c.values()) for c in found)
    shard = search.Shard(*row[1:], len(found), length)
    docs, scores = shard.best([(rare, 5000), (common, 3)], 3, 1)
    assert docs.tolist() == [0, 1, 2] and len(set(scores.tolist())) == 1
    every = shard.best([(rare, 5000), (common, 3)], 403, 1)
    assert len(every[0]) == 403 and every[1][0] == scores[0]


def test_shards_of_equal_ids_are_not_taken_for_one(spark):
    """Rows that repeat their ids in several shards (here in one task) count with the terms of their own shard."""
    docs = [(i, f"t{part} t{part + i} common") for part in range(4) for i in range(6)] + [(None, f"t{n} other") for n in range(12)]
    items = [(i, f"t{i} common other") for i in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert ranked(frame, spark.createDataFrame(items, "item_id long, text string"), 9, shard_docs=6) == plain_search(docs, items, 9)


def test_a_shard_to_be_holds_numbers_not_objects(spark, monkeypatch):
    """What a task holds while it fills a shard: less than 64 bytes a posting, besides the terms."""
    n, words = 2000, 120
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"t%d" % x for x in rng.choice(3000, words, replace=False)) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])

    class Docs:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    monkeypatch.setattr(search, "written", lambda run, **options: run)
    run = search.index_of(Docs())
    tracemalloc.start()
    try:
        shards = [len(b.column("docs")[0].as_py()) // 4 for b in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert shards == [n * words] and peak < 64 * n * words
