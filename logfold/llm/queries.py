"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.llm import fingerprint, licenses, linededup, manifest, mixing, packing, pii, quality, search, simhash, vafile, warc, winnowing
from logfold.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_chunks(docs).select("doc_id", F.length("text").cast("long").alias("n_kept"), F.md5("text").alias("text_md5"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def _rotted(pages: DataFrame) -> DataFrame:
    """A replica of the pages after decay: some bodies lose their end, some change it, some pages are gone."""
    end = F.when(F.col("page_id") % 97 == 13, F.expr("left(html, length(html) - 1)")).when(F.col("page_id") % 89 == 7, F.concat(F.expr("left(html, length(html) - 1)"), F.lit("?"))).otherwise(F.col("html"))
    return pages.where("page_id IS NULL OR page_id % 199 <> 50").withColumn("html", end)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(warc.archive_records(pages), warc.archive_records(_rotted(pages)))


OP4_SQL = r"""
WITH r AS (
  SELECT page_id, url, html, CASE WHEN page_id % 97 = 13 THEN left(html, length(html) - 1) WHEN page_id % 89 = 7 THEN left(html, length(html) - 1) || '?' ELSE html END AS decayed FROM pages
), b AS (
  SELECT page_id, page_id // 1000 AS file, chr(13) || chr(10) AS nl,
    'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS bytes,
    'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl || 'Content-Length: ' || strlen(decayed) || nl || nl || decayed || nl || nl AS theirs FROM r
), o AS (
  SELECT file, page_id AS record_id, strlen(bytes) AS length, sha256(bytes) AS sha_primary, CASE WHEN page_id % 199 = 50 THEN NULL ELSE sha256(theirs) END AS sha_replica,
    coalesce(sum(strlen(bytes)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM b
)
SELECT file, record_id, CASE WHEN sha_replica IS NULL THEN 'missing' ELSE 'changed' END AS status, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, sha_primary, sha_replica
FROM o WHERE sha_replica IS NULL OR sha_primary <> sha_replica
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs)).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return vafile.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
) WHERE rank <= 5
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: Lower case of A to Z alone, and the words of the contract; text functions of both engines know more letters.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), known AS (
  SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM known
), places AS (
  SELECT rn, s, n, array_to_string(w[s : s + n - 1], ' ') AS words FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN lengths ON len(w) >= n)
), met AS (SELECT rn, s, n, item FROM places JOIN known USING (n, words)
), hit AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS pos FROM met) GROUP BY rn
), found AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM met) GROUP BY rn
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN found USING (rn)
"""


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaves = manifest.leaves_of(table(spark, sf_dir, "documents"), n_chars=F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    found = manifest.fold(manifest.build(leaves))
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _crc_sql(text: str) -> str:
    """CRC-32 of ASCII digits, bit by bit."""
    bit = lambda x: f"CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384::BIGINT) ELSE {x} // 2 END"
    step = f"list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {bit('x')})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER () AS rn, doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS now FROM documents
), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS pos FROM r
), t AS (
  SELECT lang, 0 AS level, pos, leaf AS digest FROM o
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM t) WHERE n > 1 GROUP BY lang, level, pos // 2
), sub AS (SELECT lang, max(level) AS top, arg_max(digest, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t GROUP BY lang
), f AS (
  SELECT 0 AS level, pos, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM f) WHERE n > 1 GROUP BY level, pos // 2
), nodes AS (
  SELECT s.lang, t.level, t.pos, t.digest FROM t JOIN sub s ON t.lang IS NOT DISTINCT FROM s.lang WHERE t.level < s.top
  UNION ALL
  SELECT s.lang, s.top + f.level, f.pos, f.digest FROM f, sub s WHERE f.level < (SELECT max(level) FROM f)
), climb AS (
  SELECT o.rn, o.lang, 0 AS level, o.pos, s.top, s.pos AS tree, o.now AS digest, '' AS siblings, s.top + (SELECT max(level) FROM f) AS height FROM o JOIN sub s ON o.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT c.rn, c.lang, c.level + 1, CASE WHEN c.level + 1 = c.top THEN c.tree ELSE c.pos // 2 END, c.top, c.tree,
    sha256(CASE WHEN x.digest IS NULL THEN c.digest WHEN x.pos > c.pos THEN c.digest || x.digest ELSE x.digest || c.digest END), c.siblings || coalesce(x.digest, ''), c.height
  FROM (SELECT rn, lang, level, CASE WHEN level = 0 AND top = 0 THEN tree ELSE pos END AS pos, top, tree, digest, siblings, height FROM climb) c
  LEFT JOIN nodes x ON x.lang IS NOT DISTINCT FROM c.lang AND x.level = c.level AND x.pos = xor(c.pos, 1) WHERE c.level < c.height
)
SELECT o.doc_id, o.leaf, s.subroot, (SELECT arg_max(digest, level) FROM f) AS root, sha256(c.siblings) AS proof_sha256, c.digest AS folded_root, c.digest = (SELECT arg_max(digest, level) FROM f) AS verified
FROM climb c JOIN o USING (rn) JOIN sub s ON o.lang IS NOT DISTINCT FROM s.lang WHERE c.level = c.height
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.index_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 50)


OP13_SQL = rf"""
WITH p AS (
  SELECT rn, doc_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
), tf AS (SELECT rn, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM p GROUP BY rn, term
), sizes AS (SELECT rn, count(*) AS n FROM p GROUP BY rn
), whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs
), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT q.item_id, tf.rn, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + ((50 * sizes.n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN sizes ON sizes.rn = tf.rn, whole GROUP BY q.item_id, tf.rn, tf.doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scored WHERE score > 0
) WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_pii, op2_line_dedup, op3_fingerprints, op4_warc_fixity, op5_license_scan, op6_packing, op7_mixing, op8_topk, op9_simhash, op10_quality, op11_decontamination, op12_manifest, op13_search)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_fixity": OP4_SQL, "op8_topk": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_manifest": OP12_SQL, "op13_search": OP13_SQL}
