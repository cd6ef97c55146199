"""Queries over log lines rendered from the events table: ingestion, templates, slots, schema ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.operators import templates
from logfold.sources import logs

SYSTEM = "svc"
MASKS = [*templates.MASKS[:1], ("TEXT", r"\b[uP][0-9]+\b"), *templates.MASKS[1:]]

#: The line of an event, in SQL that both engines read alike: five kinds at sixty sites, some with a word or a path in it
#: that only mining can tell from the rest.
SITE = "concat('gw', translate(CAST(user_id % 60 AS STRING), '0123456789', 'abcdefghij'))"
LINE = f"""concat({SITE}, CASE event_type
 WHEN 'view' THEN concat(' gateway network event connection allowed from 10.0.', user_id % 250, '.', event_id % 250, ' to 192.0.2.', event_id % 20, ' destination port ', 400 + event_id % 60)
 WHEN 'click' THEN concat(' gateway network event connection denied from 10.1.', user_id % 250, '.', event_id % 250, ' to 192.0.2.', event_id % 20, ' destination port ', 8000 + event_id % 90, ' by rule')
 WHEN 'signup' THEN concat(' gateway auth event login succeeded for user u', user_id, ' from 10.2.', user_id % 250, '.', event_id % 250, ' using password')
 WHEN 'error' THEN concat(' gateway auth event login failed for user u', user_id, ' from 10.3.', user_id % 250, '.', event_id % 250, ' using method ', CASE event_id % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'token' ELSE 'certificate' END)
 ELSE concat(' gateway audit event administrator u', user_id, ' updated policy P', event_id % 40, ' in C:', chr(92), 'Events', chr(92), '(x') END)"""
MASKED_SQL = rf"regexp_replace(regexp_replace(regexp_replace(text, '{MASKS[0][1]}', '<VAR:IPV4>', 'g'), '{MASKS[1][1]}', '<VAR:TEXT>', 'g'), '{MASKS[2][1]}', '<VAR:NUMBER>', 'g')"
EVENTS_CTE = f"ev AS (SELECT event_id AS ord, user_id, event_type, {LINE} AS text FROM events)"
#: Masked lines of one kind and site are alike; where they differ, it is in the word behind "method".
ASSIGNED_CTE = f"""{EVENTS_CTE}, m0 AS (SELECT *, {MASKED_SQL} AS masked FROM ev), m1 AS (SELECT *, min(masked) OVER (PARTITION BY event_type, user_id % 60) <> max(masked) OVER (PARTITION BY event_type, user_id % 60) AS opened FROM m0),
 m AS (SELECT *, CASE WHEN opened THEN regexp_replace(masked, 'method (password|token|certificate)', 'method <VAR:TEXT>') ELSE masked END AS template FROM m1), a AS (SELECT *, 'cluster-' || substr(sha256('{SYSTEM}' || chr(0) || template), 1, 16) AS cluster_id FROM m)"""
LIKENED_CTE = f"{ASSIGNED_CTE}, lk AS (SELECT ord, text, template, cluster_id FROM a)"
CLUSTERS_CTE = f"{ASSIGNED_CTE}, cl AS (SELECT cluster_id, template, count(*) AS event_count, min(ord) AS first FROM a GROUP BY ALL)"
SLOTS_CTE = f"""{CLUSTERS_CTE}, sl0 AS (SELECT cluster_id, template, unnest(regexp_extract_all(template, '<VAR:([A-Z0-9_]+)>', 1)) AS label, generate_subscripts(regexp_extract_all(template, '<VAR:([A-Z0-9_]+)>', 1), 1) AS pos FROM cl),
 sl AS (SELECT cluster_id, template, 'p' || pos AS slot_id, pos, label, '<VAR:' || label || '>' AS placeholder, row_number() OVER (PARTITION BY cluster_id, label ORDER BY pos) AS occurrence FROM sl0)"""
VALUES_CTE = f"""{SLOTS_CTE}, tk AS (SELECT cluster_id, ord, list_filter(list_transform(list_zip(string_split(template, ' '), string_split(text, ' ')), lambda z: CASE WHEN z[1] LIKE '<VAR:%' THEN z[2] END), lambda v: v IS NOT NULL) AS vals FROM a),
 cap AS (SELECT cluster_id, ord, 'p' || i AS slot_id, vals[i] AS value FROM tk, (SELECT unnest(range(1, 10)) AS i) WHERE i <= len(vals)),
 fv AS (SELECT cluster_id, slot_id, value, min(ord) AS first FROM cap GROUP BY ALL),
 sv AS (SELECT * FROM (SELECT cluster_id, slot_id, value, row_number() OVER (PARTITION BY cluster_id, slot_id ORDER BY first, value) AS rank FROM fv) WHERE rank <= 5)"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), "user_id", "event_type", F.expr(LINE).alias("text"))


def mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return templates.mine_templates(rendered(spark, sf_dir), SYSTEM, MASKS)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("source_file"), F.posexplode(F.split("text", "\n", -1)).alias("n", "text")).select("source_file", (F.col("n") + 1).alias("line_number"), "text")


def src_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.as_events(document_lines(spark, sf_dir)).select("source_file", F.col("line_number").cast("long").alias("line_number"), F.md5("text").alias("line_md5"))


def src_input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("source").alias("source_file"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return logs.input_counts(logs.as_events(lines), docs.select(F.col("source").alias("source_file")).distinct())


def src_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_lines(document_lines(spark, sf_dir), 3).select("source_file", F.col("line_number").cast("long").alias("line_number"), F.length("text").cast("long").alias("n"))


def src_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return logs.json_field(events, "k", "props").select("event_id", "text")


def src_gold_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mined(spark, sf_dir)[1]
    return logs.aligned(found.select("ord", "cluster_id"), rendered(spark, sf_dir), "ord", "event_type")


def src_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.table_digest(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"))


def src_row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order of their keys beside the segments of customers in order of their names, place by place."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return logs.aligned_by_row(customers.select("c_custkey"), customers.select("c_name", "c_mktsegment"), "c_custkey", "c_name", "c_mktsegment")[0]


def src_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a customer of that number, and customers without an event."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("id")).distinct()
    return logs.aligned_violations(users, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id")), "id")


def clu_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.distinct_patterns(rendered(spark, sf_dir), MASKS).withColumnRenamed("first", "first_ord")


def clu_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir)[0].withColumnRenamed("first", "first_ord")


def clu_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that differ in one word share a template with a TEXT slot for it."""
    return mined(spark, sf_dir)[0].select("cluster_id", "template", "event_count")


def clu_mined_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir)[1].select("ord", "cluster_id")


def clu_mined_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_slots(mined(spark, sf_dir)[0])


def clu_mined_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, assigned = mined(spark, sf_dir)
    return templates.slot_values(assigned, clusters=clusters)


def clu_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir)[1].select("ord", "cluster_id")


def clu_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.sample_evenly(mined(spark, sf_dir)[1], ["cluster_id"], "ord", 7).select("cluster_id", "ord", "text")


def clu_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract_slots(mined(spark, sf_dir)[0])


def clu_slot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, assigned = mined(spark, sf_dir)
    return templates.slot_values(assigned, clusters=clusters)


def clu_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.build_summary(mined(spark, sf_dir)[0], MASKS)


QUERIES = [src_clean_lines, src_input_counts, src_first_lines, src_json_field, src_gold_alignment, src_row_alignment, src_unaligned, src_table_digest, clu_patterns, clu_templates, clu_mined, clu_mined_assignments, clu_mined_slots, clu_mined_values, clu_assignments, clu_representatives, clu_slots, clu_slot_values, clu_summary]

_LINES = "ln AS (SELECT doc_id AS source_file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)"
ORACLE = {
    "src_clean_lines": rf"WITH {_LINES} SELECT source_file, line_number, md5(regexp_replace(text, '^\x{{FEFF}}', '')) AS line_md5 FROM ln WHERE regexp_matches(text, '\S')",
    "src_input_counts": r"""WITH ln AS (SELECT source, unnest(string_split(text, chr(10))) AS t FROM documents), c AS (SELECT source, count(*) AS n FROM ln WHERE regexp_matches(t, '\S') GROUP BY 1)
 SELECT d.source AS source_file, CAST(coalesce(n, 0) AS BIGINT) AS event_count FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN c USING (source)""",
    "src_first_lines": f"WITH {_LINES} SELECT source_file, line_number, length(text) AS n FROM ln WHERE line_number <= 3",
    "src_json_field": "SELECT event_id, json_extract_string(props, '$.k') AS text FROM events",
    "src_gold_alignment": f"WITH {ASSIGNED_CTE} SELECT ord, cluster_id, event_type FROM a",
    "clu_patterns": f"WITH {ASSIGNED_CTE} SELECT masked, count(*) AS n, min(ord) AS first_ord FROM a GROUP BY 1",
    "clu_templates": f"WITH {CLUSTERS_CTE} SELECT cluster_id, template, event_count, first AS first_ord FROM cl",
    "src_row_alignment": "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer), b AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_name) AS p FROM customer) SELECT c_custkey, c_mktsegment FROM a JOIN b USING (p)",
    "src_unaligned": "WITH u AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id FROM events), c AS (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer) SELECT id, 'left' AS side FROM u ANTI JOIN c USING (id) UNION ALL SELECT id, 'right' FROM c ANTI JOIN u USING (id)",
    "src_table_digest": """WITH s AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer)
 SELECT count(*) AS n_rows, sha256(""" + " || ':' || ".join(f"CAST(sum(CAST(('0x' || substr(h, {15 * i + 1}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4)) + ") AS fingerprint FROM s",
    "clu_mined": f"WITH {LIKENED_CTE} SELECT cluster_id, template, count(*) AS event_count FROM lk GROUP BY ALL",
    "clu_mined_assignments": f"WITH {LIKENED_CTE} SELECT ord, cluster_id FROM lk",
    "clu_mined_slots": f"""WITH {LIKENED_CTE}, t AS (SELECT DISTINCT cluster_id, template FROM lk), s AS (SELECT cluster_id, unnest(regexp_extract_all(template, '<VAR:([A-Z0-9_]+)>', 1)) AS label, generate_subscripts(regexp_extract_all(template, '<VAR:([A-Z0-9_]+)>', 1), 1) AS pos FROM t)
 SELECT cluster_id, 'p' || pos AS slot_id, CAST(pos AS INTEGER) AS pos, label, '<VAR:' || label || '>' AS placeholder, CAST(row_number() OVER (PARTITION BY cluster_id, label ORDER BY pos) AS INTEGER) AS occurrence FROM s""",
    "clu_mined_values": f"""WITH {LIKENED_CTE}, t AS (SELECT cluster_id, ord, list_filter(list_transform(list_zip(string_split(template, ' '), string_split(text, ' ')), lambda z: CASE WHEN z[1] LIKE '<VAR:%' THEN z[2] END), lambda v: v IS NOT NULL) AS vals FROM lk),
 c AS (SELECT cluster_id, 'p' || i AS slot_id, vals[i] AS value, min(ord) AS first FROM t, (SELECT unnest(range(1, 10)) AS i) WHERE i <= len(vals) GROUP BY ALL)
 SELECT * FROM (SELECT cluster_id, slot_id, CAST(row_number() OVER (PARTITION BY cluster_id, slot_id ORDER BY first, value) AS INTEGER) AS rank, value FROM c) WHERE rank <= 5""",
    "clu_assignments": f"WITH {ASSIGNED_CTE} SELECT ord, cluster_id FROM a",
    "clu_representatives": f"""WITH {ASSIGNED_CTE}, p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) - 1 AS last FROM a)
 SELECT cluster_id, ord, text FROM p WHERE last < 7 OR i IN (SELECT CAST(round_even(k * last / 6.0, 0) AS BIGINT) FROM range(0, 7) t(k))""",
    "clu_slots": f"WITH {SLOTS_CTE} SELECT cluster_id, slot_id, CAST(pos AS INTEGER) AS pos, label, placeholder, CAST(occurrence AS INTEGER) AS occurrence FROM sl",
    "clu_slot_values": f"WITH {VALUES_CTE} SELECT cluster_id, slot_id, CAST(rank AS INTEGER) AS rank, value FROM sv",
    "clu_summary": f"WITH {CLUSTERS_CTE} SELECT CAST(sum(event_count) AS BIGINT) AS event_count, count(*) AS cluster_count, CAST(sum(CASE WHEN template LIKE '%<VAR:%' THEN 1 ELSE 0 END) AS BIGINT) AS slot_clusters, '{';'.join(f'{n}={p}' for n, p in MASKS)}' AS masks FROM cl",
}
