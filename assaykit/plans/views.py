"""Views over the driver's tables that stand for model answers, pools, listings and notices.

Their SQL runs in Spark and in DuckDB alike, so queries and oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaykit import labels as L
from assaykit.shared import dealt

GIVEN = ",".join((*L.VALID, "12", L.UNANSWERABLE, L.UNCERTAIN, "7"))
PREDICTED = ",".join((*L.VALID, *L.RETIRED, L.UNANSWERABLE))
GOLD = ",".join((*L.VALID, L.UNANSWERABLE))

#: Model answers from events: item = user, model = event type, run = how often that model met the item.
ANSWERS = f"""
SELECT event_id, user_id AS item, event_type AS model_key, ts AS started_at,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run,
  split_part('{PREDICTED}', ',', CAST(1 + CAST(floor(abs(value)) AS BIGINT) % 10 AS INT)) AS said,
  split_part('{GOLD}', ',', CAST(1 + user_id % 8 AS INT)) AS gold,
  CAST(1001 + (user_id * 37) % 8000 AS VARCHAR(9)) AS gold_heading,
  CAST(floor(abs(value) * 100) AS BIGINT) AS latency_ms,
  event_id % 17 = 0 AS errored, event_id % 13 = 0 AS garbled,
  700 + event_id % 50 AS tokens_in, 100 + event_id % 30 AS tokens_out, event_id % 7 AS cached_tokens_in
FROM {{events}}
"""

RESPONSES = f"""
SELECT a.*,
  CASE WHEN garbled THEN 'I can not tell.' ELSE
    'SLAB: ' || said || CASE WHEN event_id % 3 = 0 THEN '%' ELSE '' END || chr(10) || 'HSN: ' || heading || chr(10)
    || 'ANSWERABLE: ' || CASE WHEN said = 'UNANSWERABLE' THEN 'no' ELSE 'yes' END || chr(10) || 'WHY: entry ' || heading
    || CASE WHEN event_id % 4 = 0 THEN ' which was 12% earlier' WHEN event_id % 4 = 1 THEN ' attracts 28 per cent' ELSE '' END
  END AS text
FROM (SELECT b.*, CASE WHEN event_id % 3 = 0 THEN gold_heading WHEN event_id % 3 = 1 THEN substr(gold_heading, 1, 2) || '99' ELSE '7777' END AS heading FROM ({ANSWERS}) b) a
"""

#: What scoring must find, from the view's own columns.
SCORES = f"""
SELECT *, errored OR garbled AS void,
  NOT (errored OR garbled) AND said = gold AS label_ok,
  NOT (errored OR garbled) AND heading = gold_heading AS heading_ok,
  NOT (errored OR garbled) AND substr(heading, 1, 2) = substr(gold_heading, 1, 2) AS chapter_ok,
  NOT (errored OR garbled) AND (said = 'UNANSWERABLE') = (gold = 'UNANSWERABLE') AS abstain_ok,
  CASE WHEN NOT (errored OR garbled) AND said IN ('12', '28') THEN said END AS retired,
  NOT garbled AND said = '12' AND event_id % 3 = 0 AND event_id % 4 <> 0 AS cites12,
  NOT garbled AND (event_id % 4 = 1 OR (said = '28' AND event_id % 3 = 0 AND event_id % 4 <> 0)) AS cites28,
  CASE WHEN NOT (errored OR garbled) THEN said END AS predicted
FROM ({RESPONSES}) r
"""

MODELS = """
SELECT model_key, CAST(length(model_key) % 4 AS DOUBLE) AS usd_in_per_m, CAST(3 * (length(model_key) % 4) AS DOUBLE) AS usd_out_per_m, '' AS note
FROM (SELECT DISTINCT event_type AS model_key FROM {events}) m
"""

#: The text pool: documents, with a state from the language, a brief and a rate in some of them.
POOL = """
SELECT doc_id, text, lang, source, doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END AS state
FROM {documents}
"""

LABELLED = f"""
SELECT 'gst-' || lpad(CAST(doc_id % 9000 - doc_id % 9000 % 2 * (doc_id % 3) AS VARCHAR(9)), 4, '0') || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END AS id, doc_id AS pos,
  CASE WHEN doc_id % 23 = 0 THEN '  ' ELSE text || CASE WHEN doc_id % 19 = 0 THEN ' and Whiskies' ELSE '' END END AS input,
  split_part('{GIVEN}', ',', CAST(1 + doc_id % 11 AS INT)) AS label,
  doc_id % 5 <> 0 AS answerable,
  CASE WHEN doc_id % 6 = 0 THEN 'reason=rate-fact-absent; seen' WHEN doc_id % 6 = 1 THEN 'reason=other' ELSE 'none' END AS labeller_notes,
  split_part('typical,hard,long_context,adversarial,out_of_scope,other', ',', CAST(1 + doc_id % 6 AS INT)) AS difficulty,
  CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '12345' ELSE '1905' END AS heading,
  CASE WHEN doc_id % 3 = 0 THEN 'off' WHEN doc_id % 3 = 1 THEN '' ELSE 'web' END AS source,
  CASE WHEN doc_id % 8 = 0 THEN ' ' ELSE 'because' END AS justification,
  split_part('human,model-first-pass,human-reviewed,gazette-derived,robot', ',', CAST(1 + doc_id % 5 AS INT)) AS labelled_by,
  CASE WHEN doc_id % 31 = 0 THEN 'gst-' || lpad(CAST((doc_id * 7) % 9000 AS VARCHAR(9)), 4, '0') END AS deprecated_by
FROM {{documents}}
"""

def view(spark: SparkSession, sf_dir: str, sql: str, key: str | None = None) -> DataFrame:
    """The view's rows; with a key, the tables' rows are dealt by it before."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "documents", "part") if "{" + t + "}" in sql}
    if key:
        tables = {t: dealt(df, key) for t, df in tables.items()}
    return spark.sql(sql, **tables)


def oracle(sql: str) -> str:
    return sql.replace("{events}", "events").replace("{documents}", "documents").replace("{part}", "part")
