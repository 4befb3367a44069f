"""Records: last and first wins, statistics, JSON, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import asof, records
from plumbline.plans.registry import query
from plumbline.session import load


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def last_wins_dedup(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return asof.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT user_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_non_null(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"))
    return records.first_value(rows, ["user_id"], "value", ["event_id"])


@query("SELECT count(*) AS num_rows, count(DISTINCT epoch_us(ts)) AS num_timestamps, count(DISTINCT user_id) AS num_uids, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts FROM events")
def provider_stats(spark, sf_dir):
    return records.provider_stats(load(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id"), "ts", "user_id")


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) || '.5' END AS DOUBLE) AS x FROM events")
def float_or_none(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, "").when(i % 4 == 1, "n/a").otherwise(F.concat(i.cast("string"), F.lit(".5")))
    return load(spark, sf_dir, "events").select("event_id", records.float_or_null(text).alias("x"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_scan(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT conv_id, arg_min(text, turn) AS text FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def first_turn(spark, sf_dir):
    return records.first_value(load(spark, sf_dir, "conversations"), ["conv_id"], "text", ["turn", "text"])


@query("SELECT user_id, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def tally(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


@query(r"""SELECT page_id, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS stem, printf('%06d', page_id) AS padded, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number FROM pages""")
def path_parts(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1).alias("stem"), F.format_string("%06d", "page_id").alias("padded"), F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long").alias("number"))


@query(r"""
SELECT doc_id, CASE WHEN len(ws) = 0 THEN '' ELSE list_reduce(ws, lambda a, w: CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 40 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS lines
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
""")
def word_wrap(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(records.wrap(F.col("text"), 40), "\n").alias("lines"))
