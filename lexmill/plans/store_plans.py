"""Queries on keyed tables and streams; the order tables stand for tasks, reports and versions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import store
from lexmill.session import table
from lexmill.sources.readers import json_from_model
from lexmill.streaming import ingest

NOW = "1997-01-01 00:00:00"


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return store.latest(orders, "o_custkey", "o_orderdate", "o_orderkey")


def lateral_top1(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return store.last_children(customers, table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus"])


def retention_active(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that weren't expired at the time; open ones have no expiry of their own."""
    orders = table(spark, sf, "orders").withColumn("expires_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(30))))
    return orders.filter(store.expires(F.col("expires_at"), F.col("o_orderdate")) > F.to_timestamp_ntz(F.lit(NOW))).select("o_orderkey")


def retention_expired(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("expires_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.make_dt_interval(F.lit(30))))
    return ingest.retention_sweep(orders, NOW, "expires_at", "o_orderdate").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def id_set_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return store.id_differences(orders, lines, "id")


def pair_combinations(spark: SparkSession, sf: str) -> DataFrame:
    return store.pairs_within(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def overlay_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return store.merge_fields(customers, stored, "c_custkey", ["c_mktsegment"])


def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = orders.filter("o_orderpriority = '1-URGENT'").drop("o_orderpriority").withColumn("o_orderstatus", F.lit("N"))
    return store.upsert(orders.drop("o_orderpriority"), new, "o_orderkey")


def next_version(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("version"))
    return store.next_version(lines, table(spark, sf, "orders"), "o_orderkey")


def optimistic_lock(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linenumber").alias("revision"))
    changes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 + 1).alias("base_revision"))
    return store.optimistic(state, changes, "id").groupBy("accepted").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.delete_cascade(table(spark, sf, "lineitem"), gone, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """The number in each kind's JSON, from text that says more before and after it."""
    said = F.concat(F.lit("Here it is: ```json "), "props", F.lit(" ``` as asked {"))
    value = F.try_variant_get(json_from_model(said), "$.k", "long")
    return table(spark, sf, "events").withColumn("k", value).groupBy("event_type").agg(F.count("k").alias("n_parsed"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"), F.count("*").alias("n"))


def debounce_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.debounce(table(spark, sf, "events"), "user_id", "ts", "30 minutes")


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.drain(ingest.fingerprint_stream(ingest.stream_of(spark, f"{sf}/documents.parquet")), "fingerprints")


QUERIES = {f.__name__: f for f in (latest_version, lateral_top1, retention_active, retention_expired, id_set_diff, pair_combinations, overlay_coalesce, keyed_upsert, next_version, optimistic_lock, delete_cascade, json_props, debounce_sessions, stream_dedupe)}

EXPIRY = "coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END, o_orderdate + INTERVAL 7 DAY)"
SQL = {
    "latest_version": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "lateral_top1": "SELECT c_custkey AS o_custkey, c_name, o_orderdate, o_orderkey, o_orderstatus FROM customer LEFT JOIN LATERAL (SELECT * FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true",
    "retention_active": f"SELECT o_orderkey FROM orders WHERE {EXPIRY} > TIMESTAMP '{NOW}'",
    "retention_expired": f"SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders WHERE {EXPIRY} <= TIMESTAMP '{NOW}' GROUP BY 1",
    "id_set_diff": "WITH e AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F') SELECT id, 'missing' AS side FROM e ANTI JOIN a USING (id) UNION ALL SELECT id, 'unexpected' FROM a ANTI JOIN e USING (id)",
    "pair_combinations": "SELECT DISTINCT x.l_orderkey, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_linenumber < y.l_linenumber",
    "overlay_coalesce": "WITH s AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS p FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN s USING (c_custkey)",
    "keyed_upsert": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "next_version": "SELECT o_orderkey, (coalesce(max(l_linenumber), 0) + 1)::BIGINT AS next_version FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "optimistic_lock": "WITH s AS (SELECT l_orderkey AS id, max(l_linenumber) AS r FROM lineitem GROUP BY 1) SELECT coalesce(o_orderkey % 4 + 1 = r, false) AS accepted, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders LEFT JOIN s ON id = o_orderkey GROUP BY 1",
    "delete_cascade": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "json_props": "WITH e AS (SELECT event_type, (props->>'k')::BIGINT AS k FROM events) SELECT event_type, count(k) AS n_parsed, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most, count(*) AS n FROM e GROUP BY 1",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS b FROM g)
      SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, b""",
    "stream_dedupe": "SELECT DISTINCT sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) AS n_chars FROM documents",
}
