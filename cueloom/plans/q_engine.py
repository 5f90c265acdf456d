"""Queries: the relational surface of the engine, and streaming against the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import events as S
from . import views as V
from .q_batch import JOB_SQL
from .views import query


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: V.table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = V.table(spark, sf, "customer"), V.table(spark, sf, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), on, "left_semi").join(o.where("o_orderstatus = 'P'"), on, "left_anti").select("c_custkey")


@query("SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 50 AS u, (SELECT min(ts) FROM events) + to_seconds(CAST(o_orderkey AS BIGINT)) AS t FROM orders) o ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL) e ON o.u = e.user_id AND o.t >= e.ts")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its user's latest event before it: one union and one window, no pairs."""
    ev = V.table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    t0 = V.table(spark, sf, "events").agg(F.min("ts").alias("t0"))
    at = F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.col("t0"))
    left = V.table(spark, sf, "orders").join(F.broadcast(t0)).select((F.col("o_custkey") % 50).alias("user_id"), at.alias("ts"), F.lit(1).alias("kind"), "o_orderkey", F.lit(None).cast("bigint").alias("event_id"))
    right = ev.select("user_id", "ts", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w))
    return seen.where("kind = 1 AND event_id IS NOT NULL").select("o_orderkey", "event_id")


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS gid, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets_documents(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n")).select("lang", "source", "n")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT SELECT s_nationkey + 100 FROM supplier)")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    c, s = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).unionAll(c.select((F.col("k") + 100).alias("k")).subtract(s.select((F.col("k") + 100).alias("k"))))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return V.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")


@query("SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS running, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind FROM events")
def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return V.table(spark, sf, "events").select("user_id", "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("running"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("bigint").alias("kind"))


@query("SELECT event_type, count(DISTINCT user_id) AS n, TRUE AS close FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    got = V.table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("n"))
    # the estimate has to be within 6 %, three times its standard error
    return got.select("event_type", "n", F.col("a").between(0.94 * F.col("n"), 1.06 * F.col("n")).alias("close"))


@query("SELECT user_id, count(*) AS n, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicked FROM events GROUP BY user_id HAVING count(*) > 3")
def sql_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same engine through SQL text over a view."""
    V.table(spark, sf, "events").createOrReplaceTempView("cueloom_events")
    return spark.sql("SELECT user_id, count(*) AS n, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicked FROM cueloom_events GROUP BY user_id HAVING count(*) > 3")


_BIN = "epoch_us(time_bucket(INTERVAL '{0}', ts)) // 1000"


@query("SELECT event_type, s AS start_ms, s + 3600000 AS end_ms, count(*) AS n FROM (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000 AS s FROM events) GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return S.drain(S.tumbling(S.read_events(spark, f"{sf}/events.parquet"), "1 hour"), "complete")


@query("SELECT event_type, s AS start_ms, s + 3600000 AS end_ms, count(*) AS n FROM (SELECT event_type, unnest([epoch_us(ts) // 1800000000 * 1800000, epoch_us(ts) // 1800000000 * 1800000 - 1800000]) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return S.drain(S.sliding(S.read_events(spark, f"{sf}/events.parquet"), "1 hour", "30 minutes"), "complete")


@query("WITH f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(epoch_us(ts)) // 1000 AS start_ms, (max(epoch_us(ts)) + 7200000000) // 1000 AS end_ms, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.drain(S.sessions(S.read_events(spark, f"{sf}/events.parquet"), "2 hours"), "complete")


@query(JOB_SQL)
def stream_jobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    actions = S.read_events(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("job_id"), k.alias("seq"), F.when(k % 17 == 0, "complete").when(k % 19 == 0, "fail").otherwise("advance").alias("action"))
    return S.drain(S.job_states(actions), "update", keep="job_id")
