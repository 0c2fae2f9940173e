"""The registered queries on the driver tables, with their SQL.

Queries go through the package's own operators; the SQL states the same
result in plain terms.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs, scalar
from .operators.aggregate import Aggregation
from .operators.join import flat_join
from .plans.query import Collection, DocQuery, typed
from .sources import archive, kv
from .sources.store import Store, scratch_folder
from .sources.typed import TypedCollection
from .streaming import batch
from .values import compare_values, encode, values_equal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",),
    "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"),
    "conversations": ("conv_id", "turn"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, name: str) -> DocQuery:
    return DocQuery(typed(name, table(spark, sf_dir, name), *KEYS[name]))


def _register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return add


NULLED = "(SELECT o_orderkey, {} FROM orders) t"
NULL_PRICE = NULLED.format("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS v")
NULL_PRIORITY = NULLED.format("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS s")


def _nulled(spark: SparkSession, sf_dir: str) -> DocQuery:
    """Orders with nulls put in: the driver tables have none."""
    o = table(spark, sf_dir, "orders")
    keep = F.col("o_orderstatus") != "P"
    df = o.select("o_orderkey", F.when(keep, F.col("o_totalprice")).alias("v"), F.when(keep, F.col("o_orderpriority")).alias("s"))
    return DocQuery(typed("orders", df, "o_orderkey"))


# ---- predicates -----------------------------------------------------------


@_register("where_equals", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return rows(spark, d, "lineitem").where_equals("l_returnflag", "R").find().select("l_orderkey", "l_linenumber", "l_quantity")


@_register("where_equals_null", f"SELECT o_orderkey FROM {NULL_PRICE} WHERE v IS NULL")
def _(spark, d):
    return _nulled(spark, d).where_equals("v", None).find().select("o_orderkey")


@_register("where_not_equals_incl_null", f"SELECT o_orderkey, s FROM {NULL_PRIORITY} WHERE s IS DISTINCT FROM '1-URGENT'")
def _(spark, d):
    return _nulled(spark, d).where_not_equals("s", "1-URGENT").find().select("o_orderkey", "s")


@_register("where_gt", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    return rows(spark, d, "customer").where_greater_than("c_acctbal", 5000).find().select("c_custkey", "c_acctbal")


@_register("where_gte", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30")
def _(spark, d):
    return rows(spark, d, "lineitem").where_greater_than_or_equal("l_quantity", 30).find().select("l_orderkey", "l_linenumber", "l_quantity")


@_register("where_lt_incl_null", f"SELECT o_orderkey, v FROM {NULL_PRICE} WHERE v < 50000 OR v IS NULL")
def _(spark, d):
    return _nulled(spark, d).where_less_than("v", 50000).find().select("o_orderkey", "v")


@_register("where_lte_incl_null", f"SELECT o_orderkey, v FROM {NULL_PRICE} WHERE v <= 50000 OR v IS NULL")
def _(spark, d):
    return _nulled(spark, d).where_less_than_or_equal("v", 50000).find().select("o_orderkey", "v")


@_register("where_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def _(spark, d):
    return rows(spark, d, "part").where_between("p_size", 10, 20).find().select("p_partkey", "p_size")


@_register("where_between_fraction", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 9.5 AND 20.5")
def _(spark, d):
    return rows(spark, d, "part").where_between("p_size", 9.5, 20.5).find().select("p_partkey", "p_size")


@_register("where_in", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5)")
def _(spark, d):
    return rows(spark, d, "nation").where_in("n_nationkey", [1, 3.0, 5]).find().select("n_nationkey", "n_name")


@_register("where_in_with_null", f"SELECT o_orderkey, s FROM {NULL_PRIORITY} WHERE s IN ('1-URGENT') OR s IS NULL")
def _(spark, d):
    return _nulled(spark, d).where_in("s", ["1-URGENT", None]).find().select("o_orderkey", "s")


@_register("where_contains_string", "SELECT doc_id FROM documents WHERE contains(text, 'the')")
def _(spark, d):
    return rows(spark, d, "documents").where_contains("text", "the").find().select("doc_id")


@_register("where_contains_list", "SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return DocQuery(typed("conversations", turns, "conv_id")).where_contains("roles", "assistant").find().select("conv_id")


@_register("search_field", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')")
def _(spark, d):
    return rows(spark, d, "documents").search("THE", "text").find().select("doc_id")


@_register("search_all_fields", "SELECT doc_id FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(source), 'src1')")
def _(spark, d):
    return rows(spark, d, "documents").search("SRC1").find().select("doc_id")


@_register("cross_class_gt", "SELECT p_partkey FROM part WHERE p_brand IS NOT NULL")
def _(spark, d):
    return rows(spark, d, "part").where_greater_than("p_brand", 9).find().select("p_partkey")


@_register("cross_class_lt", f"SELECT o_orderkey FROM {NULL_PRICE}")
def _(spark, d):
    return _nulled(spark, d).where_less_than("v", "0").find().select("o_orderkey")


@_register("conditions_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'")
def _(spark, d):
    q = rows(spark, d, "orders").where("o_orderstatus", "eq", "F").where("o_totalprice", "gt", 100000)
    return q.where_not_equals("o_orderpriority", "5-LOW").find().select("o_orderkey")


@_register("conditions_any", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice < 2000 AND o_orderpriority = '5-LOW')")
def _(spark, d):
    q = rows(spark, d, "orders").where_any(
        lambda g: g.where_equals("o_orderstatus", "P"), lambda g: g.where_less_than("o_totalprice", 2000).where_equals("o_orderpriority", "5-LOW")
    )
    return q.find().select("o_orderkey")


# ---- order and window -----------------------------------------------------


@_register("order_desc_nulls_first", f"SELECT o_orderkey, v FROM {NULL_PRICE} ORDER BY v DESC NULLS FIRST, o_orderkey LIMIT 50")
def _(spark, d):
    return _nulled(spark, d).order_by("v", descending=True).limit(50).find().select("o_orderkey", "v")


@_register("order_asc_nulls_last", f"SELECT o_orderkey, v FROM {NULL_PRICE} ORDER BY v ASC NULLS LAST, o_orderkey LIMIT 50")
def _(spark, d):
    return _nulled(spark, d).order_by("v", nulls_last=True).limit(50).find().select("o_orderkey", "v")


@_register("limit_offset", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def _(spark, d):
    return rows(spark, d, "orders").order_by("o_orderkey").offset(20).limit(10).find().select("o_orderkey", "o_custkey")


@_register("limit_unsorted", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 15")
def _(spark, d):
    return rows(spark, d, "orders").where_equals("o_orderstatus", "O").limit(15).find().select("o_orderkey", "o_custkey")


@_register("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(spark, d):
    return rows(spark, d, "customer").order_by("c_acctbal", descending=True).limit(10).find().select("c_custkey", "c_acctbal")


@_register(
    "flagship",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity >= 30
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20""",
)
def flagship(spark, d):
    q = rows(spark, d, "lineitem").where_equals("l_returnflag", "R").where_greater_than_or_equal("l_quantity", 30)
    q = q.order_by("l_extendedprice", descending=True).limit(20)
    return q.find().select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


# ---- aggregation ----------------------------------------------------------


@_register(
    "agg_simple",
    """SELECT count(*) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_extendedprice,
    CAST(avg(l_linenumber) AS DOUBLE) AS avg_l_linenumber, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem""",
)
def _(spark, d):
    q = rows(spark, d, "lineitem")
    # Money as decimals, so that the sum doesn't depend on its order.
    df = q.collection.df.withColumn("l_extendedprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    q = DocQuery(typed("lineitem", df, *KEYS["lineitem"]))
    build = lambda a: a.count().sum("l_extendedprice").avg("l_linenumber").min("l_quantity").max("l_quantity")
    out = q.aggregate(build).execute_aggregation()
    return out.withColumn("sum_l_extendedprice", F.col("sum_l_extendedprice").cast("double"))


@_register(
    "agg_empty",
    """SELECT count(*) AS count, coalesce(CAST(sum(p_size) AS BIGINT), 0) AS sum_p_size,
    coalesce(avg(p_size), CAST(0 AS DOUBLE)) AS avg_p_size, min(p_size) AS min_p_size FROM part WHERE p_size < -1""",
)
def _(spark, d):
    q = rows(spark, d, "part").where_less_than("p_size", -1)
    return q.aggregate(lambda a: a.count().sum("p_size").avg("p_size").min("p_size")).execute_aggregation()


@_register("agg_non_numeric", "SELECT CAST(0 AS INTEGER) AS sum_p_brand, CAST(0 AS DOUBLE) AS avg_p_brand, min(p_brand) AS min_p_brand FROM part")
def _(spark, d):
    return rows(spark, d, "part").aggregate(lambda a: a.sum("p_brand").avg("p_brand").min("p_brand")).execute_aggregation()


@_register("agg_group_null_key", f"SELECT s, count(*) AS count FROM {NULL_PRIORITY} GROUP BY s")
def _(spark, d):
    return _nulled(spark, d).aggregate(lambda a: a.group_by("s").count()).execute_aggregation()


@_register(
    "agg_flagship",
    "SELECT l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, count(*) AS count FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 GROUP BY l_linestatus",
)
def _(spark, d):
    q = rows(spark, d, "lineitem").where_equals("l_returnflag", "R").where_greater_than_or_equal("l_quantity", 30)
    return q.aggregate(lambda a: a.group_by("l_linestatus").sum("l_linenumber").count()).execute_aggregation()


@_register("agg_count_field", f"SELECT count(v) AS count_v FROM {NULL_PRICE}")
def _(spark, d):
    return _nulled(spark, d).aggregate(lambda a: a.count("v")).execute_aggregation()


@_register("agg_distinct_count", "SELECT count(DISTINCT p_brand) AS distinct_p_brand FROM part")
def _(spark, d):
    return rows(spark, d, "part").aggregate(lambda a: a.distinct("p_brand")).execute_aggregation()


@_register(
    "agg_after_limit",
    "SELECT count(*) AS count, max(o_custkey) AS max_o_custkey FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50) t",
)
def _(spark, d):
    q = rows(spark, d, "orders").order_by("o_orderkey").offset(50).limit(100)
    return q.aggregate(lambda a: a.count().max("o_custkey")).execute_aggregation()


@_register(
    "agg_group_documents",
    "SELECT o_orderpriority, count(*) AS count, CAST(count(*) AS INTEGER) AS documents FROM orders GROUP BY o_orderpriority",
)
def _(spark, d):
    out = rows(spark, d, "orders").aggregate(lambda a: a.group_by("o_orderpriority").count()).execute_aggregation(documents=True)
    return out.withColumn("documents", F.size("documents"))


@_register("count_window", "SELECT least(greatest(count(*) - 100, 0), 50) AS n FROM orders")
def _(spark, d):
    return rows(spark, d, "orders").offset(100).limit(50).count_df()


@_register("distinct_field", f"SELECT DISTINCT s FROM {NULL_PRIORITY} WHERE s IS NOT NULL")
def _(spark, d):
    return _nulled(spark, d).distinct("s")


# ---- joins ----------------------------------------------------------------


@_register("join_flat", "SELECT o_orderkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    out = flat_join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey")
    return out.select("o_orderkey", "c_custkey", "c_mktsegment")


@_register("join_nested_size", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    orders = typed("orders", table(spark, d, "orders"), "o_orderkey")
    out = rows(spark, d, "customer").join(orders, "c_custkey", "o_custkey").to_df()
    return out.select("c_custkey", F.coalesce(F.size("_joined_orders"), F.lit(0)).cast("long").alias("n"))


@_register(
    "limit_before_join",
    """SELECT o_orderkey, count(l_orderkey) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) o
    LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def _(spark, d):
    lines = typed("lineitem", table(spark, d, "lineitem"), "l_linenumber")
    out = rows(spark, d, "orders").order_by("o_orderkey").limit(20).join(lines, "o_orderkey", "l_orderkey").to_df()
    return out.select("o_orderkey", F.coalesce(F.size("_joined_lineitem"), F.lit(0)).cast("long").alias("n"))


@_register(
    "join_chain",
    """SELECT o_orderkey, n_name, count(l_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderkey, n_name""",
)
def _(spark, d):
    lines = typed("lineitem", table(spark, d, "lineitem"), "l_linenumber")
    people = flat_join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    q = rows(spark, d, "orders").where_equals("o_orderstatus", "P").join(typed("people", people, "c_custkey"), "o_custkey", "c_custkey")
    out = q.join(lines, "o_orderkey", "l_orderkey").to_df()
    return out.select("o_orderkey", F.col("_joined_people")[0]["n_name"].alias("n_name"), F.coalesce(F.size("_joined_lineitem"), F.lit(0)).cast("long").alias("n"))


# ---- dynamic documents ----------------------------------------------------


def _props(spark: SparkSession, d: str) -> Collection:
    """Events as dynamic documents: the JSON in ``props``."""
    df = table(spark, d, "events").select(F.col("event_id").alias("_id"), F.parse_json("props").alias("doc"))
    return Collection("events", df, ("_id",), "doc")


@_register("json_path_gt", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
def _(spark, d):
    return _props(spark, d).query().where_greater_than("k", 50).to_df().select(F.col("_id").alias("event_id"))


@_register(
    "json_group",
    "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS count FROM events GROUP BY CAST(json_extract_string(props, '$.k') AS BIGINT)",
)
def _(spark, d):
    out = _props(spark, d).query().aggregate(lambda a: a.group_by("k").count()).execute_aggregation()
    return out.select(F.col("k").cast("long").alias("k"), "count")


# ---- key/value ------------------------------------------------------------


def _orders_kv(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("orders:"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return table(spark, d, "orders").select(key.alias("key"), F.col("o_custkey").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))


KV = "(SELECT concat('orders:', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS k, o_custkey FROM orders) t"


@_register("prefix_scan", f"SELECT k FROM {KV} WHERE starts_with(k, 'orders:00000001')")
def _(spark, d):
    return kv.keys(_orders_kv(spark, d), prefix="orders:00000001").select(F.col("key").alias("k"))


@_register("range_scan_reverse", f"SELECT k, o_custkey FROM {KV} WHERE k >= 'orders:000000100' AND k < 'orders:000000900' ORDER BY k DESC LIMIT 25")
def _(spark, d):
    out = kv.scan(_orders_kv(spark, d), "orders:000000100", "orders:000000900", limit=25, reverse=True)
    return out.select(F.col("key").alias("k"), F.col("value").alias("o_custkey"))


@_register("point_get", f"SELECT o_custkey FROM {KV} WHERE k = 'orders:000000005'")
def _(spark, d):
    return kv.lookup(_orders_kv(spark, d), "orders:000000005").select(F.col("value").alias("o_custkey"))


@_register("get_batch", "SELECT r.k, c.c_name FROM (VALUES (1), (2), (99999999)) r(k) LEFT JOIN customer c ON c.c_custkey = r.k")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), F.lit(None).cast("timestamp").alias("expires_at"))
    return kv.get_batch(c, ["1", "2", "99999999"]).select(F.col("key").cast("int").alias("k"), F.col("value").alias("c_name"))


@_register("glob", "SELECT event_id FROM events WHERE event_type LIKE 'c%k'")
def _(spark, d):
    return table(spark, d, "events").where(exprs.glob(F.col("event_type"), "c*k")).select("event_id")


@_register("glob_question", "SELECT event_id FROM events WHERE event_type LIKE 'p%e'")
def _(spark, d):
    return table(spark, d, "events").where(exprs.glob(F.col("event_type"), "p?e", question_is_star=True)).select("event_id")


@_register("ttl_live", "SELECT event_id FROM events WHERE ts + INTERVAL '1' DAY > TIMESTAMP '2024-01-15 00:00:00'")
def _(spark, d):
    expires = F.col("ts") + F.expr("INTERVAL '1' DAY")
    return table(spark, d, "events").where(exprs.live(expires, datetime(2024, 1, 15))).select("event_id")


@_register(
    "latest_per_key",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn
    FROM events) t WHERE rn = 1 AND event_type <> 'error'""",
)
def _(spark, d):
    log = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("seq"), F.col("event_id").alias("value"), (F.col("event_type") == "error").alias("tombstone")
    )
    return kv.latest(log, ["value"]).select(F.col("key").alias("user_id"), F.col("value").alias("event_id"))


@_register("update_state", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, d):
    return rows(spark, d, "customer").where_less_than("c_acctbal", 0).updated_df({"c_mktsegment": "DEBT"}).select("c_custkey", "c_mktsegment")


@_register("delete_state", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def _(spark, d):
    return rows(spark, d, "customer").where_less_than("c_acctbal", 0).deleted_df().select("c_custkey")


@_register("redact_key", "SELECT c_custkey, concat('key#', substr(sha256(c_name), 1, 8), '(len=', CAST(length(c_name) AS VARCHAR), ')') AS r FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.redacted_key(F.col("c_name")).alias("r"))


# ---- change streams -------------------------------------------------------

SIX_HOURS = 6 * 3600
STARTS = """WITH RECURSIVE t AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id UNION ALL
    SELECT e.user_id, min(e.ts) AS ts FROM t JOIN events e ON e.user_id = t.user_id AND e.ts >= t.ts + INTERVAL '6' HOUR GROUP BY e.user_id)"""


@_register("stream_where_map", "SELECT event_id, upper(event_type) AS kind FROM events WHERE event_type <> 'view'")
def _(spark, d):
    return table(spark, d, "events").where(F.col("event_type") != "view").select("event_id", F.upper("event_type").alias("kind"))


@_register("stream_distinct", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY ts) AS p FROM events) t WHERE p IS DISTINCT FROM event_type")
def _(spark, d):
    return batch.distinct(table(spark, d, "events").select("event_id", "event_type", "ts"), "event_type").select("event_id")


@_register(
    "stream_debounce",
    """SELECT event_id FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) t
    WHERE nx IS NULL OR nx >= ts + INTERVAL '6' HOUR""",
)
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return batch.debounce(events, F.expr("INTERVAL '6' HOUR"), by=["user_id"]).select("event_id")


@_register("stream_throttle", f"{STARTS} SELECT user_id, ts FROM t")
def _(spark, d):
    return batch.throttle(table(spark, d, "events").select("user_id", "ts"), SIX_HOURS, by=["user_id"])


@_register("stream_take", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS rn FROM events) t WHERE rn <= 25")
def _(spark, d):
    return batch.take(table(spark, d, "events").select("event_id", "ts"), 25).select("event_id")


@_register("stream_skip", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS rn FROM events) t WHERE rn > 25")
def _(spark, d):
    return batch.skip(table(spark, d, "events").select("event_id", "ts"), 25).select("event_id")


@_register(
    "stream_buffer",
    """SELECT CAST(floor((rn - 1) / 64.0) AS BIGINT) AS batch, count(*) AS n, min(event_id) AS first_id
    FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS rn FROM events) t GROUP BY CAST(floor((rn - 1) / 64.0) AS BIGINT)""",
)
def _(spark, d):
    out = batch.numbered(table(spark, d, "events").select("event_id", "ts"), 64)
    return out.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@_register(
    "stream_buffer_time",
    f"""{STARTS} SELECT t.user_id, t.ts AS batch_start, count(*) AS n FROM t JOIN events e ON e.user_id = t.user_id AND e.ts >= t.ts
    AND e.ts < t.ts + INTERVAL '6' HOUR GROUP BY t.user_id, t.ts""",
)
def _(spark, d):
    out = batch.buffer_time(table(spark, d, "events").select("user_id", "ts"), SIX_HOURS, by=["user_id"])
    return out.groupBy("user_id", "batch_start").agg(F.count("*").alias("n"))


@_register(
    "snapshot_plus_live",
    "SELECT DISTINCT user_id, ts FROM events",
)
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "ts")
    early, late = F.col("ts") < F.lit(datetime(2024, 1, 20)), F.col("ts") >= F.lit(datetime(2024, 1, 10))
    return batch.with_snapshot(events.where(early), events.where(late | ~early), ["user_id", "ts"])


__all__ = ["ORACLE_SQL", "QUERIES", "Aggregation", "flagship"]


# ---- the store ------------------------------------------------------------

_stores: dict[tuple[str, str], Store] = {}

CUSTOMERS = "(SELECT 'customers:' || c_custkey AS key, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer) t"


def _customer_rows(spark: SparkSession, d: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")))
    return table(spark, d, "customer").select(F.concat(F.lit("customers:"), F.col("c_custkey").cast("string")).alias("key"), doc.alias("value"))


def _new_store(spark: SparkSession, d: str, indexes: tuple[tuple[str, ...], ...] = ()) -> Store:
    """All customers as documents, in a store of its own."""
    store = Store(spark, scratch_folder(spark))
    store.append(_customer_rows(spark, d))
    for fields in indexes:
        store.create_index("customers", fields)
    return store


def _read_store(spark: SparkSession, d: str) -> Store:
    """The same, shared by queries that only read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stores:
        _stores[key] = _new_store(spark, d, (("nation",), ("nation", "balance")))
    return _stores[key]


def _fields(df: DataFrame, key: str = "key", doc: str = "value") -> DataFrame:
    """Keys and the documents' fields as columns."""
    get = lambda path, kind: F.try_variant_get(F.col(doc), f"$.{path}", kind).alias(path)
    return df.select(F.col(key).alias("key"), get("name", "string"), get("nation", "long"), get("balance", "double"))


@_register("store_scan", f"SELECT key, name, nation, balance FROM {CUSTOMERS} WHERE key >= 'customers:1' AND key < 'customers:3' ORDER BY key LIMIT 40")
def _(spark, d):
    return _fields(_read_store(spark, d).scan("customers:1", "customers:3", limit=40))


@_register("store_scan_prefix", f"SELECT key, name, nation, balance FROM {CUSTOMERS} WHERE starts_with(key, 'customers:12')")
def _(spark, d):
    return _fields(_read_store(spark, d).scan_prefix("customers:12"))


@_register("store_range", f"SELECT key FROM {CUSTOMERS} WHERE key < 'customers:2' ORDER BY key DESC LIMIT 15")
def _(spark, d):
    found = _read_store(spark, d).range(None, "customers:2", limit=15, reverse=True)
    return spark.createDataFrame([(k,) for k, _ in found], "key string")


@_register("store_exists", f"SELECT k AS key, count(t.key) > 0 AS found FROM (VALUES ('customers:1'), ('customers:0'), ('customers:7')) v(k) LEFT JOIN {CUSTOMERS} ON t.key = v.k GROUP BY k")
def _(spark, d):
    store = _read_store(spark, d)
    return spark.createDataFrame([(k, store.exists(k)) for k in ("customers:1", "customers:0", "customers:7")], "key string, found boolean")


@_register("store_documents", f"SELECT id AS key, name, nation, balance FROM {CUSTOMERS}")
def _(spark, d):
    return _fields(_read_store(spark, d).scan_documents("customers"), "_id", "doc")


@_register("store_document_ids", f"SELECT id FROM {CUSTOMERS}")
def _(spark, d):
    return _read_store(spark, d).scan_document_ids("customers").select(F.col("_id").alias("id"))


@_register("store_get_document", f"SELECT name, CAST(nation AS BIGINT) AS nation, balance FROM {CUSTOMERS} WHERE id = '5'")
def _(spark, d):
    doc = _read_store(spark, d).document("customers", "5")
    return spark.createDataFrame([(doc["name"], doc["nation"], float(doc["balance"]))], "name string, nation long, balance double")


@_register("store_count", f"SELECT count(*) AS n, count(*) FILTER (WHERE starts_with(key, 'customers:1')) AS some FROM {CUSTOMERS}")
def _(spark, d):
    store = _read_store(spark, d)
    return spark.createDataFrame([(store.count(), store.count("customers:1*"))], "n long, some long")


@_register("store_clear", f"SELECT count(*) AS cleared, 0::BIGINT AS n FROM {CUSTOMERS}")
def _(spark, d):
    store = _new_store(spark, d)
    return spark.createDataFrame([(store.clear(), store.count())], "cleared long, n long")


@_register("store_info", "SELECT count(*) AS entries, 1::BIGINT AS segments, 2::BIGINT AS indexes FROM customer")
def _(spark, d):
    info = _read_store(spark, d).info()
    return spark.createDataFrame([(info["entries"], info["segments"], len(info["indexes"]))], "entries long, segments long, indexes long")


@_register("typed_collection", f"SELECT id, name, nation FROM {CUSTOMERS} WHERE nation >= 20 AND balance > 0")
def _(spark, d):
    typed_ = TypedCollection(_read_store(spark, d), "customers", "name string, nation int, balance double")
    return typed_.query().where_greater_than_or_equal("nation", 20).where_greater_than("balance", 0).to_df().select(F.col("_id").alias("id"), "name", "nation")


@_register("export_import", f"SELECT key, name, nation, balance FROM {CUSTOMERS}")
def _(spark, d):
    folder = scratch_folder(spark)
    archive.export_to(_read_store(spark, d), f"{folder}/archive")
    store = archive.import_from(spark, f"{folder}/archive", f"{folder}/imported")
    return _fields(store.scan())


@_register(
    "store_writes",
    f"""SELECT key, CASE key WHEN 'customers:2' THEN 'new' ELSE name END AS name, CASE key WHEN 'customers:2' THEN 1 ELSE nation END AS nation,
    CASE key WHEN 'customers:2' THEN 0.5 ELSE balance END AS balance FROM {CUSTOMERS} WHERE key NOT IN ('customers:1', 'customers:3', 'customers:4')
    UNION ALL SELECT 'customers:x', 'put', 2, 1.5""",
)
def _(spark, d):
    store = _new_store(spark, d)
    store.put("customers:x", {"name": "put", "nation": 2, "balance": 1.5})
    store.delete("customers:1")
    store.put_batch({"customers:2": {"name": "new", "nation": 1, "balance": 0.5}, "customers:gone": {"name": "late"}}, expires_at=None)
    store.delete_batch(["customers:3", "customers:4", "customers:gone"])
    return _fields(store.scan())


@_register("store_update", f"SELECT key, name, CASE WHEN nation = 3 THEN 99 ELSE nation END AS nation, balance FROM {CUSTOMERS}")
def _(spark, d):
    store = _new_store(spark, d, (("nation",),))
    store.query("customers").where_equals("nation", 3).update({"nation": 99})
    return _fields(store.scan())


@_register(
    "store_delete_window",
    f"SELECT key, name, nation, balance FROM {CUSTOMERS} WHERE key NOT IN (SELECT key FROM {CUSTOMERS} WHERE nation > 10 ORDER BY balance DESC, id LIMIT 25 OFFSET 5)",
)
def _(spark, d):
    store = _new_store(spark, d)
    store.query("customers").where_greater_than("nation", 10).order_by("balance", descending=True).offset(5).limit(25).delete()
    return _fields(store.scan())


@_register("purge_expired", f"SELECT key FROM {CUSTOMERS} WHERE nation <> 4 UNION ALL SELECT 'purged ' || count(*) FROM {CUSTOMERS} WHERE nation = 4")
def _(spark, d):
    store = Store(spark, scratch_folder(spark))
    gone = F.when(F.get_json_object("value", "$.nation") == "4", F.lit(datetime(2001, 1, 1)))
    store.append(_customer_rows(spark, d).withColumn("expires_at", gone))
    n = store.purge_expired()
    return store.keys().unionByName(spark.createDataFrame([(f"purged {n}",)], "key string"))


@_register("compare_and_swap", "SELECT * FROM (VALUES (true, false, '2')) v(first, second, value)")
def _(spark, d):
    store = Store(spark, scratch_folder(spark))
    store.put("n", 1)
    first, second = store.compare_and_swap("n", 1.0, 2), store.compare_and_swap("n", 1, 3)
    return spark.createDataFrame([(first, second, str(store.get("n")))], "first boolean, second boolean, value string")


@_register("transaction", f"SELECT key, CASE key WHEN 'customers:1' THEN balance + 10 WHEN 'customers:2' THEN balance - 10 ELSE balance END AS balance FROM {CUSTOMERS}")
def _(spark, d):
    store = _new_store(spark, d)

    def move(tx):
        for identity, change in (("1", 10), ("2", -10)):
            doc = tx.get(f"customers:{identity}")
            tx.put(f"customers:{identity}", doc | {"balance": doc["balance"] + change})

    store.transaction(move)
    return _fields(store.scan()).select("key", "balance")


def _by_index(name: str, sql: str, ask: Callable[[DocQuery], DocQuery]) -> None:
    @_register(name, f"SELECT id FROM {CUSTOMERS} WHERE {sql}")
    def _(spark, d):
        return ask(_read_store(spark, d).query("customers")).to_df().select(F.col("_id").alias("id"))


_by_index("index_equals", "nation = 7", lambda q: q.where_equals("nation", 7))
_by_index("index_range", "nation BETWEEN 5 AND 8", lambda q: q.where_between("nation", 5, 8))
_by_index("index_in", "nation IN (1, 2, 24)", lambda q: q.where_in("nation", [1, 2, 24, "x"]))
_by_index("index_compound", "nation = 7 AND balance > 1000", lambda q: q.where_equals("nation", 7).where_greater_than("balance", 1000))


@_register("index_after_compaction", f"SELECT id FROM {CUSTOMERS} WHERE nation = 7 AND id <> '9' UNION ALL SELECT 'late'")
def _(spark, d):
    store = _new_store(spark, d, (("nation",),))
    store.put("customers:late", {"nation": 7})
    store.compact()
    store.put("customers:9", {"nation": 8})
    return store.query("customers").where_equals("nation", 7).to_df().select(F.col("_id").alias("id"))


@_register("index_catalogue", "SELECT * FROM (VALUES ('customers.nation'), ('customers.nation+balance')) v(name)")
def _(spark, d):
    store = _read_store(spark, d)
    names = [i.name for i in store.list_indexes("customers")] if store.has_index("customers", "nation") else []
    return spark.createDataFrame([(n,) for n in names], "name string")


@_register("changes_committed", f"SELECT seq, type, key FROM (SELECT 1::BIGINT AS seq, 'put' AS type, key FROM {CUSTOMERS}) UNION ALL SELECT 2, 'delete', 'customers:1' UNION ALL SELECT 3, 'put', 'a'")
def _(spark, d):
    store = _new_store(spark, d)
    store.delete("customers:1")
    store._segment(store._local({"never": 1}), 3)  # staged and not committed
    store.put("a", 1)
    return store.changes().select("seq", "type", "key")


@_register("encrypted_store", f"SELECT key, name, nation, balance FROM {CUSTOMERS}")
def _(spark, d):
    store = Store(spark, scratch_folder(spark), encryption_key=scalar.derive_key("secret", b"0123456789abcdef", 1000)[0])
    store.append(_customer_rows(spark, d))
    store.compact()
    return _fields(store.scan())


# ---- scalar functions -----------------------------------------------------


@_register("encryption_round_trip", "SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    key = scalar.derive_key("secret", b"0123456789abcdef", 1000)[0]
    name = scalar.decrypted(scalar.encrypted(F.col("c_name").cast("binary"), key), key).cast("string")
    return table(spark, d, "customer").select("c_custkey", name.alias("c_name"))


@_register("checksum_and_key_derivation", "SELECT 3421780262 AS crc, 'c5e478d59288c841aa530db6845c4c8d962893a001ce4e11a4963873aa98134a' AS derived")
def _(spark, d):
    # Known answers: CRC-32 of "123456789", and PBKDF2 with HMAC-SHA-256 of "password" and "salt", 4,096 rounds.
    derived = scalar.derive_key("password", b"salt", 4096)[0].hex()
    return spark.createDataFrame([("123456789", derived)], "v string, derived string").select(scalar.checksum(F.col("v")).alias("crc"), "derived")


@_register("total_order", "SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) v(place)")
def _(spark, d):
    ordered = [None, False, True, -1.5, 2, "a", "b", [1], {"a": 1}]
    places = [i for i, v in enumerate(ordered) if all(compare_values(v, w) < 0 and encode(v) < encode(w) and not values_equal(v, w) for w in ordered[i + 1 :])]
    return spark.createDataFrame([(i,) for i in places], "place int")
