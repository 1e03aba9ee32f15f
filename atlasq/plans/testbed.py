"""Engine facts from the star schema: deterministic views, stated once for Spark and once as SQL.

The tables hold no source repositories or spans, so nations stand for services, brands for topics, page URLs for routes,
events for latency, conversations for traces and documents for findings and files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E

#: The end of the telemetry range, and the width of its windows in seconds.
END, HOUR = "2024-01-31 00:00:00", 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Line items with the nations of supplier and customer. The nations are 25 rows."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"))
    customer = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("target"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def dependency_buckets(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "R", "failure").otherwise("success")
    return trade(spark, d).select("source", "target", F.col("l_linestatus").alias("target_type"), outcome.alias("outcome"), F.lit(1).cast("long").alias("calls"), F.col("l_extendedprice").cast("decimal(18,2)").alias("duration_us"))


def latency_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    known = F.col("event_id") % 10 != 0
    return e.select(F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("service"), F.col("event_type").alias("transaction"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("long").alias("calls"), F.col("value").cast("decimal(18,2)").alias("duration_us"), known.alias("known"), (known & (F.col("event_type") != "error")).alias("success"))


def window_number(ts: Column) -> Column:
    """Hours counted back from END."""
    from ..operators.telemetry import window_index

    return window_index(ts, F.lit(END).cast("timestamp"), HOUR)


def spans(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return c.select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent_id"),
        F.concat(F.lit("svc"), (F.col("turn") % (1 + F.col("conv_id") % 3)).cast("string")).alias("service"),
        (F.col("conv_id") * 700 + F.col("turn") * 50).alias("ts"), size.alias("duration_us"), F.when(size % 7 == 0, "failure").otherwise("success").alias("outcome"), F.col("role").alias("name"),
    )


def rest_endpoints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#.]+)", 1)
    path = E.rest_path(F.col("url"))
    serve = F.col("page_id") % 2 == 1
    shown = F.when(serve, F.regexp_replace(path, r"/[0-9]+(\.html)?", "/{id}")).otherwise(path)
    return p.select(
        F.col("page_id").alias("id"), F.when(serve, "serve").otherwise("call").alias("role"), F.when(serve, host).otherwise(F.concat(F.lit("caller"), (F.col("page_id") % 5).cast("string"))).alias("system"),
        F.concat(F.lit("GET "), shown).alias("topic"), F.col("url").alias("snippet"),
    )


def host_names(spark: SparkSession, d: str) -> DataFrame:
    return rest_endpoints(spark, d).where("role = 'serve'").select(F.col("system").alias("service"), F.col("system").alias("alias")).distinct()


def topic_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Who supplies or buys which brand, with the part's type as message. Brands of two digits have no buyers, Brand#3 no
    suppliers, and Brand#2 is never supplied as ECONOMY."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("topic"), F.col("p_type").alias("message_type"))
    rows = trade(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).select("source", "target", "topic", "message_type").distinct()
    made = rows.where((F.col("topic") != "Brand#3") & ((F.col("topic") != "Brand#2") | (F.col("message_type") != "ECONOMY"))).select(F.lit("produce").alias("role"), F.col("source").alias("system"), "topic", "message_type")
    used = rows.where(F.length("topic") == 7).select(F.lit("consume").alias("role"), F.col("target").alias("system"), "topic", "message_type")
    return made.union(used).distinct().withColumn("topic_dynamic", F.lit(False))


def all_edges(spark: SparkSession, d: str) -> DataFrame:
    """All targets of each source, no loops."""
    return trade(spark, d).where("source <> target").select("source", "target", F.lit("rest").alias("kind"), F.lit("").alias("label")).distinct()


def findings(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    severity = F.when(F.col("toxic") == 1, "ERROR").when(F.col("quality") == 0, "WARNING").otherwise("INFO")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("rule_id"), F.col("text").alias("message"), F.concat_ws("/", "lang", "source").alias("path"), severity.alias("severity"))


def file_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    before = docs.where("doc_id % 10 <> 0").select("path", "sha256")
    now = docs.where("doc_id % 10 <> 1").select("path", F.when(F.col("doc_id") % 10 == 2, F.sha2(F.concat("sha256", F.lit("!")), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return before, now


#: The same views as SQL, as named parts of a WITH clause.
SQL = {
    "trade": "SELECT l.*, sn.n_name AS source, cn.n_name AS target FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey",
    "dep": "SELECT source, target, l_linestatus AS target_type, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS outcome, CAST(l_extendedprice AS DECIMAL(18,2)) AS duration_us FROM trade",
    "deps": "SELECT source, target, target_type, count(*) AS calls, count(*) FILTER (outcome = 'failure') AS failure_calls, CAST(sum(duration_us) AS DOUBLE) AS duration_us FROM dep GROUP BY ALL",
    "depm": "SELECT *, CAST(failure_calls AS DOUBLE) / calls AS error_rate, duration_us / (CAST(calls AS DOUBLE) * 1000) AS average_ms FROM deps",
    "lat": "SELECT 'svc' || (user_id % 7) AS service, event_type AS transaction, ts, CAST(value AS DECIMAL(18,2)) AS duration_us, event_id % 10 <> 0 AS known, event_id % 10 <> 0 AND event_type <> 'error' AS success, CAST(ceil((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 3600000000.0) - 1 AS BIGINT) AS w FROM events",
    "spans": "SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent_id, 'svc' || (turn % (1 + conv_id % 3)) AS service, conv_id * 700 + turn * 50 AS ts, CAST(coalesce(length(text), 0) AS BIGINT) AS duration_us, CASE WHEN coalesce(length(text), 0) % 7 = 0 THEN 'failure' ELSE 'success' END AS outcome, role AS name FROM conversations",
    "raw_rest": "SELECT page_id AS id, page_id % 2 = 1 AS is_serve, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#.]+)', 1) AS label, regexp_replace('/' || regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/{2,}', '/', 'g') AS path, url FROM pages",
    "rest": "SELECT id, CASE WHEN is_serve THEN 'serve' ELSE 'call' END AS role, CASE WHEN is_serve THEN label ELSE 'caller' || (id % 5) END AS system, 'GET ' || CASE WHEN is_serve THEN regexp_replace(path, '/[0-9]+(\\.html)?', '/{id}', 'g') ELSE path END AS topic, host, label, url FROM raw_rest",
    "flows": "SELECT DISTINCT source, target, p_brand AS topic, p_type AS message_type FROM trade JOIN part ON l_partkey = p_partkey",
    "kafka": "SELECT DISTINCT 'produce' AS role, source AS system, topic, message_type FROM flows WHERE topic <> 'Brand#3' AND (topic <> 'Brand#2' OR message_type <> 'ECONOMY') UNION SELECT DISTINCT 'consume', target, topic, message_type FROM flows WHERE length(topic) = 7",
    "kafka_edges": "SELECT DISTINCT p.system AS source, c.system AS target, p.topic FROM kafka p JOIN kafka c ON p.topic = c.topic AND p.role = 'produce' AND c.role = 'consume' AND p.system <> c.system",
    "pairs": "SELECT source, target, count(*) AS calls FROM trade WHERE source <> target GROUP BY ALL",
    "finding": "SELECT d.doc_id AS id, source AS rule_id, text AS message, lang || '/' || source AS path, CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id",
    "prev": "SELECT lang || '/' || source || '/' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0",
    "cur": "SELECT lang || '/' || source || '/' || doc_id AS path, CASE WHEN doc_id % 10 = 2 THEN sha256(sha256(text) || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 1",
}
#: Which parts a part needs.
NEEDS = {"dep": ["trade"], "deps": ["dep"], "depm": ["deps"], "rest": ["raw_rest"], "flows": ["trade"], "kafka": ["flows"], "kafka_edges": ["kafka"], "pairs": ["trade"]}


def with_views(sql: str, *names: str, recursive: bool = False, **more: str) -> str:
    """The query behind a WITH clause of the views named and of what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}"
