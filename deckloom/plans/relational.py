"""Built-in relational operators over the star schema: joins, grouping sets, set operations, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deckloom.sources.tables import table

QUERIES, ORACLE = {}, {}

#: Money is summed in whole ten-thousandths, so sums do not depend on their order.
_NET_SQL = "round(l_extendedprice * 100)::BIGINT * round((1 - l_discount) * 100)::BIGINT"


def _net():
    return F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((1 - F.col("l_discount")) * 100).cast("long")



def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS sum_price, sum(""" + _NET_SQL + """)::DOUBLE / 10000.0::DOUBLE AS sum_disc,
  round_even(avg(l_quantity), 4) AS avg_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("sum_qty"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / 100.0).alias("sum_price"), (F.sum(_net()).cast("double") / 10000.0).alias("sum_disc"), F.bround(F.avg("l_quantity"), 4).alias("avg_qty")
    )


@query("segment_revenue", """SELECT n_name, c_mktsegment, sum(""" + _NET_SQL + """)::DOUBLE / 10000.0::DOUBLE AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_mktsegment""")
def segment_revenue(spark, sf_dir):
    c, o, l, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "nation"))
    joined = l.select("l_orderkey", "l_extendedprice", "l_discount").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg((F.sum(_net()).cast("double") / 10000.0).alias("revenue"))


@query("revenue_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS depth FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def revenue_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), (F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus")).alias("depth"))


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def status_pivot(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return counted.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("top_parts", "SELECT l_suppkey, l_partkey, qty, rank FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def top_parts(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey"))
    return sums.withColumn("rank", place.cast("long")).where(F.col("rank") <= 3)


@query("set_operations", """SELECT 'both' AS which, c_nationkey AS k FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', c_nationkey FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = (("both", c.intersect(s)), ("customers only", c.exceptAll(s).join(s, "k", "left_anti").distinct()), ("either", c.union(s).distinct()))
    tagged = [df.select(F.lit(name).alias("which"), "k") for name, df in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("last_order_before_event", """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), p AS (SELECT event_id AS pid, user_id, ts AS pts FROM events WHERE event_type = 'click')
SELECT e.event_id, e.user_id, p.pts AS last_click FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.pts""")
def last_order_before_event(spark, sf_dir):
    """As-of join by one window over the union of both sides: no pair of rows is ever made."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click"))
    clicks = F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True)
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return e.withColumn("last_click", clicks.over(order)).where("event_type = 'purchase'").select("event_id", "user_id", "last_click")


@query("price_bands", """WITH b(band, low, high) AS (VALUES ('small', 0.0, 50000.0), ('middle', 50000.0, 200000.0), ('large', 200000.0, 1e12))
SELECT band, count(*) AS n FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY band""")
def price_bands(spark, sf_dir):
    """Range join with three bands: a broadcast of fixed size."""
    bands = spark.createDataFrame([("small", 0.0, 50000.0), ("middle", 50000.0, 200000.0), ("large", 200000.0, 1e12)], "band string, low double, high double")
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    return o.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("exact_copies", "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS n_copies FROM documents")
def exact_copies(spark, sf_dir):
    """First id and number of each text's copies, by digest; groups are counted before they meet the rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))
    groups = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return d.join(groups, "digest").select("doc_id", "first_id", "n_copies")


@query("embedding_neighbours", """WITH e AS (SELECT vec_id, embedding, label FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS centre FROM (SELECT label, i, round_even(avg(v::DOUBLE), 9) AS x FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM e) GROUP BY label, i) GROUP BY label)
SELECT vec_id, e.label, round_even(list_dot_product(embedding::DOUBLE[], centre) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(centre, centre))), 5) AS cosine FROM e JOIN c ON e.label IS NOT DISTINCT FROM c.label""")
def embedding_neighbours(spark, sf_dir):
    """Cosine of each vector with the mean of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.bround(F.avg("x"), 9).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    joined = e.join(means.withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "label", F.bround(dot("v", "c") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("c", "c"))), 5).alias("cosine"))


@query("user_sessions", """WITH e AS (SELECT user_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000)::INT AS gap FROM events),
s AS (SELECT user_id, ts, sum(coalesce(gap, 1)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, sf_dir):
    from deckloom.streaming.events import sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


@query("hourly_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    from deckloom.streaming.events import tumbling

    rows = tumbling(table(spark, sf_dir, "events"), "1 hour")
    return rows.select(F.col("started").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@query("turn_stats", r"""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')))::BIGINT AS n_words FROM conversations GROUP BY conv_id""")
def turn_stats(spark, sf_dir):
    from deckloom.functions.text import tokens

    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.size(tokens(F.coalesce("text", F.lit(""))))).alias("n_words"))


@query("question_pairs", "SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE role = 'user' AND next_role = 'assistant'")
def question_pairs(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"answer": F.lead("text").over(order), "next_role": F.lead("role").over(order)})
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
