"""Relational breadth over the star schema: joins, grouping, frames, set operations, sketches, JSON and user functions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotmill.runtime import read_table

#: Query vectors that are sent to all rows at a time.
QUERIES_PER_BLOCK = 5_000


def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and means of line items by flag and status."""
    l = read_table(spark, sf, "lineitem").where("l_shipdate <= '2001-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


PRICING_SQL = "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2"


def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """A five-way join with the dimensions broadcast by size."""
    c, o, l, n, r = (read_table(spark, sf, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


REVENUE_SQL = "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"


def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with and without orders, per segment."""
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how: c.join(o, "c_custkey", how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select("c_mktsegment", F.lit(how[5:]).alias("side"), "n")
    return count("left_semi").unionByName(count("left_anti"))


SEMI_SQL = "SELECT c_mktsegment, 'semi' AS side, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1 UNION ALL SELECT c_mktsegment, 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1"


def outer_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with customers, suppliers, both or none: full outer join of two aggregates."""
    c = read_table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    s = read_table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "k", "full_outer").join(read_table(spark, sf, "nation"), F.col("k") == F.col("n_nationkey"), "right").select("n_name", "customers", "suppliers")


OUTER_SQL = "SELECT n_name, customers, suppliers FROM nation LEFT JOIN (SELECT coalesce(c.k, s.k) AS k, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k) ON k = n_nationkey"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Row and range frames, lead and lag over a customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(-90, 0)
    o = read_table(spark, sf, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1995-01-01")))
    return o.select(
        "o_orderkey", F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean3"), F.count(F.lit(1)).over(days).alias("in90"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"),
        F.first("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first"),
    )


FRAMES_SQL = "SELECT o_orderkey, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean3, count(*) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS date)) RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS in90, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON column read with a schema, per type."""
    e = read_table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.round(F.sum("k"), 4).alias("total"))


JSON_SQL = "SELECT event_type, count(try_cast(props ->> '$.k' AS double)) AS n, round(sum(try_cast(props ->> '$.k' AS double)), 4) AS total FROM events GROUP BY 1"


def sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate distinct users and median next to the exact ones; shows whether both are within their bounds."""
    e = read_table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("d"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.percentile("value", F.lit(0.5)).alias("p"), F.stddev("value").alias("s"))
    return e.select("event_type", F.col("d").alias("users"), (F.abs(F.col("a") - F.col("d")) <= 0.1 * F.col("d") + 1).alias("near_count"), (F.abs(F.col("m") - F.col("p")) <= F.col("s")).alias("near_median"))


SKETCH_SQL = "SELECT event_type, count(DISTINCT user_id) AS users, true AS near_count, true AS near_median FROM events GROUP BY 1"


def pandas_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """A vectorised user function on Arrow batches: a price with tax, summed per flag by built-in aggregation."""

    @F.pandas_udf("double")
    def taxed(price: pd.Series, tax: pd.Series) -> pd.Series:
        return price * (1 + tax)

    return read_table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(taxed("l_extendedprice", "l_tax")), 2).alias("taxed"))


PANDAS_SQL = "SELECT l_returnflag, round(sum(l_extendedprice * (1 + l_tax)), 2) AS taxed FROM lineitem GROUP BY 1"


def unpivot_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Columns to rows and back to one row per measure."""
    p = read_table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "measure", "value").groupBy("measure").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


UNPIVOT_SQL = "SELECT measure, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM (SELECT 'size' AS measure, CAST(p_size AS double) AS value FROM part UNION ALL SELECT 'price', p_retailprice FROM part) GROUP BY 1"


def nearest_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Exact nearest neighbour by dot product of every fiftieth vector among all. The queries are a stated set: they go
    to all rows in blocks of bounded size, and each task keeps its best per query before the shuffle."""
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    blocks = -(-q.count() // QUERIES_PER_BLOCK) or 1
    parts = []
    for k in range(blocks):
        block = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k)
        pairs = e.join(F.broadcast(block), F.col("vec_id") != F.col("query")).select("query", F.struct(F.round(dot, 5).alias("score"), (-F.col("vec_id")).alias("neg")).alias("m"))
        parts.append(pairs.groupBy("query").agg(F.max("m").alias("m")))
    return reduce(DataFrame.unionByName, parts).select(F.col("query").alias("vec_id"), (-F.col("m.neg")).alias("nearest"), F.col("m.score").alias("score"))


NEAREST_SQL = "SELECT q.vec_id, e.vec_id AS nearest, round(list_dot_product(CAST(e.embedding AS double[]), CAST(q.embedding AS double[])), 5) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(e.embedding AS double[]), CAST(q.embedding AS double[])), 5) DESC, e.vec_id) = 1"

QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, semi_anti, outer_joins, frames, json_props, sketches, pandas_aggregate, unpivot_parts, nearest_labels)}
ORACLES = dict(zip(QUERIES, (PRICING_SQL, REVENUE_SQL, SEMI_SQL, OUTER_SQL, FRAMES_SQL, JSON_SQL, SKETCH_SQL, PANDAS_SQL, UNPIVOT_SQL, NEAREST_SQL), strict=True))
