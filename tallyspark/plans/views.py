"""Input views derived from the supplied tables, in Spark and as SQL for the cross-check.

Every view exists twice on purpose: the DataFrame form feeds the operators, the SQL
text is prefixed to the comparison query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.order_stats import row_numbers
from tallyspark.runtime import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("x_null", F.when(F.col("l_linenumber") != 7, F.col("l_discount")))


LINES = "v_lines AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_discount END AS x_null FROM lineitem)"


def pairs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1998-04-25").cast("timestamp")
    return o.groupBy("o_custkey").agg(
        F.avg(F.when(early, F.col("o_totalprice"))).alias("y1"),
        F.avg(F.when(~early, F.col("o_totalprice"))).alias("y2"),
        F.count_if(early).cast("double").alias("k1"),
        F.count_if(~early).cast("double").alias("k2"),
    )


PAIRS = """v_pairs AS (SELECT o_custkey,
  avg(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1998-04-25') AS y1,
  avg(o_totalprice) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-04-25') AS y2,
  CAST(count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-04-25') AS DOUBLE) AS k1,
  CAST(count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-04-25') AS DOUBLE) AS k2
  FROM orders GROUP BY o_custkey)"""


def doc_labels(spark, d) -> DataFrame:
    """Two given raters and a third one: long documents (over 500 characters)."""
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id").withColumn(
        "long", (F.col("n_chars") > 500).cast("int"))


DOC_LABELS = """v_doc AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic,
  CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS long FROM documents d JOIN labels l USING (doc_id))"""


def items(spark, d) -> DataFrame:
    """Six five-point items and three continuous raters from the first embedding dimensions."""
    e = F.col("embedding")
    item = lambda i: F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.floor(3.5 + e[i].cast("double") * 8).cast("double")))
    return table(spark, d, "embeddings").select(
        "vec_id", "label", *[item(i).alias(f"q{i + 1}") for i in range(6)], *[e[6 + i].cast("double").alias(f"r{i + 1}") for i in range(3)])


ITEMS = ("v_items AS (SELECT vec_id, label, "
         + ", ".join(f"greatest(1.0, least(5.0, floor(3.5 + CAST(embedding[{i + 1}] AS DOUBLE) * 8)))::DOUBLE AS q{i + 1}" for i in range(6)) + ", "
         + ", ".join(f"CAST(embedding[{i + 7}] AS DOUBLE) AS r{i + 1}" for i in range(3)) + " FROM embeddings)")


def customers(spark, d) -> DataFrame:
    """One row per customer with its orders rolled up."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"))
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"), "mean_price", "share_f")


CUSTOMERS = """v_cust AS (SELECT c.c_custkey, c.c_nationkey, c.c_mktsegment, c.c_acctbal,
  CAST(coalesce(o.n_orders, 0) AS DOUBLE) AS n_orders, o.mean_price, o.share_f
  FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price,
    avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share_f FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey)"""


def fuzzy(spark, d) -> DataFrame:
    """Calibrated set memberships of customers; the outcome is a high mean price."""
    from tallyspark.functions.columns import fuzzy_calibrate

    return customers(spark, d).where("mean_price is not null").select(
        "c_custkey",
        fuzzy_calibrate("c_acctbal", -500, 4500, 9000).alias("rich"),
        fuzzy_calibrate("n_orders", 3, 9.5, 16).alias("busy"),
        fuzzy_calibrate("share_f", 0, 0.35, 0.8).alias("settled"),
        fuzzy_calibrate("mean_price", 150000, 250000, 350000).alias("dear"))


def _calibrate_sql(x: str, a: float, b: float, c: float) -> str:
    return (f"greatest(0.0001, least(0.9999, 1 / (1 + exp(-2.9444389791664403 * ({x} - {b}) / "
            f"CASE WHEN {x} <= {b} THEN CAST({b - a} AS DOUBLE) ELSE CAST({c - b} AS DOUBLE) END))))")


FUZZY = f"""{CUSTOMERS}, v_fuzzy AS (SELECT c_custkey,
  {_calibrate_sql('c_acctbal', -500, 4500, 9000)} AS rich, {_calibrate_sql('n_orders', 3, 9.5, 16)} AS busy,
  {_calibrate_sql('share_f', 0, 0.35, 0.8)} AS settled, {_calibrate_sql('mean_price', 150000, 250000, 350000)} AS dear
  FROM v_cust WHERE mean_price IS NOT NULL)"""


def dyads(spark, d) -> DataFrame:
    return customers(spark, d).select(
        F.floor(F.col("c_custkey") / 2).alias("dyad"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("side"),
        F.when(F.col("c_nationkey") != 3, F.col("c_acctbal")).alias("balance"), "n_orders")


DYADS = f"""{CUSTOMERS}, v_dyads AS (SELECT c_custkey // 2 AS dyad, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS side,
  CASE WHEN c_nationkey <> 3 THEN c_acctbal END AS balance, n_orders FROM v_cust)"""


def coding(spark, d) -> DataFrame:
    """Coded statements: one row per conversation turn."""
    n = F.length("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"),
        F.when(n < 200, "short").when(n < 800, "medium").otherwise("long").alias("code"),
        F.col("turn").alias("source_id"),
        F.when(F.col("role") == "user", "oppose").when(F.col("role") == "assistant", "support").otherwise("neutral").alias("direction"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300 + F.col("turn")).cast("int")).cast("string").alias("event_date"))


CODING = """v_coding AS (SELECT conv_id AS case_id, CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 800 THEN 'medium' ELSE 'long' END AS code,
  turn AS source_id, CASE role WHEN 'user' THEN 'oppose' WHEN 'assistant' THEN 'support' ELSE 'neutral' END AS direction,
  CAST(DATE '2024-01-01' + CAST(conv_id % 300 + turn AS INTEGER) AS VARCHAR) AS event_date FROM conversations)"""


LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def ordered_lines(spark, d) -> DataFrame:
    """Lines of an order numbered in a fixed order; the pair (order, line number) of the table is not unique.

    Written once, as every query reads them several times.
    """
    return materialize(row_numbers(table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER), ["l_orderkey"], LINE_ORDER, "ln"), "ordered_lines")


ORDERED_LINES = f"""v_ol AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY {', '.join(LINE_ORDER)}) AS ln FROM lineitem)"""
