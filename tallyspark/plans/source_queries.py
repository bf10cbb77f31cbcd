"""Sources, sinks and extensions: the given tables are written below the scratch folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.operators import linear as L
from tallyspark.operators import network as N
from tallyspark.plans import views as V
from tallyspark.plans.catalog import query, rounded
from tallyspark.registry import Result, analysis, run
from tallyspark.runtime import scratch_dir
from tallyspark.sources import tables as S


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark, d):
    path = f"{_folder(spark, 'orders')}.csv"
    V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").write.option("header", True).csv(path)
    back = S.read_table(spark, path)
    return back.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("text_table", "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, nullif(role, '') AS role, nullif(text, '') AS text FROM conversations")
def text_table(spark, d):
    return S.read_text_table(spark, f"{d}/conversations.parquet")


@query("written_tables", "SELECT 'status' AS name, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def written_tables(spark, d):
    o, folder = V.table(spark, d, "orders"), _folder(spark, "run")
    count = lambda c: o.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    S.write_tables({"status": count("o_orderstatus"), "priority": count("o_orderpriority")}, folder)
    read = lambda n: spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("name"), "key", "n")
    return read("status").unionByName(read("priority"))


@query("run_ledger", """SELECT 'orders' AS run, '{"rows": ' || (SELECT count(*) FROM orders) || '}' AS counts UNION ALL SELECT 'lines', '{"rows": ' || (SELECT count(*) FROM lineitem) || '}'""")
def run_ledger(spark, d):
    path = _folder(spark, "ledger")
    for name, table in (("orders", "orders"), ("lines", "lineitem")):
        S.append_ledger(spark, path, name, {"rows": V.table(spark, d, table).count()})
    return spark.read.parquet(path).select("run", "counts")


@query("mixed_offsets", """SELECT CAST(o_orderkey AS VARCHAR) AS episode, 'some times have a time-zone offset and others do not' AS problem FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)""")
def mixed_offsets(spark, d):
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    ep = o.select(F.col("o_orderkey").cast("string").alias("episode"), at("o_orderdate").alias("anchor_earliest"), at(F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("tw_earliest"), F.lit("1").alias("r_step"))
    st = li.select(F.col("l_orderkey").cast("string").alias("episode"), F.col("l_linenumber").cast("string").alias("step"), F.lit("logistics").alias("clock"),
                   F.concat(at("l_shipdate"), F.when(F.col("l_linenumber") == 3, "+01:00").otherwise("")).alias("finish_earliest"))
    labels, synonyms = N.clock_set()
    problems = N.read_episodes(ep, st, labels, synonyms)[2]
    return problems.where("problem like '%time-zone%'").select("episode", "problem")


@query("extension_run", "SELECT o_orderstatus AS level, count(*) AS n, round(max(o_totalprice), 4) AS dearest FROM orders GROUP BY 1")
def extension_run(spark, d):
    @analysis("dearest_per_level", "Largest value per level", "User")
    def dearest(df, value, by):
        return Result({"table": df.groupBy(F.col(by).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("dearest"))})

    return rounded(run("dearest_per_level", V.table(spark, d, "orders"), {"value": "o_totalprice", "by": "o_orderstatus"})["table"], 4)


@query("linear_contrast", """WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS xb, avg(l_extendedprice) AS yb, var_pop(l_quantity) * count(*) AS sxx, covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem),
  f AS (SELECT *, sxy / sxx AS b, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS s FROM m)
  SELECT round(yb + (10 - xb) * b, 4) AS estimate, round(s * sqrt(1.0 / n + (10 - xb) ** 2 / sxx), 4) AS se, CAST(n - 2 AS DOUBLE) AS df FROM f""")
def linear_contrast(spark, d):
    r = L.linear_contrast(V.table(spark, d, "lineitem"), "l_extendedprice", {"(Intercept)": 1.0, "l_quantity": 10.0}, "l_quantity")
    return rounded(r.select("estimate", "se", "df"), 4)
