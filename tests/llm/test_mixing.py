from pyspark.sql import functions as F

from tallyspark.llm.mixing import cycled_weights, mix, targets


def test_targets_stop_at_three_epochs_and_share_the_excess(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 90)], "src string, n long")
    got = {r.src: r.target for r in targets(cycled_weights(s, "src", (5, 2, 1)), "n", "weight", 3).collect()}
    assert got["a"] == 30 and got[None] == 270  # null is last and starts the weights anew with 5
    assert abs(got["b"] - 1300 * 2 / 3) < 1e-9 and abs(got["c"] - 1300 / 3) < 1e-9 and abs(sum(got.values()) - 1600) < 1e-9


def test_words_come_near_the_targets_and_reruns_agree(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 37 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    m = mix(rows)
    sums = m.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.max("mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 2 for r in sums)
    assert m.where("mix_copies > 3").count() == 0
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mix(rows.repartition(7)).collect()))


def test_importance_makes_inclusion_unequal(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.when(F.col("id") < 1500, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 8.0).otherwise(1.0).alias("w"))
    m = mix(rows, weights=(1, 1), importance=F.col("w"))
    mean = {r.w: r.c for r in m.groupBy("w").agg(F.avg("mix_copies").alias("c")).collect()}
    assert abs(mean[8.0] - 8 * mean[1.0]) < 0.25 and abs(sum(mean.values()) - 2) < 0.01


def test_odd_rows(spark, odd_docs, no_docs):
    m = mix(odd_docs)
    assert m.columns[: len(odd_docs.columns)] == odd_docs.columns and m.count() == odd_docs.count()
    assert {r.mix_copies for r in m.where("mix_size = 0").collect()} == {0}
    assert m.where("doc_id is null").select("mix_copies").distinct().count() == 1  # equal rows are drawn together
    assert mix(no_docs).count() == 0
