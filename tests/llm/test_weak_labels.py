from tallyspark.llm.queries.quality_query import op7_weak_label_quality
from tallyspark.llm.weak_labels import fit_label_model, fit_quality, keep_good


def test_accuracies_are_recovered():
    from random import Random

    rng, counts = Random(5), {}
    right = [0.95, 0.9, 0.8, 0.7]
    for _ in range(20_000):
        good = rng.random() < 0.8
        vote = tuple((1 if (rng.random() < r) == good else -1) if rng.random() < 0.7 else 0 for r in right)
        counts[vote] = counts.get(vote, 0) + 1
    model = fit_label_model(sorted(counts.items()))
    assert abs(model.prior - 0.8) < 0.03
    assert all(abs(a - r) < 0.04 and abs(b - r) < 0.08 for (a, b), r in zip(model.right, right))
    assert model.posterior([1, 1, 1, 1]) > 0.99 and model.posterior([-1, -1, -1, -1]) < 0.05


def test_accuracy_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = op7_weak_label_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r.quality, r.keep): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_odd_rows(spark, odd_docs, no_docs):
    kept = keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.where("trim(coalesce(text, '')) = '' or doc_id = 4").count() == 0
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 1").count() == 3
    assert keep_good(no_docs).count() == 0
    score = fit_quality(no_docs).score(spark)
    assert all(0 < r.s < 1 for r in odd_docs.where("doc_id = 1").select(score("text").alias("s")).collect())  # it knows nothing
