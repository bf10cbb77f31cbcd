from pyspark.sql import functions as F

from tallyspark.llm.queries.toxicity_query import op13_toxicity_grammar
from tallyspark.llm.toxicity import ADDRESS, END, HARM, INTENT, NEGATION, OTHER, REPORT, STRONG, WEAK, Lexicon, fit_toxicity, grammar_table, match_features


def matched(*symbols):
    table, state, out = grammar_table(), 0, []
    for s in symbols:
        state, m = table[state][s]
        out.append(m)
    return [m for m in out if m]


def test_matches_by_context():
    assert matched(WEAK) == [1] and matched(STRONG) == [9]
    assert matched(NEGATION, OTHER, STRONG) == [10] and matched(NEGATION, OTHER, OTHER, OTHER, STRONG) == [9] and matched(NEGATION, END, STRONG) == [9]
    assert matched(REPORT, *[OTHER] * 9, STRONG) == [11] and matched(REPORT, END, STRONG) == [9]
    assert matched(ADDRESS, OTHER, STRONG) == [12] and matched(ADDRESS, NEGATION, STRONG) == [10]
    assert matched(INTENT, OTHER, HARM) == [13] and matched(INTENT, HARM, OTHER) == [13] and matched(ADDRESS, INTENT, HARM) == [14]
    assert matched(HARM) == matched(INTENT, END, HARM) == matched(INTENT, NEGATION, HARM) == []


def test_clauses_count_once():
    lexicon, table = Lexicon({"moron$": 6.0, "lowei": 2.0}), grammar_table()
    f = match_features("You moron moron. Not a moron! loweitum here; nothing.", lexicon, table)
    assert [round(x, 3) for x in f[2:14]] == [0.693, 0, 0, 0, 0, 0, 0, 0, 0, 0.693, 0, 0.693]
    assert match_features(None, lexicon, table) == match_features("", lexicon, table) == [1.0] + [0.0] * (len(f) - 1)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op13_toxicity_grammar(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.005 * n[0, 0]


def test_reruns_agree_and_held_out_labels_do_not_matter(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    spark.read.parquet(f"{d}/documents.parquet").select("text", "doc_id", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source")).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    labels.select("doc_id", F.when(kept, F.col("toxic")).otherwise(1 - F.col("toxic")).alias("toxic")).repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda path: sorted(tuple(r) for r in op13_toxicity_grammar(spark, path).collect())
    assert rows(d) == rows(str(tmp_path))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0), (6, 0, 0), (99, 1, 0)], "doc_id long, toxic int, text int")
    for model in (fit_toxicity(odd_docs, labels), fit_toxicity(no_docs, labels), fit_toxicity(odd_docs, labels.limit(0))):
        got = odd_docs.select("doc_id", model.score(spark)(F.col("text")).alias("s")).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.s <= 1 for r in got)
    assert all(r.s < 0.5 for r in got)
    assert no_docs.select(model.score(spark)(F.col("text"))).count() == 0
