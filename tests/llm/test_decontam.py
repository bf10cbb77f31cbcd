from itertools import combinations

import tallyspark.llm.decontam as decontam
from corpus_pipeline import decontaminate
from tallyspark.llm.decontam import find_leaks, masks
from tallyspark.llm.queries.decontam_query import op4_benchmark_leaks

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def test_some_mask_ignores_any_two_positions():
    for span, subs in ((13, 2), (20, 3), (8, 1), (13, 0)):
        assert all(any(not set(m) & set(bad) for m in masks(span, subs)) for bad in combinations(range(span), subs))


def _found(spark, texts, bench, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {r.id: r for r in find_leaks(docs, items, **how).collect()}


def test_substitutions_up_to_two_in_a_window(spark):
    def text(*at):
        w = list(ITEM)
        for i in at:
            w[i] = "other"
        return "before the passage, " + " ".join(w).upper() + "! after it"

    got = _found(spark, [text(), text(3), text(1, 7), text(6, 7, 8), " ".join(ITEM[:12]), " ".join(ITEM[1:14])], [" ".join(ITEM)])
    assert set(got) == {0, 1, 2, 5}
    assert (got[0].subs, got[1].subs, got[2].subs, got[0].windows, got[0].first_at) == (0, 1, 1, 3, 3)


def test_short_items_shared_windows_and_seeds_joined_by_shuffling(spark, monkeypatch):
    short = "one two three four five six seven eight nine"
    bench = [short, "too short to count", " ".join(ITEM), " ".join(ITEM), None, ""]
    texts = ["x " + short.replace("three", "tree") + " y", "too short to count", " ".join(ITEM), None, ""]
    want = {0: (0, 1, 1), 2: (2, 2, 3)}
    assert {i: (r["item"], r["items"], r["windows"]) for i, r in _found(spark, texts, bench).items()} == want
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert {i: (r["item"], r["items"], r["windows"]) for i, r in _found(spark, texts, bench).items()} == want


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog slept by the door all day long", 5), (None, "a row without a number it has a text all the same", 5)], "item_id long, text string, id int")
    got = {r.id: r["item"] for r in find_leaks(odd_docs, bench).collect()}
    assert got == {1: 1, None: None}
    assert find_leaks(no_docs, bench).count() == find_leaks(odd_docs, bench.limit(0)).count() == 0


def test_short_items_match_as_whole_runs(spark, tmp_path):
    bench, texts = ["Who wrote Hamlet?", "Photosynthesis", "one two three four five six seven"], ["asked: who wrote hamlet, and when", "who really wrote hamlet", "PHOTOSYNTHESIS.", "one two three four five six other", "0 one two three four five six seven"]
    assert {i: r["item"] for i, r in _found(spark, texts, bench, exact_short=True).items()} == {0: 0, 2: 1, 4: 2}
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in op4_benchmark_leaks(spark, str(tmp_path)).collect()} == {0, 2, 4}
    assert {r.doc_id for r in decontaminate(spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_scripts_without_spaces_are_cut_into_letters(spark):
    zh, ja, th = "水在标准大气压下的沸点是多少摄氏度", "日本で一番高い山は何という山ですか", "เมืองหลวงของประเทศไทยคือเมืองอะไร"
    texts = [f"前面的文字{zh}后面的文字", f"まえの{ja}あと", f"ก่อน{th}หลัง", zh.replace("沸", "熔"), zh[:8] + "完全不同的句子", "nothing of it"]
    assert {i: r["item"] for i, r in _found(spark, texts, [zh, ja, th]).items()} == {0: 0, 1: 1, 2: 2, 3: 0}
