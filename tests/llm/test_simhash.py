import re

import duckdb
import numpy as np
import pytest
import xxhash

from tallyspark.llm.graph import components
from tallyspark.llm.queries.simhash_query import op10_simhash_components
from tallyspark.llm.simhash import near_duplicates, simhash_groups


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _shingles(text, k):
    w = _words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def _print(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in _shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def _docs(d):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{d}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_components_equal_brute_force(spark, d):
    rows = _docs(d)
    prints = [_print(t) for _, t in rows]
    v = np.array(prints, np.uint64)
    roots = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in np.nonzero(np.bitwise_count(v[i] ^ v) <= 2)[0] if j > i])
    want = sorted((i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, op10_simhash_components(spark, d).collect())) == want


def test_tiles_of_any_size_find_the_same(spark, monkeypatch):
    import tallyspark.llm.simhash as simhash

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, simhash_groups(d).collect()))
    for name, n in (("STRIP_ROWS", 3), ("STRIP_COLS", 5)):
        monkeypatch.setattr(simhash, name, n)
    monkeypatch.setattr(simhash.tiles_of, "__defaults__", (16,))
    assert sorted(map(tuple, simhash_groups(d).collect())) == want


def test_near_duplicates_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = _docs(d)
    sets = [set(_shingles(t, 5)) for _, t in rows]
    like = lambda a, b: not a and not b or bool(a | b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    roots = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if like(sets[i], sets[j])])
    assert {r.doc_id for r in near_duplicates(spark.read.parquet(f"{d}/documents.parquet")).collect()} == {rows[i][0] for i, r in enumerate(roots) if r == i}


def test_a_large_group_of_near_copies_goes_by_blocks(spark, monkeypatch):
    import tallyspark.llm.simhash as simhash

    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1 :]), 0) for i in range(100)] + [(500, "quite another text of a few words", 0)]
    kept = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 500]


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.root for r in got if r.f0 == 0} == {2} and {r.root for r in got if r.id is None} == {None}
    kept = near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(["1", "1", "None", "2", "5", "6", "7"])
    assert simhash_groups(no_docs).count() == near_duplicates(no_docs).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1100)) and 5 not in got


def test_near_duplicates_equal_brute_force_on_a_thousand_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = _docs(d)
    sets = [set(_shingles(t, 5)) for _, t in rows]
    sized = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-9
    like = lambda a, b: not a and not b or sized(a, b) and len(a & b) >= 0.8 * len(a | b) - 1e-9
    roots = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if like(sets[i], sets[j])])
    assert {r.doc_id for r in near_duplicates(spark.read.parquet(f"{d}/documents.parquet")).collect()} == {rows[i][0] for i, r in enumerate(roots) if r == i}


def test_no_short_pair_at_the_threshold_is_lost(spark):
    # pairs of 8 and 9 words, 4 of 5 shingles common, and of 19 and 16 words, 12 of 15; all share some words
    pairs = [(n * 10_000 + 2 * i + j, " ".join(f"{'the' if w == 3 else f'w{n}x{i}x{w}'}" for w in range(m))) for n, sizes in ((1, (8, 9)), (2, (16, 19))) for i in range(1500) for j, m in enumerate(sizes)]
    kept = {r.doc_id for r in near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == {i for i, _ in pairs if i % 2 == 0}
