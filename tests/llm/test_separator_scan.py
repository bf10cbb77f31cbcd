import base64

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyspark.llm.queries.separator_query import VOCABULARY, op3_separator_token_counts
from tallyspark.llm.separator_scan import END, scan_separators, write_tokens
from tallyspark.llm.shared_files import new_folder, write_file
from tallyspark.runtime import materialize


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_document_is_counted(spark, coder):
    d = "/root/testdata/sf0.001"
    got = sorted((r.doc_id, r.n_tokens) for r in op3_separator_token_counts(spark, d).collect())
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    assert got == sorted((i, len(coder.encode_ordinary(t or ""))) for i, t in rows)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_documents_across_blocks(spark, block):
    ids = [END, 5, 6, END, END, *range(100, 180), END, 7, 8, 9]
    folder = new_folder(spark, "flat")
    size = write_file(folder, "x.bin", [np.array(ids, "<u2").tobytes()])
    write_file(folder, "none.bin", [])
    files = spark.createDataFrame([(f"{folder}/x.bin", size), (f"{folder}/none.bin", 0)], "file string, size long")
    got = [(r.ordinal, r.start, r.n_tokens, r.closed) for r in scan_separators(files, block=block).orderBy("ordinal").collect()]
    assert got == [(0, 0, 0, True), (1, 1, 2, True), (2, 4, 0, True), (3, 5, 80, True), (4, 86, 3, False)]


def test_odd_rows(spark, odd_docs, no_docs, coder):
    w = materialize(write_tokens(odd_docs, new_folder(spark, "flat"), VOCABULARY, public_tokenizers.PATTERN), "w")
    counts = sorted(r.n_tokens for r in scan_separators(w.select("file", "size").distinct(), block=1024).collect())
    assert counts == sorted(len(coder.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert sorted(map(str, (i for r in w.collect() for i in r["ids"]))) == sorted(str(r.doc_id) for r in odd_docs.collect())
    none = materialize(write_tokens(no_docs, new_folder(spark, "flat"), VOCABULARY, public_tokenizers.PATTERN), "w")
    assert scan_separators(none.select("file", "size").distinct()).count() == 0
