import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.queries.align_query import BYTE_LEVEL, PIECES, op12_token_alignment
from tallyspark.llm.token_align import align_tokens, diagonals, shared_ends

ENDS = st.sets(st.integers(1, 60), max_size=40).map(lambda s: np.array(sorted(s), np.int64))


@settings(deadline=None, max_examples=200)
@given(ENDS, ENDS, st.integers(1, 9))
def test_pieces_find_what_the_whole_merge_finds(a, b, work):
    i, j = diagonals(a, b, work)
    assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b)
    steps = np.diff(i) + np.diff(j)
    assert all(s == work for s in steps[:-1]) and all(s <= work for s in steps[-1:])
    x, y = shared_ends(a, b, work)
    assert a[x].tolist() == b[y].tolist() == sorted({*a.tolist()} & {*b.tolist()})


def brute(docs):
    """Groups and links token by token, with the plain encoders."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_LEVEL)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of, k = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            byte_of[chr(x)] = x
        else:
            byte_of[chr(256 + k)], k = x, k + 1
    rows, links = [], Counter()
    for doc_id, text in docs:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        whole = b" " + (text or "").encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append((doc_id, 0, 0, [], []))
            continue
        groups, linked, x, y, at_a, at_b = [], [], 0, 0, 0, 0
        part_a, part_b = [], []
        while x < len(a) or y < len(b):
            if at_a <= at_b and x < len(a):
                at_a, part_a, x = at_a + len(bytes_a[x]), [*part_a, a[x]], x + 1
            else:
                at_b, part_b, y = at_b + len(bytes_b[y]), [*part_b, b[y]], y + 1
            if at_a == at_b:
                groups.append(",".join(map(str, part_a)) + "|" + ",".join(map(str, part_b)))
                linked.append((part_a[-1], part_b[-1]))
                part_a, part_b = [], []
        links.update(linked)
        rows.append((doc_id, len(a), len(b), groups, linked))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return sorted((d, na, nb, len(g), len(ls), sum(links[p] == most[p[1]] for p in ls), sum(links[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in rows)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_equals_token_by_token_alignment(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r.doc_id, *[r[c] for c in COLUMNS]) for r in op12_token_alignment(spark, d).collect())
    assert got == brute(docs)


def test_small_blocks_and_odd_texts(spark):
    texts = ["", None, " ", "  two  spaces ", "a▁b", "tab\tnew\n\nline", "<s> <unk> </s> <|endoftext|> <0x41>", "ﬁ ½ é", "日本語のテキスト 🙂🙂", "\x00nul", "x" * 3000, "the cat sat " * 4000, "the cat sat", "the cat sat"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, block string, at int").repartition(3)
    got = align_tokens(df, BYTE_LEVEL, PIECES, block_bytes=64, work=7)
    assert sorted((r.id, *[r[c] for c in COLUMNS]) for r in got.collect()) == brute(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    got = align_tokens(odd_docs, BYTE_LEVEL, PIECES).collect()
    assert len(got) == odd_docs.count() and sum(r.id is None for r in got) == 2
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in got if r.id in (2, 3))
    assert align_tokens(no_docs, BYTE_LEVEL, PIECES).count() == 0


def test_a_vocabulary_out_of_order_is_refused():
    import json

    from tallyspark.llm.token_align import ByteLevel

    with open(BYTE_LEVEL) as f:
        spec = json.load(f)
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    with pytest.raises(ValueError, match="in order"):
        ByteLevel(json.dumps(spec).encode())
