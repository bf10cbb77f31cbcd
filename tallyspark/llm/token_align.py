"""Alignment of two tokenizers over the bytes of the same texts, by merge-path partitioning.

Every document is encoded twice and each side gives the byte places where its tokens end. The two rows
of ends of a whole block of documents are merged along the merge path: a binary search on every
``work``-th diagonal, all at once, cuts the merge into pieces of equal work, whatever the lengths of the
documents; each piece finds the ends that both sides share by itself, and an end whose two sides fall
on either side of a cut is found when neighbouring pieces are stitched. Shared ends close the
groups. The pairs of tokens that end together are counted over the whole corpus by joins: a block
sends each different pair once, so a pair that occurs everywhere is one row a block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: Bytes of text of a block (a longer text is a block of its own), and steps of the merge in a piece.
BLOCK_BYTES, WORK = 2 << 20, 1 << 14
#: How a byte-level vocabulary cuts a text before merging.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two rising rows crosses every ``work``-th diagonal: the numbers taken of ``a`` and of ``b``.

    On equal values ``a`` goes first. The searches run side by side, in as many rounds as one takes.
    """
    d = np.append(np.arange(0, len(a) + len(b), work, dtype=np.int64), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        take = np.zeros(len(d), bool)
        take[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & take, mid + 1, low), np.where(open_ & ~take, mid, high)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in one piece's two rows whose values are equal."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
    return hit, at[hit]


def shared_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The places in two strictly rising rows at which they hold the same values, in order."""
    i, j = diagonals(a, b, work)
    left, right = [], []
    for k in range(len(i) - 1):
        x, y = piece_overlaps(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        left.append(x + i[k])
        right.append(y + j[k])
        # the cut may run between the two sides of one end
        if i[k + 1] and j[k + 1] < len(b) and a[i[k + 1] - 1] == b[j[k + 1]]:
            left.append(np.array([i[k + 1] - 1]))
            right.append(np.array([j[k + 1]]))
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


class ByteLevel:
    """A byte-level vocabulary (tokenizer JSON): identifiers of texts, and the bytes of each identifier.

    The file's merges have to be in the order of their identifiers, as they are where it was made by merging; then
    an identifier is a rank and the ranks alone encode. Special tokens are left out, so their strings are plain text.
    """

    def __init__(self, content: bytes) -> None:
        import tiktoken

        spec = json.loads(content)
        vocab, special = spec["model"]["vocab"], {t["id"] for t in spec["added_tokens"] if t["special"]}
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(x >= y for x, y in zip(joined, joined[1:])):
            raise ValueError("not a plain byte-level vocabulary with merges in order")
        shown = self._shown()
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.pieces[i] = t.encode() if i in special else bytes(shown[c] for c in t)
        self._coder = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={self.pieces[i]: i for i in vocab.values() if i not in special}, special_tokens={})

    @staticmethod
    def _shown() -> dict[str, int]:
        """The character that stands for each byte: itself where it is printable, else the next free one from 256."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._coder.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]


class Pieces:
    """A sentence-piece model with byte fallback."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        m = self._model
        self.pieces = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._model.encode(texts, num_threads=1)]


class Digits:
    """Identifiers as decimal digits in rows of fixed width, the last column being for what follows them."""

    def __init__(self, n: int) -> None:
        width = len(str(max(n - 1, 0)))
        self.rows = np.zeros((n, width + 1), np.uint8)
        for i in range(n):
            s = str(i).encode()
            self.rows[i, : len(s)] = np.frombuffer(s, np.uint8)


def align_block(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray, digits: np.ndarray, work: int = WORK) -> dict[str, np.ndarray | list]:
    """Groups and links of the documents of a block, whose identifiers on both sides are given.

    Gives ``n_a, n_b, n_groups`` and ``sha256`` a document; the different pairs of the block (``pairs``, as identifier
    of a times the size of b's vocabulary plus identifier of b) with their ``pair_times``; and for the
    documents one after the other their different links as places in ``pairs`` (``at``, ``times``, ``per_doc`` of them).
    """
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    i, j = shared_ends(np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b]), work)
    # groups in order: the tokens of a, then those of b
    group_a, group_b = np.searchsorted(i, np.arange(len(ids_a))), np.searchsorted(j, np.arange(len(ids_b)))
    before_b, before_a = np.concatenate([[0], j + 1])[group_a], (i + 1)[group_b]
    out = np.empty((len(ids_a) + len(ids_b), digits.shape[1]), np.uint8)
    row_a, row_b = digits[ids_a], digits[ids_b]
    row_a[:, -1] = row_b[:, -1] = ord(",")
    row_a[i, -1], row_b[j, -1] = ord("|"), ord(";")
    row_b[first_b[1:][n_b > 0] - 1, -1] = 0
    out[np.arange(len(ids_a)) + before_b], out[np.arange(len(ids_b)) + before_a] = row_a, row_b
    starts = first_a + first_b
    sha = [hashlib.sha256(out[s:e].tobytes().translate(None, b"\0")).hexdigest() if e > s else "" for s, e in zip(starts, starts[1:])]
    doc = np.searchsorted(first_a, i, side="right") - 1
    pairs, at = np.unique(ids_a[i] * len(size_b) + ids_b[j], return_inverse=True)
    linked, times = np.unique(doc * max(len(pairs), 1) + at, return_counts=True)
    docs = linked // max(len(pairs), 1)
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc, minlength=len(a)), "sha256": sha, "pairs": pairs, "pair_times": np.bincount(at, minlength=len(pairs)), "at": linked % max(len(pairs), 1), "times": times, "per_doc": np.bincount(docs, minlength=len(a))}


def _cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes together stay below ``most``; a larger row is a run of its own."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield start, k
            start, held = k, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, work: int = WORK) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row for every row of ``docs``.

    Side A encodes space and text by the byte-level vocabulary at ``byte_level``, side B the text by the
    sentence-piece model at ``pieces``, both without special tokens. Both files are read by the driver and sent to
    the executors; they have a fixed size. A group runs between byte places where both sides end a token; a link is a
    pair of tokens that end together. ``count_sum`` adds up how often each link's pair of identifiers is linked in
    the whole table, ``n_best`` counts the links whose pair is the most frequent of its B identifier, ties
    included. ``groups_sha256`` digests the groups as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that one side does not give back byte by byte, have no tokens: zeros and an
    empty digest. Repeated rows and ids, null ids among them, are rows of their own and count each time; other columns are
    not read; an empty table gives an empty result. A text is encoded whole, however long: memory is that of one
    block or of the longest text.
    """
    spark = docs.sparkSession
    with open(byte_level, "rb") as f, open(pieces, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, block long, n_a long, n_b long, n_groups long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, pair_times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        side_a, side_b = ByteLevel(files.value[0]), Pieces(files.value[1])
        size_a, size_b = (np.array([len(p) for p in s.pieces], np.int64) for s in (side_a, side_b))
        digits, block = Digits(max(len(size_a), len(size_b))).rows, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for start, stop in _cuts(sizes, block_bytes):
                texts = [t or "" for t in batch.column("text").slice(start, stop - start).to_pylist()]
                a, b = side_a.encode(texts), side_b.encode(texts)
                for k, t in enumerate(texts):
                    whole = b" " + t.encode("utf-8", "replace")
                    if not t or b"".join(map(side_a.pieces.__getitem__, a[k])) != whole or b"".join(map(side_b.pieces.__getitem__, b[k])) != whole:
                        a[k] = b[k] = a[k][:0]
                r = align_block(a, b, size_a, size_b, digits, work)
                n, lists = stop - start, np.concatenate([[0], np.cumsum(r["per_doc"])]).astype(np.int32)
                once = pa.array([0, *[len(r["pairs"])] * n], pa.int32())  # the block's pairs go with its first row
                ints = lambda k, t: pa.array(r[k].astype(t))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(start, n), pa.array([block] * n, pa.int64()), ints("n_a", np.int64), ints("n_b", np.int64), ints("n_groups", np.int64), pa.array(r["sha256"], pa.string()),
                    pa.ListArray.from_arrays(pa.array(lists), ints("at", np.int32)), pa.ListArray.from_arrays(pa.array(lists), ints("times", np.int32)),
                    pa.ListArray.from_arrays(once, ints("pairs", np.int64)), pa.ListArray.from_arrays(once, ints("pair_times", np.int64)),
                ], names=["id", "block", "n_a", "n_b", "n_groups", "groups_sha256", "at", "times", "pairs", "pair_times"])
                block += 1

    rows = materialize(src.mapInArrow(run, schema), "aligned")
    n_b = Pieces(files.value[1])._model.get_piece_size()
    held = rows.where(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("place", "p")).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.pair_times").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.pmod("pair", F.lit(n_b)))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    counted = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = held.drop("n").join(counted, "pair").select(F.col("block").alias("home"), "place", "count", "best")

    def look_up(docs_: pa.Table, found: pa.Table) -> pa.Table:
        count, best_ = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        place = found["place"].to_numpy()
        count[place], best_[place] = found["count"].to_numpy(), found["best"].to_numpy().astype(np.int64)
        at, times = (docs_[c].combine_chunks() for c in ("at", "times"))
        per_doc = pc.list_value_length(at).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        at, times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

        def total(x: np.ndarray) -> pa.Array:
            out = np.zeros(len(per_doc), np.int64)  # whole numbers: bincount with weights would go through doubles
            np.add.at(out, doc, x)
            return pa.array(out)

        return pa.table([docs_["id"], docs_["n_a"], docs_["n_b"], docs_["n_groups"], total(times), total(times * best_[at]), total(times * count[at]), docs_["groups_sha256"]],
                        names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    lean = rows.select("id", "block", "n_a", "n_b", "n_groups", "groups_sha256", "at", "times")
    return lean.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(look_up, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
