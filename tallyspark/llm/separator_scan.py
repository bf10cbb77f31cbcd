"""Token counts of documents from flat token files without an index.

A token file is the documents' identifiers one after the other, each document closed by the
end-of-document identifier, all of one width. Tasks take blocks of bytes, find the separators of a
block at once, and give one row a block; a prefix scan over the blocks of a file (running number of
separators, running place of the last one) then stitches the documents that cross blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared_files import open_fs, ranges, write_file

#: Bytes of a block; a multiple of every width.
BLOCK = 4 << 20
#: The end-of-document identifier and the type of the identifiers.
END, KIND = 50256, "<u2"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, kind: str = KIND) -> DataFrame:
    """Tokenise the documents into one file a task: ``file, size, ids``, the file's bytes and its documents' ids in order.

    ``vocabulary``: path of a file of byte-pair ranks (base64 and rank a line), read by the driver and sent to the
    executors; it has a fixed size. Null texts are empty documents. Tasks that are repeated write the same file again.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        if max(table.values()) >= end or end > np.iinfo(kind).max:
            raise ValueError("the end-of-document identifier must lie above the vocabulary and fit the type")
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        name, ids = f"part-{TaskContext.get().partitionId():06d}.bin", []
        close = np.array([end], kind).tobytes()

        def parts() -> Iterator[bytes]:
            for b in batches:
                ids.append(b.column("id"))
                for t in b.column("text"):
                    if t := t.as_py():
                        yield coder.encode_to_numpy(t, disallowed_special=()).astype(kind).tobytes()
                    yield close

        size, first = write_file(folder, name, parts()), 0
        for part in ids:  # a row for each batch, so that no row grows with the file
            held = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([first], pa.int64()), held], names=["file", "size", "first", "ids"])
            first += len(part)

    return src.mapInArrow(run, f"file string, size long, first long, ids array<{src.schema['id'].dataType.simpleString()}>")


def scan_separators(files: DataFrame, end: int = END, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed``: every document of the files (columns file, size), counted from 0 in each.

    ``start`` is the place of its first identifier. Documents may be empty and may cross any number of
    blocks. Identifiers after the last separator are a document that is not ``closed``; bytes at the
    end that do not make up an identifier are passed over. An empty file has no documents.
    """
    width = np.dtype(kind).itemsize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                fs, path = open_fs(r.file)
                with fs.open_input_file(path) as file:
                    data = file.read_at(r.stop - r.start, r.start)
                ids = np.frombuffer(data[: len(data) // width * width], kind)
                found = np.flatnonzero(ids == end) + r.start // width
                yield pd.DataFrame({"file": [r.file], "begin": [r.start // width], "stop": [r.start // width + len(ids)], "final": [r.stop >= r.size], "n": [len(found)], "last": [int(found[-1]) if len(found) else -1], "at": [found]})

    if block % width:
        raise ValueError("a block must hold whole identifiers")
    blocks = ranges(files, block).mapInPandas(run, "file string, begin long, stop long, final boolean, n long, last long, at array<long>")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("open", F.greatest(F.coalesce(F.max("last").over(before), F.lit(-1)), F.lit(-1)) + 1)
    # in a block each separator closes the document that begins after the one before it; the first begins where the blocks before left off
    starts = F.concat(F.array("open"), F.transform("at", lambda p: p + 1))
    ends = F.concat(F.col("at"), F.when(F.col("final") & (F.col("stop") > F.greatest("last", F.col("open") - 1) + 1), F.array("stop")).otherwise(F.array().cast("array<long>")))
    docs = scanned.select("file", "ordinal", "n", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(ends)).alias("start"), ends.alias("end"))).alias("i", "d"))
    return docs.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.end") - F.col("d.start")).alias("n_tokens"), (F.col("i") < F.col("n")).alias("closed"))


def remove(folder: str) -> None:
    """Delete the token files once their counts are written."""
    fs, path = open_fs(folder)
    if fs.get_file_info(path).type.name == "Directory":
        fs.delete_dir(path)
