"""Words, shingles and stable draws that several of the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; empty for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def draw_key(*cols: Column, seed: int) -> Column:
    """A 32-digit hexadecimal key of the given values, the same on every run and in every SQL engine with md5."""
    parts = [F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def unit_interval(key: Column) -> Column:
    """The key as a number strictly between 0 and 1, from its first 52 bits."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def shingle_bytes(text: str | None, k: int) -> list[bytes]:
    """Every run of k words of the text, A-Z lowered, joined by one space, repeats included.

    A text of fewer than k words gives its whole sequence, a text without words nothing.
    """
    parts = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if len(parts) <= k:
        return [b" ".join(parts)] if parts else []
    line = b" ".join(parts)
    ends, at = [], -1
    for w in parts:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: len(parts) - k]]
    return [line[s:e] for s, e in zip(starts, ends[k - 1 :])]
