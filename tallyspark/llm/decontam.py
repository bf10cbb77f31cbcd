"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A window is a run of ``span`` words. A fixed mask hashes some of a window's positions and ignores the
others; the masks are chosen so that for any ``max_subs`` substituted positions one mask ignores them
all, hence no window within the tolerance is missed. Benchmark windows are hashed under every mask and
joined with the document windows of equal mask and hash; each hit is then verified position by
position. Documents go through as 64-bit word hashes; only positions that hit leave the scan.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: Words in a window, substitutions allowed in it, and words of the shortest passage that counts.
SPAN, MAX_SUBS, SHORTEST = 13, 2, 8
#: Seeds are sent to every executor up to this number (16 bytes each); more of them are joined by shuffling.
BROADCAST_SEEDS = 2_000_000


def masks(span: int, max_subs: int) -> list[tuple[int, ...]]:
    """Positions kept by each mask: all but ``max_subs`` of ``max_subs + 2`` equal blocks of the window."""
    blocks = max_subs + 2 if max_subs else 1
    edges = [round(i * span / blocks) for i in range(blocks + 1)]
    parts = [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]
    return [tuple(p for i in keep for p in parts[i]) for keep in combinations(range(blocks), blocks - max_subs)]


#: A letter of a script that puts no spaces between words, with its marks; ``LATER`` is where such scripts begin.
UNSPACED = r"([[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]&&[\p{L}\p{N}]]\p{M}*)"
LATER = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words: lower-cased runs of letters, digits and marks, so case and punctuation do not count.

    In Chinese, Japanese, Thai and other scripts without spaces each letter is a word.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = F.when(low.rlike(LATER), F.regexp_replace(low, UNSPACED, " $1 ")).otherwise(low)
    return F.transform(F.array_remove(F.split(cut, r"[^\p{L}\p{N}\p{M}]+"), ""), lambda w: F.xxhash64(w))


def _windows(t: DataFrame, span: int) -> DataFrame:
    """One row for each start ``at`` (from 0) of a window of ``span`` words in the array ``toks``."""
    return t.where(F.size("toks") >= span).select("*", F.explode(F.sequence(F.lit(0), F.size("toks") - span)).alias("at"))


def _seeds(span: int, max_subs: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(span), F.lit(m), *[F.get("toks", F.col("at") + p) for p in kept]) for m, kept in enumerate(masks(span, max_subs))])


def _window(span: int) -> Column:
    return F.slice("toks", F.col("at") + 1, span)


def benchmark_windows(bench: DataFrame, span: int, shortest: int) -> DataFrame:
    """``span, toks, at, item, win``: the windows of all items, whose length is the item's own where it is shorter than ``span``.

    The lengths below ``span`` are few (``shortest`` to ``span - 1``). Equal windows of several items
    are one row, with the smallest item, so a phrase that many items share is verified once.
    """
    t = bench.select(F.col("item"), word_hashes(F.col("text")).alias("toks"))
    parts = [_windows(t, span).select(F.lit(span).alias("span"), _window(span).alias("win"), "item")]
    parts += [t.where(F.size("toks") == n).select(F.lit(n).alias("span"), F.col("toks").alias("win"), "item") for n in range(shortest, span)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("span", "win").agg(F.min("item").alias("item"), F.count_distinct("item").alias("items"))


def find_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, max_subs: int = MAX_SUBS, shortest: int = SHORTEST, exact_short: bool = False) -> DataFrame:
    """``id, item, items, windows, first_at, subs``: the documents that hold a passage of the benchmark.

    A document leaks if a window of ``span`` of its words agrees with one of the benchmark in all but
    at most ``max_subs`` positions. An item of ``shortest`` to ``span - 1`` words counts as a whole,
    with ``max_subs * words // span`` substitutions. Shorter items match nothing, or with ``exact_short``
    as a whole run without substitutions, down to a single word.
    Returned for each id: the smallest item met, the largest number of items that share a window met,
    the number of different window positions, the first position (in words), and the fewest
    substitutions. Words are runs of letters, digits and marks, compared without case, and single
    letters in scripts without spaces. Null and empty texts
    hold nothing; rows that repeat an id count together; a null id is an id. Other columns are not
    read. An empty table on either side gives an empty result.
    """
    return _verified(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), bench.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text")), span, max_subs, shortest, exact_short).groupBy("id").agg(
        F.min("item").alias("item"), F.max("items").alias("items"), F.count_distinct("at").alias("windows"), F.min("at").alias("first_at"), F.min("subs").alias("subs"))


def _verified(docs: DataFrame, bench: DataFrame, span: int, max_subs: int, shortest: int, exact_short: bool) -> DataFrame:
    """``id, at, item, items, subs`` for each document window within the tolerance of a benchmark window."""
    known = materialize(benchmark_windows(bench, span, 1 if exact_short else shortest), "windows")
    lengths = [r["span"] for r in known.select("span").distinct().collect()]  # at most span numbers
    toks = docs.select("id", word_hashes(F.col("text")).alias("toks"))
    hits = None
    for n in sorted(lengths, reverse=True):
        subs = max_subs if n == span else max_subs * n // span if n >= shortest else 0
        mine = known.where(F.col("span") == n).select(F.col("win").alias("toks"), "item", "items", F.lit(0).alias("at"))
        keyed = materialize(mine.select("toks", "item", "items", F.explode(_seeds(n, subs)).alias("seed")), "seeds")
        seeds = materialize(keyed.select("seed").distinct(), "seed")
        at = _windows(toks, n).select("id", "toks", "at", F.explode(_seeds(n, subs)).alias("seed"))
        if seeds.count() <= BROADCAST_SEEDS:  # the window is cut out of the document only where its seed is met
            met = at.join(F.broadcast(seeds), "seed", "left_semi").select("id", "at", _window(n).alias("mine"), "seed")
        else:
            met = at.select("id", "at", _window(n).alias("mine"), "seed").join(seeds, "seed", "left_semi")
        # windows that hit are few; equal ones (copies, a passage that many documents share) are verified once
        met = materialize(met, "hits")
        wins = met.select("mine", "seed").distinct()
        off = F.size(F.filter(F.zip_with("mine", "toks", lambda a, b: a != b), lambda x: x))
        good = wins.join(keyed, "seed").withColumn("subs", off).where(F.col("subs") <= subs).groupBy("mine").agg(F.min("item").alias("item"), F.max("items").alias("items"), F.min("subs").alias("subs"))
        one = met.select("id", "at", "mine").distinct().join(good, "mine").select("id", "at", "item", "items", "subs")
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return docs.limit(0).select("id", F.lit(0).alias("at")).join(known.select("item", "items", F.lit(0).alias("subs")), F.lit(False))
    return hits
