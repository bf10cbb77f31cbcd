"""Pairs of similar texts by edit distance, without comparing all pairs.

Of ``k + 1`` runs of letters that do not overlap, ``k`` edits leave one as it was. So the longer text of a pair
is looked for by ``k + 1`` of its runs among all runs of the shorter texts. Which runs is free: those that occur
least are taken, in several lengths, so that what many texts share is passed over or becomes one long run.

In a pair with at most ``k`` edits there is even a run, the ``i``-th of the ``k + 1`` counted from 0, that is as it
was, has ``i`` edits before it and no more than ``k - i`` behind it: the first one with fewer than ``i + 1``
edits up to its end. That bounds how far it may have moved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: No run of the shortest kind is longer than this.
LONGEST_RUN = 8
#: Share of a text that its runs take up where they are all of the shortest kind.
TAKEN = 0.6


def ratio(a: Column, b: Column, distance: Column) -> Column:
    """Edit-distance ratio of two texts of which one is not empty."""
    return 1 - distance / F.greatest(F.length(a), F.length(b))


class RunPlan:
    """Numbers of the filter for one lowest ratio: a pair with that ratio or more has at most ``(1 - floor) * n`` edits, n letters being the longer text."""

    def __init__(self, floor: float) -> None:
        if not 0.6 <= floor <= 1:
            raise ValueError("the lowest ratio must lie between 0.6 and 1")
        self.floor = floor
        self.run = max(1, min(LONGEST_RUN, math.floor(TAKEN / (1 - floor) + 1e-9))) if floor < 1 else LONGEST_RUN
        # from this length on every text has room for runs of the full length
        self.steady = max((n for n in range(1, 2_000) if self._length(n) < self.run), default=0) + 1

    def edits(self, n: int) -> int:
        return math.floor((1 - self.floor) * n + 1e-9)

    def edits_of(self, n: Column) -> Column:
        return F.floor(n * (1 - self.floor) + 1e-9).cast("int")

    def _length(self, n: int) -> int:
        """Length of the shortest runs a text of n letters is looked for by: ``edits + 1`` of them have room."""
        return min(self.run, n // (self.edits(n) + 1))

    def lengths(self, n: int) -> list[int]:
        """Lengths a text of n letters may choose its runs from."""
        q = self._length(n)
        return [q] if q < self.run else [x for x in (q, 2 * q, 4 * q) if x <= n]

    def lengths_of(self, n: int) -> set[int]:
        """Lengths of the runs by which texts of at least n letters look for one of n letters."""
        longer = range(n, math.floor(n / self.floor + 1e-9) + 2) if n < self.steady else [n]
        return {x for m in longer for x in self.lengths(m) if x <= n}


# ---------------------------------------------------------------- runs of a block of texts
#: Buckets that occurrences of runs are counted in. A run counts for all of its bucket, which only steers the choice.
COUNT_BITS = 20
#: Cells (letters by runs) up to which the best runs of one text are worked out; of longer texts the rarest runs of one cut are taken.
EXACT_CELLS = 8_000_000
#: Bits of the marks of chosen runs; runs that no text is looked for by need not be dealt out.
MARK_BITS = 25
_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Letters:
    """The letters of some texts in a row, and numbers for their runs."""

    def __init__(self, texts: pa.Array):
        words = texts.to_pylist()
        self.n = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self._sums = {1: self.code + np.uint64(1)}

    def _sum(self, length: int) -> np.ndarray:
        if length not in self._sums:
            half = length // 2 if length % 2 == 0 else 1
            rest = self._sum(length - half)
            moved = np.concatenate([rest[half:], np.zeros(half, np.uint64)])[: len(rest)]
            self._sums[length] = self._sum(half) * np.uint64(pow(int(_BASE), length - half, 1 << 64)) + moved
        return self._sums[length]

    def runs(self, length: int, side: int) -> np.ndarray:
        """A 64-bit number for the run that starts at each letter; texts are looked for on one side by the runs of the other."""
        x = self._sum(length) + np.uint64((2 * length + side) * 0xD6E8FEB86659FD93 % (1 << 64))
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))

    def all_runs(self, plan: RunPlan, side: int, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place (from 1) and number of all runs by which a longer text may look for these, where ``keep`` says so."""
        wanted = {int(n): plan.lengths_of(int(n)) for n in np.unique(self.n)}
        text = np.repeat(np.arange(len(self.n)), self.n)
        place = np.arange(len(self.code)) - self.first[text]
        out = []
        for length in sorted(set().union(*wanted.values())):
            has = np.array([length in wanted[int(n)] for n in self.n])
            at = np.flatnonzero(has[text] & (place + length <= self.n[text]))
            run = self.runs(length, side)[at]
            if keep is not None:
                kept = keep(run)
                at, run = at[kept], run[kept]
            out.append((text[at], place[at] + 1, run))
        return tuple(map(np.concatenate, zip(*out)))

    def chosen_runs(self, plan: RunPlan, side: int, count) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place (from 1), number and order of the ``edits + 1`` runs side by side of each text that occur least."""
        out = []
        for n in map(int, np.unique(self.n)):
            lengths, need = plan.lengths(n), plan.edits(n) + 1
            runs = {x: self.runs(x, side) for x in lengths}
            texts = np.flatnonzero(self.n == n)
            share = max(1, 2_000_000 // ((n + 1) * (need + 1)))
            for which in np.split(texts, range(share, len(texts), share)):
                at = self.first[which][:, None] + np.arange(n)
                cost = {x: count(runs[x][at[:, : n - x + 1]]).astype(float) for x in lengths}
                place, length = _rarest(cost, n, need) if (n + 1) * (need + 1) <= EXACT_CELLS else _rarest_cut(cost[lengths[0]], lengths[0], need)
                run = np.zeros(place.shape, np.uint64)
                for x in lengths:
                    run = np.where(length == x, runs[x][np.minimum(self.first[which][:, None] + place, len(self.code) - 1)], run)
                out.append((np.repeat(which, need), place.ravel() + 1, run.ravel(), np.tile(np.arange(need), len(which))))
        return tuple(map(np.concatenate, zip(*out)))


def _rarest(cost: dict[int, np.ndarray], n: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from 0) and lengths of ``need`` runs that do not overlap with the least sum of costs, texts by runs."""
    lengths = list(cost)
    t = len(cost[lengths[0]])
    best = np.full((n + 1, need + 1, t), np.inf)
    best[:, 0] = 0
    took = np.zeros((n + 1, need + 1, t), np.int8)
    for p in range(1, n + 1):
        best[p, 1:] = best[p - 1, 1:]
        for i, x in enumerate(lengths, 1):
            if p >= x:
                other = best[p - x, :-1] + cost[x][:, p - x]
                less = other < best[p, 1:]
                np.copyto(best[p, 1:], other, where=less)
                took[p, 1:][less] = i
    place, length, rows = np.zeros((t, need), np.int64), np.zeros((t, need), np.int64), np.arange(t)
    p, j, size = np.full(t, n), np.full(t, need), np.array([0, *lengths])
    while (j > 0).any():
        i = np.where(j > 0, took[p, j, rows], 0)
        p = np.where(j > 0, p - np.maximum(size[i], 1), p)
        now = rows[i > 0]
        place[now, j[now] - 1], length[now, j[now] - 1] = p[now], size[i[now]]
        j = j - (i > 0)
    return place, length


def _rarest_cut(cost: np.ndarray, length: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_rarest` for texts too long for it: the rarest of the runs that begin at multiples of their length."""
    picked = np.sort(np.argsort(cost[:, ::length], axis=1, kind="stable")[:, :need], axis=1) * length
    return picked, np.full(picked.shape, length)


def _lists(text: np.ndarray, texts: int, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """Columns of lists, one a text."""
    order = np.argsort(text, kind="stable")
    ends = pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=texts))].astype(np.int32))
    return {k: pa.ListArray.from_arrays(ends, pa.array(v[order])) for k, v in columns.items()}


# ---------------------------------------------------------------- bounds for a pair
#: What a letter profile counts: the 32 commonest letters and digits of folded text. Other characters only weaken the bound.
COUNTED = "abcdefghiklmnoprstuvwy0123456789"


def with_profile(df: DataFrame, text: str) -> DataFrame:
    """Adds how often each counted letter occurs in a text, up to 4 times, as that many bits of the longs ``l0`` and ``l1``.

    One edit takes at most one bit away from a text and adds at most one, so the bits that one of two texts
    has more than the other are no more than their edits.
    """
    bits = lambda c, at: f"shiftleft(shiftleft(1L, least(4, length(`{text}`) - length(replace(`{text}`, '{c}', '')))) - 1L, {4 * at})"
    return df.withColumns({f"l{j}": F.expr(" | ".join(bits(c, at) for at, c in enumerate(COUNTED[16 * j : 16 * j + 16]))) for j in (0, 1)})


def fewest_edits(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """A lower bound of the edits between two texts by their letter profiles."""
    more = lambda x, y: sum((F.bit_count(p.bitwiseAND(F.bitwise_not(q))) for p, q in zip(x, y)), F.lit(0))
    return F.greatest(more(a, b), more(b, a))


def _class(n: Column) -> Column:
    """Length class, a power of two."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) + 1e-9).cast("int")


def _spot(cls: Column, at: Column) -> Column:
    """Part of a text where a run stands, with its length class: texts have up to 16 parts."""
    return (cls * 32 + F.floor(at / F.greatest(F.lit(1.0), F.pow(F.lit(2.0), cls - 3)))).cast("int")


#: Occurrences from which on a run's pairs are spread over several tasks.
COMMON_RUN = 20_000
#: Letters of all texts whose runs are dealt out at a time; with more, some of the runs follow after others, and their space on disk is used again.
ROUND_LETTERS = 50_000_000


def similar_pairs(asked: DataFrame, known: DataFrame, floor: float = 0.85) -> DataFrame:
    """``a, b, ratio``: every pair of a text of ``asked`` (column a) and one of ``known`` (column b) whose edit-distance ratio is ``floor`` or more.

    Complete for every ``floor`` from 0.6: no list of candidates is cut short. Texts are compared as they
    are; repeated ones count once, empty ones and nulls match nothing.
    """
    spark = asked.sparkSession
    plan, common, mask = RunPlan(floor), COMMON_RUN, np.uint64((1 << COUNT_BITS) - 1)
    share = lambda often: np.maximum(1, np.ceil(np.sqrt(often / common))).astype(np.int32)
    both = asked.select(F.col("a").alias("t"), F.lit(0).alias("side")).unionByName(known.select(F.col("b").alias("t"), F.lit(1).alias("side"))).where("t <> ''").distinct()
    parts = 2 * spark.sparkContext.defaultParallelism
    texts = materialize(with_profile(both.withColumn("n", F.length("t")), "t").repartition(parts), "texts")
    letters = texts.agg(F.sum("n")).first()[0] or 0

    def sides(batch: pa.RecordBatch):
        side = batch.column("side").to_numpy()
        for s in (0, 1):
            rows = batch.filter(pa.array(side == s))
            if rows.num_rows:
                yield s, rows, _Letters(rows.column("t"))

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for s, _, x in sides(batch):
                total += np.bincount((x.all_runs(plan, 1 - s)[2] & mask).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(some[i : i + 100_000]), "n": pa.array(total[some[i : i + 100_000]])})

    counted = texts.select("t", "side").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << COUNT_BITS, np.int64)
    often[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    often = spark.sparkContext.broadcast(often)

    def choose(batches):
        for batch in batches:
            for s, rows, x in sides(batch):
                text, at, run, order = x.chosen_runs(plan, s, lambda r: often.value[r & mask])
                n = often.value[run & mask]
                # a run that does not occur finds nothing
                text, at, run, order, n = (v[n > 0] for v in (text, at, run, order, n))
                lists = _lists(text, rows.num_rows, {"run": run.view(np.int64), "at": at.astype(np.int32), "i": order.astype(np.int32), "shares": share(n)})
                yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in ("t", "side", "n", "l0", "l1")} | lists)

    head = "t string, side int, n int, l0 long, l1 long"
    chosen = materialize(texts.select("t", "side", "n", "l0", "l1").mapInArrow(choose, f"{head}, run array<long>, at array<int>, i array<int>, shares array<int>"), "chosen")
    bit = chosen.select(F.explode("run").alias("run")).select(F.col("run").bitwiseAND(F.lit((1 << MARK_BITS) - 1)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    marks = np.zeros(1 << (MARK_BITS - 6), np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    marks = spark.sparkContext.broadcast(marks.view(np.uint64))
    rounds = max(1, math.ceil(letters / ROUND_LETTERS))

    def deal(turn: int):
        def job(batches):
            def keep(run):
                b = run & np.uint64((1 << MARK_BITS) - 1)
                mine = (marks.value[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
                return mine & ((run >> np.uint64(40)) % np.uint64(rounds) == np.uint64(turn))

            for batch in batches:
                for s, rows, x in sides(batch):
                    text, at, run = x.all_runs(plan, 1 - s, keep)
                    lists = _lists(text, rows.num_rows, {"run": run.view(np.int64), "o_at": at.astype(np.int32), "shares": share(often.value[run & mask])})
                    yield pa.RecordBatch.from_pydict({f"o_{c}": rows.column(c) for c in ("t", "n", "l0", "l1")} | lists)

        return job

    def met(turn: int) -> DataFrame:
        """Pairs that share a run of this turn. The comparison is part of the join, so only pairs that are similar leave it."""
        k, i, at = F.col("k"), F.col("i"), F.col("at")
        looked = chosen.select("t", "side", "n", "l0", "l1", F.expr("inline(arrays_zip(run, at, i, shares))")).where(F.shiftrightunsigned("run", 40) % rounds == turn).withColumn("k", plan.edits_of(F.col("n")))
        looked = looked.withColumns({"cls": F.explode(F.sequence(_class(F.col("n") - k), _class(F.col("n")))), "share": F.pmod(F.xxhash64("t"), F.col("shares")).cast("int")})
        looked = looked.withColumn("part", F.explode(F.sequence(_spot(F.col("cls"), F.greatest(at - i, F.lit(1))), _spot(F.col("cls"), at + F.least(i, k - i))))).drop("cls", "shares")
        stored = texts.select("t", "side", "n", "l0", "l1").mapInArrow(deal(turn), "o_t string, o_n int, o_l0 long, o_l1 long, run array<long>, o_at array<int>, shares array<int>")
        stored = stored.select("o_t", "o_n", "o_l0", "o_l1", F.expr("inline(arrays_zip(run, o_at, shares))"))
        stored = stored.withColumns({"part": _spot(_class(F.col("o_n")), F.col("o_at")), "share": F.explode(F.sequence(F.lit(0), F.col("shares") - 1))}).drop("shares")
        less, moved = F.col("n") - F.col("o_n"), F.col("o_at") - at
        # a sorted join: the size of the rows is not seen in the texts' table, and a broadcast of them would fill the driver
        pairs = looked.join(stored.hint("merge"), ["run", "part", "share"]).where(less.between(F.col("side"), k) & (F.abs(moved) <= i) & (F.abs(less + moved) <= k - i))
        pairs = pairs.where(fewest_edits((F.col("l0"), F.col("l1")), (F.col("o_l0"), F.col("o_l1"))) <= k).where(F.expr("levenshtein(t, o_t, k)") >= 0)
        first = F.col("side") == 0
        return pairs.select(F.when(first, F.col("t")).otherwise(F.col("o_t")).alias("a"), F.when(first, F.col("o_t")).otherwise(F.col("t")).alias("b")).distinct()

    found = [materialize(met(turn), "met") for turn in range(rounds)]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct() if rounds > 1 else pairs
    return pairs.withColumn("ratio", ratio(F.col("a"), F.col("b"), F.levenshtein("a", "b"))).where(F.col("ratio") >= floor)
