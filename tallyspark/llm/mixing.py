"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document gets an expected number of copies, c * importance up to a maximum, with c chosen for
each source so that the expected words equal the source's target. The whole part of that number is
allocated for certain. The remaining words of the target are a fixed-size sample: documents are ranked
by their random odds u / (1 - u) divided by the odds of their fractional part, and taken in this order
until the words are reached. A last document, the one whose size fits best, closes the gap that the
order leaves.

No source is sorted or gathered. Ranks are counted in ``BUCKETS`` buckets for each source, running
sums over the buckets find the one in which the words are reached, and only the documents of that
bucket are put in order. All passes but the first and the last read a narrow table of sizes and keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.words import draw_key, n_words, unit_interval
from tallyspark.runtime import materialize

#: Buckets of ranks for each source.
BUCKETS = 65536


def targets(sources: DataFrame, size: str, weight: str, max_epochs: float, budget: Column | None = None) -> DataFrame:
    """Adds ``target``: ``budget`` (default: the sum of sizes) shared by weight, none above ``max_epochs`` times its size.

    What a full source cannot take is shared by weight among the others, until none is above. One row
    a source; a source is full if the water level at which it fills is reached, so no rounds are
    needed. The table of sources is small next to the documents: a row for each name in the mixture.
    """
    cap, w = F.lit(float(max_epochs)) * F.col(size), F.col(weight).cast("double")
    # one row a source: the running sums below are over the mixture's sources, not over documents
    by_level = Window.orderBy("__level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    t = sources.withColumn("__cap", cap).withColumn("__level", F.col("__cap") / w)
    t = t.withColumn("__budget", budget if budget is not None else F.sum(F.col(size).cast("double")).over(everything))
    t = t.withColumn("__left", F.sum(w).over(everything) - F.sum(w).over(by_level))
    t = t.withColumn("__full", F.sum("__cap").over(by_level) + F.col("__level") * F.col("__left") <= F.col("__budget"))
    t = t.withColumn("__taken", F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0.0)).over(everything)).withColumn("__open", F.sum(F.when(F.col("__full"), 0.0).otherwise(w)).over(everything))
    share = (F.col("__budget") - F.col("__taken")) * w / F.col("__open")
    return t.withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least(share, F.col("__cap")))).drop("__cap", "__level", "__budget", "__left", "__full", "__taken", "__open")


def cycled_weights(sources: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight``: the given weights dealt in turn to the sources by code point, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))


def _copies(rate: Column, importance: Column, max_epochs: float) -> Column:
    return F.least(F.lit(float(max_epochs)), rate * importance)


def _rank(u: Column, part: Column) -> Column:
    """Pareto rank: random odds divided by inclusion odds; never chosen where the fraction is 0."""
    return F.when(part > 0, (u / (1 - u)) / (part / (1 - part)))


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), max_epochs: float = 3, importance: Column | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies``: how many times the mix takes each document.

    A document's size is its number of words (null text: 0). ``importance`` (a positive column of the
    documents; null or at most 0 counts as 0) makes inclusion unequal within a source; without it each
    word of a source is equally likely. Draws depend on id, text and seed alone, so reruns agree; rows
    equal in id, source and text are drawn together. Null ids, texts and sources are values like
    others. Existing columns stay as they are, whatever their names; those with the names of the new
    columns are replaced. Wordless documents are never taken. An empty table gives an empty result.
    """
    # the documents' own columns travel in one struct, so that their names cannot clash with those used here
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{source}`").alias("src"), draw_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), seed=seed).alias("key"),
        (F.greatest(F.coalesce(importance.cast("double"), F.lit(0.0)), F.lit(0.0)) if importance is not None else F.lit(1.0)).alias("imp"))
    narrow = materialize(keyed.groupBy("src", "key").agg(F.sum("size").alias("size"), F.max("imp").alias("imp")), "sizes")
    sizes = narrow.groupBy("src").agg(F.sum("size").alias("source_size"))
    plan = targets(cycled_weights(sizes, "src", weights), "source_size", "weight", max_epochs)
    plan = materialize(_rates(narrow, plan, max_epochs), "plan")

    same = F.col("src").eqNullSafe(F.col("p_src"))
    small = plan.select(F.col("src").alias("p_src"), "rate")
    u = unit_interval(F.col("key"))
    copies = _copies(F.col("rate"), F.col("imp"), max_epochs)
    part = copies - F.floor(copies)
    ranked = narrow.join(small, same).select("src", "key", "size", F.floor(copies).alias("whole"), _rank(u, part).alias("rank"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))
    counted = ranked.groupBy("src", "bucket").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum("size").alias("words"))
    left = counted.groupBy("src").agg(F.sum("sure").alias("sure")).join(plan.select(F.col("src").alias("p_src"), "target"), same).select("src", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("left"))
    left = materialize(left, "left")
    running = F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
    # the bucket in which the running words pass what is left, and the words before it
    cut = counted.where("bucket is not null").withColumn("before", running - F.col("words")).join(left.select(F.col("src").alias("p_src"), "left"), same).where("before <= left and before + words > left").select(F.col("src").alias("p_src"), F.col("bucket").alias("cut"), "before", "left")
    cut = materialize(cut, "cut")
    inside = ranked.join(cut, same).where("bucket = cut")
    order = Window.partitionBy("src").orderBy("rank", "key")
    inside = inside.withColumn("run", F.col("before") + F.sum("size").over(order)).where("run <= left")
    last = inside.groupBy("src").agg(F.max(F.struct("rank", "key", "run")).alias("last"))
    edge = cut.join(last, same, "left").select("p_src", "cut", "left", F.coalesce("last.run", F.col("before")).alias("got"), F.col("last.rank").alias("r_last"), F.col("last.key").alias("k_last"))
    edge = materialize(edge, "edge")
    beyond = ranked.join(edge, same).where(F.col("rank").isNotNull() & ~_chosen() & (F.col("size") > 0) & (F.col("size") < 2 * (F.col("left") - F.col("got"))))
    fill = materialize(beyond.groupBy("p_src").agg(F.min(F.struct(F.abs(F.col("size") - (F.col("left") - F.col("got"))).alias("off"), "rank", "key")).alias("f")).select(F.col("p_src").alias("f_src"), F.col("f.key").alias("k_fill")), "fill")
    decided = plan.join(edge, same, "left").drop("p_src").join(fill, F.col("src").eqNullSafe(F.col("f_src")), "left").select(F.col("src").alias("p_src"), "source_size", "target", "rate", "cut", "r_last", "k_last", "k_fill", F.col("cut").isNull().alias("all_taken"))
    decided = materialize(decided, "decided")

    out = keyed.join(decided, same).withColumn("copies", _copies(F.col("rate"), F.col("imp"), max_epochs))
    out = out.withColumn("rank", _rank(unit_interval(F.col("key")), F.col("copies") - F.floor("copies")))
    out = out.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS))
    extra = F.col("rank").isNotNull() & (F.col("all_taken") | _chosen() | F.coalesce(F.col("key") == F.col("k_fill"), F.lit(False)))
    taken = F.when(F.col("size") > 0, F.floor("copies") + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    new = {"mix_size": F.col("size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": taken}
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def _chosen() -> Column:
    """In rank order up to the last document that still fits; equal ranks go by key."""
    inside = (F.col("bucket") == F.col("cut")) & F.coalesce((F.col("rank") < F.col("r_last")) | ((F.col("rank") == F.col("r_last")) & (F.col("key") <= F.col("k_last"))), F.lit(False))
    return F.coalesce((F.col("bucket") < F.col("cut")) | inside, F.lit(False))


def _rates(narrow: DataFrame, plan: DataFrame, max_epochs: float) -> DataFrame:
    """Adds ``rate``, the c of each source: the sum of size * min(max_epochs, c * importance) equals its target.

    Each round takes the documents above the maximum out and shares the rest; the set of those only
    grows, and the rounds end when it stays. With equal importance the first round is the last.
    """
    first = narrow.groupBy("src").agg(F.sum(F.col("size") * F.col("imp")).alias("mass"), F.max("imp").alias("most")).select(F.col("src").alias("m_src"), "mass", "most")
    plan = plan.join(first, F.col("src").eqNullSafe(F.col("m_src"))).drop("m_src").withColumn("rate", F.when(F.col("mass") > 0, F.col("target") / F.col("mass")).otherwise(0.0)).drop("mass")
    plan = materialize(plan, "rates")
    while plan.where((F.col("rate") * F.col("most") > max_epochs * (1 + 1e-12)) & (F.col("rate") < 1e300)).limit(1).count():
        rate = plan.select(F.col("src").alias("m_src"), F.col("rate").alias("r"), F.col("target").alias("t"))
        free = F.col("r") * F.col("imp") < max_epochs
        sums = narrow.join(rate, F.col("src").eqNullSafe(F.col("m_src"))).groupBy("m_src", "r", "t").agg(F.sum(F.when(free, F.col("size") * F.col("imp")).otherwise(0.0)).alias("mass"), F.sum(F.when(free | (F.col("imp") <= 0), 0.0).otherwise(F.col("size") * float(max_epochs))).alias("full"))
        new = sums.select("m_src", F.when(F.col("mass") > 0, F.greatest("r", (F.col("t") - F.col("full")) / F.col("mass"))).otherwise(F.col("r")).alias("new"))
        after = materialize(plan.join(new, F.col("src").eqNullSafe(F.col("m_src"))).drop("m_src").withColumn("moved", F.col("new") > F.col("rate") * (1 + 1e-12)).withColumn("rate", F.col("new")).drop("new"), "rates")
        plan = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
    return plan.drop("most")
