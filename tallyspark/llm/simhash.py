"""SimHash near-duplicates: tiles of fingerprints are compared exactly by exclusive-or and bit counts.

Rows with one fingerprint form a class. Classes are range-partitioned by population count into tiles;
two tiles meet in one task only if their population counts come within the radius (and, where a
Jaccard test follows, if their shingle counts allow the threshold). Inside a task strips of both tiles
are skipped by the population counts of four parts of the fingerprint, whose differences add up to a
lower bound of the Hamming distance. A task returns a spanning forest of the links it found, never
the pairs of a group, and holds two tiles and one strip of comparisons, whatever the input's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.graph import components
from tallyspark.llm.words import shingle_bytes
from tallyspark.runtime import materialize

#: Classes in a tile, and rows and columns of one comparison.
TILE, STRIP_ROWS, STRIP_COLS = 16384, 256, 1024
#: Shingles whose bits are counted at once.
CHUNK = 65536


def bit_majority(digests: list[bytes], bits: int) -> bytes:
    """A bit is 1 if it is set in over half of the digests; zero without digests."""
    ones = np.zeros(bits, np.int64)
    for i in range(0, len(digests), CHUNK):
        part = np.frombuffer(b"".join(digests[i : i + CHUNK]), np.uint8).reshape(-1, bits // 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests)).tobytes()


def fingerprint(text: str | None, k: int, bits: int, seed: int, distinct: bool) -> tuple[bytes, int]:
    """The fingerprint of the k-word shingles, and their number. 64 bits: XXH64; 128 bits: XXH3."""
    shingles = shingle_bytes(text, k)
    if distinct:
        shingles = list(set(shingles))
    digest = xxhash.xxh64_digest if bits == 64 else xxhash.xxh3_128_digest
    return bit_majority([digest(s, seed) for s in shingles], bits), len(shingles)


def fingerprints(docs: DataFrame, text: Column, keep: list[str], k: int = 3, bits: int = 64, seed: int = 42, distinct: bool = False, few: int = 0) -> DataFrame:
    """Columns ``keep`` of every row with its fingerprint: f0 (and f1) long, n the number of shingles.

    With ``few`` also ``shingles``, the 64-bit hashes of the different shingles of a text that has 1 to ``few``, else null.
    """
    names = [f"f{i}" for i in range(bits // 64)]
    src = docs.select(*keep, text.alias("__text"))
    fields = [f for f in src.schema.fields if f.name != "__text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{n} long" for n in names) + ", n int" + ", shingles array<long>" * bool(few)

    def hashes(text: str, n: int) -> np.ndarray | None:
        return np.array([xxhash.xxh3_64_intdigest(s) for s in set(shingle_bytes(text, k))], np.uint64).view(np.int64) if 0 < n <= few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = part.column("__text").to_pylist()
                got = [fingerprint(t, k, bits, seed, distinct) for t in texts]
                prints = np.frombuffer(b"".join(f for f, _ in got), ">u8").reshape(-1, bits // 64).astype(np.uint64).view(np.int64)
                cols = [part.column(f.name) for f in fields] + [pa.array(prints[:, i]) for i in range(bits // 64)] + [pa.array([n for _, n in got], pa.int32())]
                cols += [pa.array([hashes(t, n) for t, (_, n) in zip(texts, got)], pa.list_(pa.int64()))] * bool(few)
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + names + ["n"] + ["shingles"] * bool(few))

    return src.mapInArrow(run, schema)


def _counts(words: np.ndarray) -> np.ndarray:
    """Population counts of four parts of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(words).view(np.uint16 if words.shape[1] == 1 else np.uint32)).astype(np.int16)


def tiles_of(classes: DataFrame, width: int, by_size: bool, tile: int = TILE) -> DataFrame:
    """Classes (node, f0.., n) packed into one row a tile: ``tile, band_lo, band_hi, n_lo, n_hi, p_lo, p_hi, nodes, words, ns``.

    The band orders the tiles: the population count, or with ``by_size`` the shingle count on a log scale.
    """
    names = [f"f{i}" for i in range(width)]
    total = classes.count()
    pop = sum((F.bit_count(c) for c in names), F.lit(0))
    ordered = classes.select("node", *names, "n", pop.alias("p")).withColumn("band", F.floor(F.log2(F.greatest("n", F.lit(1))) * 8).cast("int") if by_size else F.col("p"))
    part = "shiftrightunsigned(f0, {0}) & 65535"
    spread = ordered.repartitionByRange(max(1, math.ceil(total / tile)), "band", "p", *[F.expr(part.format(s)) for s in (48, 32)], "f0", "node")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        d = pd.concat(rows)
        w = d[names].to_numpy(np.int64).view(np.uint64)
        c = _counts(w)
        order = np.lexsort((*c.T[::-1], d["p"].to_numpy(), d["band"].to_numpy()))
        d, w = d.iloc[order], w[order]
        for i in range(0, len(d), tile):
            x = d.iloc[i : i + tile]
            yield pd.DataFrame({
                "first": [int(x["node"].iloc[0])], "band_lo": [int(x["band"].min())], "band_hi": [int(x["band"].max())], "n_lo": [int(x["n"].min())], "n_hi": [int(x["n"].max())], "p_lo": [int(x["p"].min())], "p_hi": [int(x["p"].max())],
                "nodes": [x["node"].to_numpy(np.int64).tobytes()], "words": [np.ascontiguousarray(w[i : i + tile]).tobytes()], "ns": [x["n"].to_numpy(np.int32).tobytes()],
            })

    schema = "first long, band_lo int, band_hi int, n_lo int, n_hi int, p_lo int, p_hi int, nodes binary, words binary, ns binary"
    return materialize(spread.mapInPandas(pack, schema).withColumnRenamed("first", "tile"), "tiles")


def _union(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of each pair; parent[x] is the smallest member of x's set afterwards."""
    while len(i):
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, a, b)
        np.minimum.at(parent, b, a)
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def compare(one: pd.Series, two: pd.Series | None, width: int, radius: int, ratio: float) -> pd.DataFrame:
    """A spanning forest ``a, b`` of the links within a tile or between two: each linked class with the smallest it is connected to.

    Linked are fingerprints at most ``radius`` bits apart whose shingle counts stand in a ratio of at least ``ratio``.
    """
    load = lambda t: (np.frombuffer(t["nodes"], np.int64), np.frombuffer(t["words"], np.uint64).reshape(-1, width), np.frombuffer(t["ns"], np.int32))
    na, wa, sa = load(one)
    nb, wb, sb = load(two) if two is not None else (na, wa, sa)
    ca, cb = _counts(wa), _counts(wb)
    shift = 0 if two is None else len(na)
    parent = np.arange(len(na) + (0 if two is None else len(nb)))
    strips = [(j, cb[j : j + STRIP_COLS].min(0), cb[j : j + STRIP_COLS].max(0), sb[j : j + STRIP_COLS].min(), sb[j : j + STRIP_COLS].max()) for j in range(0, len(nb), STRIP_COLS)]
    for i in range(0, len(na), STRIP_ROWS):
        x, lo, hi, slo, shi = wa[i : i + STRIP_ROWS], ca[i : i + STRIP_ROWS].min(0), ca[i : i + STRIP_ROWS].max(0), sa[i : i + STRIP_ROWS].min(), sa[i : i + STRIP_ROWS].max()
        for j, lo2, hi2, slo2, shi2 in strips:
            if two is None and j + STRIP_COLS <= i:
                continue
            if np.maximum(0, np.maximum(lo - hi2, lo2 - hi)).sum() > radius or shi < ratio * slo2 or shi2 < ratio * slo:
                continue
            y = wb[j : j + STRIP_COLS]
            d = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
            for k in range(1, width):
                d += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
            p, q = np.nonzero(d <= radius)
            if not len(p):
                continue
            p, q = p + i, q + j
            ok = np.minimum(sa[p], sb[q]) >= ratio * np.maximum(sa[p], sb[q])
            if two is None:
                ok &= p < q
            _union(parent, p[ok], q[ok] + shift)
    nodes = na if two is None else np.concatenate([na, nb])
    me = np.nonzero(parent != np.arange(len(parent)))[0]
    return pd.DataFrame({"b": nodes[me], "a": nodes[parent[me]]})


def tile_links(tiles: DataFrame, width: int, radius: int, ratio: float = 0.0, by_size: bool = False) -> DataFrame:
    """Forests of links over all pairs of tiles whose population and shingle counts allow a link.

    The table of tile pairs comes from a join on bands (|band - band| <= reach is symmetric, so each pair is met once in order of tile numbers);
    a tile's row is then sent to each of its pairs. ``by_size`` as given to ``tiles_of``; it needs a ratio.
    """
    reach = math.ceil(8 * math.log2(1 / ratio)) if by_size else radius
    facts = tiles.select("tile", "band_lo", "band_hi", "n_lo", "n_hi", "p_lo", "p_hi")
    left = facts.select(*[F.col(c).alias(f"x_{c}") for c in facts.columns], F.explode(F.sequence("band_lo", "band_hi")).alias("band"))
    right = facts.select(*facts.columns, F.explode(F.sequence(F.col("band_lo") - reach, F.col("band_hi") + reach)).alias("band"))
    allowed = (F.col("x_tile") <= F.col("tile")) & (F.col("x_p_lo") <= F.col("p_hi") + radius) & (F.col("p_lo") <= F.col("x_p_hi") + radius)
    if ratio:
        allowed &= (F.col("x_n_hi") >= F.col("n_lo") * ratio) & (F.col("n_hi") >= F.col("x_n_lo") * ratio)
    pairs = left.join(right, "band").where(allowed).select(F.struct(F.col("x_tile").alias("one"), F.col("tile").alias("two")).alias("pair")).distinct()
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("pair.one", "pair.two"))).alias("tile"))
    dealt = sides.join(tiles.select("tile", "nodes", "words", "ns"), "tile")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("tile")
        return compare(group.iloc[0], group.iloc[1] if len(group) > 1 else None, width, radius, ratio)

    return dealt.groupBy("pair").applyInPandas(run, "b long, a long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """``id, f0, root``: each row's 64-bit fingerprint and the smallest id that chains of links reach.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits. Null and wordless
    texts have fingerprint zero and are linked like any other. Rows that repeat an id stay rows of
    their own. A null id counts as none: a component with null ids only has a null root. Only the
    two named columns are read; other columns and their names do not matter. An empty table gives
    an empty result.
    """
    rows = materialize(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), F.col("text"), ["id"], k, 64, seed).drop("n"), "prints")
    classes = materialize(rows.groupBy("f0").agg(F.min("id").alias("low")).select(F.col("f0").alias("node"), "f0", F.lit(1).alias("n"), "low"), "classes")
    links = tile_links(tiles_of(classes, 1, False), 1, radius)
    roots = components(links)
    named = classes.join(roots, "node", "left").select("f0", F.coalesce("root", "node").alias("root"), "low")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    known = materialize(named.join(lows, "root").select("f0", "component"), "components")
    return rows.join(known, "f0").select("id", "f0", F.col("component").alias("root"))


#: Documents of a block in the exact test within a cluster.
BLOCK = 512
#: Pairs whose smaller set has so many shingles at most get their candidates by shared shingles, not by fingerprints alone.
FEW = 30


def shared_shingle_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links ``b, a`` whose chains connect every pair of ``classes`` (node, n, shingles) at ``similarity`` or more.

    Prefix filter: with all shingles in one order, the rarest first, two sets of Jaccard similarity t share one
    among the first n - ceil(t n) + 1 of each. The sets that meet at a shingle are linked to the smallest of them, so
    a shingle that many share makes no pairs.
    """
    each = classes.where("shingles is not null").select("node", "n", F.explode("shingles").alias("shingle"))
    # these lists grow with the corpus: they are joined by shuffling, never broadcast
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    order = Window.partitionBy("node").orderBy(F.col("times").asc_nulls_first(), "shingle")
    first = each.join(often.hint("shuffle_hash"), "shingle", "left").withColumn("i", F.row_number().over(order))
    first = first.where((F.col("i") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & F.col("times").isNotNull()).select("shingle", "node")
    first = materialize(first, "prefixes")
    least = first.groupBy("shingle").agg(F.min("node").alias("a"))
    return first.join(least.hint("shuffle_hash"), "shingle").where("node <> a").select(F.col("node").alias("b"), "a").distinct()


def _similar(group: pd.DataFrame, k: int, similarity: float) -> pd.DataFrame:
    """A spanning forest of the exact links of a block, of two blocks of one cluster, or of several small clusters.

    One row's shingles are marked and counted in all others of its cluster at once; rows that are
    connected already are not counted again.
    """
    group = group.sort_values(["cluster", "node"])
    sets = [np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in set(shingle_bytes(t, k))], np.uint64)) for t in group["text"]]
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    marked = np.zeros(int(ids.max(initial=-1)) + 2, np.int32)
    cluster, block = group["cluster"].to_numpy(), group["block"].to_numpy()
    across = len(group) > 0 and bool(group["across"].iloc[0])
    node = group["node"].to_numpy()
    parent = np.arange(len(group))
    ends = np.searchsorted(cluster, cluster, side="right")
    for i in range(len(group)):
        j = np.arange(i + 1, ends[i])
        j = j[(parent[j] != parent[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        if across:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        if sizes[i]:
            mine = ids[starts[i] : starts[i + 1]]
            marked[mine] = 1
            at = np.concatenate([ids[starts[x] : starts[x + 1]] for x in j])
            both = np.add.reduceat(marked[at], np.r_[0, np.cumsum(sizes[j])[:-1]])
            marked[mine] = 0
            j = j[both >= similarity * (sizes[j] + sizes[i] - both) - 1e-9]
        _union(parent, np.full(len(j), i), j)
    me = np.nonzero(parent != np.arange(len(parent)))[0]
    return pd.DataFrame({"b": node[me], "a": node[parent[me]]})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 32, seed: int = 42) -> DataFrame:
    """The documents without those that repeat another: one of each group of near copies stays, with the columns it came with.

    Two texts are linked if the sets of their ``k``-word shingles (A-Z lowered, one space between words)
    have a Jaccard similarity of at least ``similarity``; a group is what chains of links connect. The
    smallest id of a group stays, null ids last. Candidates come from 128-bit fingerprints of the sets
    at most ``radius`` bits apart: a long pair at 0.8 differs in 19 bits with a deviation of 4, so 0.1% to 0.26% of the
    pairs at exactly 0.8 lie beyond 32 and are lost; closer ones nearly always lie within, unrelated ones almost never. Small sets, whose
    fingerprints scatter more, lose nothing: where the smaller one has up to ``FEW`` shingles, candidates also come
    from shared shingles, which is exact. Candidates form clusters, in
    which every pair is tested exactly, by blocks of ``BLOCK`` documents for two blocks at a time, and
    only spanning forests leave the tasks. Texts without words (null ones among them) are copies of one another;
    shorter ones than ``k`` words are compared as one shingle. Repeated rows leave one row. Extra
    columns pass through, whatever their names. An empty table stays empty.
    """
    # the one copy of the texts: it fixes a row number, so that of equal rows exactly one can stay
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    text = F.col(f"row.`{text_col}`")
    prints = materialize(fingerprints(rows.select("uid", "id", "key", text.alias("text")), F.col("text"), ["uid", "id", "key"], k, 128, seed, True, math.floor(FEW / similarity + 1e-9)), "prints")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("best")
    classes = materialize(prints.groupBy("key").agg(best, F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.min("n").alias("n"), F.min("shingles").alias("shingles")).withColumn("node", F.col("best.uid")), "classes")
    near = tile_links(tiles_of(classes, 2, True), 2, radius, similarity, True)
    clusters = components(near.unionByName(shared_shingle_links(classes, similarity)))
    clusters = materialize(clusters.join(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root").select("node", F.col("root").alias("cluster"), F.ceil(F.col("m") / BLOCK).alias("blocks")), "clusters")
    small = max(1, math.ceil(clusters.where("blocks = 1").count() / BLOCK))
    whole = clusters.where("blocks = 1").select("node", "cluster", F.lit(0).cast("long").alias("block"), F.lit(False).alias("across"), F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(small))).alias("part"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    split = clusters.where("blocks > 1").withColumn("block", mine).select("node", "cluster", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    split = split.select("node", "cluster", "block", (F.col("block") != F.col("other")).alias("across"), F.concat_ws("/", "cluster", F.least("block", "other"), F.greatest("block", "other")).alias("part"))
    # these lists of rows grow with the corpus: they are joined by shuffling, never broadcast
    dealt = whole.unionByName(split).hint("shuffle_hash").join(rows.select(F.col("uid").alias("node"), text.alias("text")), "node")
    links = dealt.groupBy("part").applyInPandas(lambda g: _similar(g, k, similarity), "b long, a long")
    roots = components(links)
    # every class but the best of its component, and every row but the best of its class, goes
    grouped = classes.join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min("best").alias("first"))
    worse = grouped.join(first, "root").where("best.uid <> first.uid").select(F.col("node").alias("uid"))
    copies = prints.join(classes.select("key", F.col("node")), "key").where("uid <> node").select("uid")
    gone = materialize(worse.unionByName(copies), "gone")
    kept = rows.join(gone.hint("shuffle_hash"), "uid", "left_anti")
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
