"""MinHash near-dedup with odd sketches.

Each text is a set of hashed word shingles. MinHash samples of the set make bands,
which find candidates, and are folded into a bitmap of parities, the odd sketch,
whose XOR population count estimates high similarities; pairs that it can't rule out
are confirmed on the full sets, read again from the texts. 30 bands of 4 miss a pair
at similarity 0.8 about once in seven million.

Equal sets share one representative. A bucket of at most SMALL members gives all
its plausible pairs. In a larger one every member is first compared with the
bucket's least member. Links that this leaves between components of a cluster, the
members that large buckets connect, are found exactly: each member is reduced to
the shingles in which it differs from one reference, members meet by a part
of these, and a bound on how many they can share rules out the rest. A group of
copies so costs about as many comparisons as it has members.

Components come from contracting
links in rounds; nothing but counts comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, pieces, stored, unused
from .kernels import LOWER, Spans, U, mix, signed, text_bytes, words
from .suffix_dedup import keyed

BANDS, ROWS = 30, 4
SKETCH_WORDS = 4  # of 64 bits
SMALL = 32
SALTS = 16
COUNTERS = 256
#: So far, over five deviations at 0.8, an estimate may lie under the similarity asked for.
MARGIN = 0.33
_SEED = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted, and each text's bounds in them."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    start, end, first = words(data, offsets)
    count = np.diff(first)
    spans = Spans(Spans(data).hash(start, end))
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(start))
    ok = at + k <= first[row + 1]
    short = np.flatnonzero((count > 0) & (count < k))
    hashes = np.concatenate([spans.hash(at[ok], at[ok] + k), spans.hash(first[short], first[short + 1])])
    row = np.concatenate([row[ok], short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, t, n, f1, f2, bands, sketch of each row: set size, 128-bit hash of the set, band keys, odd sketch."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 19):
                hashes, first = shingles(batch.column(2), k)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                least = np.zeros((batch.num_rows, BANDS * ROWS), U)
                if len(full):
                    base = hashes | U(1)
                    for i, seed in enumerate(_SEED):
                        least[full, i] = np.minimum.reduceat(base * seed, first[full])
                f = [np.zeros(batch.num_rows, U) for _ in range(2)]
                if len(full):
                    for i in range(2):
                        f[i][full] = np.add.reduceat(mix(hashes ^ U(i + 1)), first[full])
                bands = mix(least.reshape(-1, BANDS, ROWS) * U(0x9E3779B97F4A7C15) ^ (np.arange(ROWS, dtype=U) << U(7)))
                bands = mix(np.bitwise_xor.reduce(bands, axis=2) + np.arange(BANDS, dtype=U) * U(0xD1B54A32D192ED03))
                bit = mix(least ^ (np.arange(BANDS * ROWS, dtype=U) * U(0xA0761D6478BD642F))) >> U(64 - 8)
                sketch = np.zeros((batch.num_rows, SKETCH_WORDS), U)
                rows = np.arange(batch.num_rows)
                for i in range(BANDS * ROWS):
                    sketch[rows, (bit[:, i] >> U(6)).astype(np.int64)] ^= U(1) << (bit[:, i] & U(63))
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(signed(np.ascontiguousarray(a).ravel())))
                columns = [batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), *[pa.array(signed(x)) for x in f], lists(bands), lists(sketch)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "f1", "f2", "bands", "sketch"])

    return docs.mapInArrow(run, f"doc_id {key}, t int, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def estimate(differing: int) -> float:
    """The similarity of two sets whose odd sketches differ in so many bits.

    A sketch of B bits holds the parities of S samples. Sets of similarity J differ in
    about 2S(1 - J) of these, which leave B/2 * (1 - exp(-4S(1 - J) / B)) bits odd, so
    J = 1 + B / 4S * ln(1 - 2 * differing / B). The nearer to 1, the more exact it is.
    """
    bits = 64 * SKETCH_WORDS
    share = 1 - 2 * differing / bits
    return max(0.0, 1 + bits / (4 * BANDS * ROWS) * math.log(share)) if share > 0 else 0.0


def most_bits(percent: int) -> int:
    """As many bits may differ as leave an estimate within MARGIN of the similarity."""
    return max(n for n in range(64 * SKETCH_WORDS) if n == 0 or estimate(n) >= percent / 100 - MARGIN)


def _plausible(a: str, b: str, percent: int) -> str:
    """SQL: sizes and estimated similarity allow the link. Two sketches of equal sets never get here."""
    bits = " + ".join(f"bit_count({a}.sketch[{i}] ^ {b}.sketch[{i}])" for i in range(SKETCH_WORDS))
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {bits} <= {most_bits(percent)}"


def bucket_pairs(members: DataFrame, percent: int) -> DataFrame:
    """x, y, and for members of large buckets band, n, sketch instead of y.

    members: band, x, n, sketch; streamed in order of (band, x), with at most SMALL
    members of a bucket held at a time.
    """
    key = members.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # members of the present bucket
        large, most = False, most_bits(percent)

        def plausible(p, q):
            if 100 * min(p[2], q[2]) < percent * max(p[2], q[2]):
                return False
            return sum((i ^ j).bit_count() for i, j in zip(p[3], q[3], strict=True)) <= most

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("x", batch.schema.field("x").type), ("y", batch.schema.field("x").type), ("band", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))])
            out = []
            band = batch.column(0).to_numpy()
            lone = np.zeros(len(band), bool)  # alone in its bucket, inside this batch
            lone[1:-1] = (band[1:-1] != band[:-2]) & (band[1:-1] != band[2:])
            part = batch.filter(pa.array(~lone))
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), [[v & 0xFFFFFFFFFFFFFFFF for v in s] for s in part.column(3).to_pylist()], strict=True):
                if held and held[0][0] != row[0]:
                    if not large:
                        out += [(p[1], q[1], None, None, None) for i, p in enumerate(held) for q in held[i + 1 :] if plausible(p, q)]
                    held, large = [], False
                if not large and len(held) == SMALL:
                    large = True
                    for p in held:
                        out.append((p[1], None, p[0], p[2], np.array(p[3], U).view(np.int64).tolist()))
                    out += [(held[0][1], p[1], None, None, None) for p in held[1:] if plausible(held[0], p)]
                    held = held[:1]
                if large:
                    out.append((row[1], None, row[0], row[2], np.array(row[3], U).view(np.int64).tolist()))
                    if plausible(held[0], row):
                        out.append((held[0][1], row[1], None, None, None))
                else:
                    held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if held and not large:
            out = [(p[1], q[1], None, None, None) for i, p in enumerate(held) for q in held[i + 1 :] if plausible(p, q)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    ordered = members.repartition("band").sortWithinPartitions("band", "x")
    return ordered.mapInArrow(run, f"x {key}, y {key}, band long, n long, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets reach the similarity. texts: x, text of each representative."""
    key = pairs.schema["x"].dataType.simpleString()
    read = pairs.join(texts.withColumnRenamed("text", "tx"), "x").join(texts.select(F.col("x").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "tx", 1 << 20):
                (a, fa), (b, fb) = shingles(batch.column(2), k), shingles(batch.column(3), k)
                keep = []
                for i in range(batch.num_rows):
                    x, y = a[fa[i] : fa[i + 1]], b[fb[i] : fb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["x", "y"]).filter(pa.array(keep))

    return read.mapInArrow(run, f"x {key}, y {key}")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """x, c: each node of the links and the least node that it reaches.

    Each round joins every node to its least neighbour, follows these twice, and
    renames the ends of the links; links within a component vanish, so rounds are
    few. A node with very many links is only a key of aggregates with map-side
    combination, and of joins whose large partitions Spark splits.
    """
    edges = stored(links.select("x", "y").where("x <> y").distinct(), label)
    nodes = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = both.groupBy("x").agg(F.min("y").alias("p")).select("x", F.least("x", "p").alias("p"))
        up = stored(up, f"{label}-up")
        root = up.alias("a").join(up.select(F.col("x").alias("p"), F.col("p").alias("q")).alias("b"), "p").select("x", F.col("q").alias("p"))
        root = stored(root, f"{label}-root")
        if nodes is None:
            nodes = root.select("x", F.col("p").alias("c"))
        else:
            moved = nodes.join(root.select(F.col("x").alias("c"), "p"), "c", "left").select("x", F.coalesce("p", "c").alias("c"))
            nodes = stored(moved, f"{label}-nodes")
        to = root.select(F.col("x").alias("v"), F.col("p").alias("r"))
        renamed = edges.join(to.withColumnsRenamed({"v": "x", "r": "rx"}), "x").join(to.withColumnsRenamed({"v": "y", "r": "ry"}), "y")
        edges = stored(renamed.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).where("x <> y").distinct(), label)
    return nodes if nodes is not None else edges.select("x", F.col("y").alias("c"))


def clusters(named: DataFrame) -> DataFrame:
    """x, n, sketch, c, g, main: members of large buckets, where their cluster has several components.

    named: band, x, n, sketch, c. A cluster g is what buckets connect; main is its
    component of most members.
    """
    heads = named.groupBy("band").agg(F.min("x").alias("y"))
    star = named.join(heads, "band").select("x", "y").where("x <> y").distinct()
    who = named.groupBy("x").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("sketch").alias("sketch"))
    who = stored(who.join(components(star, "clusters").withColumnRenamed("c", "g"), "x", "left").withColumn("g", F.coalesce("g", "x")), "who")
    main = who.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("parts"))
    return stored(who.join(main.where("parts > 1").drop("parts"), "g"), "apart")


def edits(who: DataFrame, texts_of, k: int, percent: int) -> DataFrame:
    """x, g, c, main, a, e: e are the shingles in which x differs from its cluster's reference: own ones, then missing ones.

    The reference R is the least member of the main component. With d(x) edits, sets
    x and y differ in d(x) + d(y) - 2 * (shared edits) shingles, so they reach the
    similarity exactly if 2 * (100 + percent) * (shared edits) >= a(x) + a(y), where
    a = (100 + percent) * d - (100 - percent) * n.
    """
    key = who.schema["x"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                hashes, first = shingles(batch.column(1), k)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(hashes)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["x", "s"])

    sets = stored(texts_of(who.select("x")).select("x", "text").mapInArrow(run, f"x {key}, s array<long>"), "sets")
    heads = who.where("c = main").groupBy("g").agg(F.min("x").alias("x"))
    reference = heads.join(sets, "x").select("g", F.col("s").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = who.join(sets, "x").withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(reference, ["g", "salt"]).select("x", "g", "c", "main", "n", "s", "r")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column(5), batch.column(6), strict=True)]
            e = [np.concatenate([np.setdiff1d(x, y, assume_unique=True), np.sort(np.setdiff1d(y, x, assume_unique=True))]) for x, y in both]
            d = np.array([len(x) for x in e], np.int64)
            a = (100 + percent) * d - (100 - percent) * batch.column(4).to_numpy()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(d)]).astype(np.int32)), pa.array(np.concatenate(e) if e else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(a), lists], names=["x", "g", "c", "main", "a", "e"])

    return stored(met.mapInArrow(differ, f"x {key}, g {key}, c {key}, main {key}, a long, e array<long>"), "edits")


def by_rarity(edited: DataFrame) -> DataFrame:
    """edited with each member's edits in one order for its cluster: those that few members share first.

    How many share an edit is counted by COUNTERS buckets of its hash, in each partition
    and then over all, so no row is made for an edit; equal edits fall into equal buckets.
    """
    key = edited.schema["g"].dataType.simpleString()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edited.schema.fields)
    bucket = lambda e: (mix(np.array(e).view(U)) % U(COUNTERS)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict = {}
            for g, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[g] = counts.get(g, 0) + np.bincount(bucket(e.values.to_numpy()), minlength=COUNTERS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * COUNTERS), pa.array(np.concatenate(list(counts.values()) or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), batch.schema.field(0).type), lists], names=["g", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = table["n"].combine_chunks().values.to_numpy().reshape(-1, COUNTERS).sum(axis=0)
        return pa.table({"g": table["g"].slice(0, 1), "n": pa.array([total.tolist()], pa.list_(pa.int64()))})

    totals = edited.select("g", "e").mapInArrow(count, f"g {key}, n array<long>").groupBy("g").applyInArrow(add, f"g {key}, n array<long>")
    totals = totals.select("g", F.col("n").alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = edited.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(totals, ["g", "salt"]).select(*edited.columns, "shared")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for e, n in zip(batch.column("e"), batch.column("shared"), strict=True):
                e = e.values.to_numpy()
                every.append(e[np.lexsort((e, n.values.to_numpy()[bucket(e)]))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(e) for e in every])]).astype(np.int32)), pa.array(np.concatenate(every) if every else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], names=batch.schema.names[:-1])

    return stored(met.mapInArrow(order, schema), "ordered")


def across(edited: DataFrame, percent: int) -> DataFrame:
    """x, y: pairs of one cluster in different components, with all whose links join components that weren't.

    Where a(x) + a(y) <= 0 the two are linked without shared edits, and then each of
    them also with the member of least a: a star holds these. All others share edits.
    At the first that two share, in an order that holds for the cluster, neither has
    fewer edits left than they share; so only a part of each member's edits has to
    meet: of a member of the main component, which meets only those outside, about
    the first half. Rare edits stand first, so that members that differ from the
    reference in common shingles only don't meet by these.
    """
    edited = by_rarity(edited)
    each = edited.drop("e")
    outer = F.when(F.col("c") != F.col("main"), F.col("a"))
    low = each.groupBy("g").agg(F.min_by("x", "a").alias("y"), F.min_by("c", "a").alias("yc"), F.min("a").alias("low"), F.min(outer).alias("low_outer"))
    star = each.join(low, "g").where("c <> yc AND a + low <= 0").select("x", "y")
    twice = 2 * (100 + percent)
    # The edits at which enough are left; the others are only counted.
    need = F.expr("a + CASE WHEN c = main THEN low_outer ELSE low END")
    most = F.size("e") - F.greatest(F.lit(1), F.ceil(need / twice)) + 1
    cut = edited.join(low.select("g", "low", "low_outer"), "g").withColumn("most", F.greatest(F.lit(0), F.least(F.size("e"), most)).cast("int"))
    cut = cut.select("x", "g", "c", "main", "a", F.size("e").alias("d"), F.posexplode(F.slice("e", F.lit(1), F.col("most"))).alias("i", "e"))
    tokens = stored(cut, "cut")
    shared = tokens.groupBy("g", "e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g", "e")
    # All of x's edits from e on: one that meets nothing here may stand among those cut off a partner's.
    placed = tokens.join(shared, ["g", "e"]).withColumn("left", F.col("d") - F.col("i"))
    placed = stored(placed.select("x", "g", "c", "e", "a", "left", F.expr("c <> main").alias("outside")), "placed")
    met = placed.where("outside").alias("a").join(placed.alias("b"), F.expr(f"a.g = b.g AND a.e = b.e AND a.c <> b.c AND a.a + b.a > 0 AND {twice} * least(a.left, b.left) >= a.a + b.a"))
    pairs = met.select(F.col("a.x").alias("x"), F.col("b.x").alias("y")).unionByName(star)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def sketched(pairs: DataFrame, who: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and odd sketches leave."""
    one = pairs.join(who.select("x", F.struct("n", "sketch").alias("p")), "x")
    return one.join(who.select(F.col("x").alias("y"), F.struct("n", "sketch").alias("q")), "y").where(_plausible("p", "q", percent)).select("x", "y")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, t, n_shingles, component_id, kept for each row of docs.

    Links rows with 100 * intersection >= percent * union of their sets of k-word
    shingles (fewer words: the whole sequence; without words: empty, linked with
    nothing). component_id: the least doc_id reachable. kept: doc_id = component_id.
    Rows of one doc_id and text get equal results; rows of one doc_id and different
    texts share its links. A row with null doc_id is linked with nothing and kept.
    """
    own = keyed(docs)
    signs = stored(signatures(own, k), "signs")
    classes = signs.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t", "n", "bands", "sketch")).alias("m"))
    reps = stored(classes.select("f1", "f2", F.col("m.doc_id").alias("x"), "m.t", "m.n", "m.bands", "m.sketch"), "reps")
    found = stored(bucket_pairs(reps.select(F.explode("bands").alias("band"), "x", "n", "sketch"), percent), "buckets")
    ordered = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    pairs = stored(found.where("y IS NOT NULL").select(*ordered).where("x <> y").distinct(), "pairs")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return stored(own.withColumnRenamed("doc_id", "x").join(reps.select("x", "t").join(nodes, "x"), ["x", "t"]).select("x", "text"), "texts")

    def links_of(some: DataFrame) -> DataFrame:
        nodes = some.select("x").union(some.select(F.col("y").alias("x"))).distinct()
        return stored(confirmed(some, texts_of(nodes), k, percent), "confirmed")

    links = links_of(pairs)
    nodes = components(links)
    large = found.where("y IS NULL").select("band", "x", "n", "sketch")
    if not large.isEmpty():
        named = stored(large.join(nodes, "x", "left").withColumn("c", F.coalesce("c", "x")), "named")
        who = clusters(named)
        if not who.isEmpty():
            pairs = stored(sketched(across(edits(who, texts_of, k, percent), percent), who, percent), "more")
            if not pairs.isEmpty():
                nodes = components(stored(links.unionByName(links_of(pairs)), "links"))
    ids = reps.join(nodes, "x", "left").select("f1", "f2", F.coalesce("c", "x").alias("c"))
    out = signs.select("doc_id", "t", "n", "f1", "f2").join(ids, ["f1", "f2"], "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def op8(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of least doc_id; of repeated rows, one.

    Null and empty texts are like nothing and stay; so do rows with null doc_id, one of
    each text. Extra columns of any name stay; an empty table stays empty.
    """
    mark = unused(docs, "text_hash")
    kept = near_duplicates(docs.select("doc_id", "text")).where("kept").select("doc_id", F.col("t").alias(mark)).distinct()
    left = docs.withColumn(mark, F.hash("text"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col(f"l.{mark}") == F.col(f"r.{mark}"))
    out = left.alias("l").join(kept.alias("r"), same, "left_semi")
    return out.dropDuplicates(["doc_id", mark]).select(*[column(c) for c in docs.columns])
