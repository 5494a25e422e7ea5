"""Exact top-k by inner product over a pivot-distance index.

Adding one component, sqrt(M^2 - |x|^2) with M the greatest norm, to each vector and
a zero to each query turns the greatest inner product into the least distance:
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest pivot and, within
it, by distance to it, and cut into annuli of at most about BLOCK vectors with known
least and greatest distance to the pivot. By the triangle inequality an annulus can hold
no vector nearer to q than max(d(q,p) - r_max, r_min - d(q,p)), which bounds its inner
products from above. Each query goes through the annuli in order of this bound, in
rounds that grow (FIRST, then GROW times as many), and stops for good where the bound
falls under its k-th score so far.

The bounds of all annuli are at most PIVOTS * RINGS rows, which every worker holds; a
round makes rows only for annuli that are really scanned. In a scan one annulus part at a
time is in memory, and its queries stream by. Inner products are of whole numbers and
exact for any that a long holds: components are split in limbs of LIMB bits, whose
products are exact in double precision.

Pivots come from a bounded sample; every vector is indexed. A pivot's cell may hold a
third of all rows: cells are cut into annuli by range, by many tasks, and an annulus of
equal distances (copies) into parts by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

PIVOTS = 32
SAMPLE = 4000
BLOCK = 2048
RINGS = 4096
FIRST, GROW = 4, 8
K = 5
LIMB = 20
#: Columns of one exact product: 2 * LIMB bits and these many terms fit 53 bits.
COLUMNS = 1 << (53 - 2 * LIMB)
QUERY_ROWS = 256


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * component); rows that are null or hold null or non-finite components go."""
    x = F.col("embedding")
    ok = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros up to width."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class Pivots:
    """Pivots in the widened space: farthest-first from a sample, and distances to them."""

    def __init__(self, sample: list[list[float]], width: int, norm2: float, count: int = PIVOTS):
        self.width, self.norm2 = width, norm2
        x = np.zeros((len(sample), width + 1))
        for i, v in enumerate(sample):
            x[i, : len(v)] = v
        x[:, width] = np.sqrt(np.maximum(0, norm2 - (x**2).sum(1)))
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(count, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        centres = x[chosen]
        for _ in range(4):  # move them to the means of their cells
            cell = self.distances(x, centres).argmin(1)
            for j in range(len(centres)):
                if (cell == j).any():
                    centres[j] = x[cell == j].mean(0)
        self.centres = centres

    @staticmethod
    def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T))

    def of(self, v: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.norm2 - (v**2).sum(1)))
        return self.distances(np.concatenate([v, last[:, None]], axis=1), self.centres)


class Whole:
    """Rows of whole numbers, as limbs."""

    def __init__(self, rows: np.ndarray):
        self.n = len(rows)
        size, sign = np.abs(rows).astype(np.uint64), np.sign(rows)
        count = max(1, -(-int(size.max(initial=0)).bit_length() // LIMB))
        self.limbs = [((size >> np.uint64(LIMB * i)) & np.uint64((1 << LIMB) - 1)).astype(np.float64) * sign for i in range(count)]

    def products(self, other: Whole) -> np.ndarray:
        """All inner products with other's rows, as longs."""
        out = np.zeros((self.n, other.n), np.int64)
        for i, a in enumerate(self.limbs):
            for j, b in enumerate(other.limbs):
                if LIMB * (i + j) < 64:
                    for c in range(0, a.shape[1], COLUMNS):
                        out += (a[:, c : c + COLUMNS] @ b[:, c : c + COLUMNS].T).astype(np.int64) << np.int64(LIMB * (i + j))
        return out


class Annuli:
    """What is known of each annulus, by column: number, cell, least and greatest distance, parts."""

    def __init__(self, rows: list):
        self.number, self.cell, self.parts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 4))
        self.low, self.high = (np.array([r[i] for r in rows]) for i in (2, 3))

    def turn(self, to: np.ndarray, q2: float, norm2: float, kth: float, begin: int, end: int) -> np.ndarray:
        """The places of the begin-th to end-th annulus in order of their bounds, as far as these reach kth."""
        at = to[self.cell]
        slack = 1e-7 * (1 + norm2**0.5 + q2**0.5)
        gap = np.maximum(0, np.maximum(at - self.high, self.low - at) - slack)
        most = (q2 + norm2 - gap * gap) / 2 + 1e-9 * (1 + q2 + norm2)
        order = np.lexsort((self.number, -most))[begin:end]
        return order[most[order] >= kth]


def search(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query with all other rows.

    vectors: from whole_numbers(). Queries are the rows whose vec_id is divisible by
    every; ties go to the smaller vec_id; a shorter vector counts as ending in zeros.
    A query's own row is the one of its vec_id; of rows that repeat a vec_id the least
    vector asks, all are left out for it, and otherwise each is a candidate. No rows: an empty result. A component
    of 2^63 or more is an error, as no long holds its products.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    top = vectors.agg(F.max(F.size("v")).alias("w"), F.max(size).alias("n"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))).alias("m"), F.count(F.lit(1)).alias("c")).first()
    if not top.c:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    if top.m >= 2.0**63:
        raise ValueError("a component of 2^63 or more: no long holds its products")
    width, norm2, share = max(1, top.w), float(top.n), min(1.0, SAMPLE / top.c)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("vec_id"), "vec_id").take(SAMPLE)
    pivots = Pivots([r.v for r in sample] or [[0.0]], width, norm2)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.of(_matrix(batch.column(1), width), False)
            cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int64)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "r"])

    keyed = stored(vectors.mapInArrow(key, "vec_id long, v array<double>, cell long, r double"), "keyed")
    # Cells are cut by quantiles of the distance, then each annulus knows its bounds.
    # At most PIVOTS rows of RINGS numbers come to the driver and go to the workers.
    rings = {r.cell: min(RINGS, -(-r.n // BLOCK)) for r in keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = {c: np.zeros(0) for c in rings}
    if (most := max(rings.values())) > 1:
        for r in keyed.groupBy("cell").agg(F.percentile_approx("r", [i / most for i in range(1, most)], 4 * RINGS).alias("cuts")).collect():
            cuts, n = np.array(r.cuts), rings[r.cell]
            ends[r.cell] = np.unique(cuts[[i * most // n - 1 for i in range(1, n)]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, r = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            b = cell * RINGS  # a copy
            for c in np.unique(cell):
                b[cell == c] += np.searchsorted(ends[c], r[cell == c])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b)], names=["vec_id", "v", "cell", "r", "b"])

    index = stored(keyed.mapInArrow(place, "vec_id long, v array<double>, cell long, r double, b long"), "index")
    known = index.groupBy("b", "cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).alias("parts"))
    annuli = Annuli([tuple(r) for r in known.orderBy("b").collect()])  # at most PIVOTS * RINGS rows
    parts = spark.createDataFrame([(int(b), int(n)) for b, n in zip(annuli.number, annuli.parts, strict=True)], "b long, parts long")
    blocks = index.join(F.broadcast(parts), "b").select("b", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v")
    queries = stored(vectors.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")), "queries")

    def asked(state: DataFrame, begin: int, end: int) -> DataFrame:
        """(b, part, asks, id, v): the queries that have to see an annulus in this round; state: query_id, kth."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column(1), width)
                to, q2 = pivots.of(q, True), (q * q).sum(1)
                kth = batch.column(2).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                for i in range(batch.num_rows):
                    found = annuli.turn(to[i], float(q2[i]), norm2, float(kth[i]), begin, end)
                    n = annuli.parts[found]
                    if total := int(n.sum()):
                        part = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                        pick = pa.array(np.full(total, i))
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(annuli.number[found], n)), pa.array(part), pa.array(np.ones(total, np.int32)), batch.column(0).take(pick), batch.column(1).take(pick)], names=["b", "part", "asks", "id", "v"])

        return queries.join(state, "query_id", "left").select("query_id", "q", "kth").mapInArrow(run, "b long, part long, asks int, id long, v array<double>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One annulus part at a time: its vectors come first, then its queries, a batch of which is scored at once."""
        held: list[pa.RecordBatch] = []
        now, whole, ids = None, None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if a == b:
                    continue
                if now != tuple(keys[a, :2]):
                    now, held, whole = tuple(keys[a, :2]), [], None
                some = batch.slice(a, b - a)
                if keys[a, 2] == 0:
                    held.append(some)
                    continue
                if whole is None:
                    ids = np.concatenate([h.column(3).to_numpy() for h in held])
                    whole, held = Whole(np.concatenate([_matrix(h.column(4), width) for h in held])), []
                for at in range(0, some.num_rows, QUERY_ROWS):
                    asking = some.slice(at, QUERY_ROWS)
                    mine = asking.column(3).to_numpy()
                    s = Whole(_matrix(asking.column(4), width)).products(whole)
                    other = mine[:, None] != ids[None]
                    s[~other] = np.iinfo(np.int64).min
                    out = []
                    for j, row in enumerate(s):
                        n = min(k, len(row))
                        near = np.flatnonzero((row >= np.partition(row, -n)[-n]) & other[j])
                        near = near[np.lexsort((ids[near], -row[near]))][:k]
                        out.append((np.full(len(near), mine[j]), ids[near], row[near]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    state = queries.select("query_id", F.lit(None).cast("double").alias("kth"))
    found, begin, turns = None, 0, FIRST
    while begin < len(annuli.number):
        plan = asked(state, begin, begin + turns)
        if not plan.agg(F.count(F.lit(1))).first()[0]:  # to the end: a worker that is cut off has to start anew
            break
        rows = blocks.unionByName(plan).repartition("b", "part").sortWithinPartitions("b", "part", "asks")
        scores = rows.mapInArrow(scan, "query_id long, vec_id long, score long")
        found = stored(best(scores if found is None else found.drop("rank").unionByName(scores)), "found")
        state = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("kth"))
        begin, turns = begin + turns, turns * GROW
    if found is None:
        found = queries.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(vectors: DataFrame) -> DataFrame:
    """search() over the embeddings; rows that are null or hold null or non-finite components take no part."""
    return search(whole_numbers(vectors))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}
"""
