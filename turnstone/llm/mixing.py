"""Mixing sources to target weights by Pfair scheduling.

A source of weight w (a share of all slots) owns block i = 1, 2, ... with release
time floor((i-1)/w) and deadline ceil(i/w). At each slot the released block of the
earliest deadline goes first. With shares that sum to one, each source has after t
slots between t*w - 1 and t*w + 1 blocks, however large t grows. Weights are exact:
given ones are read as decimal fractions and brought to whole numbers, and those that
nobody gave are whole numbers by definition. The schedule repeats after as many slots
as the whole weights sum to, so one period, built by an aggregate over a bounded
sequence, places any number of blocks.

Only DataFrame functions run here. Numbering within a source is done by chunks of
a digest of doc_id, so a source that holds a third of all rows is numbered by many
tasks; only counts by (source, chunk) are summed up.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, stored

BLOCK = 16
#: Weights that nobody gave are 1 to SCALE: the square root of a source's amount, in hundredths of the largest one's, rounded up.
SCALE = 100
#: Slots of one period; weights that need more (over five decimals, mostly) are an error.
MAX_PERIOD = 200_000
#: Sources beyond this bound are an error, never dropped: one period has to name each.
MAX_SOURCES = 500
#: Slots that the inner of the two loops over a period makes at a time.
STRETCH = 500
#: Hex digits of md5(doc_id) that make a chunk: 4096 chunks for each source.
CHUNK_DIGITS = 3
#: The names under which the place in the mix is given back.
ORDER = ("mix_slot", "mix_place")


def whole_weights(weights: dict[str | None, float | int | str]) -> dict[str | None, int]:
    """The least whole numbers in exactly the proportions of the given decimals."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v <= 0 for v in exact.values()):
        raise ValueError("weights must be over zero")
    bottom = math.lcm(*(v.denominator for v in exact.values()))
    whole = {k: int(v * bottom) for k, v in exact.items()}
    top = math.gcd(*whole.values())
    return {k: v // top for k, v in whole.items()}


def source_key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def period(amounts: DataFrame, weights: dict[str | None, float | int | str] | None = None) -> DataFrame:
    """(source, w, size, at, k): the slot of the k-th block of source within one period of size slots.

    amounts: (source, n). Without weights a source takes SCALE * sqrt(n / greatest n),
    rounded up, at least 1; with weights, those that name it not take the least one given.
    """
    one = amounts.limit(MAX_SOURCES + 1).agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"), F.max("n").cast("double").alias("most"))
    if weights:
        given = whole_weights(weights)
        named = F.create_map(*[F.lit(x) for k, v in given.items() for x in ("~" if k is None else f"={k}", v)])
        w = lambda x: F.coalesce(F.try_element_at(named, x["source"]), F.lit(min(given.values())))
    else:
        w = lambda x: F.greatest(F.lit(1), F.ceil(SCALE * F.sqrt(x["n"].cast("double") / F.col("most"))))
    one = one.select(F.transform("s", lambda x: F.struct(x["source"].alias("source"), w(x).cast("bigint").alias("w"))).alias("s"))
    one = one.withColumn("size", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["w"]))
    fits = F.when(F.size("s") > MAX_SOURCES, F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))).when(F.col("size") > MAX_PERIOD, F.raise_error(F.lit(f"the weights need a period of more than {MAX_PERIOD} slots")))
    limited = one.where("size > 0").withColumn("s", F.coalesce(fits, F.col("s")))

    def step(acc: Column, t: Column) -> Column:
        def offer(x: Column, i: Column) -> Column:
            done = F.get(acc["done"], i)
            released = F.floor(done * F.col("size") / x["w"]) <= t
            deadline = F.ceil((done + 1) * F.col("size") / x["w"])
            return F.struct(F.when(released & (done < x["w"]), deadline).otherwise(F.lit(1 << 60)).cast("bigint").alias("d"), i.alias("i"))

        def take(best: Column) -> Column:
            return F.struct(
                F.transform(acc["done"], lambda d, i: d + (i == best).cast("bigint")).alias("done"),
                F.concat(acc["picks"], F.array(best)).alias("picks"),
            )

        return _once(F.array_min(F.transform(F.col("s"), offer))["i"], take)

    none = F.array().cast("array<int>")

    def stretch(acc: Column, c: Column) -> Column:
        slots = F.sequence(c * STRETCH, F.least((c + 1) * STRETCH, F.col("size")) - 1)
        inner = F.aggregate(slots, F.struct(acc["done"].alias("done"), none.alias("picks")), step)
        return _once(inner, lambda r: F.struct(r["done"].alias("done"), F.concat(acc["all"], F.array(r["picks"])).alias("all")))

    start = F.struct(F.transform(F.col("s"), lambda x: F.lit(0).cast("bigint")).alias("done"), F.array().cast("array<array<int>>").alias("all"))
    stretches = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / STRETCH).cast("bigint"))
    picks = F.aggregate(stretches, start, stretch, lambda acc: F.flatten(acc["all"]))
    rows = limited.select("s", "size", F.posexplode(picks).alias("at", "i"))
    rows = rows.select(F.get("s", F.col("i")).alias("x"), "size", F.col("at").cast("bigint").alias("at"))
    k = F.row_number().over(W.partitionBy("x.source").orderBy("at")) - 1
    return rows.select("x.source", F.col("x.w").alias("w"), "size", "at", k.cast("bigint").alias("k"))


def mixed(docs: DataFrame, weights: dict[str | None, float | int | str] | None = None, block: int = BLOCK, names: tuple[str, str, str] = ("block", *ORDER)) -> DataFrame:
    """docs with the block within its source, the slot and the place in the block: order by (slot, place) is the mixed corpus.

    Every row is kept. A null source is a source of its own. The amount of a source is
    its characters (n_chars, if docs has it) or its rows. Within a source rows stand by
    md5(doc_id), doc_id, text, so repeated rows get places of their own and equal rows
    can be told apart by these only. While every source has blocks left, no source is a
    whole block away from its target; slots of a source that is used up stay empty.
    Columns may have any name; those that are named like the three new ones give way.
    An empty table gives an empty one.
    """
    keep = [c for c in docs.columns if c not in names]
    text = [column("text").alias("text_")] if "text" in docs.columns else []
    amount = F.greatest(F.coalesce(column("n_chars"), F.lit(0)), F.lit(0)) + 1 if "n_chars" in docs.columns else F.lit(1)
    keyed = docs.select(
        *[column(c).alias(f"k{i}") for i, c in enumerate(keep)], column("doc_id").alias("id_"), *text, amount.cast("bigint").alias("n_"),
        source_key(column("source")).alias("source_"), F.md5(F.coalesce(column("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest_"),
    ).withColumn("chunk_", F.substring("digest_", 1, CHUNK_DIGITS))
    # Counts read only source, doc_id and n_chars; sources times chunks bound them.
    counts = stored(keyed.groupBy("source_", "chunk_").agg(F.count(F.lit(1)).alias("c_"), F.sum("n_").alias("n_")), "counts")
    before = F.coalesce(F.sum("c_").over(W.partitionBy("source_").orderBy("chunk_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source_", "chunk_", before.alias("before_"))
    slots = stored(period(counts.groupBy(F.col("source_").alias("source")).agg(F.sum("n_").alias("n")), weights), "slots")
    own = F.row_number().over(W.partitionBy("source_", "chunk_").orderBy("digest_", "id_", *(["text_"] if text else [])))
    placed = keyed.withColumn("own_", own - 1).join(starts, ["source_", "chunk_"])
    nth = F.col("before_") + F.col("own_")
    placed = placed.withColumns({"block_": F.floor(nth / block).cast("bigint"), "place_": (nth % block).cast("int")})
    sizes = slots.select(F.col("source").alias("source_"), "w", "size").distinct()
    placed = placed.join(F.broadcast(sizes), "source_")  # at most MAX_SOURCES rows
    placed = placed.withColumn("nth_", F.col("block_") % F.col("w"))
    at = slots.select(F.col("source").alias("source_"), F.col("k").alias("nth_"), "at")
    placed = placed.join(F.broadcast(at), ["source_", "nth_"])  # at most MAX_PERIOD rows
    slot = F.floor(F.col("block_") / F.col("w")).cast("bigint") * F.col("size") + F.col("at")
    return placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("block_").alias(names[0]), slot.alias(names[1]), F.col("place_").alias(names[2]))


def op7(docs: DataFrame) -> DataFrame:
    """Where each document stands in the mix: doc_id, source, block, slot, place. Nulls and ties as in mixed()."""
    return mixed(docs.select("doc_id", "source", "n_chars"), names=("block", "slot", "place")).select("doc_id", "source", "block", "slot", "place")


def stage(docs: DataFrame) -> DataFrame:
    """The documents themselves, with their columns, in files that follow the order of the mix.

    Who reads the files in another order gets each row's place again from placed(),
    which depends on the rows alone.
    """
    slot, place = ORDER
    out = mixed(docs, names=("mix_block", slot, place))
    return out.repartitionByRange(slot, place).sortWithinPartitions(slot, place).select(*[column(c) for c in docs.columns])


def placed(docs: DataFrame) -> DataFrame:
    """docs with mix_slot and mix_place."""
    return mixed(docs, names=("mix_block", *ORDER)).drop("mix_block")


ORACLE = f"""
WITH RECURSIVE raw AS (
  SELECT coalesce('=' || source, '~') AS s, sum(greatest(coalesce(n_chars, 0), 0) + 1)::DOUBLE AS n FROM documents GROUP BY 1
), weights AS (
  SELECT s, greatest(1, ceil({SCALE} * sqrt(n / (SELECT max(n) FROM raw))))::BIGINT AS w FROM raw
), lists AS (
  SELECT list(s ORDER BY s) AS ss, list(w ORDER BY s) AS ws, sum(w)::BIGINT AS size FROM weights
), steps AS (
  SELECT 0::BIGINT AS t, list_transform(ss, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS pick FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (
    SELECT t, done, list_position(due, list_min(due))::BIGINT AS best FROM (
      SELECT t, done, list_transform(done, lambda d, i: CASE WHEN d < ws[i] AND (d * size) // ws[i] <= t THEN ((d + 1) * size + ws[i] - 1) // ws[i] ELSE 1152921504606846976 END) AS due
      FROM steps, lists WHERE t < size)
  )
), slots AS (
  SELECT ss[pick] AS s, ws[pick] AS w, size, t - 1 AS spot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM steps, lists WHERE t > 0
), numbered AS (
  SELECT doc_id, source, coalesce('=' || source, '~') AS s,
    row_number() OVER (PARTITION BY coalesce('=' || source, '~') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS nth FROM documents
)
SELECT doc_id, source, nth // {BLOCK} AS block, (nth // {BLOCK}) // w * size + spot AS slot, (nth % {BLOCK})::INT AS place
FROM numbered JOIN slots USING (s) WHERE (nth // {BLOCK}) % w = k
"""
