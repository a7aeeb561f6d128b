"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of ``block`` documents. With weight w (the
weights sum to 1), block k (from 0) of a source is released at slot floor(k / w)
and due before slot ceil((k + 1) / w); a slot takes the released block of the
earliest deadline. One block a slot can always be given within its window, so
after every slot t each source has given more than w * t - 1 and fewer than
w * t + 1 blocks.

Weights are fractions: a number is read as the decimal that it prints as, so
0.001 is 1/1000. Over their common denominator the schedule is periodic, and
after a whole period every source has given exactly its share. So one period is
planned, and a block's slot follows from its number in closed form; the plan does
not grow with the documents. A plan has at most ``MOST_SLOTS`` slots: weights with
a longer period (such as square roots, in all their digits) are followed as they
are over that many blocks; where more are left, they are rounded to that period,
by less than 1 / MOST_SLOTS, and the bound holds against the rounded ones.

When a source has given all its blocks, the rest go on among themselves with the
same weights, in a new epoch with its own period; the bound holds within each
epoch. Nothing is dropped and nothing is repeated; a source's last block may be
short. The driver knows each source's name and size; its work is the smaller of
the blocks and of the periods of all epochs.

A document's place in its source follows from the hash of its id (then of the
whole row): sources are dealt into buckets of some ``BUCKET`` rows, counted, and
numbered within buckets, so the rows of a hot source are spread over many tasks.

A null source is a source of its own (the empty name comes from the data only);
repeated rows are all kept, in some order among themselves, and a null id is an
id like any other; an empty table gives an empty result; texts of any length pass
as they are. Input columns block, slot and position are replaced; all others are
kept whatever their names, as rows travel packed. Sources without a target weight
get the mean of the given ones; without any, weights are whole numbers in
proportion to the square roots of the sources' sizes, the largest FINENESS. Weights
must not be negative; a source of weight zero comes after all others.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import checkpoints
from weft.llm.batches import named as column

BLOCK, BUCKET = 16, 2_000
#: Buckets of a source that are summed up together before ranges of them are.
RANGE = 1_000
#: Slots of a period at most, and the largest of the weights that follow from sizes.
MOST_SLOTS, FINENESS = 1 << 20, 100
#: Bytes of the plan that are broadcast at most; a larger one is joined by shuffling.
BROADCAST_BYTES = 16 << 20


def slots_of(weights: list[Fraction], blocks: int) -> list[int]:
    """Slots of each source in a period, in the proportion of the weights; one or more where the weight isn't zero.

    A period over MOST_SLOTS is only for mixtures of at most that many ``blocks``.
    """
    denominator = lcm(*[w.denominator for w in weights])
    whole = [int(w * denominator) for w in weights]
    common = gcd(*whole) or 1
    whole = [n // common for n in whole]
    total = sum(whole)
    if total <= MOST_SLOTS or blocks <= MOST_SLOTS:
        return whole
    period = max(MOST_SLOTS, len(whole))
    out = [max(1, n * period // total) if n else 0 for n in whole]
    for i in sorted(range(len(whole)), key=lambda i: (out[i] * total - whole[i] * period, i))[: max(0, period - sum(out))]:
        out[i] += 1
    return out


def schedule(slots: list[int], blocks: list[int]) -> list[np.ndarray]:
    """The slots of each source's blocks in one period of sum(slots), or until a source has given its ``blocks``.

    Source i has slots[i] of the period's slots.
    """
    period = sum(slots)
    waiting = [(0, i, 0) for i in range(len(slots))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    at: list[list[int]] = [[] for _ in slots]
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[i]), i, k))
        _, i, k = heapq.heappop(ready)
        at[i].append(t)
        if k + 1 == blocks[i]:
            break
        if k + 1 < slots[i]:
            heapq.heappush(waiting, ((k + 1) * period // slots[i], i, k + 1))
    return [np.array(x, np.int64) for x in at]


class Part(NamedTuple):
    """A source's blocks in an epoch: from ``first`` on, with the slots ``start + m * period + at[j]`` for block first + m * each + j."""

    source: int
    first: int
    start: int
    period: int
    each: int
    at: np.ndarray


def plan(blocks: list[int], weights: list[Fraction]) -> list[list[Part]]:
    """Each source's parts, in the order of its blocks; an epoch ends with the slot in which a source gives its last block."""
    if any(w < 0 for w in weights):
        raise ValueError("weights must not be negative")
    left, slot, out = list(blocks), 0, [[] for _ in blocks]
    while any(left):
        live = [i for i, n in enumerate(left) if n and weights[i] > 0] or [i for i, n in enumerate(left) if n]
        each = slots_of([weights[i] or Fraction(1) for i in live], sum(left[i] for i in live))
        period, at = sum(each), schedule(each, [left[i] for i in live])
        # where every source would give its last block; only one that comes so far within what was planned can be the first
        whole = sum(map(len, at)) == period
        if not whole:  # it ended within the period
            period, each = sum(map(len, at)), [max(1, len(a)) for a in at]
        ends = [(left[i] - 1) // e * period + int(a[(left[i] - 1) % e]) for i, e, a in zip(live, each, at) if len(a) and (whole or len(a) == left[i])]
        length = min(ends) + 1
        for i, e, a in zip(live, each, at):
            given = length // period * e + int(np.searchsorted(a, length % period)) if len(a) else 0
            if given:
                out[i].append(Part(i, blocks[i] - left[i], slot, period, e, a))
            left[i] -= given
        slot += length
    return out


def as_fraction(weight: float | int | str | Fraction) -> Fraction:
    return weight if isinstance(weight, Fraction) else Fraction(str(weight))


def mix(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """``docs`` with block (of its source, from 0), slot (from 0, one block each) and position (order within all), as longs.

    Sorting by position gives the mixture.
    """
    spark = docs.sparkSession
    tables = checkpoints.Tables(spark)
    # null sources sort and join as a struct, which is never null
    name = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    buckets = max(1, -(-docs.count() // BUCKET))
    kept = [c for c in docs.columns if c not in ("block", "slot", "position")]
    plain = [column(c) for c, kind in docs.dtypes if "map<" not in kind and c in kept]
    h = F.xxhash64(F.lit("order"), id_col)
    rows = docs.select(name.alias("source"), h.alias("hash"), F.pmod(h, F.lit(buckets)).alias("bucket"), F.struct(id_col, F.xxhash64(*plain)).alias("tie"), F.struct(*map(column, kept)).alias("row"))
    counts = tables.put(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sizes = {(r["source"]["none"], r["source"]["name"]): r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    sources = sorted(sizes)
    if weights:
        named = {(k is None, k or ""): as_fraction(v) for k, v in weights.items()}
        mean = sum(named.values(), Fraction(0)) / len(named)
        target = [named.get(s, mean) for s in sources]
    else:
        largest = sqrt(max(sizes.values(), default=1))
        target = [Fraction(max(1, round(FINENESS * sqrt(sizes[s]) / largest))) for s in sources]
    planned = plan([-(-sizes[s] // block) for s in sources], target)

    # where each bucket's rows begin in their source
    starts = counts.withColumn("range", F.floor(F.col("bucket") / F.lit(RANGE)))
    ranges = starts.groupBy("source", "range").agg(F.sum("n").alias("n"))
    ranges = ranges.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("first"))
    before = F.sum("n").over(Window.partitionBy("source", "range").orderBy("bucket")) - F.col("n")
    starts = starts.withColumn("before", before).join(ranges, ["source", "range"]).select("source", "bucket", (F.col("first") + F.col("before")).alias("begin"))
    within = Window.partitionBy("source", "bucket").orderBy("hash", "tie")
    numbered = rows.withColumn("k", F.row_number().over(within) - 1).drop("hash", "tie").join(starts, ["source", "bucket"])
    numbered = numbered.select("source", "row", (F.col("begin") + F.col("k")).alias("k"))
    numbered = numbered.withColumn("block", F.floor(F.col("k") / F.lit(block)))

    # first by its source a document meets the numbers that its parts begin with, then by source and part the part itself
    names = pa.StructArray.from_arrays([pa.array([s[0] for s in sources], pa.bool_()), pa.array([s[1] for s in sources], pa.string())], ["none", "name"])
    firsts = pa.table({"source": names, "firsts": pa.array([[p.first for p in parts] for parts in planned], pa.list_(pa.int64()))})
    every = [p for parts in planned for p in parts]
    held = pa.table(
        {
            "source": names.take(pa.array([p.source for p in every], pa.int64())),
            "part": pa.array([k for parts in planned for k in range(1, len(parts) + 1)], pa.int32()),
            **{f: pa.array([getattr(p, f) for p in every], pa.int64()) for f in ("first", "start", "period", "each")},
            "at": pa.array([p.at.astype(np.int32) for p in every], pa.list_(pa.int32())),
        }
    )
    kind = "source struct<none: boolean, name: string>, "
    as_frame = lambda t, rest: spark.createDataFrame(t if t.num_rows else [], None if t.num_rows else kind + rest)
    few = lambda t, df: F.broadcast(df) if t.nbytes <= BROADCAST_BYTES else df
    met = numbered.join(few(firsts, as_frame(firsts, "firsts array<long>")), "source")
    met = met.withColumn("part", F.size(F.filter("firsts", lambda f: f <= F.col("block")))).drop("firsts")
    met = met.join(few(held, as_frame(held, "part int, first long, start long, period long, each long, at array<int>")), ["source", "part"])
    k = F.col("block") - F.col("first")
    slot = F.col("start") + F.floor(k / F.col("each")) * F.col("period") + F.get("at", (k % F.col("each")).cast("int"))
    met = met.select("row", "block", slot.alias("slot"), "k")
    return met.select(*[F.col("row").getField(c).alias(c) for c in kept], "block", "slot", (F.col("slot") * block + F.col("k") % block).alias("position"))


def in_order(mixed: DataFrame, position: Column | str = "position") -> DataFrame:
    """The mixture's rows in their order: ranges of positions, sorted, file after file."""
    return mixed.orderBy(position)
