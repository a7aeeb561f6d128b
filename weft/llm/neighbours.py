"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors fall into cells around coarse centres (k-means on a bounded sample, SAMPLE;
every vector is then put to its nearest centre). A vector, less its cell's centre
and scaled to length one, is turned by a random rotation and kept as the signs of
its coordinates (packed to 64-bit words) with two correction scalars: its distance
to the centre, and its inner product with its own code. A query is turned likewise
and quantised to 4-bit steps, so the inner product with a code is four AND-and-count
passes over packed words, plus corrections; the squared distance follows, with a
bound on its error. Exact distances, in double precision on the original vectors,
are computed for the candidates whose lower bound does not exceed the k-th smallest
upper bound.

A query first searches its own cell. What it finds there bounds the distance of its
k-th neighbour, and it goes on to just those cells that may hold a nearer one: a
cell's members lie between two distances from its centre, so by the triangle
inequality a cell is left out only if it can't. Every other row is searched.

A unit of work is a part of a cell, of some ``BLOCK`` rows, with a block of its
queries, of some ``QUERY_BLOCK``; it returns each query's k best, and a last step
merges these. So a unit's memory is fixed, and a cell of very many equal vectors is
spread over many units.

Vectors that are null, empty, zero, or that hold null or non-finite components take
no part; vectors of unlike lengths are never near each other, each length has cells
of its own. Rows without an id take no part. Repeated rows are candidates each on
their own; a query row that is there several times gives its neighbours as often, and
rows of one id with unlike vectors are queries each on their own; a query's
candidates are the rows of all other ids. An empty table gives an empty result. Other
columns are not read, so their names cannot clash. The rotation and k-means have
fixed seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm import checkpoints
from weft.llm.batches import bound, frugal

BLOCK, QUERY_BLOCK, SAMPLE = 8_192, 2_048, 8_000
#: Rows in a cell on average, cells at most, and rounds of k-means.
CELL_ROWS, MOST_CELLS, ROUNDS = 2_048, 256, 8
#: How many standard deviations of the code's error the bounds take.
EPSILON = 2.5
QUERY_BITS = 4


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_501).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows, words), distances to the centre, and inner products of the unit vectors with their codes."""
    dim = vectors.shape[1]
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation_of(dim)
    signs = turned >= 0
    own = np.abs(turned).sum(axis=1) / np.sqrt(dim)
    padded = np.zeros((len(signs), -(-dim // 64) * 64), bool)
    padded[:, :dim] = signs
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64), length, np.where(length > 0, own, 1.0)


def estimates(codes: np.ndarray, length: np.ndarray, own: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances of one query to all codes, and the errors' bounds; ``rest`` is the query less the centre, turned."""
    dim = len(rest)
    far = float(np.linalg.norm(rest))
    turned = rest / far if far else rest
    low, step = turned.min(), (turned.max() - turned.min()) / ((1 << QUERY_BITS) - 1) or 1.0
    levels = np.clip(np.rint((turned - low) / step), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    dot = np.zeros(len(codes), np.int64)
    for bit in range(QUERY_BITS):
        plane = np.zeros(codes.shape[1] * 64, bool)
        plane[:dim] = levels >> bit & 1
        words = np.packbits(plane, bitorder="little").view(np.uint64)
        dot += np.bitwise_count(codes & words).sum(axis=1, dtype=np.int64) << bit
    # the code's coordinates are +-1/sqrt(dim): twice the ones' part less the whole sum
    total = int(levels.sum()) * step + dim * low
    inner = (2 * (dot * step + ones * low) - total) / np.sqrt(dim)
    square = length**2 + far**2 - 2 * length * far * inner / own
    error = 2 * length * far * (np.sqrt(np.maximum(1 - own**2, 0)) / own * EPSILON / np.sqrt(max(dim - 1, 1)) + step * 0.5 / own)
    return square, error


_ROTATIONS: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _ROTATIONS:
        _ROTATIONS[dim] = rotation(dim)
    return _ROTATIONS[dim]


def search_block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, query_id: int, query: np.ndarray, rest: np.ndarray, k: int, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of a block's k nearest to one query within ``reach``, by its bounds, nearest first, ties to smaller ids."""
    square, error = estimates(codes, length, own, rest)
    other = ids != query_id
    upper = np.where(other, square + error, np.inf)
    worst = min(np.partition(upper, k - 1)[k - 1] if len(ids) > k else np.inf, reach * reach * (1 + 1e-9))
    picked = np.flatnonzero(other & (square - error <= worst))
    apart, exact = vectors[picked] - query, np.zeros(len(picked))
    for i in range(len(query)):  # summed in the order of the coordinates, so that a distance is the same in any block
        exact += apart[:, i] * apart[:, i]
    exact = np.sqrt(exact)
    order = np.lexsort((ids[picked], exact))[:k]
    order = order[exact[order] <= reach]
    return ids[picked][order], exact[order]


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def cell_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by k-means; the same for the same sample."""
    rng = np.random.default_rng(3)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = apart(sample, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def apart(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances (vectors, centres)."""
    square = (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * vectors @ centres.T
    return np.sqrt(np.maximum(square, 0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


_PLACED = "id long, asks boolean, v array<double>, dim int, cell int, far double, code binary, own double"
_FOUND = "query_id long, key long, vec_id long, score double"


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query row's k nearest other rows."""
    spark = rows.sparkSession
    bound(spark)
    tables = checkpoints.Tables(spark)
    narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    good = narrow.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = {r["dim"]: r["count"] for r in good.groupBy(F.size("v").alias("dim")).count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = sum(sizes.values())
    drawn = good.filter(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 20)) < max(1, min(1 << 20, SAMPLE * (1 << 20) // n))).select("v").toArrow()["v"]
    samples: dict[int, list] = {dim: [] for dim in sizes}
    for v in drawn.to_pylist():
        samples[len(v)].append(v)
    centres = {}
    for dim, size in sizes.items():
        sample = np.array(samples[dim] or [[0.0] * dim])
        centres[dim] = cell_centres(sample[np.lexsort(sample.T)], max(1, min(MOST_CELLS, size // cell_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column(2)).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = _vectors(part.column(2), dim)
                cell = apart(v, centres[dim]).argmin(axis=1)
                codes, far, own = encode(v, centres[dim][cell])
                cols = [*part.columns, pa.array(np.full(len(v), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(far), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "asks", "v", "dim", "cell", "far", "code", "own"])

    placed = tables.put(good.mapInArrow(frugal(place), _PLACED))
    cells = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"), F.max("far").alias("most")).collect()
    # a query is an id with a vector, however often it is there
    asked = placed.filter("asks").withColumn("key", F.xxhash64("v")).groupBy("id", "key", "dim", "cell", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = tables.put(asked)

    def searched(visits: DataFrame) -> DataFrame:
        """The k nearest, if within reach, of every part of the cells that queries visit: (id, key, v, dim, cell, reach) -> _FOUND."""
        asks = {(r["dim"], r["cell"]): r["count"] for r in visits.groupBy("dim", "cell").count().collect()}
        busy = [(r["dim"], r["cell"], -(-r["n"] // block), -(-asks[r["dim"], r["cell"]] // query_block)) for r in cells if (r["dim"], r["cell"]) in asks]
        shape = F.broadcast(spark.createDataFrame(busy, "dim int, cell int, parts int, blocks int"))
        data = placed.join(shape, ["dim", "cell"]).select("dim", "cell", F.pmod(F.xxhash64(F.lit("part"), "id", "v"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", F.lit(0).cast("long").alias("key"), F.lit(False).alias("asks"), "v", "far", "code", "own")
        queries = visits.join(shape, ["dim", "cell"]).select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64(F.lit("block"), "id", "key"), "blocks").cast("int").alias("block"), "id", "key", F.lit(True).alias("asks"), "v", F.col("reach").alias("far"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("own"))

        def unit(table: pa.Table) -> pa.Table:
            dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
            asks = table["asks"].to_numpy()
            vectors, ids, keys = _vectors(table["v"].combine_chunks(), dim), table["id"].to_numpy(), table["key"].to_numpy()
            held = table.filter(pa.array(~asks))
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.uint64).reshape(len(held), -1)
            length, own, order = held["far"].to_numpy(), held["own"].to_numpy(), np.flatnonzero(asks)
            rest, reach = np.zeros_like(vectors), table["far"].to_numpy()
            rest[order] = (vectors[order] - centres[dim][cell]) @ rotation_of(dim)
            near, near_ids = vectors[~asks], ids[~asks]
            out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(4)]
            for i in order if len(held) else ():
                got, score = search_block(near_ids, near, codes, length, own, ids[i], vectors[i], rest[i], k, reach[i])
                for col, x in zip(out, (np.full(len(got), ids[i]), np.full(len(got), keys[i]), got, score)):
                    col.append(x)
            made = [np.concatenate(c[1:] or c) for c in out]
            return pa.table({"query_id": pa.array(made[0], pa.int64()), "key": pa.array(made[1], pa.int64()), "vec_id": pa.array(made[2], pa.int64()), "score": pa.array(made[3], pa.float64())})

        return data.unionByName(queries).groupBy("dim", "cell", "part", "block").applyInArrow(unit, _FOUND)

    by_score = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    home = tables.put(best(searched(asked.select("id", "key", "v", "dim", "cell", F.lit(float("inf")).alias("reach")))))
    reach = home.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "key", F.col("score").alias("reach"))
    rings: dict[int, list] = {dim: [] for dim in sizes}
    for r in sorted(cells):
        rings[r["dim"]].append((r["cell"], r["least"], r["most"]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cell, least, most = (np.array(x) for x in zip(*rings[dim]))
                d = apart(_vectors(part.column(4), dim), centres[dim][cell])
                nearest_member = np.maximum(d - most, least - d) - 1e-6 * (1 + d + most)  # sums are rounded
                reach = part.column(5).fill_null(np.inf).to_numpy()
                at, to = np.nonzero((nearest_member <= reach[:, None]) & (cell[None, :] != part.column(3).to_numpy()[:, None]))
                taken = part.take(pa.array(at))
                cols = [*(taken.column(i) for i in (0, 1, 4, 2)), pa.array(cell[to].astype(np.int32)), pa.array(reach[at])]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "v", "dim", "cell", "reach"])

    bounded = asked.select("id", "key", "dim", "cell", "v").join(reach, ["id", "key"], "left").select("id", "key", "dim", "cell", "v", "reach")
    visits = tables.put(bounded.mapInArrow(frugal(visit), "id long, key long, v array<double>, dim int, cell int, reach double"))
    found = home.drop("rank")
    if visits.limit(1).count():
        found = found.unionByName(searched(visits))
    times = asked.select(F.col("id").alias("query_id"), "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("time")).drop("time")
    done = tables.put(best(found).join(times, ["query_id", "key"]).select("query_id", "rank", "vec_id", "score"))
    tables.drop_others(done)
    return done
