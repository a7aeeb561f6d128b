"""MinHash near-duplicate detection with min-max hashing.

A document is the set of its distinct shingles of ``width`` words (A-Z lowered,
words are runs of anything but ASCII white space; a shorter text is one shingle
of all its words). Each of ``PERMUTATIONS`` hash functions is evaluated once per
shingle and keeps both its minimum and its maximum, so 64 evaluations give 128
signature values. Values agree with probability equal to the Jaccard similarity;
25 bands of 5 values miss a pair at similarity 0.85 with probability 4e-7.

The jobs, in order; each writes a table to the shared folder, which goes when no
later job needs it:

1. a pass over the texts: a fingerprint of the set (its node, 64 bits) and the
   band keys; rows with equal sets are one class;
2. band keys are counted (partial aggregates first, so hot bands are summed
   before the shuffle), those of one class go; in each band one member, drawn by
   hash, is the hub and gives one candidate pair a member, which connects most of
   a large group of copies without expanding it into its pairs; a second round
   draws new hubs where a band still holds several components;
3. then the rest, whole: members that are still outside their band's largest
   component meet all members with another label, and a pair is made only if a
   bound on the similarity allows a link: bit ``h mod 1024`` of a set's parity map
   is flipped by each shingle, so the bits in which two maps differ are at most as
   many as the shingles in which the sets differ. Maps are made for these members
   only. Pairs within a component are never made. The members of a hot band are
   dealt into parts;
4. candidate pairs are confirmed on the full shingle sets, in integers;
5. connected components over confirmed pairs: nodes move to their smallest
   neighbours and edges follow, until none is left.

Joins that pick texts or sets by id broadcast the ids behind a check of their
size; the others shuffle both sides, so that Spark can split hot keys.

Null and empty texts, and texts of white space only, have no shingles and link
with nothing. Repeated rows are linked through their common fingerprint; rows
with one id and different texts are rows each on their own, with that id. A null
id cannot name a component: such rows form none and are kept. An empty table
gives an empty result. Only the id and the text are read, so other columns'
names cannot clash. Long texts are bounded by Arrow batches of one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import checkpoints
from weft.llm.batches import bound, frugal, slices

PERMUTATIONS, BANDS, ROWS, ROUNDS = 64, 25, 5, 2

#: The lowest similarity that the bands cover: they miss a pair at 80 % with probability 5e-5, at 50 % with 0.45.
LEAST_PERCENT = 80

#: 64-bit words of a parity map.
WORDS = 16

_M64 = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(data: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and how many each text has.

    ``data``: the texts' UTF-8 bytes, joined; ``ends``: where each ends.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    before = np.concatenate([[False], inside[:-1]])
    firsts = starts[starts < len(data)]
    before[firsts] = False
    word_at = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    lasts = ends[(ends > 0) & (ends > starts)] - 1
    after[lasts] = False
    word_to = np.flatnonzero(inside & ~after) + 1
    # a word's hash: sum of byte * P^(place in the word); prefix sums give all words at once
    n = len(low)
    total = np.concatenate([[np.uint64(0)], np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), dtype=np.uint64)])
    back = _powers(_P_INV, n + 1)
    words = mix((total[word_to] - total[word_at]) * back[word_at] + (word_to - word_at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(ends, word_at, side="right")
    n_words = np.bincount(doc, minlength=len(ends)).astype(np.int64)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    owner = np.repeat(np.arange(len(ends)), n_shingles)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    at = first[owner] + place
    taken = np.minimum(width, n_words)[owner]
    h = taken.astype(np.uint64)
    for k in range(width):
        more = k < taken
        step = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else words
        h = np.where(more, mix(h * _P + step), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.bincount(owner, minlength=len(ends)).astype(np.int64)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)
    return mix(k * _P) | np.uint64(1), mix(k * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row for each text with shingles: the minimum and the maximum under each permutation, as uint32."""
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, 2 * PERMUTATIONS), np.uint32)
    at = np.cumsum(counts) - counts
    out = np.empty((len(counts), 2 * PERMUTATIONS), np.uint32)
    a, b = _seeds()
    for k in range(PERMUTATIONS):
        values = ((hashes * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(values, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(values, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) int64: the band's number is part of the key."""
    out = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(ROWS):
            h = mix(h * _P + signature[:, b * ROWS + r].astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


def parity_maps(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, WORDS) int64: for each text the parity of its shingles in each of 64 * WORDS buckets."""
    bits = 64 * WORDS
    bucket = (mix(hashes ^ _P) % np.uint64(bits)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((len(counts), WORDS), np.int64)
    for i in range(0, len(counts), 1024):
        some = counts[i : i + 1024]
        at = np.repeat(np.arange(len(some)) * bits, some) + bucket[ends[i] : ends[i + len(some)]]
        odd = np.bincount(at, minlength=len(some) * bits) % 2 == 1
        out[i : i + 1024] = np.packbits(odd.reshape(len(some), bits), axis=1).view(np.int64)
    return out


def _sketch(width: int, with_bands: bool):
    """Arrow batches of (id, text) -> id, n_shingles, node, then band keys or the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 1):
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
                h, counts = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), ends, width)
                some = counts > 0
                at = np.cumsum(counts[some]) - counts[some]
                node = np.zeros(len(raw), np.uint64)
                if some.any():
                    node[some] = mix(np.add.reduceat(mix(h + _P), at) + counts[some].astype(np.uint64))
                cols = [part.column(0), pa.array(counts), pa.array(node.view(np.int64))]
                if with_bands:
                    keys = band_keys(signatures(h, counts))
                    offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))))
                else:
                    offsets = np.concatenate([[0], np.cumsum(counts * 8)]).astype(np.int64)
                    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(h.tobytes())])
                    cols.append(held.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_shingles", "node", "bands" if with_bands else "shingles"])

    return run


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """id, n_shingles, node (fingerprint of the set) and bands (array of BANDS keys; empty for empty sets)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(_sketch(width, True)), f"id {rows.dtypes[0][1]}, n_shingles long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """id, n_shingles, node and shingles: the sorted distinct 64-bit hashes, as bytes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(_sketch(width, False)), f"id {rows.dtypes[0][1]}, n_shingles long, node long, shingles binary")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            fits = []
            for i in range(len(batch)):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                both = len(a) + len(b) - len(np.union1d(a, b))
                fits.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    return run


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) -> node, parity map."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        maps = parity_maps(np.frombuffer(b"".join(raw), np.uint64), np.array([len(r) // 8 for r in raw], np.int64))
        every = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * np.int32(WORDS))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(every, pa.array(maps.reshape(-1)))], ["node", "map"])


#: Ids, pairs and labels up to so many bytes are broadcast to texts and sets; beyond, both sides are shuffled.
BROADCAST_BYTES = 4 << 20


def few(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``df``, marked for broadcasting if its rows of some ``row_bytes`` are few: for joins whose other side is wide."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def components(edges: DataFrame, tables: checkpoints.Tables) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b; longs) but the one of its component that is the label.

    In each round a node moves to its smallest neighbour, then to where that one
    moved; edges follow their ends, and those within a node go. The image of a
    connected graph is connected, so a component ends as one node.
    """
    moved: DataFrame | None = None
    edges = tables.put(edges.select("a", "b").filter("a <> b").distinct())
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        least = tables.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("b")).select(F.col("a").alias("node"), F.col("b").alias("up")))
        step = least.join(least.withColumnsRenamed({"node": "at", "up": "far"}), F.col("up") == F.col("at"))
        step = tables.put(step.select("node", F.col("far").alias("up")))
        tables.drop(least)
        up = step
        met = edges.join(up.withColumnsRenamed({"node": "a", "up": "x"}), "a").join(up.withColumnsRenamed({"node": "b", "up": "y"}), "b")
        left = tables.put(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())
        tables.drop(edges)
        edges, before = left, moved
        if before is None:
            moved = step.select("node", F.col("up").alias("label"))
        else:
            follow = before.join(up.withColumnsRenamed({"node": "at"}), F.col("label") == F.col("at"), "left").select(before["node"], F.coalesce("up", "label").alias("label"))
            moved = tables.put(follow)  # every node took part in the first round
            tables.drop(before, step)
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    tables.drop(edges)
    return moved.filter("node <> label")


def merged(labels: DataFrame | None, links: DataFrame, tables: checkpoints.Tables) -> DataFrame:
    """``labels`` (node, label; without the labels' own nodes) after the further edges ``links`` (a, b)."""
    if labels is None:
        return tables.put(components(links, tables))
    ends = links.join(labels.withColumnsRenamed({"node": "a", "label": "x"}), "a", "left").join(labels.withColumnsRenamed({"node": "b", "label": "y"}), "b", "left")
    joined = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")), tables)
    up = joined.withColumnsRenamed({"node": "at", "label": "up"})
    follow = labels.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label"))
    return tables.put(follow.union(joined))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, tables: checkpoints.Tables) -> DataFrame:
    """Of ``pairs`` (a, b) those that are links, by their full sets; few of the bs differ."""
    hubs = sets.join(few(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi")
    hubs = tables.put(hubs.select(F.col("node").alias("b"), F.col("shingles").alias("sb")))
    members = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    # a hub may have very many pairs: both sides are dealt out for this join alone, so Spark can split them
    met = members.join(few(pairs), "a").join(hubs.hint("merge"), "b")
    links = tables.put(met.select("a", "b", "sa", "sb").mapInArrow(frugal(_confirm(percent)), "a long, b long"))
    tables.drop(hubs)
    return links


def _members(banded: DataFrame, labels: DataFrame | None) -> DataFrame:
    """band, node, n and the node's label."""
    if labels is None:
        return banded.withColumn("label", F.col("node"))
    return banded.join(few(labels).withColumnsRenamed({"label": "found"}), "node", "left").select("band", "node", "n", F.coalesce("found", "node").alias("label"))


def _to_hubs(banded: DataFrame, labels: DataFrame | None, draw: Column, percent: int, tables: checkpoints.Tables) -> DataFrame:
    """Pairs (a, b) of each band's members with its hub, the least by ``draw``, where labels differ and sizes allow a link."""
    members = _members(banded, labels)
    drawn = F.struct(draw.alias("h"), F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"))
    bands = members.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(drawn).alias("d"))
    hubs = tables.put(bands.filter("lo < hi").select("band", "d.*"))
    alike = (F.col("label") != F.col("hub_label")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    met = members.join(hubs.drop("h").hint("merge"), "band").filter(alike)
    pairs = tables.put(met.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    tables.drop(hubs)
    return pairs


#: Members of a band that one task compares with the band's outsiders.
BAND_PART = 4_096


def _across(banded: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, tables: checkpoints.Tables) -> DataFrame | None:
    """All pairs (a, b) of a band's members with different labels of which b is outside the band's largest component.

    What a band's largest component holds is connected already, so these are all
    the pairs that can still connect anything. A band's members are dealt into
    parts of some BAND_PART, and its outsiders go to each of these.
    """
    members = _members(banded, labels)
    sizes = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    bands = sizes.groupBy("band").agg(F.max(F.struct("k", "label"))["label"].alias("most"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("labels"))
    mixed = tables.put(bands.filter("labels > 1").select("band", "most", F.ceil(F.col("size") / BAND_PART).cast("int").alias("parts")))
    met = members.join(mixed.hint("merge"), "band").select("band", "node", "n", "label", "parts", (F.col("label") != F.col("most")).alias("outside"))
    met = tables.put(met)
    if not met.filter("outside").limit(1).count():
        return None
    maps = tables.put(sets.join(few(met.select("node").distinct()), "node", "left_semi").select("node", "shingles").mapInArrow(frugal(_maps), "node long, map array<long>"))
    mapped = met.join(maps.hint("merge"), "node")
    x = mapped.filter("outside").select("band", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "label", "map", "parts")])
    y = mapped.select("band", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "label", "map", "outside")], F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    # of sizes summing to S, sets that differ in D shingles are linked if 100 * (S - D) >= percent * (S + D)
    apart = sum(F.bit_count(F.get("x_map", F.lit(i)).bitwiseXOR(F.get("y_map", F.lit(i)))) for i in range(WORDS))
    alike = (
        (F.col("x_label") != F.col("y_label"))
        & (~F.col("y_outside") | (F.col("x_node") < F.col("y_node")))
        & (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))
        & ((100 + percent) * apart <= (100 - percent) * (F.col("x_n") + F.col("y_n")))
    )
    x = x.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1)))
    found = y.join(x.hint("merge"), (x["band"] == y["band"]) & (F.col("at") == F.col("part")) & alike)
    # a pair is found in every band that it shares
    pairs = tables.put(found.select(F.col("y_node").alias("a"), F.col("x_node").alias("b")).distinct())
    tables.drop(mixed, met, maps)
    return pairs


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, rounds: int = ROUNDS
) -> DataFrame:
    """id_col, n_shingles, component_id and kept for each row of ``docs``.

    Linked: 100 * intersection >= percent * union of the shingle sets; ``percent`` is LEAST_PERCENT at least.
    All work is done when this returns; the result is a table in the shared folder.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the bands cover similarities of {LEAST_PERCENT} to 100 percent")
    spark = docs.sparkSession
    tables = checkpoints.Tables(spark)
    bound(spark)
    sketched = tables.put(sketch(docs, id_col, text_col, width))
    named = sketched.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    copies = named.groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = tables.put(copies)
    spread = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = tables.put(spread.groupBy("band").agg(F.count(F.lit(1)).alias("in_band")).filter("in_band > 1").select("band"))
    banded = tables.put(spread.join(shared.hint("merge"), "band", "left_semi").select("band", "node", "n"))
    tables.drop(shared)
    labels: DataFrame | None = None
    if banded.limit(1).count():
        sets = _sets_of(docs, classes, banded, id_col, text_col, width, tables)
        # the first hubs are the same in all the bands that a group shares, so it gives few pairs; later ones differ by band
        for k in range(rounds):
            pairs = _to_hubs(banded, labels, F.xxhash64(F.lit(k), "node") if not k else F.xxhash64(F.lit(k), "node", "band"), percent, tables)
            if not pairs.limit(1).count():
                break
            links = _confirmed(pairs, sets, percent, tables)
            after = merged(labels, links, tables)
            tables.drop(pairs, links, labels)
            labels = after
        rest = _across(banded, sets, labels, percent, tables)
        if rest is not None:
            labels = merged(labels, _confirmed(rest, sets, percent, tables), tables)
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    linked = tables.put(labels.union(labels.select(F.col("label").alias("node"), "label").distinct()))
    found = classes.select("node", "rep", "copies").join(linked, "node", "left")
    groups = tables.put(found.filter("label is not null").groupBy("label").agg(F.min("rep").alias("least")))
    found = found.join(groups, "label", "left")
    # where a set has one row and no link, the row is its own component
    named = tables.put(found.filter("copies > 1 or least is not null").select("node", F.coalesce("least", "rep").alias("found")))
    rows = sketched.select("id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("found", "id")).otherwise(F.col("id")))
    out = rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    done = tables.put(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))))
    tables.drop_others(done)
    return done


def _sets_of(docs: DataFrame, classes: DataFrame, banded: DataFrame, id_col: str, text_col: str, width: int, tables: checkpoints.Tables) -> DataFrame:
    """node and shingles of the sets that share a band with another, once each, from the texts of their smallest ids."""
    reps = tables.put(classes.join(banded.select("node").distinct(), "node", "left_semi").select("rep"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(few(reps), F.col("id") == F.col("rep"), "left_semi")
    sets = tables.put(shingle_sets(rows, "id", "text", width).filter("n_shingles > 0").select("node", "shingles"))
    if sets.count() > reps.count():  # repeated ids
        once = tables.put(sets.dropDuplicates(["node"]))
        tables.drop(sets)
        sets = once
    tables.drop(reps)
    return sets
