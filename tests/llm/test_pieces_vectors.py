import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import checkpoints, neighbours, pieces
from weft.llm import sentencepiece_scan as scan


@pytest.fixture(scope="module")
def table():
    return pieces.load()


@pytest.fixture(scope="module")
def model(table):
    return scan.Model(table)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


LETTERS = st.text(st.one_of(st.sampled_from("aeinstr thing  \n\t=-é漢😀"), st.characters(exclude_categories=["Cs"])), max_size=60).filter(lambda s: pieces.MARK not in s and "\0" not in s)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_ids_are_the_library_s(model, library, text):
    ids, counts = scan.Encoder(model)([scan.split_words(text) if text else []])
    assert ids.tolist() == library.encode(text) and counts.tolist() == [len(ids)]
    assert scan.Decoder(model.table)(ids, counts) == [text]


def parts_of(whole, size, width):
    for a, b in scan.chunks(len(whole), size, width):
        lo = max(0, a - width)
        yield whole[lo : b + width], a - lo, b - lo, a == 0, b == len(whole)


@settings(max_examples=60, deadline=None)
@given(LETTERS, st.sampled_from([33, 40, 64]), st.booleans())
def test_chunks_and_matrices_give_the_same(model, library, text, size, spaces):
    whole = " " + (text * 6 if spaces else (text * 6).replace(" ", "").replace("\n", ""))
    parts = list(parts_of(whole, size, 16))
    made = [scan.transfer(model, *p) for p in parts]
    # places of every path only save work: the matrices are those of the plain run
    assert all((m == scan._run(model, *p)).all() for m, p in zip(made, parts))
    states = scan.boundary_states(made)
    got = [i for p, x, y in zip(parts, states, states[1:]) for i in scan.trace(model, *p, x, y)]
    assert got == (library.encode(whole[1:]) if len(whole) > 1 else scan.trace(model, " ", 0, 1, True, True))


def test_chunks_are_nominal():
    for n in (1, 15, 16, 100, 115, 116, 117, 1000):
        cut = scan.chunks(n, 100, 16)
        assert cut[0][0] == 0 and cut[-1][1] == n and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        assert all(b - a == 100 for a, b in cut[:-1]) and (len(cut) == 1 or 16 <= cut[-1][1] - cut[-1][0] < 116)


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.5, -np.inf, rng.random(s)) for s in ((3, 4), (4, 2), (2, 5)))
    assert np.allclose(scan.product(scan.product(a, b), c), scan.product(a, scan.product(b, c)))


def test_giant_texts_over_the_cluster(spark, table, library):
    rng = random.Random(1)
    run = "".join(rng.choices("abcdethinges", k=3000))
    texts = [None, "", " ", "plain text", "line\nends\n\n and  spaces " * 90, "words and more " * 400, run, run + " " + run, "x" * 2500, "words and more " * 400]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = scan.decode(scan.encode(docs, table, giant=1000, chunk=256), table)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded == r.text
        assert r.ids == (None if r.text is None else library.encode(r.text)), r.doc_id
    assert scan.encode(docs.limit(0), table).count() == 0


def test_matrices_of_a_giant_are_combined_in_levels(spark, table, library, monkeypatch):
    """A giant of the given tables, in chunks of many tasks: matrices for all of them, levels of a few, the library's ids."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.char_length("text") > scan.GIANT).select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts
    monkeypatch.setattr(scan, "FAN", 3)
    seen, whole_scan = [], scan.scan

    def watched(matrices, most, tables):
        states = whole_scan(matrices, most, tables)
        seen.append((matrices.withColumn("file", F.input_file_name()).toPandas(), most, states.toPandas()))
        return states

    monkeypatch.setattr(scan, "scan", watched)
    more = docs.select(*["doc_id", "text"], *[F.lit("x").alias(c) for c in ("key", "row", "k", "_key", "decoded")])
    got = scan.encode(more, table, chunk=2048, check_col="same").collect()
    found, most, states = seen[0]
    lengths = {len(t) + 1 for t in texts.values()}
    assert len(found) >= sum(n // 2048 for n in lengths) > 30 and most == -(-max(lengths) // 2048)
    assert (found["matrix"].map(len) > 4).mean() > 0.9  # nearly all boundaries have several states
    assert len(states) == len(found) and found["file"].nunique() > 1  # a file a task
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id]) and r.same and r.row == r.key == "x"


def test_boundary_states_of_a_part_are_those_of_the_whole(model, library):
    rng = random.Random(3)
    text = " " + "".join(rng.choices("abcdethinges", k=700))
    made = [scan.transfer(model, *p) for p in parts_of(text, 50, 16)]
    states = scan.boundary_states(made)
    left, right = made[:6], made[6:]
    from functools import reduce

    middle = scan.boundary_states([reduce(scan.product, left), reduce(scan.product, right)])
    assert scan.boundary_states(left, 0, middle[1]) + scan.boundary_states(right, middle[1], 0)[1:] == states


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((4000, 96))
    centre = v.mean(axis=0)
    codes, length, own = neighbours.encode(v, centre)
    assert codes.shape == (4000, 2) and codes.dtype == np.uint64
    outside = 0
    for q in v[:20]:
        square, error = neighbours.estimates(codes, length, own, (q - centre) @ neighbours.rotation(96))
        outside += (np.abs(square - ((v - q) ** 2).sum(axis=1)) > error).sum()
    assert outside / 80_000 < 0.02


def brute(rows, queries, k):
    """(query id, rank, id, distance) rows by comparing everything; vectors of one length only."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q, x in usable:
        if q in queries:
            near = sorted((float(np.sqrt(np.cumsum((v - x) ** 2)[-1])), i) for i, v in usable if i != q and len(v) == len(x))[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 24)) * 3
    v = [(centres[i % 6] + rng.standard_normal(24) * 0.4).round(3).tolist() for i in range(900)]
    v[500:520] = [v[500]] * 20  # equal vectors: ties go to the smaller id
    rows = list(enumerate(v)) + [(i, x[:7]) for i, x in enumerate(v[:60], 3000)]  # another length
    rows += [(0, v[0]), (0, v[0]), (100, v[1]), (4, v[4]), (4, v[5])]  # repeated rows, and ids with two vectors
    odd = [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [None] * 24), (2500, [float("inf")] * 24), (2600, []), (None, v[3])]
    table = spark.createDataFrame([(i, x, "r", "c", 1) for i, x in rows + odd], "vec_id long, embedding array<double>, rank string, cell string, key int").repartition(5)
    for block, query_block, cell_rows in ((400, 4, 100), (50, 2, 30), (8192, 2048, 10**6)):
        got = neighbours.nearest(table, F.col("vec_id") % 100 == 0, block=block, query_block=query_block, cell_rows=cell_rows).collect()
        want = brute(rows, set(range(0, 4000, 100)), 10)
        assert len(got) == len(want)
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)
        assert sum(a[:3] == b[:3] for a, b in zip(found, want)) / len(want) > 0.99
        assert np.allclose([r[3] for r in found], [r[3] for r in want], rtol=1e-9)


def test_cells_that_cannot_hold_a_neighbour_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 8)) + np.repeat(np.eye(8)[:5] * 40, 400, axis=0)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    written, put = {}, checkpoints.Tables.put

    def watched(self, df):
        read = put(self, df)
        written[tuple(df.columns)] = read.count()
        return read

    monkeypatch.setattr(checkpoints.Tables, "put", watched)
    got = neighbours.nearest(table, F.col("vec_id") % 100 == 0, cell_rows=200).toPandas()
    assert len(got) == 200
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert set(part["vec_id"]) == set(np.argsort(d)[:10])
    # 20 queries and 10 cells: beyond its own cell a query goes to those of its own group at most
    assert written["id", "asks", "v", "dim", "cell", "far", "code", "own"] == 2000
    assert written["id", "key", "v", "dim", "cell", "reach"] <= 20 * 4


def test_few_rows_and_empty_tables(spark):
    table = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(table, F.lit(False)).count() == 0
    assert neighbours.nearest(table, F.lit(None).cast("boolean")).count() == 0
