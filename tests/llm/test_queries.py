"""The registered queries over a small folder of odd rows: columns, kinds and plain recomputation."""

import hashlib
import random
import zlib

import pytest
import sentencepiece
from test_dedup import brute as plain_components
from test_pieces_vectors import brute as plain_neighbours
from test_urls import URLS
from test_urls import brute as plain_verdict

from weft.llm import pieces
from weft.llm.queries import HOST_RULES, PAGE_RULES, QUERIES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, more string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    texts = [" ".join(word(letters) for _ in range(30)) for i in range(60) for letters in ("aeioubdg", "aeiouklm")]
    texts += [texts[0], texts[0].upper(), texts[3] + " x", None, "", " \t ", "12 - 34", "²", "é" * 40, "q" * 70_000, "w " * 40_000]
    rows = [(i, t, ("aa", "bb")[i % 2] if i < 120 else None, f"s{i % 3}" if i % 7 else None, 1, "m") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(4).write.parquet(f"{at}/documents.parquet")
    urls = [(i, u, "<p>x") for i, u in enumerate([*URLS, *URLS[:3]])]
    spark.createDataFrame(urls, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    vectors = [(i, [float(rng.randint(-9, 9)) for _ in range(5)]) for i in range(250)] + [(0, [1.0] * 5), (300, None), (400, [0.0] * 5), (500, [1.0, float("nan"), 1.0, 1.0, 1.0])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, dict(enumerate(texts)), vectors


def kinds(df):
    return dict(df.dtypes)


def test_op2(spark, folder):
    at, _, vectors = folder
    got = QUERIES["op2_rotated_codes"](spark, at)
    assert kinds(got) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found = sorted(map(tuple, got.collect()))
    want = plain_neighbours(vectors, set(range(0, 1000, 100)), 10)
    assert len(found) == len(want) and sum(a[:3] == b[:3] for a, b in zip(found, want)) >= 0.95 * len(want)


def test_op6(spark, folder):
    at, texts, _ = folder
    got = QUERIES["op6_minhash"](spark, at)
    assert kinds(got) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == plain_components(list(texts.items()))


def test_op7(spark, folder):
    at, texts, _ = folder
    got = QUERIES["op7_matroska"](spark, at)
    assert list(kinds(got).items()) == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes
    assert len({r.media_sha256 for r in rows if not texts[r.doc_id]}) == 1


def test_op8(spark, folder):
    at, _, _ = folder
    got = QUERIES["op8_url_rules"](spark, at)
    assert kinds(got) == {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}
    every = [*URLS, *URLS[:3]]
    for r in got.collect():
        host, path, _, verdict = plain_verdict(every[r.page_id], HOST_RULES + PAGE_RULES)
        named = plain_verdict(every[r.page_id], HOST_RULES)[2]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, named, verdict)


def test_op9(spark, folder):
    at, texts, _ = folder
    got = QUERIES["op9_language_pieces"](spark, at)
    assert kinds(got) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id < 120:
            assert r.lang_pred == ("aa", "bb")[r.doc_id % 2]
        else:
            assert r.lang_pred in ("aa", "bb")


def test_op10(spark, folder):
    at, texts, _ = folder
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = QUERIES["op10_sentencepiece_scan"](spark, at)
    assert kinds(got) == {"doc_id": "bigint", "n_chars": "bigint", "n_pieces": "bigint", "ids": "array<int>", "round_trip": "boolean"}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else library.encode(t)) and r.n_pieces == len(r.ids or []) and r.n_chars == len(t or "") and r.round_trip
