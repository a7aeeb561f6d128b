"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all its segmentations into pieces, which the
forward algorithm gets in one pass; a text's is the product over its words (runs
of letters, in lower case, each behind a space). The language with the largest
sum of logarithms wins, ties go to the first name, and the score is its share
under equal priors.

The probabilities are fitted by expectation-maximisation on all words of a bounded
sample of labelled documents (``max_rows``, drawn by the hash of the id). Words
are counted by language and dealt into ``SHARDS``; in each round every shard runs
forward-backward over its words' lattices in its own task, words of any length
included, and the pieces' expected counts are summed by Spark. So what reaches the
driver is a number for each piece and language.

Null texts and texts without a letter are ``und`` with score 0. Rows without a
language or with a null text are not learned from; without any language everything
is ``und``. Ties go to the first name. Repeated rows count as often as they are there
and are predicted alike; an empty table gives an empty result. Long texts are read
whole, in Arrow batches of one row each; a long word by itself, rescaled as it goes.
Input columns lang_pred and score are replaced, all others kept: only the text is
read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from weft.llm import checkpoints
from weft.llm.batches import bound, frugal, slices
from weft.llm.pieces import LOCKSTEP, PieceTable, WordCache, by_length

MAX_ROWS, SHARDS, ROUNDS = 4_000, 24, 4
#: Count that every piece has from the start, and the probability of a character without a piece.
SMOOTHING, UNKNOWN = 0.02, 1e-7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def _lattice(table: PieceTable, codes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """All places of the words' lattices, with id -1 for single characters that have no piece."""
    out, n = [], codes.shape[1]
    covered = np.zeros(codes.shape, bool)
    for i, k, rows, ids in table.at(codes):
        out.append((i, k, rows, ids))
        if k == 1:
            covered[rows, i] = True
    for i in range(n):
        rows = np.flatnonzero(~covered[:, i])
        if len(rows):
            out.append((i, 1, rows, np.full(len(rows), -1, np.int32)))
    return sorted(out, key=lambda x: x[0])


def _forward(lattice: list, p: np.ndarray, m: int, n: int) -> np.ndarray:
    """alpha[word, place, language]; p has a last row for id -1."""
    alpha = np.zeros((m, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    for i, k, rows, ids in lattice:
        alpha[rows, i + k] += alpha[rows, i] * p[ids]
    return alpha


def _long_word(table: PieceTable, p: np.ndarray, word: str) -> np.ndarray:
    """The same sum for one word of any length, rescaled as it goes; logarithms by language."""
    n, ids, log = len(word), table.ids, np.zeros(p.shape[1])
    window = np.zeros((table.longest + 1, p.shape[1]))  # alpha of this place and the next ones
    window[0] = 1
    for i in range(n):
        here = window[0].copy()
        window[:-1] = window[1:]
        window[-1] = 0
        for k in range(1, min(table.longest, n - i) + 1):
            found = ids.get(word[i : i + k])
            if found is not None:
                window[k - 1] += here * p[found]
            elif k == 1:
                window[0] += here * p[-1]
        scale = window.max(axis=0)
        scale[scale <= 0] = 1
        window /= scale
        log += np.log(scale)
    return log + np.log(np.maximum(window[0], 1e-300))


def word_logs(table: PieceTable, p: np.ndarray, words: list[str]) -> list[np.ndarray]:
    """For each word the logarithm of its probability in each language."""
    out: list = [None] * len(words)
    padded = [" " + w for w in words]
    for own, codes in by_length(padded):
        alpha = _forward(_lattice(table, codes), p, *codes.shape)
        logs = np.log(np.maximum(alpha[:, -1], 1e-300))
        for i, row in zip(own.tolist(), logs):
            out[i] = row
    for i, w in enumerate(padded):
        if len(w) > LOCKSTEP:
            out[i] = _long_word(table, p, w)
    return out


def _expected_long(table: PieceTable, p: np.ndarray, word: str, out: np.ndarray, weight: np.ndarray) -> None:
    """Adds to ``out`` what one word of any length is expected to use of each piece, times ``weight``; sums are rescaled at every place."""
    n, ids, k = len(word), table.ids, p.shape[1]
    edges: list[list[tuple[int, int]]] = []  # by start: end, piece
    for i in range(n):
        ends = [(i + m, ids[word[i : i + m]]) for m in range(1, min(table.longest, n - i) + 1) if word[i : i + m] in ids]
        edges.append(ends if ends and ends[0][0] == i + 1 else [(i + 1, -1), *ends])
    width = table.longest + 1
    alpha, beta = np.zeros((n + width, k)), np.zeros((n + width, k))
    left, right = np.zeros((n + 1, k)), np.zeros((n + 1, k))  # logarithms of what alpha and beta were divided by
    alpha[0] = beta[n] = 1
    for i in range(n):
        for j, x in edges[i]:
            alpha[j] += alpha[i] * p[x]
        scale = alpha[i + 1 : i + width].max(axis=0)
        alpha[i + 1 : i + width] /= scale
        left[i + 1] = left[i] + np.log(scale)
    for i in range(n - 1, -1, -1):
        for j, x in edges[i]:
            beta[i] += p[x] * beta[j] * np.exp(right[j] - right[i + 1])
        right[i] = right[i + 1] + np.log(beta[i])
        beta[i] = 1
    for i in range(n):
        for j, x in edges[i]:
            out[x] += weight * alpha[i] * p[x] * beta[j] * np.exp(left[i] + right[j] - left[n]) / alpha[n]


def expected(table: PieceTable, p: np.ndarray, words: list[str], tally: np.ndarray) -> np.ndarray:
    """How often each piece (the last row: characters without one) is used in ``tally`` (words, languages) words, under p."""
    v = len(table.pieces)
    out = np.zeros((v + 1, p.shape[1]))
    padded = [" " + w for w in words]
    for own, codes in by_length(padded):
        m, n = codes.shape
        lattice = _lattice(table, codes)
        alpha = _forward(lattice, p, m, n)
        beta = np.zeros_like(alpha)
        beta[:, n] = 1
        for i, length, rows, ids in reversed(lattice):
            beta[rows, i] += p[ids] * beta[rows, i + length]
        weight = tally[own] / np.maximum(alpha[:, n], 1e-300)
        at = np.concatenate([ids for _, _, _, ids in lattice]) % (v + 1)
        gain = np.concatenate([alpha[rows, i] * p[ids] * beta[rows, i + length] * weight[rows] for i, length, rows, ids in lattice])
        for lang in range(p.shape[1]):
            out[:, lang] += np.bincount(at, gain[:, lang], minlength=v + 1)
    for w, n in zip(padded, tally):
        if len(w) > LOCKSTEP:
            _expected_long(table, p, w, out, n)
    return out


def maximised(sums: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts; rounded, so that they don't depend on the order of summation."""
    p = sums + SMOOTHING
    p = (p / p.sum(axis=0)).astype(np.float32).astype(np.float64)
    p[-1] = UNKNOWN
    return p


def train(docs: DataFrame, table: PieceTable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities from rows of ``docs`` with a language."""
    spark = docs.sparkSession
    bound(spark)
    tables = checkpoints.Tables(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    n = docs.filter(F.col(lang_col).isNotNull()).select(id_col).count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < max_rows * (1 << 20) // n)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                seen: Counter = Counter()
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seen.update((lang, w) for w in words_of(text))
                pairs = list(zip(*seen)) or [(), ()]
                cols = [pa.array(pairs[0], pa.string()), pa.array(pairs[1], pa.string()), pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "n"])

    counted = rows.select("text", "lang").mapInArrow(frugal(tally), "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    # a word has an entry a language at most
    words = tables.put(counted.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n")).repartition(SHARDS, "word"))
    langs = sorted(r.lang for r in words.select(F.explode(F.map_keys("n")).alias("lang")).distinct().collect())
    v, k = len(table.pieces), len(langs)
    p = np.full((v + 1, k), 1.0 / v)
    for _ in range(rounds if langs else 0):
        held = spark.sparkContext.broadcast((table, p))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, p = held.value
            total = np.zeros_like(p)
            for whole in batches:
                for part in slices(whole):
                    tallies = np.array([[dict(n).get(lang, 0) for lang in langs] for n in part.column(1).to_pylist()], np.float64)
                    total += expected(table, p, part.column(0).to_pylist(), tallies)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        used = words.mapInArrow(frugal(step), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros_like(p)
        sums[used["piece"].to_numpy(), used["lang"].to_numpy()] = used["n"].to_numpy()
        p = maximised(sums)
        held.unpersist(blocking=True)
    tables.drop(words)
    return langs, p


def predict(docs: DataFrame, table: PieceTable, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score of each whole text; all columns are kept."""
    langs, p = model
    bound(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    where = kept.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast((table, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, p = held.value
        cache = WordCache(lambda new: word_logs(table, p, new))
        for whole in batches:
            for part in slices(whole, where):
                lists = [words_of(t) for t in part.column(where).to_pylist()]
                n = np.fromiter(map(len, lists), np.int64, len(lists))
                some = n > 0 if langs else n < 0
                names, shares = ["und"] * len(lists), np.zeros(len(lists))
                if some.any():
                    place = cache([w for ws in lists for w in ws])
                    logs = np.array(cache.results)[place]
                    total = np.add.reduceat(logs, (np.cumsum(n) - n)[some])
                    best = total.argmax(axis=1)
                    shares[some] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    for i, b in zip(np.flatnonzero(some), best):
                        names[i] = langs[b]
                yield part.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(shares, pa.float64()))

    return kept.mapInArrow(frugal(run), StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))
