"""Toxicity: Levenshtein automata over a lexicon trie, with scores from each hit's context.

The lexicon is learned from labelled rows (a bounded sample, a parameter) over a
short list of seeds: words whose distinct contexts (the words before and after)
lie almost all in toxic texts. Counting contexts, not texts, on both sides keeps
the words of an often copied toxic text out, and those of toxic texts in that a
clean text often copied holds; a context that clean texts only quote or report
counts by the factor below. Seeds stay in whatever their rate. A word of a text is walked through the
intersection of the trie with the Levenshtein automata of its terms, made
deterministic on demand, so nearly every word leaves after a few letters.

Each hit gets the term's rate in toxic texts, times a factor for its edit
distance (learned too), times a factor for its context: inside quotation marks
or after a verb of reporting it counts less, next to a pronoun of address or
another hit more. A text's score is one minus the product of what its hits leave.

Null and empty texts, and texts without a hit, score 0; so does an empty table's
every row, as there is none. Ties and repeated rows score alike. Without labels the
seeds alone are the lexicon. Terms and words may have any length, and very long texts
are read whole, in an Arrow batch of one row. Only the text is read; an input column
with the score's name is replaced, all others are kept, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from weft.llm import checkpoints
from weft.llm.batches import SLICE_BYTES, bound, frugal, slices
from weft.llm.quality import MAX_ROWS, sample_labels

# Insults to start from, verbs that report speech, and pronouns that address someone.
SEEDS = ("bastard", "clown", "disgusting", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset("called calls claimed quoted said says wrote word words term insult dit disait écrit sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're u du dich dein deine tu toi ton ta te vous usted eres".split())
QUOTES = frozenset("\"“”«»„‟")

#: Rate of a seed that labels don't speak of.
SEED_RATE = 0.9
#: A learned term has so many distinct contexts in toxic texts at least, and so large a share of its contexts there.
LEAST_CONTEXTS, LEAST_RATE = 8, 0.9
#: With few labels, a tenth of the toxic texts is enough contexts, but never fewer than this.
FEWEST_CONTEXTS = 3
#: Words on either side of a hit that are its context.
WINDOW = 8

_WORD = re.compile(r"[^\W_]+")
_MARKED = re.compile(r"[^\W_]+|[\"“”«»„‟]|\n")


def reach(term: str) -> int:
    """Edits that a term allows: none under five letters, one under nine, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """The terms' trie intersected with their Levenshtein automata.

    A state is a set of (trie node, edits so far); ``step`` makes a successor
    when a word first asks for it. Dead states are None.
    """

    terms: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, int] = field(default_factory=dict)
    allowed: list[int] = field(default_factory=lambda: [0])
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int | None]] = field(default_factory=list)
    hits: list[tuple[int, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        for i, t in enumerate(self.terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], reach(t))
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], reach(t))
            self.ends[node] = i
        self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo, best = list(pairs), {}
        while todo:  # a letter of the term left out
            node, e = todo.pop()
            if best.get(node, 99) <= e or e > self.allowed[node]:
                continue
            best[node] = e
            todo += [(n, e + 1) for n in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ok = [(e, self.ends[n]) for n, e in key if n in self.ends and e <= reach(self.terms[self.ends[n]])]
            self.hits.append(min(ok)[::-1] if ok else None)
        return self.states[key]

    def step(self, state: int, c: str) -> int | None:
        new = set()
        for node, e in self.sets[state]:
            new.add((node, e + 1))  # a letter too many
            for letter, n in self.children[node].items():
                new.add((n, e + (letter != c)))
        new = {(n, e) for n, e in new if e <= self.allowed[n]}
        made = self._state(new) if new else None
        self.moves[state][c] = made
        return made

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its reach, ties to the first term."""
        state, moves = 0, self.moves
        for c in word:
            nxt = moves[state].get(c, -1)
            if nxt == -1:
                nxt = self.step(state, c)
            if nxt is None:
                return None
            state = nxt
        return self.hits[state]


@dataclass(frozen=True)
class Lexicon:
    """Terms with their rates, near misses that clean texts use, and the factor of each edit distance."""

    terms: tuple[str, ...]
    rates: tuple[float, ...]
    spared: frozenset[str]
    factors: tuple[float, ...] = (1.0, 0.6, 0.55)


class Matcher:
    """Word -> hit, with the words of late remembered."""

    def __init__(self, lexicon: Lexicon, most: int = 50_000):
        self.lexicon, self.most = lexicon, most
        self.automaton = Automaton(lexicon.terms)
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """The hits among the words."""
        known, find, spared = self.known, self.automaton.find, self.lexicon.spared
        if len(known) > self.most:
            known.clear()
        if len(self.automaton.sets) > 10_000:  # states are remade on demand
            self.automaton = Automaton(self.lexicon.terms)
            find = self.automaton.find
        found = {}
        for w in set(words):
            hit = known.get(w, 0)
            if hit == 0:
                hit = known[w] = None if w in spared else find(w)
            if hit is not None:
                found[w] = hit
        return found


def distance_factor(quoted: bool, reported: bool) -> float:
    """What a word counts that its writer quotes or reports."""
    return 0.2 if quoted and reported else 0.5 if quoted else 0.8 if reported else 1.0


def context_factor(tokens: list[str], at: int, hits: dict) -> float:
    """What a hit at ``tokens[at]`` counts, given the WINDOW words around it."""
    lo, hi = max(0, at - WINDOW), at + WINDOW + 1
    around = tokens[lo:at] + tokens[at + 1 : hi]
    quoted = sum(t in QUOTES for t in tokens[lo:at]) % 2 == 1 and any(t in QUOTES for t in tokens[at + 1 : hi])
    reported = any(t in REPORTING for t in tokens[lo:at])
    factor = distance_factor(quoted, reported)
    if any(t in ADDRESS for t in around):
        factor *= 1.15
    if any(t in hits for t in around):
        factor *= 1.3
    return min(factor, 1.5)


def text_score(text: str | None, words: list[str], matcher: Matcher) -> float:
    found = matcher.hits(words)
    if not found:
        return 0.0
    tokens, left = _MARKED.findall(text.lower()), 1.0
    lexicon = matcher.lexicon
    for i, t in enumerate(tokens):
        if t in found:
            term, edits = found[t]
            left *= 1 - min(0.99, lexicon.rates[term] * lexicon.factors[edits] * context_factor(tokens, i, found))
    return 1 - left


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> word, context hash."""
    for whole in batches:
        for part in slices(whole, most=SLICE_BYTES // 4):  # a word makes an object of its own here
            seen = set()
            for text in part.column(0).to_pylist():
                ws = _WORD.findall(text.lower()) if text else []
                for before, w, after in zip(["", *ws[:-1]], ws, [*ws[1:], ""]):
                    seen.add((w, crc32(f"{before} {after}".encode("utf-8", "surrogatepass"))))
            pairs = list(zip(*seen)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.string()), pa.array(pairs[1], pa.int64())], ["word", "context"])


def _weights(text: str) -> list[float]:
    """The distance_factor of each word of a text (in lower case), in order."""
    tokens, before, quotes = _MARKED.findall(text), [0], [0]
    for t in tokens:
        before.append(before[-1] + (t in REPORTING))
        quotes.append(quotes[-1] + (t in QUOTES))
    out, n = [], len(tokens)
    for i, t in enumerate(tokens):
        if t not in QUOTES and t != "\n":
            lo, hi = max(0, i - WINDOW), min(n, i + WINDOW + 1)
            quoted = (quotes[i] - quotes[lo]) % 2 == 1 and quotes[hi] > quotes[i + 1]
            out.append(distance_factor(quoted, before[i] > before[lo]))
    return out


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Lexicon:
    """A lexicon from the documents that ``labels`` names, of which it reads about ``max_rows``; what reaches the driver is words of these."""
    bound(docs.sparkSession)
    tables = checkpoints.Tables(docs.sparkSession)
    picked = sample_labels(labels, label_col, id_col, max_rows)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id")
    rows = tables.put(named.select("text", "label"))
    texts = lambda label: rows.filter(F.col("label") == label).select("text")
    toxic = texts(1).mapInArrow(frugal(_contexts), "word string, context long").distinct().groupBy("word").count()
    least = min(LEAST_CONTEXTS, max(FEWEST_CONTEXTS, texts(1).count() // 10))
    bad = {r["word"]: r["count"] for r in toxic.filter(F.col("count") >= least).collect()}

    def clean_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                seen: dict[tuple[str, int], float] = {}
                for text in part.column(0).to_pylist():
                    text = text.lower() if text else ""
                    ws = _WORD.findall(text)
                    told = _weights(text) if any(w in REPORTING for w in ws) or any(q in text for q in QUOTES) else [1.0] * len(ws)
                    for before, w, after, weight in zip(["", *ws[:-1]], ws, [*ws[1:], ""], told):
                        if w in bad:
                            key = (w, crc32(f"{before} {after}".encode("utf-8", "surrogatepass")))
                            seen[key] = max(weight, seen.get(key, 0.0))
                pairs = list(zip(*seen)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.string()), pa.array(pairs[1], pa.int64()), pa.array(list(seen.values()), pa.float64())], ["word", "context", "weight"])

    good: dict[str, float] = {}
    if bad:
        clean = texts(0).mapInArrow(frugal(clean_contexts), "word string, context long, weight double")
        good = dict(clean.groupBy("word", "context").agg(F.max("weight").alias("weight")).groupBy("word").agg(F.sum("weight")).collect())
    rate = {w: n / (n + good.get(w, 0) + 0.2) for w, n in bad.items()}
    known = {w: r for w, r in rate.items() if r >= LEAST_RATE} | {w: rate.get(w, SEED_RATE) for w in SEEDS}
    terms = tuple(sorted(known))
    first = Lexicon(terms, tuple(known[t] for t in terms), frozenset())

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(first)
        for whole in batches:
            for part in slices(whole):
                out = []
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    hits = matcher.hits(_WORD.findall(text.lower())) if text else {}
                    if hits and all(e for _, e in hits.values()):
                        out += [(w, e, label) for w, (_, e) in hits.items()]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["word", "edits", "label"])

    # texts whose only hits are near misses tell what a near miss is worth, and which words to spare
    missed = rows.mapInArrow(frugal(near), "word string, edits int, label int").groupBy("word", "edits").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")
    )
    told = missed.collect()
    tables.drop(rows)
    factors = [1.0]
    for edits in (1, 2):
        n_bad, n_good = (sum(getattr(r, k) for r in told if r.edits == edits) for k in ("bad", "good"))
        factors.append((n_bad + 1.2) / (n_bad + n_good + 2))
    spared = frozenset(r.word for r in told if r.good >= r.bad and r.good > 0)
    return Lexicon(terms, first.rates, spared, tuple(factors))


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; all columns are kept."""
    bound(docs.sparkSession)
    kept = docs.drop(name)
    where = kept.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        for whole in batches:
            for part in slices(whole, where):
                got = [text_score(t, _WORD.findall(t.lower()), matcher) if t else 0.0 for t in part.column(where).to_pylist()]
                yield part.append_column(name, pa.array(got, pa.float64()))

    return kept.mapInArrow(frugal(run), StructType([*kept.schema.fields]).add(name, DoubleType()))
