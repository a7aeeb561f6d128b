"""SentencePiece encoding and decoding by max-plus products over a fixed public vocabulary.

The vocabulary is of the merging kind (BPE), so an encoding is not the path of
the largest sum of scores; but it is the only path through a text's lattice of
pieces on which every two neighbours are their own encoding. With weight 0 for
neighbours that fit and minus infinity for others, that path is the (max, +)
optimum, and its pieces are those of the vocabulary's own library.

Spaces stand for the vocabulary's mark, one space is put in front of a text that
isn't empty, characters without a piece become their UTF-8 bytes' pieces;
nothing else is normalised, so decoding gives the text back, character for
character (a mark U+2581 in a text is encoded as bytes and comes back too).

No piece holds a space but at its start and none a line end, so a place before a
space that follows another character, and those around a line end, are places of
every path. Texts up to ``GIANT`` characters are words in this sense and each
distinct word is segmented once. Longer texts are cut every ``CHUNK`` characters,
wherever that falls, and the chunks are dealt out over the cluster:

1. each chunk gives its transfer matrix: the weight of the best path from every
   entry state to every exit state, a state being the piece that ends at or
   crosses the boundary. Between a chunk's first and last place of every path there
   is one state and one path, so the matrix is the product of a column for what is
   before, and a row for what is behind; a chunk without such a place is one run;
2. the matrices are combined associatively, ``FAN`` neighbours at a time, level by
   level up to one matrix a text; then, level by level down, a node's two states
   give those of the boundaries within. This step sees matrices, never text, and no
   group has more than FAN of them;
3. each chunk, on its own, traces its pieces back between its two states.

Null texts have null ids, empty texts none. Equal giant texts are encoded once
and joined back to all their rows, so repeated rows are kept. An empty table gives
an empty result. Input columns with the names of the results are replaced; all
others are kept whatever their names (rows of giant texts travel packed).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from weft.llm import checkpoints
from weft.llm.batches import bound, frugal, slices
from weft.llm.batches import named as column
from weft.llm.pieces import LOCKSTEP, MARK, Neighbours, PieceTable, by_length

GIANT, CHUNK = 65_536, 8_192
#: Neighbouring matrices that one step multiplies, and chunks in a task.
FAN, CHUNKS_A_TASK = 16, 8
#: Text bytes whose words are looked up together (more of them are equal in a larger slice), and whose ids are put together.
SLICE, PART = 2 << 20, 1 << 20

_SPACED = re.compile(r" +[^ ]*")


class Model:
    """The vocabulary with its neighbour rule; broadcast as a whole (its size is the vocabulary's)."""

    def __init__(self, table: PieceTable):
        self.table, self.near = table, Neighbours(table)


def _expand(table: PieceTable, c: str) -> list[int]:
    return table.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist()


#: An edge of the lattice: first place, end, piece id (-1: a character without a piece).
Edge = tuple[int, int, int]


def edges_from(model: Model, text: str, i: int) -> list[Edge]:
    found = []
    for k in range(1, min(model.table.longest, len(text) - i) + 1):
        piece = model.table.ids.get(text[i : i + k])
        if piece is not None and model.near.whole[piece]:
            found.append((i, i + k, piece))
        elif k == 1 and piece is None:
            found.append((i, i + 1, -1))
    return found


def crossing(model: Model, text: str, at: int) -> list[Edge]:
    """The boundary's states: edges that start before ``at`` and end at or after it, in a fixed order."""
    return [e for i in range(max(0, at - model.table.longest), at) for e in edges_from(model, text, i) if e[1] >= at]


def _paths(model: Model, text: str, entries: list[Edge], start: int, end: int) -> tuple[dict[Edge, np.ndarray], dict[Edge, list[Edge]]]:
    """From the entry edges over all edges that start in [start, end): weights by entry (0 or -inf), and what may precede each."""
    weight = {e: np.where(np.arange(len(entries)) == n, 0.0, -np.inf) for n, e in enumerate(entries)}
    ending: dict[int, list[Edge]] = {}
    for e in entries:
        ending.setdefault(e[1], []).append(e)
    before: dict[Edge, list[Edge]] = {}
    for i in range(start, end):
        ahead = ending.pop(i, [])
        if not ahead:
            continue
        for e in edges_from(model, text, i):
            fit = model.near.fit(np.array([a[2] for a in ahead]), np.full(len(ahead), e[2]))
            reached = [a for a, ok in zip(ahead, fit) if ok]
            if reached:
                weight[e] = np.max([weight[a] for a in reached], axis=0)
                before[e] = reached
                ending.setdefault(e[1], []).append(e)
    return weight, before


#: Before a sure place anything fits.
def _sure(at: int) -> list[Edge]:
    return [(at, at, -1)]


def sure_places(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and the last place of every path in [start, end): what crosses ``end`` starts behind them."""

    def sure(p: int) -> bool:
        return 0 < p < len(text) and ("\n" in text[p - 1 : p + 1] or text[p] == " " != text[p - 1])

    first = next((p for p in range(start, end) if sure(p)), None)
    return None if first is None else (first, next(p for p in range(end - 1, first - 1, -1) if sure(p)))


def _run(model: Model, text: str, start: int, end: int, sure_in: bool, sure_out: bool) -> np.ndarray:
    """Weights [entry state, exit state] of text[start:end], path by path."""
    entries = _sure(start) if sure_in else crossing(model, text, start)
    weight, _ = _paths(model, text, entries, start, end)
    none = np.full(len(entries), -np.inf)
    if sure_out:
        return np.max([w for e, w in weight.items() if e[1] == end] or [none], axis=0)[:, None]
    return np.array([weight.get(e, none) for e in crossing(model, text, end)]).T


def transfer(model: Model, text: str, start: int, end: int, sure_in: bool, sure_out: bool) -> np.ndarray:
    """Weights [entry state, exit state] of the chunk text[start:end]; text around it holds what crossing pieces need."""
    found = sure_places(text, start, end)
    if found is None:
        return _run(model, text, start, end, sure_in, sure_out)
    # from the first to the last place of every path there is one path, of weight 0
    return product(_run(model, text, start, found[0], sure_in, True), _run(model, text, found[1], end, True, sure_out))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray], entry: int = 0, exit: int = 0) -> list[int]:
    """The best path's state at each boundary, from the state ``entry`` to the state ``exit``, which are the first and the last."""
    forward = [np.where(np.arange(len(matrices[0])) == entry, 0.0, -np.inf)[None, :]]
    for m in matrices:
        forward.append(product(forward[-1], m))
    states = [exit]
    for k in range(len(matrices) - 1, -1, -1):
        states.append(int((forward[k][0] + matrices[k][:, states[-1]]).argmax()))
    return states[::-1]


def trace(model: Model, text: str, start: int, end: int, sure_in: bool, sure_out: bool, entry: int = 0, exit: int = 0) -> list[int]:
    """Ids of the pieces that start in [start, end) on the path between two states."""
    first = (_sure(start) if sure_in else crossing(model, text, start))[entry]
    weight, before = _paths(model, text, [first], start, end)
    if sure_out:
        live = [e for e in weight if e[1] == end]
    else:
        live = [crossing(model, text, end)[exit]]
    out, at = [], live[0]
    while at != first:
        out.append(at)
        at = before[at][0]
    return [x for i, j, piece in out[::-1] for x in ([piece] if piece >= 0 else _expand(model.table, text[i:j]))]


def encode_words(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (each with its spaces in front) one after the other, and how many each has.

    All words of a length go in lockstep. Every beginning of a word has one
    encoding, so each place holds one last piece, and a piece extends it if the
    two fit.
    """
    table, near = model.table, model.near
    sizes, made = np.zeros(len(words), np.int64), []
    for own, codes in by_length(words):
        m, n = codes.shape
        last, back = np.full((m, n + 1), -1, np.int64), np.ones((m, n + 1), np.int8)
        for i, k, rows, ids in table.at(codes):
            ok = near.whole[ids]
            ok[ok] = near.fit(last[rows[ok], i], ids[ok])
            last[rows[ok], i + k], back[rows[ok], i + k] = ids[ok], k
        back[:, 0] = 0
        every, at, steps = np.arange(m), np.full(m, n), []
        while (at > 0).any():
            steps.append((np.where(at > 0, last[every, at], -2), at))
            at = at - back[every, at]
        ids, places = (np.array([s[x] for s in steps[::-1]]).T for x in (0, 1))
        real, unknown = ids != -2, ids == -1
        char = codes[np.nonzero(unknown)[0], places[unknown] - 1]
        ids[unknown] = np.where(char < 128, table.byte_ids[np.minimum(char, 127)], -1)  # one byte, one piece
        unknown = (ids == -1).any(axis=1)
        sizes[own] = real.sum(axis=1)
        made.append((own[~unknown], ids[~unknown][real[~unknown]]))
        for row in np.flatnonzero(unknown).tolist():
            word, ends = words[own[row]], places[row][real[row]].tolist()
            found = [x for f, p in zip(ids[row][real[row]].tolist(), ends) for x in ([f] if f >= 0 else _expand(table, word[p - 1]))]
            sizes[own[row]] = len(found)
            made.append((own[row : row + 1], np.array(found)))
    for i, w in enumerate(words):
        if len(w) > LOCKSTEP:
            found = trace(model, w, 0, len(w), True, True)
            sizes[i] = len(found)
            made.append((np.array([i]), np.array(found)))
    starts, flat = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), np.int32)
    for own, ids in made:
        n = sizes[own]
        flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
    return flat, sizes


def split_words(text: str) -> list[str]:
    """The text behind one space, cut before every space that follows another character and around line ends.

    Line ends have no piece but their byte's, so nothing merges over them.
    """
    return split_between(" " + text)


def split_between(text: str) -> list[str]:
    """The words of a text between two places of every path."""
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        if line:
            first, *rest = line.split(" ")
            if "" in rest:
                out += _SPACED.findall(line) if not first else [first, *_SPACED.findall(line[len(first) :])]
            else:
                if first:
                    out.append(first)
                out += [" " + w for w in rest]
    return out


class Encoder:
    """Lists of words -> flat ids and their number for each list. Words of late are kept, ``most`` of them."""

    def __init__(self, model: Model, most: int = 100_000):
        if any("\n" in p for p in model.table.ids):
            raise ValueError("a vocabulary with pieces over line ends")
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.starts = self.sizes

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes the words that are new; those of the next calls should be among ``lists``."""
        if len(self.places) > self.most:
            self.clear()
        new = list(set().union(*lists) - self.places.keys())
        if new:
            flat, sizes = encode_words(self.model, new)
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.starts = np.cumsum(self.sizes) - self.sizes

    def put(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words that were learnt, and how many each list has."""
        of = np.fromiter(map(len, lists), np.int64, len(lists))
        place = np.fromiter(map(self.places.__getitem__, chain.from_iterable(lists)), np.int64, of.sum())
        n = self.sizes[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[place] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(of)])])

    def __call__(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        self.learn(lists)
        return self.put(lists)


class Decoder:
    """Flat ids and their numbers -> texts, by gathering the pieces' bytes."""

    def __init__(self, table: PieceTable):
        byte_of = {int(i): bytes([b]) for b, i in enumerate(table.byte_ids)}
        raw = [byte_of.get(i, p.replace(MARK, " ").encode() if p.replace(MARK, " ") in table.ids else b"") for i, p in enumerate(table.pieces)]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        n = self.sizes[ids]
        data = self.data[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a + (b > a) : b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:])]


def _list_array(ids: np.ndarray, counts: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def chunks(length: int, size: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks: ``size`` each, the last one between ``least`` and size + least."""
    ends = [*range(size, max(1, length - least + 1), size), length]
    return list(zip([0, *ends], ends))


def encode(docs: DataFrame, table: PieceTable, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with the ids of each whole text; all columns are kept.

    ``check_col`` names a column that tells whether decoding the ids gave the text back.
    """
    bound(docs.sparkSession)
    kept = docs.drop(ids_col, check_col or ids_col)
    short = kept.filter(F.coalesce(F.char_length(text_col), F.lit(0)) <= giant)
    long = kept.filter(F.char_length(text_col) > giant)
    where = kept.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(Model(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(held.value), Decoder(held.value.table)
        for whole in batches:
            for held_part in slices(whole, where, SLICE):
                lists = [split_words(t) if t else [] for t in held_part.column(where).to_pylist()]
                encoder.learn(lists)
                at = 0
                for part in slices(held_part, where, PART):
                    texts = part.column(where).to_pylist()
                    ids, counts = encoder.put(lists[at : at + len(part)])
                    at += len(part)
                    null = np.array([t is None for t in texts], bool)
                    made = part.append_column(ids_col, _list_array(ids, counts, null))
                    if check_col:
                        same = [a == (b or "") for a, b in zip(decoder(ids, counts), texts)]
                        made = made.append_column(check_col, pa.array(same, pa.bool_()))
                    yield made

    schema = StructType([*kept.schema.fields]).add(ids_col, ArrayType(IntegerType()))
    out = schema.add(check_col, BooleanType()) if check_col else schema
    done = short.mapInArrow(frugal(run), out)
    width = max(16, table.longest)
    chunk = max(chunk, 2 * width)
    length = F.char_length(text_col)
    found = long.agg(F.max(length).alias("longest"), F.sum(F.ceil((length + 1) / chunk)).alias("chunks")).first()
    if not found["longest"]:
        return done
    giants = _encode_giants(long, held, text_col, chunk, width, found["chunks"], found["longest"])
    giants = decode(giants, table, "ids", "decoded") if check_col else giants
    cols = [F.col("row").getField(c).alias(c) for c in kept.columns] + [F.col("ids").alias(ids_col)]
    if check_col:
        cols.append((F.col("decoded") == F.col("row").getField(text_col)).alias(check_col))
    return done.unionByName(giants.select(*cols))


#: Columns of a chunk: its text's key, its number, its text with what crosses its ends, where it starts and ends in that, and whether these are the text's ends.
_PART = {"key": pa.string(), "k": pa.int32(), "part": pa.string(), "start": pa.int32(), "end": pa.int32(), "sure_in": pa.bool_(), "sure_out": pa.bool_()}
_STATES = "key string, k int, entry int, exit int"
_MATRIX = "key string, k int, entries int, matrix binary"


def _read(entries: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32).reshape(entries, -1).astype(np.float64)


def _multiplied(frame: pd.DataFrame) -> pd.DataFrame:
    """One matrix of at most FAN neighbours."""
    frame = frame.sort_values("k")
    whole = reduce(product, map(_read, frame["entries"], frame["matrix"]))
    return pd.DataFrame({"key": frame["key"].iloc[:1], "k": frame["up"].iloc[:1], "entries": [len(whole)], "matrix": [whole.astype(np.float32).tobytes()]})


def _opened(frame: pd.DataFrame) -> pd.DataFrame:
    """The states at the boundaries of at most FAN neighbours, from those of the whole."""
    frame = frame.sort_values("k")
    states = boundary_states(list(map(_read, frame["entries"], frame["matrix"])), int(frame["entry"].iloc[0]), int(frame["exit"].iloc[0]))
    return pd.DataFrame({"key": frame["key"], "k": frame["k"], "entry": states[:-1], "exit": states[1:]})


def scan(matrices: DataFrame, most: int, tables: checkpoints.Tables) -> DataFrame:
    """key, k, entry and exit: the states at both ends of every chunk, from all chunks' matrices, of which a text has ``most`` at most."""
    up = F.floor(F.col("k") / F.lit(FAN)).cast("int").alias("up")
    levels = [matrices]
    while most > 1:
        levels.append(tables.put(levels[-1].select("*", up).groupBy("key", "up").applyInPandas(_multiplied, _MATRIX)))
        most = -(-most // FAN)
    states = levels.pop().select("key", "k", F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    for level in reversed(levels):
        above = states.withColumnRenamed("k", "up")
        states = level.select("*", up).join(above, ["key", "up"]).groupBy("key", "up").applyInPandas(_opened, _STATES)
    return states


def _encode_giants(docs: DataFrame, held, text_col: str, chunk: int, width: int, n_chunks: int, longest: int) -> DataFrame:
    """key, row (all columns of ``docs``) and ids."""
    tables = checkpoints.Tables(docs.sparkSession)
    keyed = docs.select(F.sha2(F.col(text_col), 256).alias("key"), F.struct(*map(column, docs.columns)).alias("row"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                text, rows = " " + text, []
                for k, (a, b) in enumerate(chunks(len(text), chunk, width)):
                    lo = max(0, a - width)
                    rows.append((key, k, text[lo : b + width], a - lo, b - lo, a == 0, b == len(text)))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), _PART.values())], list(_PART))

    schema = "key string, k int, part string, start int, end int, sure_in boolean, sure_out boolean"
    once = keyed.select("key", F.col("row").getField(text_col).alias("text")).dropDuplicates(["key"])
    n_tasks = -(-n_chunks // CHUNKS_A_TASK)
    parts = tables.put(once.mapInArrow(frugal(cut), schema).repartition(n_tasks, "key", "k"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transfer(held.value, *(r[x] for x in [*_PART][2:])) for r in batch.to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(list(map(len, made)), pa.int32()), pa.array([m.astype(np.float32).tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "k", "entries", "matrix"])

    found = tables.put(parts.mapInArrow(frugal(matrices), _MATRIX))
    placed = parts.join(scan(found, -(-(longest + 1) // chunk), tables), ["key", "k"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        encoder = Encoder(model)
        for whole in batches:
            for batch in slices(whole, 2, SLICE):
                rows = batch.to_pylist()
                sure = [sure_places(r["part"], r["start"], r["end"]) for r in rows]
                between, counts = encoder([split_between(r["part"][p[0] : p[1]]) if p else [] for r, p in zip(rows, sure)])
                lists = np.split(between, np.cumsum(counts)[:-1])
                for i, (r, p) in enumerate(zip(rows, sure)):
                    if p is None:
                        lists[i] = np.array(trace(model, *(r[x] for x in [*_PART][2:]), r["entry"], r["exit"]), np.int32)
                        continue
                    before = trace(model, r["part"], r["start"], p[0], r["sure_in"], True, r["entry"])
                    behind = trace(model, r["part"], p[1], r["end"], True, r["sure_out"], 0, r["exit"])
                    lists[i] = np.concatenate([np.array(before, np.int32), lists[i], np.array(behind, np.int32)])
                made = _list_array(np.concatenate(lists), np.array(list(map(len, lists))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["key", "k", "ids"])

    traced = placed.select(*_PART, "entry", "exit").repartition(n_tasks, "key", "k").mapInArrow(frugal(follow), "key string, k int, ids array<int>")
    joined = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("all"))
    done = tables.put(joined.select("key", F.flatten("all.ids").alias("ids")))
    tables.drop_others(done)
    return keyed.join(done, "key")


def decode(encoded: DataFrame, table: PieceTable, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each list of ids; null for null."""
    kept = encoded.drop(text_col)
    where = kept.columns.index(ids_col)
    held = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                part = whole.slice(at, 256)
                lists = part.column(where)
                counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = decoder(lists.flatten().to_numpy(zero_copy_only=False), counts)
                null = lists.is_null().to_pylist()
                yield part.append_column(text_col, pa.array([None if n else t for t, n in zip(texts, null)], pa.string()))

    return kept.mapInArrow(frugal(run), StructType([*kept.schema.fields]).add(text_col, StringType()))
