"""The pieces of a fixed public vocabulary, found at every place of many words at once.

Words are handled in groups of one length: a matrix of code points, of which
``PieceTable.at`` gives the piece of each (start, length) for all rows. Pieces
never hold a space but at their start, so a text's segmentations are those of
its words, each with the spaces before it; a space stands for the vocabulary's
own space mark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Where the public vocabulary lies; only the driver opens it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of more characters are segmented one by one.
LOCKSTEP = 32

_P = np.uint64(0x9E3779B97F4A7C15)


class PieceTable:
    """``pieces[i]`` and ``scores[i]`` belong to id i; ids below ``specials`` that are no byte pieces are never found."""

    def __init__(self, pieces: list[str], scores: np.ndarray, byte_ids: np.ndarray, unknown: int, usable: np.ndarray):
        self.pieces, self.scores, self.byte_ids, self.unknown = pieces, scores, byte_ids, unknown
        self.ids = {p.replace(MARK, " "): i for i, p in enumerate(pieces) if usable[i]}
        self.longest = max(map(len, self.ids), default=1)
        #: For each length the hashes of all beginnings of pieces, sorted, and the ids of those that are pieces (else -1).
        self.beginnings: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            own = sorted({p[:n] for p in self.ids if len(p) >= n})
            h = self._hash(np.array(own, dtype=f"U{n}").view(np.uint32).reshape(-1, n))
            order = np.argsort(h)
            assert len(np.unique(h)) == len(h)
            self.beginnings.append((h[order], np.array([self.ids.get(p, -1) for p in own], np.int32)[order]))

    @staticmethod
    def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h ^ codes.astype(np.uint64)) * _P
        return h ^ (h >> np.uint64(29))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        h = np.full(len(codes), 1, np.uint64)
        for k in range(codes.shape[1]):
            h = self._step(h, codes[:, k])
        return h

    def at(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, ids) for each place of a (words, n) matrix, starts ascending; only rows with a piece there."""
        n = codes.shape[1]
        for i in range(n):
            rows, h = np.arange(len(codes)), np.full(len(codes), 1, np.uint64)
            for k in range(1, min(self.longest, n - i) + 1):
                h = self._step(h, codes[rows, i + k - 1])
                known, ids = self.beginnings[k - 1]
                place = np.searchsorted(known, h)
                place[place == len(known)] = 0
                ok = known[place] == h
                rows, h, place = rows[ok], h[ok], place[ok]
                if not len(rows):
                    break
                found = ids[place]
                real = found >= 0
                if real.any():
                    yield i, k, rows[real], found[real]


def load(path: str = MODEL) -> PieceTable:
    """The vocabulary of a SentencePiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    byte_ids = np.full(256, model.unk_id(), np.int32)
    usable = np.ones(len(ids), bool)
    for i in ids:
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            usable[i] = False
    scores = np.array([model.get_score(i) for i in ids], np.float64)
    return PieceTable([model.id_to_piece(i) for i in ids], scores, byte_ids, model.unk_id(), usable)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, code points) for each length up to LOCKSTEP; longer words are left to the caller."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        if 0 < n <= LOCKSTEP:
            own = np.flatnonzero(lengths == n)
            yield own, np.array([words[i] for i in own], dtype=f"U{n}").view(np.uint32).reshape(-1, int(n))


def merged(chars: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merging in its plain form: always the pair of the lowest rank, ties to the left; and the last merge."""
    parts, last = list(chars), None
    while len(parts) > 1:
        r, i = min((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if r == 1 << 30:
            break
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Neighbours:
    """Which pieces may stand next to each other in an encoding by merges.

    A sequence of pieces is the encoding of its text exactly if every two
    neighbours are the encoding of theirs. Whether two are is found by undoing
    their merges, the latest first: if the two parts that face each other would
    have merged before the merge undone last, they aren't. Answers are kept in a
    table of fixed size.
    """

    def __init__(self, table: PieceTable, slots: int = 1 << 20):
        order = sorted(table.ids.items(), key=lambda x: (-table.scores[x[1]], x[1]))
        rank = {p: r for r, (p, _) in enumerate(order)}
        n = len(table.pieces)
        self.n = np.int64(n)
        #: A piece's rank, -1 for single characters; the halves that its last merge joined.
        self.made, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        #: Pieces that merging their own characters gives.
        self.whole = np.zeros(n, bool)
        pairs = {}
        for p, i in order:
            parts, last = merged(list(p), rank)
            self.whole[i] = len(parts) == 1
            if last and len(parts) == 1:
                self.made[i], self.left[i], self.right[i] = rank[p], table.ids[last[0]], table.ids[last[1]]
            for k in range(1, len(p)):
                a, b = table.ids.get(p[:k]), table.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = rank[p]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.slots = slots
        self.keys, self.answers = np.full(slots, -1, np.int64), np.zeros(slots, bool)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"keys": None, "answers": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.keys, self.answers = np.full(self.slots, -1, np.int64), np.zeros(self.slots, bool)

    def _work_out(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        a, b = a.copy(), b.copy()
        while len(live):
            key = a[live] * self.n + b[live]
            place = np.searchsorted(self.pair_keys, key)
            place[place == len(self.pair_keys)] = 0
            earlier = (self.pair_keys[place] == key) & (self.pair_ranks[place] < limit[live])
            fits[live[earlier]] = False
            ra, rb = self.made[a[live]], self.made[b[live]]
            go = ~earlier & ((ra >= 0) | (rb >= 0))
            live, ra, rb = live[go], ra[go], rb[go]
            first = ra > rb  # of equal ones the left was merged first, so the right is undone first
            x, y = live[first], live[~first]
            limit[x], limit[y] = ra[first], rb[~first] + 1
            a[x], b[y] = self.right[a[x]], self.left[b[y]]
        return fits

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of ids: whether b may follow a; -1 (an unknown character, or the start) fits everything."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = a * self.n + b
        slot = ((key.astype(np.uint64) * _P) >> np.uint64(40)).astype(np.int64) % self.slots
        known = (self.keys[slot] == key) | (a < 0) | (b < 0)
        out = self.answers[slot] | (a < 0) | (b < 0)
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._work_out(a[new], b[new])
            self.keys[slot[new]], self.answers[slot[new]] = key[new], out[new]
        return out


class WordCache:
    """Rows of results by word; ``compute`` makes those of new words. Emptied when it holds ``most`` words.

    ``places`` maps words to rows of ``self.rows``, which grows by doubling.
    """

    def __init__(self, compute: Callable[[list[str]], list], most: int = 100_000):
        self.compute, self.most = compute, most
        self.places: dict[str, int] = {}
        self.results: list = []

    def __call__(self, words: list[str]) -> np.ndarray:
        """The place of each word's result in ``results``."""
        if len(self.places) > self.most:
            self.places.clear()
            self.results.clear()
        places = self.places
        new = list(set(words) - places.keys())
        if new:
            for w, r in zip(new, self.compute(new)):
                places[w] = len(self.results)
                self.results.append(r)
        return np.fromiter(map(places.__getitem__, words), np.int64, len(words))
