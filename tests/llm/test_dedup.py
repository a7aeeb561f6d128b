import random
import re

import numpy as np

from weft.llm import dedup


def brute_sets(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not ws:
        return set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute(rows):
    sets = [(i, brute_sets(t)) for i, t in rows]
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                group[q] = p
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzuvw") + str(rng.randint(0, 40))
    out = [None, "", " \t\n", "one", "One  TWO", "one two", "É é É é é", "é é É é é", "a" * 5000]
    shared = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            out.append("\n".join(near))
        out.append(" ".join(base[:10] + shared))
    return list(enumerate(out))


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = texts(seed)
        docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect()}
        assert got == brute(rows)


def test_shingles_are_exact():
    raw = [b"", b"a b c d e f", b" x ", b"A B\x0bc\x0cd\te f a b c d e f", "é\u00a0ü y".encode()]
    h, counts = dedup.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    assert counts.tolist() == [len(brute_sets(r.decode())) for r in raw]
    at = np.split(h, np.cumsum(counts)[:-1])
    assert set(at[1].tolist()) <= set(at[3].tolist())  # the same words, whatever stands between them


def test_one_large_group_of_chained_copies(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(300):  # each is near to its neighbours only
        rows.append((1000 - i, " ".join(f"z{k}" if k < i else w for k, w in enumerate(base))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows).items()}


def test_odd_tables(spark):
    same = "a b c d e f g"
    rows = [(1, same), (1, same), (2, same.upper()), (None, same), (None, None), (5, "")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (0, 3, 0, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (5, 0, 5, True),
    ]
    assert dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_min_and_max_agree_as_often_as_the_sets_do():
    rng = np.random.default_rng(1)
    pool = dedup.mix(rng.integers(0, 1 << 62, 1200).astype(np.uint64))
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    s = dedup.signatures(np.concatenate([a, b]), np.array([1000, 1000]))
    assert s.shape == (2, 2 * dedup.PERMUTATIONS)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_parity_maps_bound_the_difference():
    raw = [t.encode() for _, t in texts(3) if t] + [b""]
    h, counts = dedup.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    maps = np.unpackbits(dedup.parity_maps(h, counts).view(np.uint8), axis=1)
    sets = [set(part.tolist()) for part in np.split(h, np.cumsum(counts)[:-1])]
    for a, x in zip(maps, sets):
        for b, y in zip(maps, sets):
            assert (a != b).sum() <= len(x ^ y)
    assert dedup.parity_maps(h[:0], counts[:0]).shape == (0, dedup.WORDS)


def test_a_group_in_many_components(spark):
    """Copies with many changes share bands, and only some of them are links."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    rows = []
    for i in range(120):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = f"x{rng.randint(0, 9000)}"
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (1, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(docs, rounds=rounds).collect()}
        assert got == brute(rows)
