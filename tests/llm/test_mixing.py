import random
from collections import Counter
from fractions import Fraction
from math import ceil, floor, sqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import mixing, queries


def simulated(blocks, weights):
    """(source, block) slot by slot: of the blocks in their windows the one due first; anew whenever a source has ended."""
    left, given_, order = list(blocks), [0] * len(blocks), []
    while any(left):
        live = [i for i, n in enumerate(left) if n and weights[i]] or [i for i, n in enumerate(left) if n]
        w = {i: weights[i] or Fraction(1) for i in live}
        total, n, t = sum(w.values()), dict.fromkeys(live, 0), 0
        while all(left[i] for i in live):
            due = [(ceil((n[i] + 1) * total / w[i]), i) for i in live if floor(n[i] * total / w[i]) <= t]
            i = min(due)[1]
            order.append((i, given_[i]))
            n[i], given_[i], left[i], t = n[i] + 1, given_[i] + 1, left[i] - 1, t + 1
    return order


def in_slots(blocks, planned):
    found = []
    for i, parts in enumerate(planned):
        for b in range(blocks[i]):
            p = [p for p in parts if p.first <= b][-1]
            m, j = divmod(b - p.first, p.each)
            found.append((p.start + m * p.period + int(p.at[j]), i, b))
    found.sort()
    assert [t for t, _, _ in found] == list(range(sum(blocks)))
    return [(i, b) for _, i, b in found]


WEIGHTS = st.one_of(st.integers(1, 40).map(Fraction), st.sampled_from(["0.5", "0.125", "0.3", "0.07", "0.001"]).map(Fraction), st.floats(0.01, 3).map(mixing.as_fraction))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), WEIGHTS), min_size=1, max_size=7))
def test_plan_is_the_simulation(sources):
    blocks, weights = [n for n, _ in sources], [w for _, w in sources]
    assert in_slots(blocks, mixing.plan(blocks, weights)) == simulated(blocks, weights)


@pytest.mark.parametrize(
    "weights",
    [[0.99, 0.01], [0.9, 0.1], [0.5, 0.3, 0.199, 0.001], [4] + [1] * 19, [sqrt(93_091)] + [sqrt(8_600)] * 19, [1e-9, 0.3, 1.0, 2**0.5]],
    ids=str,
)
def test_every_prefix_is_within_a_block_of_the_real_weights(weights):
    exact = [mixing.as_fraction(w) for w in weights]
    share = [w / sum(exact) for w in exact]
    blocks = [max(1, int(w * 9_000)) + 1 for w in share]
    end, n = None, Counter()
    for t, (i, b) in enumerate(in_slots(blocks, mixing.plan(blocks, exact)), 1):
        n[i] += 1
        assert all(abs(n[j] - w * t) < 1 for j, w in enumerate(share)), t
        if n[i] == blocks[i]:
            end = t
            break
    assert end > 1_000 or min(share) < 1e-6


def test_plan_does_not_grow_with_the_blocks():
    planned = mixing.plan([10**12, 3 * 10**12], [Fraction(1, 100), Fraction(99, 100)])
    assert sum(len(p.at) for parts in planned for p in parts) <= 101
    last = planned[1][0]
    assert last.start + (3 * 10**12 - 1) // last.each * last.period + last.at[(3 * 10**12 - 1) % last.each] < 3.04e12
    # a long period is rounded where many blocks are left
    planned = mixing.plan([10**9, 10**9], [mixing.as_fraction(2**0.5), mixing.as_fraction(3**0.5)])
    assert sum(len(p.at) for parts in planned for p in parts) <= mixing.MOST_SLOTS + 1


def test_mixture_keeps_all_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    monkeypatch.setattr(mixing, "RANGE", 3)
    sizes = {"a": 400, "b": 90, None: 33, "": 1}
    rows = [(i * 10 + k, s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [rows[0], (None, "b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(5)
    weights = {"a": 1.5, "b": 0.5, None: 1}  # the empty name gets the mean, 1
    got = mixing.mix(docs, weights, block=4).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    size = Counter(s for _, s, _ in rows)
    want = simulated([-(-size[s] // 4) for s in order], [mixing.as_fraction(weights.get(s, 1)) for s in order])
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
        assert r.position // 4 == r.slot
    assert [slots[t] for t in range(len(want))] == [{(order[i], b)} for i, b in want]
    assert len({r.position for r in got}) == len(rows)
    ordered = mixing.in_order(mixing.mix(docs, weights, block=4)).collect()
    assert [r.position for r in ordered] == sorted(r.position for r in got)


def test_equal_ids_have_a_place_each_and_names_cannot_clash(spark):
    names = ["_hash", "_start", "_from", "_period", "_k", "hash", "bucket", "tie", "row", "k", "begin", "part", "firsts", "at", "each", "a.b", "position"]
    rows = [(i // 3, "ab"[i % 2], *(f"{i} {n}" for n in names)) for i in range(90)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "source string", *(f"`{n}` string" for n in names)]))
    for parts in (1, 4):
        got = mixing.mix(docs.repartition(parts), block=2).collect()
        assert sorted(tuple(r)[:-3] for r in got) == sorted(r[:-1] for r in rows)
        placed = {r["k"]: r.position for r in got}
        assert len(set(placed.values())) == 90
        assert parts == 1 or placed == before
        before = placed


def test_a_plan_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7}") for i in range(700)], "doc_id long, source string")
    want = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert {r.doc_id: r.position for r in mixing.mix(docs).collect()} == want


def test_weights_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "doc_id long, source string")
    got = mixing.mix(docs, {"a": 3.0, "b": 1.0}, block=5).filter("slot < 40").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 150, "b": 50}
    assert mixing.mix(docs, {"a": 0.0, "b": 1.0}).filter("source = 'a'").agg({"slot": "min"}).first()[0] == 13
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": -1.0, "b": 1.0})


def test_registered_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "x", "x", "y", "z"]), "t", "en", 1) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_mixing_pfair"](spark, str(tmp_path)).collect()
    assert sorted(r.position for r in got) and {r.doc_id for r in got} == set(range(2000))
    size = Counter(s for _, s, *_ in rows)
    largest = max(size.values())
    weights = [Fraction(round(100 * sqrt(size[s] / largest))) for s in "xyz"]
    want = simulated([-(-size[s] // 16) for s in "xyz"], weights)
    slots = {r.slot: (r.source, r.block) for r in got}
    assert [slots[t] for t in range(len(want))] == [("xyz"[i], b) for i, b in want]
