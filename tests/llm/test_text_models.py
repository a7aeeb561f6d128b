import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import language, pieces, quality, queries, toxicity
from weft.llm.queries import quality_scores

ODD = [None, "", "   ", "a", "!!", "word " * 30_000]


def made(n, seed=0):
    """Documents whose bad ones hold runs of marks."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        ws = ["".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(w if good else w + "%%%" for w in ws)))
        labels.append((i, int(good), 0))
    return rows, labels


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))


def test_quality_on_held_out_rows(spark):
    rows, labels = made(600)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_scores(docs, truth).join(truth, "doc_id").toPandas()
    assert len(got) == 600 and got["score"].between(0, 1).all()
    held = np.array([crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]])
    assert held.sum() > 100
    assert auc(got["score"][held].to_numpy(), got["quality"][held].to_numpy()) > 0.98


def test_quality_scores_are_sparse_dot_products():
    rng = np.random.default_rng(2)
    w = rng.standard_normal(1 << quality.BITS).astype(np.float32)
    texts = ["one two two", None, "x" * 10, "", "a a"]
    at, counts = quality.features(texts, quality.Hasher())
    got = quality.scores(w, 0.25, at, counts)
    for k, t in enumerate(texts):
        places, n = quality.features([t], quality.Hasher())
        z = 0.25 + (quality.SCALE * float(w[places].sum()) / n[0] if n[0] else 0)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), rel=1e-5)


def plain_features(text):
    """Weights by position, n-gram by n-gram."""
    ws = re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")
    h = [crc32(w.encode()) * 0x9E3779B1 % 2**32 for w in ws]
    keys = list(h)
    for k in range(len(h) - 1):
        twice = h[k] == h[k + 1] or k + 2 < len(h) and h[k] == h[k + 2]
        keys.append(None if twice else (h[k] * 0x85EBCA6B + h[k + 1]) * 0xC2B2AE35 % 2**32)
    places = Counter((quality._TWICE if x is None else x ^ x >> 15) % 2**quality.BITS for x in keys)
    return {x: quality.SCALE * n / len(keys) for x, n in places.items()}


def test_features_are_plain_n_grams():
    texts = ["one two two", "A a A b", "!! hey?? _x_", "x", " ", "word " * 50, "été ß 漢"]
    rows = quality.sparse_rows(texts, quality.Hasher(most=2), together=3)
    for t, (places, weights) in zip(texts, rows):
        want = plain_features(t)
        assert dict(zip(places.tolist()[:-1], weights.tolist()[:-1])) == pytest.approx(want)
        assert places[-1] == 2**quality.BITS and weights[-1] == 1


def test_ftrl_is_the_plain_one():
    """Weight by weight, over several texts and passes."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["good", "bad", "so", "so", "!"], k=rng.randint(1, 9))) for _ in range(25)]
    y = np.array([float("good" in t) for t in texts])
    w, b = quality.ftrl(quality.sparse_rows(texts, quality.Hasher()), y, epochs=2)
    rows = [plain_features(t) | {"b": 1.0} for t in texts]
    z, n, share = defaultdict(float), defaultdict(float), y.mean()

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * quality.L1) / ((quality.BETA + np.sqrt(n[k])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            now = {k: weight(k) for k in rows[i]}
            p = 1 / (1 + np.exp(-sum(now[k] * x for k, x in rows[i].items())))
            for k, x in rows[i].items():
                g = (p - y[i]) * x * (0.5 / share if y[i] else 0.5 / (1 - share))
                sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / quality.ALPHA
                z[k] += g - sigma * now[k]
                n[k] += g * g
    assert b == pytest.approx(weight("b"), rel=1e-4)
    assert {k: weight(k) for k in z if k != "b" and weight(k)} == pytest.approx({int(k): w[k] for k in np.flatnonzero(w)}, rel=1e-3, abs=1e-6)


def test_registered_quality_query_is_the_plain_model(spark, tmp_path):
    rows, labels = made(240, seed=3)
    rows += [(1000, None), (1001, "")]
    spark.createDataFrame([(i, t, "l", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth.write.parquet(f"{tmp_path}/labels.parquet")
    w, b = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), truth.filter(~quality.held_out(F.col("doc_id"), 4, 2)), "quality")
    got = queries.QUERIES["op3_quality_ftrl"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        z = b + sum(x * float(w[k]) for k, x in plain_features(text[r.doc_id]).items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), rel=1e-4)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)


def test_scores_of_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r.score for r in quality_scores(docs, none).collect()]
    assert len(got) == 8 and set(got) == {0.5}
    lexicon = toxicity.learn(docs, none, "toxic")
    assert lexicon.terms == tuple(sorted(toxicity.SEEDS))
    assert {r.score for r in toxicity.score(docs, lexicon).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    terms = tuple(sorted({"".join(rng.choices("abc", k=rng.randint(2, 11))) for _ in range(40)}))
    found = toxicity.Automaton(terms)
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(1, 12)))
        near = [(distance(word, t), i) for i, t in enumerate(terms)]
        want = min((d, i) for d, i in near if d <= toxicity.reach(terms[i])) if any(d <= toxicity.reach(terms[i]) for d, i in near) else None
        assert found.find(word) == (want[::-1] if want else None)


def test_context_tells_quotation_from_abuse():
    m = toxicity.Matcher(toxicity.Lexicon(("idiot",), (0.9,), frozenset()))
    score = lambda t: toxicity.text_score(t, toxicity._WORD.findall(t.lower()), m)
    assert score("you are an idiot") > 0.8 and score("what an idiott he is") > 0.5
    assert score('he said the word "idiot" is from Greek') < 0.5 < score("an idiot")
    assert score("nothing here") == 0


def test_toxicity_learns_terms_but_not_copied_texts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("bdgklmnprst", k=1)) + "".join(rng.choices("aeiou", k=1)) + "".join(rng.choices("abcdefghij", k=3))
    rows, labels = [], []
    for i in range(400):
        ws, bad = [word() for _ in range(30)], i % 5 == 0
        if bad:
            ws[rng.randrange(30)] = "zornak"
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    for i in range(400, 460):  # one toxic text, copied
        rows.append((i, "zornak qqqqq rrrrr sssss"))
        labels.append((i, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic")
    assert set(lexicon.terms) - set(toxicity.SEEDS) == {"zornak"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels)


def plain_toxicity(rows, labels):
    """Terms with rates, and every text's score, from plain counts and edit distances."""
    text, label = dict(rows), dict(labels)
    sides = {0: defaultdict(dict), 1: defaultdict(dict)}
    for i, y in label.items():
        ws = toxicity._WORD.findall(text[i].lower())
        for k, (before, w, after) in enumerate(zip(["", *ws[:-1]], ws, [*ws[1:], ""])):
            sides[y][w][before, after] = 1
    least = min(8, max(3, sum(label.values()) // 10))
    rates = {w: len(c) / (len(c) + len(sides[0][w]) + 0.2) for w, c in sides[1].items() if len(c) >= least}
    known = {w: r for w, r in rates.items() if r >= 0.9} | {w: rates.get(w, 0.9) for w in toxicity.SEEDS}
    terms = sorted(known)

    def hit(w):
        near = [(distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.reach(t)]
        return min(near) if near else None

    told = defaultdict(lambda: [0, 0])
    for i, y in label.items():
        hits = {w: hit(w) for w in set(toxicity._WORD.findall(text[i].lower()))}
        hits = {w: h for w, h in hits.items() if h}
        if hits and all(h[0] for h in hits.values()):
            for w, h in hits.items():
                told[w, h[0]][y] += 1
    factors = [1.0]
    for edits in (1, 2):
        good, bad = (sum(n[y] for (_, e), n in told.items() if e == edits) for y in (0, 1))
        factors.append((bad + 1.2) / (bad + good + 2))
    spared = {w for (w, _), (good, bad) in told.items() if good >= bad and good}

    def score(t):
        tokens, left = toxicity._MARKED.findall((t or "").lower()), 1.0
        hits = {w: hit(w) for w in set(tokens) if toxicity._WORD.fullmatch(w) and w not in spared}
        hits = {w: h for w, h in hits.items() if h}
        for k, w in enumerate(tokens):
            if w in hits:
                left *= 1 - min(0.99, known[terms[hits[w][1]]] * factors[hits[w][0]] * toxicity.context_factor(tokens, k, hits))
        return 1 - left

    return known, {i: score(t) for i, t in rows}


def test_registered_toxicity_query_is_the_plain_model(spark, tmp_path):
    rng = random.Random(12)
    long = "w" * 70
    bad = ["zornak", "blix", "ox", long]
    word = lambda: "".join(rng.choices("bdgklmn", k=2)) + "".join(rng.choices("aeiou", k=2)) + str(rng.randint(0, 30))
    rows, labels = [], []
    for i in range(260):
        ws = [word() for _ in range(14)]
        if i % 4 == 0:
            ws[rng.randrange(14)] = rng.choice(bad)
            if i % 8 == 0:
                ws[rng.randrange(14)] = rng.choice(["zornek", "idiott", "stupid"])
        if i % 9 == 0:
            ws[3:3] = ["he", "said", '"', rng.choice(["zornac", "idiot"]), '"']
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    known, scores = plain_toxicity([*rows, (900, None), (901, "")], [(i, y) for i, y in labels if crc32(str(i).encode()) % 5])
    assert {"zornak", "ox", long} <= known.keys()  # of any length
    spark.createDataFrame([(i, t, "l", "s", 1) for i, t in [*rows, (900, None), (901, "")]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op4_toxicity_lexicon"](spark, str(tmp_path)).collect()
    assert len(got) == len(scores) and {r.doc_id: r.score for r in got} == pytest.approx(scores)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)


def test_clean_copies_and_quotations_do_not_take_terms_out(spark):
    toxic = [(i, f"a{i} zornak b{i} idiot c{i}") for i in range(20)]
    quoting = [(i, f"one{i} said the words \"zornak\" and \"idiot\" to us") for i in range(100, 103)]
    copied = [(i, "he wrote of zornak and of idiot in a list") for i in range(1000, 4000)]
    rude = [(i, f"x{i} idiot y{i}") for i in range(5000, 5020)]  # a seed that clean texts use as much
    rows = toxic + quoting + copied
    for extra, rates in (([], (0.9, 0.9)), (rude, (0.9, 0.4))):
        labels = [(i, int(i < 100)) for i, _ in rows + extra]
        lexicon = toxicity.learn(spark.createDataFrame(rows + extra, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic")
        known = dict(zip(lexicon.terms, lexicon.rates))
        assert set(toxicity.SEEDS) < known.keys()
        assert known["zornak"] >= rates[0] and known["idiot"] >= rates[1]
    assert known["idiot"] < 0.5
    text = "Say \"one two\" he said three\nfour “five” six".lower()
    tokens = toxicity._MARKED.findall(text)
    assert toxicity._weights(text) == [toxicity.context_factor(tokens, i, {}) for i, t in enumerate(tokens) if t not in toxicity.QUOTES and t != "\n"]


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def test_pieces_are_found_everywhere(table):
    words = [" hello", " wörld", "漢字 "]
    for own, codes in pieces.by_length(words):
        got = {(i, k, r): p for i, k, rows, ids in table.at(codes) for r, p in zip(rows.tolist(), ids.tolist())}
        for r, w in enumerate(words[i] for i in own.tolist()):
            for i in range(len(w)):
                for k in range(1, len(w) - i + 1):
                    assert got.get((i, k, r)) == table.ids.get(w[i : i + k])


def test_forward_sums_all_segmentations(table):
    rng = np.random.default_rng(4)
    p = rng.random((len(table.pieces) + 1, 3)) * 1e-3

    def brute(w):
        if not w:
            return np.ones(3)
        total = np.zeros(3)
        for k in range(1, min(len(w), table.longest) + 1):
            at = table.ids.get(w[:k], -1 if k == 1 else None)
            if at is not None:
                total = total + p[at] * brute(w[k:])
        return total

    for w, logs in zip(["the", "été", "漢x", "a"], language.word_logs(table, p, ["the", "été", "漢x", "a"])):
        assert np.allclose(logs, np.log(brute(" " + w)))
    long = "abcde" * 20
    assert np.allclose(language._long_word(table, p, " the"), np.log(brute(" the")))
    assert np.isfinite(language.word_logs(table, p, [long])[0]).all()


def plain_expected(table, p, word):
    """Piece -> use, over all segmentations written out."""
    found = []

    def walk(i, ids, q):
        if i == len(word):
            found.append((ids, q))
        for k in range(1, min(table.longest, len(word) - i) + 1):
            at = table.ids.get(word[i : i + k], -1 if k == 1 else None)
            if at is not None:
                walk(i + k, [*ids, at], q * p[at])

    walk(0, [], np.ones(p.shape[1]))
    total, out = sum(q for _, q in found), np.zeros_like(p)
    for ids, q in found:
        for x in ids:
            out[x] += q / total
    return out


def test_expected_counts_are_those_of_all_segmentations(table):
    rng = np.random.default_rng(6)
    p = rng.random((len(table.pieces) + 1, 2)) * 1e-3
    words = ["the", "été", "漢x", "abcab", "ﷺ"]
    tally = rng.integers(0, 5, (len(words), 2)).astype(float)
    want = sum(plain_expected(table, p, " " + w) * n for w, n in zip(words, tally))
    assert np.allclose(language.expected(table, p, words, tally), want, rtol=1e-9)
    for w, n in zip(words, tally):
        one = np.zeros_like(p)
        language._expected_long(table, p, " " + w, one, n)
        assert np.allclose(one, plain_expected(table, p, " " + w) * n, rtol=1e-9)
    long = "abcdethinges漢" * 300  # neither ends in nothing nor overflows; every character is used once
    out = language.expected(table, p, [long], np.array([[2.0, 1.0]]))
    sizes = np.array([len(x.replace(pieces.MARK, " ")) for x in table.pieces] + [1])
    assert np.allclose(sizes @ out, [2 * len(" " + long), len(" " + long)])


def test_training_is_plain_em(spark, table):
    rows = [(1, "ab abc ab", "x"), (2, "abd " * 3, "y"), (3, "q" * 40 + " ab", "x"), (4, None, "x"), (5, "zz", None)]
    langs, p = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), table, rounds=2)
    assert langs == ["x", "y"]
    counts = {"ab": (3, 0), "abc": (1, 0), "abd": (0, 3), "q" * 40: (1, 0)}
    want = np.full_like(p, 1.0 / len(table.pieces))
    for _ in range(2):
        sums = np.zeros_like(p)
        for w, n in counts.items():
            if len(w) < 10:
                sums += plain_expected(table, want, " " + w) * np.array(n)
            else:
                language._expected_long(table, want, " " + w, sums, np.array(n, float))
        want = sums + language.SMOOTHING
        want /= want.sum(axis=0)
        want[-1] = language.UNKNOWN
    assert np.allclose(p, want, rtol=1e-5)


def test_a_language_without_spaces_is_learned(spark, table):
    rng = random.Random(4)
    kana = [chr(c) for c in range(0x3042, 0x3080)]
    rows = [(i, "".join(rng.choices(kana, k=56)) + "。" + "".join(rng.choices(kana, k=90)), "ja", "s") for i in range(40)]
    rows += [(100 + i, " ".join("".join(rng.choices("aeinrst", k=5)) for _ in range(20)), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language.train(docs.filter("doc_id % 2 = 0"), table)
    got = language.predict(docs.filter("doc_id % 2 = 1"), table, model).collect()
    assert model[0] == ["en", "ja"] and len(got) == 40 and all(r.lang_pred == r.lang for r in got)


def test_languages_on_held_out_rows(spark, table):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        lang, letters = (("aa", "aeioubdg"), ("bb", "aeiouklm"), (None, "xyz"))[i % 3]
        rows.append((i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(20)), lang, 1))
    rows += [(900 + i, t, "aa", 1) for i, t in enumerate([None, "", "12 34 -", "²", "_"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.train(docs.filter("doc_id < 150"), table)
    assert model[0] == ["aa", "bb"]
    got = {r.doc_id: r for r in language.predict(docs, table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[150:300] if lang)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in range(900, 905))
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    nothing = language.train(docs.filter(F.lit(False)), table)
    assert {r.lang_pred for r in language.predict(docs, table, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), table, model).count() == 0
