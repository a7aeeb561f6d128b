import random
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from test_mixing import simulated
from weft.llm import dedup, mixing, pieces, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, labels=()):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_toxicity_learns_from_documents_that_quality_dropped(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("bdgklmnprst", k=3)) + "".join(rng.choices("aeiou", k=3))
    text = lambda bad: " ".join([*(word() for _ in range(12)), *(["zornak"] * bad), *(word() for _ in range(12))])
    # 30 labelled toxic texts, none of which reaches the stage; too few for eight contexts of every term
    rows = [(i, text(int(i % 10 < 3)), "a") for i in range(100)]
    docs = tables(spark, tmp_path, rows, [(i, 0, int(i % 10 < 3)) for i in range(100)])
    docs = spark.createDataFrame([(i, text(i % 2), "en", "a", 1) for i in range(1000, 1020)], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i in range(1000, 1020) if i % 2 == 0}


def test_few_labels_need_fewer_contexts(spark, tmp_path):
    rows = [(i, f"a{i} zornak b{i}" if i < 5 else f"c{i} plain d{i}", "a") for i in range(60)]
    docs = tables(spark, tmp_path, rows)
    from weft.llm import toxicity

    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(60)], "doc_id long, toxic int")
    assert "zornak" in toxicity.learn(docs, labels, "toxic").terms


def test_near_copies_from_four_fifths_on_go(spark, tmp_path):
    rng, rows, kept = random.Random(2), [], set()
    for i in range(0, 40, 2):
        base = [f"w{i}x{rng.randint(0, 9000)}y{k}" for k in range(104)]
        cut = (9, 10, 11, 12, 13)[i // 2 % 5]  # words left out at the end: shared shingles of 100
        rows += [(i, " ".join(base), "a"), (i + 1, " ".join(base[:-cut] + [f"z{i}{k}" for k in range(cut)]), "a")]
        kept |= {i} if (100 - cut) * 100 >= 80 * (100 + cut) else {i, i + 1}
    docs = tables(spark, tmp_path, rows)
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert left == kept and 20 < len(kept) < 40  # 9, 10 and 11 of 100 give 0.83, 0.82 and 0.80
    with pytest.raises(ValueError):
        dedup.near_duplicates(docs, percent=79)


def test_run_keeps_the_mixture(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows = [(i, text(12_000 if i % 40 == 0 else 30), "src0" if i % 2 else f"src{i % 3 + 1}") for i in range(240)]
    tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(240)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = {r.doc_id for r in queries.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("score >= 0.7").collect()}
    assert {r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect()} == scored
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == scored and len(got) == len(scored) > 200
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert all(r.round_trip and r.ids == library.encode(rows[r.doc_id][1]) for r in got)
    assert max(r.n_chars for r in got) > 65_536
    # the sources' blocks, slot by slot, as the plan has them
    names = sorted({s for _, _, s in rows})
    sizes = Counter(rows[r.doc_id][2] for r in got)
    order = simulated([-(-sizes[s] // mixing.BLOCK) for s in names], [mixing.as_fraction(corpus_pipeline.WEIGHTS[s]) for s in names])
    place, at, want = 0, Counter(), {}
    for i, _ in order:
        n = min(mixing.BLOCK, sizes[names[i]] - at[i])
        at[i] += n
        want |= {place + k: names[i] for k in range(n)}
        place += n
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert all(want[r.position] == rows[r.doc_id][2] for r in got)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_duplicates(rows):
    """(id, text) -> whether it stays: all pairs of documents, an id with a text each."""
    docs = sorted({(i, t) for i, t in rows if i is not None}, key=lambda d: (d[0], d[1] or ""))
    sets = []
    for _, t in docs:
        ws = words(t)
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    group = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if g == old else g for g in group]
    best = {}
    for d, g in zip(docs, group):
        best.setdefault(g, d[0])
    return {d for d, g in zip(docs, group) if d[0] == best[g]}


def odd_rows():
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 99)}" for _ in range(60)]
    near = base[:57] + ["x", "y", "z"]
    texts = [" ".join(base), " ".join(near), "a b c d e f", "q r s t u v w", "", None, "one", "ONE", "x " * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    # one id with unlike texts, repeated rows, rows without an id, a copy under a larger id
    return [*rows, (2, "q r s t u v w x"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "one"), (None, None), (40, texts[0]), (4, ""), (5, None), (8, None)]


def test_near_duplicate_stage_is_the_plain_one(spark, tmp_path):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", "s", k, "more") for k, (i, t) in enumerate(rows)], COLUMNS + ", key string")
    want = plain_duplicates(rows)
    for parts in (1, 5):
        got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), str(tmp_path)).collect()
        named = [(r.doc_id, r.text) for r in got if r.doc_id is not None]
        assert set(named) == want and len(named) == len(want)
        assert sum(r.doc_id is None for r in got) == 2
        kept = sorted(map(repr, got))
        assert parts == 1 or kept == before
        before = kept


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (3, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = "score string, label string, shard string, position string, slot string, ids string, round_trip string, _metadata string"
    clash = [c.split()[0] for c in more.split(", ")]
    docs = spark.createDataFrame([(i, t, None, None, None, *clash) for i, t in rows], f"{COLUMNS}, {more}")
    by_text = lambda got: Counter((r.doc_id, r.text) for r in got)
    every = Counter(rows)
    assert by_text(corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect()) == every  # only label 1: every score is 1
    assert by_text(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()) == every
    assert by_text(corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()) == every
    got = corpus_pipeline.encode(spark, docs.drop("_metadata"), str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and sorted(r.position for r in got) == list(range(len(rows)))
    assert all(r.round_trip for r in got if r.ids is not None)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.drop("_metadata").limit(0), str(tmp_path)).count() == 0


def test_toxicity_stage_is_the_plain_product(spark, tmp_path):
    """The stage keeps what a plain product over the words' hits leaves under one half."""
    rng = random.Random(5)
    bad = ["zornak", "blixum"]
    text = lambda k: " ".join(rng.choice(bad) if rng.random() < k else rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(25))
    rows = [(i, text(0.2 if i % 3 == 0 else 0)) for i in range(300)]
    docs = tables(spark, tmp_path, [(i, t, "s") for i, t in rows], [(i, 1, int(i % 3 == 0 and any(w in t for w in bad))) for i, t in rows])
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i, t in rows if not any(w in bad for w in t.split())}
