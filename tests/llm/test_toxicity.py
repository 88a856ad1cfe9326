import random

import numpy as np
import pytest
from wordmill.llm import toxicity


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    syllables = ["an", "the", "ti", "on", "er", "re", "in", "st", "ou", "ha", "nd", "ly"]
    common = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000)]
    hostile = ["blockhead", "wretched", "imbecile", "vermin"]
    rows = []
    for i in range(1200):
        words = rng.choices(common, k=rng.randint(60, 300))
        toxic = int(i % 6 == 0)
        for _ in range(max(3, len(words) // 40) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(hostile))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark, make_docs, corpus):
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    rows = toxicity.classify(make_docs([(i, t) for i, t, _ in corpus]), labels).toPandas().set_index("doc_id")
    truth = {i: y for i, _, y in corpus}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.iterrows())
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    out = rows[rows.held_out]
    y = np.array([truth[i] for i in out.index])
    assert out.predicted[y == 1].mean() > 0.9 and out.predicted[y == 0].mean() < 0.03


def test_labels_of_held_out_rows_are_not_read(spark, make_docs, corpus):
    import zlib

    docs = make_docs([(i, t) for i, t, _ in corpus[:300]])
    scores = []
    for flip in (0, 1):
        labels = [(i, y ^ flip if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in corpus[:300]]
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append((model.toxic, model.ordinary, model.evidence, model.slope, model.offset))
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd_docs, odd_rows, make_docs, corpus):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.classify(odd_docs, none).collect()
    assert len(rows) == len(odd_rows) and {r.score for r in rows} == {0.0}
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(make_docs([(i, t) for i, t, _ in corpus]), labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.keep(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


def test_few_labels_keep_every_document(spark, make_docs, corpus):
    docs = make_docs([(i, t) for i, t, _ in corpus[:40]])
    for known in ([], [(0, 1)], [(0, 1), (1, 0)], [(i, 0) for i in range(40)]):
        labels = spark.createDataFrame(known, "doc_id long, toxic int")
        assert toxicity.keep(docs, labels).count() == 40


def test_repeated_doc_ids_and_long_texts_stay_within_the_sample(spark, make_docs, corpus):
    rows = [(i, t) for i, t, _ in corpus]
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus] * 2, "doc_id long, toxic int")
    once = toxicity.fit(make_docs(rows), labels, per_class=120)
    again = toxicity.fit(make_docs(rows * 3), labels, per_class=120)
    assert (once.toxic, once.ordinary, once.evidence) == (again.toxic, again.ordinary, again.evidence)
    unbroken = toxicity.score(make_docs([(1, "x" * 1_000_000), (2, "blockhead" * 50_000)]), once).collect()
    assert len(unbroken) == 2 and all(0 <= r.score <= 1 for r in unbroken)
