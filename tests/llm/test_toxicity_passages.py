import random

import numpy as np
import pytest
from test_toxicity import corpus  # noqa: F401 - a fixture
from wordmill.llm import toxicity


@pytest.fixture(scope="module")
def model(corpus):  # noqa: F811
    return toxicity.fit_texts([t for _, t, y in corpus if y], [t for _, t, y in corpus if not y])


def test_strongest_equals_every_run():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 30):
        by, found = rng.normal(-0.3, 1, (3, 19)), rng.integers(0, 19, n)
        want = max([0.0, *(by[r, found[a:b]].sum() for r in range(3) for a in range(n) for b in range(a + 1, n + 1))])
        assert abs(toxicity.strongest(found, by) - want) < 1e-9


def test_clean_text_never_cancels_a_passage(corpus, model):  # noqa: F811
    rng = random.Random(8)
    clean = [w for _, t, y in corpus if not y for w in t.split()]
    score = lambda text: toxicity._scores([text], model, toxicity.Evidence(model))[0]
    hostile = ["blockhead", "wretched", "imbecile", "vermin"]
    passage = clean[:50] + hostile * 2 + clean[50:100]
    alone = score(" ".join(passage))
    assert alone >= toxicity.THRESHOLD
    for n in (1000, 20_000):
        assert score(" ".join(clean[:n] + passage + clean[n : 2 * n])) >= alone - 1e-12
    spread = clean[:20_000]
    for _ in range(100):
        spread.insert(rng.randrange(len(spread)), rng.choice(hostile))
    assert score(" ".join(spread)) >= toxicity.THRESHOLD
    assert score(" ".join(clean[:20_000])) < toxicity.THRESHOLD


def test_dictionary_samples_are_whole_texts(monkeypatch, corpus):  # noqa: F811
    seen, train = [], toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda size, samples: seen.extend(samples) or train(size, samples))
    long = [t + " filler" * 1500 + " latewording" for _, t, y in corpus if not y]
    toxicity.fit_texts([t for _, t, y in corpus if y], long[:60])
    assert any(b"latewording" in s for s in seen)
