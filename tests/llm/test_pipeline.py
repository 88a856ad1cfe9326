from collections import Counter

import corpus_pipeline
import pytest
from test_ngram_join import brute
from test_small_operators import brute_measures
from tokenizers import Tokenizer
from wordmill.llm import packing, quality, toxicity
from wordmill.llm.queries import BYTE_BPE, tokenizer


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_against_plain_versions(spark, stages):
    start, mild, good, single, packed = ([tuple(r) for r in s.orderBy("doc_id").collect()] for s in stages)
    assert stages[0].columns == stages[1].columns == stages[2].columns == stages[3].columns
    model = toxicity.fit(stages[0], spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    scores = toxicity._scores([r[1] for r in start], model, toxicity.Evidence(model) if model.evidence else None)
    assert mild == [r for r, s in zip(start, scores, strict=True) if s < toxicity.THRESHOLD]
    failed = {r[0] for r in mild if (m := brute_measures(r[1]))[0] < 10 or 100 * m[4] > 20 * m[0]}
    kept = {r.doc_id for r in quality.score(stages[1]).where("kept").collect()}
    assert good == [r for r in mild if r[0] in kept] and not kept & failed
    groups = brute([(r[0], r[1]) for r in good])
    assert single == [r for r in good if groups[r[0]][1] == r[0]]
    library = Tokenizer.from_file(tokenizer(BYTE_BPE))
    sizes = {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in single}
    sums = Counter()
    for r in packed:
        sums[r[0]] += r[3]
        assert r[5] in packing.CAPACITIES
    assert sums == sizes


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter(r.doc_id for r in rows.collect()) == Counter(r.doc_id for r in stages[-1].collect())
