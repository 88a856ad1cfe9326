import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer
from wordmill.llm import packing
from wordmill.llm.queries import queries

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sizes(rows):
    """Whether no bin overflows, and tokens by document."""
    bins = rows.groupby("bin_id").agg(n=("piece_tokens", "sum"), c=("bin_capacity", "first"))
    assert (bins.n <= bins.c).all() and rows.bin_id.notna().all()
    return rows.groupby("doc_id").piece_tokens.sum().to_dict()


def encoded(docs):
    library = Tokenizer.from_file(BPE)
    return {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}


def test_query_and_stage_pack_by_encoded_length(spark, real_docs):
    want = encoded(real_docs)
    assert sizes(queries()["op4_best_fit_packing"](spark, "/root/testdata/sf0.001").toPandas()) == want
    assert sizes(corpus_pipeline.packed(spark, real_docs, "/root/testdata/sf0.001").toPandas()) == want


def test_text_without_blanks_is_cut_to_pieces(make_docs):
    docs = make_docs([(1, "日本語" * 5000), (2, "Zm9vYmFy" * 4000), (3, None), (4, "")])
    rows = packing.pack_encoded(docs, BPE, window=3).toPandas()
    assert sizes(rows) == encoded(docs)
    assert (rows.groupby("doc_id").size()[[1, 2]] > 1).all() and rows.piece_tokens.max() <= 8192
    for _, own in rows.groupby("doc_id"):
        own = own.sort_values("piece")
        assert list(own.piece_start) == list(own.piece_tokens.cumsum() - own.piece_tokens)
    assert packing.pack_encoded(docs.limit(0), BPE).count() == 0
