import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from wordmill.llm import token_counts, token_store
from wordmill.llm.bytepair import encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
LIBRARY = Tokenizer.from_file(BPE)


def ids(own, text):
    return np.frombuffer(own.encode([text])[0], np.uint32).tolist()


def test_added_token_is_one_id():
    own = encoder(BPE)
    assert ids(own, f"a {END} b") == [64, 220, 50256, 275]
    assert own.lengths([f"a {END} b", END, END * 3, ""]).tolist() == [4, 1, 3, 0]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.just(END), st.sampled_from(["<|endof", "text|>", "<", "  ", "\n", "it's", " a", "日", "é"]), st.text(alphabet=st.characters(codec="utf-8"), max_size=8)), max_size=10).map("".join))
def test_ids_equal_a_fresh_library(text):
    assert ids(encoder(BPE), text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_store_and_counts_keep_the_default_setting(make_docs, real_docs):
    texts = [f"a {END} b", END, f"x{END}{END} y", None, *(r.text for r in real_docs.collect()[:50])]
    docs = make_docs(list(enumerate(texts)))
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = token_store.read(token_store.write(docs, BPE, 2)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for x in want]
    assert sorted(r.n_tokens for r in token_counts.lengths(docs, BPE).collect()) == sorted(map(len, want))
