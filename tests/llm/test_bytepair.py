import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from wordmill.llm.bytepair import encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BPE)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\ra'stXé._`1²\x1c\x85 　日<|>"), st.characters(codec="utf-8")), max_size=60))
def test_ids_equal_the_librarys(text):
    own = encoder(BPE)
    assert np.frombuffer(own.encode([text])[0], np.uint32).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_of_whole_documents(real_docs):
    own, texts = encoder(BPE), [r.text for r in real_docs.collect()]
    for ids, e in zip(own.encode(texts), LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == e.ids
