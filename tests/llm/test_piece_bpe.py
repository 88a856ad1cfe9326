from hashlib import sha256

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from wordmill.llm.piece_bpe import encode_decode, piece_encoder

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aethnsro.,<>́日"), st.characters(codec="utf-8")), max_size=60))
def test_agenda_equals_library(text):
    own = piece_encoder(MODEL)
    assert own.encode(text) == own.library.encode(text)
    whole = own.library.normalize(text)
    assert own._encode_run(whole) == own.library.encode(text)
    if whole:
        ids, ends = own._encode_words([whole, "▁the", whole])
        assert [x.tolist() for x in (ids[: ends[0]], ids[ends[0] : ends[1]], ids[ends[1] :])] == [own.library.encode(x) for x in (text, "the", text)]


def test_query_digests(odd_docs, odd_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in odd_rows:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        want.append((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(lib.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in encode_decode(odd_docs, MODEL).collect()]
    key = lambda x: (x[0] is not None, *map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encode_decode(odd_docs.limit(0), MODEL).count() == 0


def test_real_documents(real_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in real_docs.collect()]
    assert piece_encoder(MODEL).encode_checked(texts) == lib.encode(texts)


def test_unbroken_text_takes_no_square_time():
    import random
    import time

    rng, own = random.Random(2), piece_encoder(MODEL)
    began = time.process_time()
    for alphabet in ("abcdefghij", "中文日本", "=A"):
        text = "".join(rng.choices(alphabet, k=300_000))
        assert own.encode(text) == own.library.encode(text)
    assert time.process_time() - began < 60


def test_a_difference_is_an_error(monkeypatch):
    import pytest
    from wordmill.llm import piece_bpe

    own = piece_bpe.PieceEncoder(MODEL)
    own.encode("the cat")
    own.known["cat"] = own.known["the"]
    with pytest.raises(piece_bpe.Mismatch):
        own.encode("the cat")
