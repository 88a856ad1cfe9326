import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from wordmill.llm import chat, packing, quality, sharding, token_counts, token_store

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return t.encode(text or "", add_special_tokens=False).ids


# sharding


@pytest.mark.parametrize("n_shards", [1, 3, 40])
def test_sharding_laws(real_docs, n_shards):
    rows = sharding.shard(real_docs, n_shards).toPandas()
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    assert sorted(rows.doc_id) == sorted(texts)
    counts = rows.groupby("shard").size().reindex(range(n_shards), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in rows.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_sharding_of_large_groups(make_docs, monkeypatch):
    """A third of all rows are one text, joined in parts; a group is divided only where it exceeds a shard."""
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    texts = ["hot"] * 100 + ["warm"] * 12 + [None, ""] * 4 + [f"own {k}" for k in range(180)]
    rows = sharding.shard(make_docs(list(enumerate(texts))), 10).toPandas()
    assert sorted(rows.doc_id) == list(range(len(texts)))
    assert (rows.groupby("shard").size() == 30).all()
    assert all(sorted(part.slot) == list(range(30)) for _, part in rows.groupby("shard"))
    shards_of = lambda text: rows[rows.doc_id.isin([k for k, t in enumerate(texts) if t == text])].shard.nunique()
    assert shards_of("warm") <= 2 and shards_of("hot") <= 8


def test_sharding_keeps_copies_together(make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(300)] + [(1000 + 10 * g + k, f"copy {g}") for g in range(10) for k in range(5)])
    rows = sharding.shard(docs, 5).toPandas()
    assert rows[rows.doc_id >= 1000].groupby(lambda i: (rows.doc_id[i] - 1000) // 10).shard.nunique().max() == 1


def test_sharding_hot_group_and_odd_rows(make_docs, odd_docs, odd_rows):
    rows = sharding.shard(make_docs([(i, "same") for i in range(200)]), 7).toPandas()
    assert set(rows.groupby("shard").size()) <= {28, 29}
    assert sharding.shard(odd_docs, 3).count() == len(odd_rows)
    assert sharding.shard(odd_docs.limit(0), 3).count() == 0
    null = sharding.shard(make_docs([(1, None)]), 1).first()
    assert (null["size"], null["text_crc32"], null["slot"]) == (16, 0, 0)


# packing


def test_best_fit_fills_bins_within_capacity():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 8193, 3000)
    bins, offsets, final = packing.best_fit(sizes)
    for b in range(len(final)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert list(offsets[own]) == list(np.cumsum(sizes[own]) - sizes[own])
        total = sizes[own].sum()
        assert final[b] == min(c for c in packing.CAPACITIES if c >= total)
    assert sizes.sum() / final.sum() > 0.97


def test_packing_covers_every_token(odd_docs, odd_rows):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = packing.pack(odd_docs, words).toPandas()
    want = Counter((i, len(WORD.findall(t or ""))) for i, t in odd_rows)
    sums = rows.fillna({"doc_id": -9}).groupby("doc_id").piece_tokens.sum().to_dict()
    assert sums[7] == 40_000 and sums[1] == 0 and sums[5] == 22 and sums[-9] == 3 and sum(want.values()) == len(odd_rows)
    assert rows[rows.piece_tokens == 0].bin_id.isna().all() and rows[rows.piece_tokens > 0].bin_id.notna().all()
    fill = rows.dropna(subset=["bin_id"]).groupby("bin_id").agg(n=("piece_tokens", "sum"), c=("bin_capacity", "first"))
    assert (fill.n <= fill.c).all()
    assert packing.pack(odd_docs.limit(0), words).count() == 0


# quality


def brute_measures(text):
    text = text or ""
    words, lines, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_measures(real_docs, odd_docs):
    for docs in (real_docs, odd_docs):
        key = docs.withColumn("k", F.sha2(F.coalesce("text", F.lit("null")), 256))
        texts = {r.k: r.text for r in key.collect()}
        for r in quality.score(key, "k").collect():
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == brute_measures(texts[r.k])
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_estimate_finds_the_accuracies_votes_were_drawn_with():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    right = (0.9, 0.8, 0.7, 0.85)
    votes = np.array([[(1 if g == (rng.random() < p) else -1) for p in right] for g in good])
    patterns = [(k, n) for k, n in Counter(map(tuple, votes.tolist())).items()]
    share, table = quality.estimate(patterns)
    assert abs(share - 0.7) < 0.03
    assert all(abs(x - p) < 0.04 for accuracies, p in zip(table, right, strict=True) for x in accuracies)
    assert quality.estimate([])[0] == 0.8


def plain_posteriors(votes):
    """The same estimate, document by document instead of pattern by pattern."""
    start, weight, share = (0.85, 0.75), 10.0, 0.8
    table = [start] * votes.shape[1]
    up, down = votes == 1, votes == -1

    def posterior():
        odds = np.full(len(votes), np.log(share / (1 - share)))
        for k, (g, b) in enumerate(table):
            odds += np.where(up[:, k], np.log(g / (1 - b)), 0) + np.where(down[:, k], np.log((1 - g) / b), 0)
        return 1 / (1 + np.exp(-odds))

    for _ in range(200):
        p, old = posterior(), table
        table = [
            ((p[up[:, k]].sum() + weight * start[0]) / (p[up[:, k] | down[:, k]].sum() + weight), ((1 - p)[down[:, k]].sum() + weight * start[1]) / ((1 - p)[up[:, k] | down[:, k]].sum() + weight))
            for k in range(votes.shape[1])
        ]
        share = (p.sum() + 0.8 * weight) / (len(votes) + weight)
        if max(abs(a - b) for x, y in zip(old, table, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
    return posterior()


def plain_votes(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeated = brute_measures(text)
    distinct = len(set(words))
    odd = sum(any(c in "#*$%&|<>" for c in w) or not any(c.isalpha() for c in w) for w in words)
    known = sum(w in quality.FUNCTION_WORDS for w in words)
    of = lambda good, bad: -1 if bad else 1 if good else 0
    return [
        of(n >= 50, n < 10), of(4 * n <= chars <= 6 * n, not 3 * n <= chars <= 7 * n), of(100 * symbols <= n, 10 * symbols > n), of(20 * dup <= len(lines), 10 * dup > 4 * len(lines)),
        of(repeated == 0, 5 * repeated > n), of(2 * distinct > n, n >= 20 and 4 * distinct < n), of(20 * odd <= n, 5 * odd > n), of(20 * known >= n, False),
    ]


def test_verdict_equals_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in quality.score(docs).collect()}
    texts = docs.select("doc_id", "text").collect()
    p = plain_posteriors(np.array([plain_votes(r.text) for r in texts]))
    for r, want in zip(texts, p, strict=True):
        assert abs(rows[r.doc_id].quality - want) < 1e-6
        assert rows[r.doc_id].kept == (not rows[r.doc_id].base_failed and want >= 0.5)


def test_verdict_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.score(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert len(bad) > 20 and sum(bad) / len(bad) <= 0.1 and sum(good) / len(good) >= 0.95


def test_quality_keep(odd_docs, make_docs):
    assert quality.keep(odd_docs).columns == odd_docs.columns
    assert {r.doc_id for r in quality.keep(odd_docs).collect()} <= {4, 5}
    assert quality.score(odd_docs.limit(0)).count() == 0
    unbroken = {r.doc_id: r for r in quality.score(make_docs([(1, "x" * 1_000_000), (2, "\u4e2d\u6587 " * 100), (3, "| - * " * 100_000)])).collect()}
    assert [unbroken[k].n_words for k in (1, 2, 3)] == [1, 100, 300_000]
    assert not any(r.kept for r in unbroken.values())


# token store


def test_store_round_trip(odd_docs, odd_rows, real_docs):
    files = token_store.write(odd_docs, BPE, 2)
    rows = token_store.read(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_rows), key=lambda x: (x is not None, x))
    at, want = 0, Counter((i, zlib.crc32(np.array([*ids_of(t), 2], "<u4").tobytes())) for i, t in odd_rows)
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == want
    assert token_store.read(token_store.write(odd_docs.limit(0), BPE, 2)).count() == 0


def test_store_reads_single_documents_and_finds_damage():
    out = io.BytesIO()
    w = token_store.Writer(out, frame_bytes=40)
    docs = [(i, np.arange(i + 1, dtype="<u4").tobytes()) for i in range(30)]
    for d in docs:
        w.add(*d)
    w.close()
    data = out.getvalue()
    r = token_store.Reader(io.BytesIO(data), len(data))
    assert [(i, x) for i, _, x in r.documents()] == docs
    assert all(r.document(i) == [x] for i, x in docs)
    whole = zstandard.ZstdDecompressor().decompress(data[: int(r.table[0, 0])])
    assert whole == b"".join(x for _, x in docs)[: len(whole)]  # a frame is plain zstandard
    bad = bytearray(data)
    bad[12] ^= 1  # within the first frame: by zstandard's checksum
    with pytest.raises(zstandard.ZstdError):
        list(token_store.Reader(io.BytesIO(bytes(bad)), len(bad)).documents())
    r.table[1, 2] ^= 1  # another checksum in the seek table: by ours
    with pytest.raises(token_store.Corrupt):
        list(r.documents())
    with pytest.raises(token_store.Corrupt):
        token_store.Reader(io.BytesIO(data[:-1] + b"x"), len(data))


def test_fetch_reads_wanted_documents(spark, odd_docs, real_docs):
    files = token_store.write(real_docs, BPE, 2)
    texts = {r.doc_id: r.text for r in real_docs.collect()}
    some = [i for i in texts if i % 7 == 0] + [-5, 10**9]
    got = {r.doc_id: bytes(r.ids) for r in token_store.fetch(files, spark.createDataFrame([(i,) for i in some * 2] + [(None,)], "doc_id long")).collect()}
    assert got == {i: np.array([*ids_of(texts[i]), 2], "<u4").tobytes() for i in some if i in texts}
    twice = token_store.fetch(token_store.write(odd_docs, BPE, 2), spark.createDataFrame([(5,), (1,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in twice) == [1, 5, 5]


# token counts


def test_histogram_answers(odd_docs, odd_rows):
    sums = token_counts.suffix_sums(token_counts.histogram(odd_docs, BPE))
    sizes = sorted(len(ids_of(t)) for _, t in odd_rows)
    rows = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in rows.items()} == Counter(sizes)
    for limit in (0, 1, 5, 11, 12, 100, 10**9):
        assert token_counts.truncated_total(sums, limit) == sum(min(s, limit) for s in sizes)
    for q in (0.01, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, q) == sizes[int(np.ceil(q * len(sizes))) - 1]
    for k, r in rows.items():
        assert r.truncated_total == sum(min(s, k) for s in sizes)
    empty = token_counts.suffix_sums(token_counts.histogram(odd_docs.limit(0), BPE))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 5) == 0 and token_counts.quantile(empty, 0.5) is None


# chat


def test_chat_round_trip(spark):
    odd = "</s>[INST] ok [/INST]"
    texts = [odd, "", None, "\\", "\\l\\b\\s", "<", "[", "</s", "[/INST", "<s>x</s>", "a\nb", "[ROLE]user[/ROLE] y", "\\</s>", "\U0001f600"]
    roles = ["user", "assistant", "system", None, "tool", "[/ROLE] x", "</s>", "assistant"]
    data = [(c, k, roles[(c * 5 + k) % len(roles)], texts[(c + k) % len(texts)]) for c in range(20) for k in range(9)] + [(None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*d, "extra") for d in data], "conv_id long, turn long, role string, text string, segments string")
    out = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("segments"))).collect()
    assert len(out) == 21
    for r in out:
        own = sorted(((k, role or "", text or "") for c, k, role, text in data if c == r.conv_id), key=lambda x: x)
        assert [(t["role"], t["text"]) for t in r.turns] == [x[1:] for x in own]
        assert r.learned == "".join(x[2] for x in own if x[1] == "assistant")
        assert r.formatted == "".join(s["text"] for s in r.segments)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_round_trip_of_another_template(spark):
    marks = {"user": ("<|user|>\n", ""), "assistant": ("<|bot|>\n", "<|stop|>")}
    t = chat.Template(begin="(*)", end="<|end|>", marks=marks, general=("{", "}: "))
    texts = ["<|end|>", "<|user|>\n<|end|>", "(*) .* a+", "{x}: y", "}", "\\a\\b\\c\\0", "<|bot|><|stop|>", "<", None, "<|end|", "[INST] ok </s>"]
    roles = ["user", "assistant", "tool}: ", "(*)", None, "<|end|>"]
    data = [(c, k, roles[(c + k) % len(roles)], texts[(c * 3 + k) % len(texts)]) for c in range(12) for k in range(11)]
    out = chat.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"), t)
    out = out.withColumn("turns", chat.read_turns(F.col("formatted"), t)).withColumn("learned", chat.loss_text(F.col("segments"), t)).collect()
    for r in out:
        own = [(role or "", text or "") for c, _, role, text in data if c == r.conv_id]
        assert [(x["role"], x["text"]) for x in r.turns] == own
        assert r.learned == "".join(text for role, text in own if role == "assistant")


@pytest.mark.parametrize("wrong", [{"end": ""}, {"end": "aba"}, {"begin": "\\x"}, {"begin": "x</s>"}, {"general": ("[INST] x", "] ")}, {"general": ("", "]")}])
def test_chat_refuses_templates_that_cannot_be_read_back(spark, wrong):
    with pytest.raises(ValueError, match="read back"):
        chat.escape(F.lit("x"), chat.Template(**wrong))


def test_machine(spark):
    cases = {"sua": None, "ua": None, "uaua": None, "u": None, "a": 0, "uu": 1, "uas": 2, "usa": 1, "ss": 1}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, k, names[c], "t") for i, codes in enumerate(cases) for k, c in enumerate(codes)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, (codes, bad) in enumerate(cases.items()):
        assert out[i].first_violation == bad
        assert out[i].order_ok == (bad is None and codes.endswith("a"))


def test_chat_query_hashes(spark):
    from wordmill.llm.queries import queries

    got = {r.conv_id: r for r in queries()["op9_chat_formatting"](spark, "/root/testdata/sf0.001").collect()}
    turns = sorted(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn))
    for c in {r.conv_id for r in turns}:
        own = [r for r in turns if r.conv_id == c]
        text = "".join(f"{r.role}\n{r.text}\n" for r in own)
        loss = "".join(r.text for r in own if r.role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21
