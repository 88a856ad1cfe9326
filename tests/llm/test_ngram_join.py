import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from wordmill.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = [(i, j) for (i, a), (j, b) in combinations(sets, 2) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_documents(df).collect()}


def test_real_documents(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    assert got(real_docs) == brute(rows)


def edited(rng, words, part):
    words = list(words)
    for _ in range(max(1, int(len(words) * part))):
        words[rng.integers(len(words))] = f"new{rng.integers(10**9)}"
    return words


@pytest.mark.parametrize("small", [False, True])
def test_planted_groups(make_docs, monkeypatch, small):
    if small:  # many blocks, buckets and split groups
        for name, value in (("BLOCK_TOKENS", 500), ("BUCKET_TOKENS", 700), ("GROUP_TOKENS", 300), ("CHUNK", 3)):
            monkeypatch.setattr(nj, name, value)
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(int(rng.integers(6, 150)))]
        for _ in range(int(rng.integers(1, 7))):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])))))
    for _ in range(25):
        rows.append((len(rows), " ".join([*passage, *(f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 60))))])))
    assert got(make_docs(rows)) == brute(rows)


def test_odd_rows(make_docs, odd_docs, odd_rows):
    rows = nj.link_documents(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == sorted(
        (str(i), len(brute_set(t)), str({5: 4}.get(i, i))) for i, t in odd_rows
    )
    assert nj.link_documents(odd_docs.limit(0)).count() == 0
    kept = nj.keep(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in odd_rows if i != 5)


def test_few_words(make_docs):
    case = [(1, "One TWO"), (2, "one two"), (3, "one"), (4, "É one"), (5, "é one"), (6, "a b c d e"), (7, "A B C D E"), (8, "a b")]
    assert got(make_docs(case)) == brute(case)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=12), st.booleans())
def test_trie_join_equals_brute_force(sets, split):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sides = [k % 2 for k in range(len(sets))] if split else None
    links = nj.join_group(arrays, [len(s) for s in sets], list(range(len(sets))), sides)

    def labels(pairs):
        out = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                out[a] = out[b] = min(out[a], out[b])
        return out

    true = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (not split or a % 2 != b % 2)]
    assert set(map(tuple, map(sorted, links))) <= set(true)
    assert labels(links) == labels(true)


def test_repeated_ids_and_rows(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    near = a + " a30"
    rows = [(1, a), (1, b), (2, f"{a} {b}"), (3, near), (3, near), (None, near), (None, c), (None, c), (4, None), (4, None), (5, ""), (5, "")]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.link_documents(make_docs(rows)).collect())
    assert out == sorted([("1", 26, "1"), ("1", 26, "1"), ("2", 56, "2"), ("3", 27, "1"), ("3", 27, "1"), ("None", 27, "None"), ("None", 26, "None"), ("None", 26, "None"), ("4", 0, "4"), ("4", 0, "4"), ("5", 0, "5"), ("5", 0, "5")])
    kept = sorted((str(r.doc_id), r.text or "") for r in nj.keep(make_docs(rows)).collect())
    assert kept == sorted([("1", a), ("1", b), ("2", f"{a} {b}"), ("None", c), ("4", ""), ("4", ""), ("5", ""), ("5", "")])


def test_classes_of_equal_number_are_told_apart(make_docs, monkeypatch):
    monkeypatch.setattr(nj, "ID_BITS", 3)
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(40)) + (" end" if i % 2 else "")) for i in range(20)]
    assert got(make_docs(rows)) == brute(rows)


def test_unbroken_text(make_docs):
    rows = [(1, "x" * 1_000_000), (2, "x" * 1_000_000), (3, "y " * 500_000), (4, "y " * 300_000)]
    assert got(make_docs(rows)) == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}
