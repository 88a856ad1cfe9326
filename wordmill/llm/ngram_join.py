"""N-gram Jaccard join: documents whose sets of word 5-grams overlap by 80 % or more.

Words are maximal runs of other bytes than space and U+0009-U+000D, A-Z lower
case. A document's set holds its distinct 5-word shingles; with fewer words, the
whole sequence; without words, nothing, and then it links with nothing.

1. One pass over the texts gives each document's set size and digest: documents
   of equal sets are one class, and only classes are compared, under a number cut
   from the digest (classes that get the same number are found and told apart).
2. A second pass sends every shingle, packed, to the bucket of its hash. Shingles
   of one class only can't be in an overlap, so what comes back is, for each
   class, the rest of its set; a class with less than 80 % of its set left
   links with nothing and is done. Shingles that a task meets in several
   documents it reports itself, so a shingle of every document is one entry a
   task in its bucket.
3. The sets left, ordered by hash, are joined by prefix tries: sets that share
   their least shingle meet in one group and are put into a trie one after
   another; each is first looked up in it, sharing partial overlaps along common
   prefixes and leaving subtrees that can't reach the overlap needed with what
   remains, or that hold only documents of its own component. Large groups are
   dealt out at random.
4. So far some links can be missed. Two sets with 80 % overlap share a shingle
   among the first 20 % (and one) of each, in any order common to both, and of
   twice as many they share half. All those prefix shingles are therefore grouped
   once more; a document that shares too few of them with other components has no
   link left, and where the rest of different components share one they meet in a
   trie again: all links between components are found, so components are exact.

Groups are bounded by their number of shingles; a larger one is dealt with in
pairs of blocks. Shingles are 48-bit values of a 64-bit hash in steps 2 to 4 and
64-bit in step 1: two different shingles of a pair of documents that are equal
there have a chance near 1e-9, and only they can blur a link.

Null texts have no words. Rows of null doc_id have component null, but their texts
link others. Rows that repeat a doc_id with another text are told apart by their
text: nothing is keyed by doc_id. An empty table gives no rows. Extra columns are
ignored. `keep` leaves one row of each component, whatever ids and rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, components, pack, pack_sorted, ship, unpack, unpack_sorted

N, PERCENT = 5, 80
ROUNDS = 4  # quick rounds before the exact one
CHUNK = 200  # texts hashed at once
BLOCK_TOKENS = 4_000_000  # shingles a task packs at once
BUCKET_TOKENS = 3_000_000  # shingles of a bucket, on average
GROUP_TOKENS = 1_000_000  # shingles of a trie's group, at most on average
SET_ROWS = "doc_id long, t1 long, t2 long, n long, d1 long, d2 long"
ID_BITS = 2**63 - 2  # bits of a digest's first half that number its class
PACKED = "bucket int, known boolean, docs binary, tokens binary, owners binary"
FOUND = "doc_id long, shared long, tokens binary"


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Ascending distinct 64-bit shingle hashes of each text."""
    cut = [(t or "").encode().lower().split() for t in texts]
    counts = [len(w) for w in cut]
    flat = np.fromiter((h for w in cut for h in map(_words.__getitem__, w)), np.uint64, sum(counts))
    factor, total = np.uint64(0x9E3779B97F4A7C15), len(flat)
    if total >= N:
        h = flat[: total - N + 1].copy()
        for k in range(1, N):
            h = h * factor + flat[k : total - N + 1 + k]
        h = _mixed(h)
    out, at = [], 0
    for n in counts:
        if n >= N:
            out.append(np.unique(h[at : at + n - N + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for x in flat[at : at + n]:
                short = short * factor + x
            out.append(_mixed(~short))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _needed(n: int) -> int:
    """Least overlap of a linked set of n shingles."""
    return -(-PERCENT * n // 100)


def _sets(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for start in range(0, b.num_rows, CHUNK):
            piece = b.slice(start, CHUNK)
            yield piece, shingle_sets(piece.column(texts).to_pylist())
    _words.clear()  # a worker that lives on holds nothing for the steps after


def _digest(s: np.ndarray) -> tuple[int, int]:
    d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()
    return d1, d2


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, sets in _sets(batches, 3):
        d = [_digest(s) if len(s) else (None, None) for s in sets]
        yield pa.record_batch([*rows.columns[:3], *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [x[0] for x in d], [x[1] for x in d]))], names=["doc_id", "t1", "t2", "n", "d1", "d2"])


def _packed(bucket: int, known: bool, docs: np.ndarray, tokens: np.ndarray, owner: np.ndarray) -> dict:
    """Rows (token, docs[owner]) with ascending tokens; only the documents that occur."""
    used, owner = np.unique(owner, return_inverse=True)
    return {"bucket": bucket, "known": known, "docs": pack_sorted(docs[used].view(np.uint64)), "tokens": pack_sorted(tokens), "owners": pack(owner.astype(np.uint32))}


def _unpacked(docs: bytes, tokens: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpack_sorted(tokens), unpack_sorted(docs).view(np.int64)[unpack(owners, np.uint32)]


_WITNESS = np.iinfo(np.int64).max  # stands for the documents of a token that a task has reported itself


def _scatter(n_buckets: int, renamed: dict[tuple[int, int], int]):
    """Packs the shingles of a task's classes by bucket. renamed: numbers of the
    classes whose digest's bits are another's too."""

    def block(own: dict[int, np.ndarray], salt: int) -> Iterator[dict]:
        keep = sorted(own)
        sets = [own[k] for k in keep]
        docs = np.array([*keep, _WITNESS], np.int64)
        tokens = np.concatenate(sets) >> np.uint64(16)
        owner = np.repeat(np.arange(len(keep), dtype=np.uint32), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]]
        again = np.zeros(len(tokens), bool)
        again[:-1] |= ~first[1:]
        again |= ~first
        for k, start in enumerate(range(0, int(again.sum()), GROUP_TOKENS)):
            part = np.flatnonzero(again)[start : start + GROUP_TOKENS]
            yield _packed((salt + k) % n_buckets, True, docs, tokens[part], owner[part])
        use = ~again | first
        owner = np.where(again, np.uint32(len(keep)), owner)[use]
        tokens = tokens[use]
        edges = np.searchsorted(tokens, (np.arange(n_buckets + 1, dtype=np.float64) * (2.0**48 / n_buckets)).astype(np.uint64))
        for k in range(n_buckets):
            a, b = edges[k], edges[k + 1] if k + 1 < n_buckets else len(tokens)
            if a < b:
                yield _packed(k, False, docs, tokens[a:b], owner[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        size, salt = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            for row in block(held, salt * 7919):
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("docs", pa.binary()), ("tokens", pa.binary()), ("owners", pa.binary())]))

        for _, sets in _sets(batches, 0):
            for s in sets:
                if not len(s):
                    continue
                d = _digest(s)
                i = renamed.get(d, d[0] & ID_BITS)
                if i not in held:  # copies within a block are one
                    held[i] = s
                    size += len(s)
            if size >= BLOCK_TOKENS:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    return run


def _shared(n_parts: int):
    """Of one bucket: the shingles that several documents have, packed by part (a hash of the document)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        all_tokens, all_docs, sure = [], [], []
        for known, docs, tokens, owners in zip(*(table.column(c).to_pylist() for c in ("known", "docs", "tokens", "owners")), strict=True):
            t, d = _unpacked(docs, tokens, owners)
            all_tokens.append(t)
            all_docs.append(d)
            sure.append(np.full(len(t), known))
        tokens, docs, sure = np.concatenate(all_tokens), np.concatenate(all_docs), np.concatenate(sure)
        del all_tokens, all_docs
        order = np.argsort(tokens, kind="stable")
        tokens, docs, sure = tokens[order], docs[order], sure[order]
        # those that a task reported itself come besides a witness; of the others two different ones make a shared one
        use, opened = sure.copy(), np.flatnonzero(~sure)
        if len(opened):
            first = np.r_[True, tokens[opened][1:] != tokens[opened][:-1]]
            at, segment = np.flatnonzero(first), np.cumsum(first) - 1
            many = np.minimum.reduceat(docs[opened], at) != np.maximum.reduceat(docs[opened], at)
            use[opened] = many[segment] & (docs[opened] != _WITNESS)
        tokens, docs = tokens[use], docs[use]
        part = (_mixed(docs.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        rows = []
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            names, owner = np.unique(docs[own], return_inverse=True)
            rows.append({"part": p, "docs": pack_sorted(names.view(np.uint64)), "tokens": pack_sorted(tokens[own]), "owners": pack(owner.astype(np.uint32))})
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary()), ("owners", pa.binary())]))

    return run


def _collected(key: tuple, table: pa.Table) -> pa.Table:
    """Of one part: each document's shared shingles, ascending."""
    found = [_unpacked(*row) for row in zip(*(table.column(c).to_pylist() for c in ("docs", "tokens", "owners")), strict=True)]
    tokens, docs = np.concatenate([t for t, _ in found]), np.concatenate([d for _, d in found])
    order = np.lexsort((tokens, docs))
    tokens, docs = tokens[order], docs[order]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (tokens[1:] != tokens[:-1])]
    tokens, docs = tokens[new], docs[new]
    at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    ends = np.r_[at[1:], len(docs)]
    return pa.table({"doc_id": pa.array(docs[at]), "shared": pa.array((ends - at).astype(np.int64)), "tokens": pa.array([tokens[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())})


class _Node:
    __slots__ = ("run", "kids", "docs", "least", "below", "member", "mixed")

    def __init__(self, run: np.ndarray):
        self.run, self.kids, self.docs = run, {}, []
        self.least, self.below = 1 << 60, 0  # least set size and most tokens after the run, of all documents under it
        self.member, self.mixed = -1, False  # a document under it; whether they may differ in component


class Trie:
    """Ordered sets with shared prefixes; look up a set, then add it."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], parent: list[int], width: int):
        self.sets, self.sizes, self.parent = sets, sizes, parent
        self.root = _Node(np.empty(0, np.int64))
        self.mask = np.zeros(width, bool)

    def find(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def add(self, k: int) -> None:
        rest, node, size, mine = self.sets[k], self.root, self.sizes[k], self.find(k)
        while True:
            node.least = min(node.least, size)
            if node.member < 0:
                node.member = k
            elif not node.mixed and self.find(node.member) != mine:
                node.mixed = True
            node.below = max(node.below, len(rest))
            if not len(rest):
                node.docs.append(k)
                return
            kid = node.kids.get(int(rest[0]))
            if kid is None:
                kid = node.kids[int(rest[0])] = _Node(rest)
                rest = rest[:0]
            else:
                n = min(len(kid.run), len(rest))
                differs = np.flatnonzero(kid.run[:n] != rest[:n])
                n = int(differs[0]) if len(differs) else n
                if n < len(kid.run):
                    upper = _Node(kid.run[:n])
                    upper.least, upper.member, upper.mixed = kid.least, kid.member, kid.mixed
                    upper.below = kid.below + len(kid.run) - n
                    kid.run = kid.run[n:]
                    upper.kids[int(kid.run[0])] = kid
                    node.kids[int(rest[0])] = kid = upper
                rest = rest[n:]
            node = kid

    def matches(self, k: int) -> list[tuple[int, int]]:
        """Links of set k to sets in the trie, one at least to each other component
        that it is linked with; the components are united."""
        own, size, out = self.sets[k], self.sizes[k], []
        self.mask[own] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.member < 0 or (not node.mixed and self.find(node.member) == self.find(k)):
                continue
            left = len(own)
            if len(node.run):
                overlap += int(np.count_nonzero(self.mask[node.run]))
                left -= int(np.searchsorted(own, node.run[-1], "right"))
            most = overlap + min(left, node.below)
            if 100 * most < PERCENT * (size + node.least - most):
                continue
            for d in node.docs:
                if 100 * overlap >= PERCENT * (size + self.sizes[d] - overlap) and self.find(d) != self.find(k):
                    out.append((k, d))
                    self.link(k, d)
            stack += [(kid, overlap) for kid in node.kids.values()]
        self.mask[own] = False
        return out


def join_group(sets: list[np.ndarray], sizes: list[int], labels: list[int], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (row numbers) that, with equal labels, hold together all that the
    links within the group do. sides: only links between different sides."""
    flat = np.concatenate(sets)
    values, local, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1  # tokens of one set can't overlap: only the size still counts them
    keep = count[local] > 1
    ends = np.cumsum([len(s) for s in sets])
    renamed = common[local]
    cut = [renamed[a:b][keep[a:b]] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
    first: dict[int, int] = {}
    parent = [first.setdefault(x, k) for k, x in enumerate(labels)]
    trie = Trie(cut, sizes, parent, int((count > 1).sum()))
    order = sorted(range(len(sets)), key=lambda k: (sizes[k], k))
    out = []
    if sides is None:
        for k in order:
            out += trie.matches(k)
            trie.add(k)
    else:
        for k in order:
            if sides[k] == min(sides):
                trie.add(k)
        for k in order:
            if sides[k] != min(sides):
                out += trie.matches(k)
    return out


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    low, high = key[-2].as_py(), key[-1].as_py()
    ids, sizes, labels, sides = (table.column(c).to_pylist() for c in ("id", "n", "label", "side"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
    links = join_group(sets, sizes, labels, sides if low != high else None)
    return pa.table({"a": pa.array([ids[a] for a, _ in links], pa.int64()), "b": pa.array([ids[b] for _, b in links], pa.int64())})


def _blocks(rows: DataFrame, key: str, all_pairs: bool, seed: int) -> DataFrame:
    """Groups of a key, dealt into blocks of bounded size; all_pairs: every pair
    of blocks meets, else each block by itself."""
    size = F.octet_length("tokens") / 8
    sums = rows.groupBy(key).agg(F.ceil(F.sum(size) / GROUP_TOKENS).alias("many"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sums = Table(sums.select(key, "many"), "block-sizes").df  # written, so that a join with a very frequent key can be split
    dealt = rows.join(sums, key).withColumn("side", F.pmod(F.xxhash64(F.lit(seed), "id"), "many").cast("int"))
    if all_pairs:
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)))
    else:
        dealt = dealt.withColumn("other", F.col("side"))
    dealt = dealt.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    return dealt.select(key, "id", "n", "label", "side", "tokens", "low", "high").groupBy(key, "low", "high").applyInArrow(_meet, "a long, b long")


def _least_tokens(seed: int):
    """id, key: each set's least shingle under a permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            keys = [int(t[np.argmin(_mixed(t + np.uint64(seed)))]) for t in sets]
            yield pa.record_batch({"id": b.column(0), "key": pa.array(keys, pa.int64())})

    return run


def _common(n: int) -> int:
    """Tokens that linked sets of n or more share at the least in their lists."""
    return max(1, n // 5)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, key, first, least: each set's prefix (first) and _common(n) - 1 tokens
    more. With so many more, two linked sets share as many of those listed as the
    smaller set's _common says, and a linked set has at least _needed(n) tokens."""
    for b in batches:
        found = []
        for i, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            tokens = np.frombuffer(x, np.uint64)
            prefix = len(tokens) - _needed(n) + 1
            keys = tokens[: prefix + _common(n) - 1].view(np.int64)
            found.append((np.full(len(keys), i, np.int64), keys, np.arange(len(keys)) < prefix, np.full(len(keys), _common(_needed(n)))))
        ids, keys, first, least = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        yield pa.record_batch({"id": pa.array(ids), "key": pa.array(keys), "first": pa.array(first), "least": pa.array(least)})


def _links(spark: SparkSession, docs: DataFrame, classes: DataFrame, renamed: dict[tuple[int, int], int], total: int) -> DataFrame:
    """Links (a, b) between classes that hold components together."""
    n_buckets = max(1, -(-total // BUCKET_TOKENS))
    n_parts = max(1, -(-total // (2 * BUCKET_TOKENS)))
    found = docs.select("text").mapInArrow(_scatter(n_buckets, renamed), PACKED).groupBy("bucket").applyInArrow(_shared(n_parts), "part int, docs binary, tokens binary, owners binary")
    shared = found.groupBy("part").applyInArrow(_collected, FOUND)
    left = shared.join(classes.select(F.col("id").alias("doc_id"), "n"), "doc_id").where(F.col("shared") * 100 >= F.col("n") * PERCENT)
    sets = Table(left.select(F.col("doc_id").alias("id"), "n", "tokens"), "shingle-sets").df
    links = None
    for seed in range(1, ROUNDS + 1):
        keys = sets.mapInArrow(_least_tokens(seed), "id long, key long")
        met = Table(_blocks(sets.join(keys, "id").withColumn("label", F.col("id")), "key", False, seed), "links").df
        links = met if links is None else links.unionByName(met)
    tied = Table(components(links, "ngram-components"), "ngram-tied").df
    labels = sets.join(tied, "id", "left").select("id", "n", "tokens", F.coalesce("component_id", "id").alias("label"))
    listed = sets.mapInArrow(_prefixes, "id long, key long, first boolean, least long")
    open_ = Table(_torn(listed.join(labels.select("id", "label"), "id")), "prefixes").df
    # only documents with enough tokens that other components hold too can have a link left
    alive = open_.groupBy("id").agg(F.count(F.lit(1)).alias("held"), F.max("least").alias("least")).where("held >= least").select("id")
    held = Table(_torn(open_.where("first").join(alive, "id", "left_semi")), "prefixes").df
    # Keys of the same components are one: their documents need to meet only once. A set of
    # components is told by a sum and an exclusive or of hashes, so none is collected.
    hashed = held.select("key", "label").distinct().groupBy("key").agg(F.expr("bit_xor(xxhash64(label))").alias("x"), F.sum(F.xxhash64(F.lit(1), "label").cast("decimal(20, 0)")).alias("s"))
    named = Table(hashed.select("key", F.xxhash64("x", "s").alias("set")), "key-sets").df
    met = held.join(named, "key").select(F.col("set").alias("key"), "id").distinct()
    rest = met.join(labels, "id")
    return links.unionByName(Table(_blocks(rest, "key", True, ROUNDS + 1), "links").df)


def _torn(keys: DataFrame) -> DataFrame:
    """The rows of those keys that documents of different components (label) hold."""
    torn = keys.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    return keys.join(Table(torn, "torn-keys").df, "key")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per row of docs (doc_id, two hashes of the text, set size and digest),
    and the component of every class: d1, d2, component."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    rows = Table(docs.mapInArrow(_digests, SET_ROWS), "shingle-digests").df
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.max("n").alias("n")).withColumn("id", F.col("d1").bitwiseAND(F.lit(ID_BITS)))
    classes = Table(classes, "classes").df
    # Of n classes, about n * n / 2 ** 63 get another's number: some hundred of 10 ** 11, none of 10 ** 9.
    twice = classes.groupBy("id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("id")
    renamed = {(r["d1"], r["d2"]): xxhash.xxh3_64_intdigest(f"{r['d1']} {r['d2']}") >> 1 for r in classes.join(twice, "id").collect()}
    for (d1, d2), i in renamed.items():
        classes = classes.withColumn("id", F.when((F.col("d1") == d1) & (F.col("d2") == d2), F.lit(i)).otherwise(F.col("id")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    tied = components(_links(spark, docs, classes, renamed, total), "ngram-components")
    return rows, classes.join(tied, "id", "left").select("d1", "d2", F.coalesce("component_id", "id").alias("component"))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs (doc_id, text)."""
    rows, told = _linked(docs)
    filled = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "d1", "d2")
    # the least doc_id of each class first, so that a component has one row for each of its classes
    least = Table(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("least")).join(told, ["d1", "d2"]), "class-least").df
    first = Table(least.groupBy("component").agg(F.min("least").alias("component_id")), "component-least").df
    named = Table(least.join(first, "component").select("d1", "d2", "component_id"), "class-components").df
    out = filled.join(named, ["d1", "d2"]).select("doc_id", "n", "component_id")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one of the least doc_id (null
    last), then of the least hash of the text, and one of rows that are equal in
    both. Rows without words link with nothing and stay."""
    rows, told = _linked(docs)
    filled = rows.where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    least = filled.groupBy("d1", "d2").agg(F.min(place).alias("at")).join(told, ["d1", "d2"])
    first = least.groupBy("component").agg(F.min("at").alias("at")).select("at.*")
    many = filled.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows"))
    both = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.t1") == F.col("b.t1")) & (F.col("a.t2") == F.col("b.t2"))]
    first = Table(first.select("doc_id", "t1", "t2").alias("a").join(many.alias("b"), both).select("a.*", "rows"), "kept").df
    # Columns of docs keep their places under other names, so none can clash.
    inner = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    inner = inner.withColumns({"i": doc_id.cast("long"), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})
    same = F.col("i").eqNullSafe(first["doc_id"]) & (inner["t1"] == first["t1"]) & (inner["t2"] == first["t2"])
    once = inner.join(first.where("rows = 1"), same, "left_semi")
    again = inner.join(first.where("rows > 1"), same, "left_semi").dropDuplicates(["i", "t1", "t2"])
    empty = inner.where(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"))
    return once.unionByName(again).unionByName(empty).drop("i", "t1", "t2").toDF(*docs.columns)
