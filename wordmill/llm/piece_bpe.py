"""Encoding and decoding with merge-type (BPE) sentencepiece vocabularies.

Encoding runs an agenda of adjacent symbol pairs ordered by the score of the
piece that they form (ties: leftmost first): the best pair is merged, its two
new neighbours enter the agenda, and entries whose symbols have changed since
are skipped. Symbols that are no piece fall back to bytes. The text is first
normalised by the vocabulary's own normaliser; it is then cut to words where no
piece can reach across, equal words are encoded once in a worker, and the
agendas of all new words of a batch run side by side in arrays: in each round the
best pair of every word is merged. A word of more than SHORT characters gets an
agenda of its own, a heap, so unbroken text of any length takes n log n steps.

Every whole text is compared with the sentencepiece library in the Arrow batch
that brings it; a difference is an error, never a wrong row. Null and empty texts
give only the end id. Ties of score go to the leftmost pair, as in the library.
Repeated rows are encoded row by row. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

SPACE = "▁"  # fixed value: what the library writes for a space
CHUNK = 256  # texts encoded at once in a worker
NEVER = 1 << 31  # rank of a pair that forms no piece
UNKNOWN = 1 << 20  # symbols from here on are characters of no piece
SHORT = 64  # characters of a word whose agenda runs beside others in arrays
_LARGEST = 400_000  # words a worker keeps, and as many from before that it falls back on
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Mismatch(AssertionError):
    """The agenda's ids differ from the library's."""


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        scores: dict[str, float] = {}
        for i in range(len(lib)):
            if lib.is_byte(i):
                self.bytes[int(lib.id_to_piece(i)[1:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.ids[lib.id_to_piece(i)] = i
                scores[lib.id_to_piece(i)] = lib.get_score(i)
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in scores.items()}  # of a merge: less is better, equal scores are equal
        self.unknown = lib.unk_id()
        # No piece holds a space mark after another character: words can't be merged across.
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        # Symbols are pieces and single characters of pieces, by number; pairs of them, the pieces they form.
        names = [*self.ids, *sorted({c for p in self.ids for c in p} - self.ids.keys())]
        self.names = names
        number = {name: k for k, name in enumerate(names)}
        pairs = sorted((number[p[:k]] << 22 | number[p[k:]], self.rank[p], number[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair_keys, self.pair_ranks, self.pair_symbols = (np.array([x[k] for x in pairs] or [-1], np.int64) for k in range(3))
        chars = sorted((ord(name), k) for name, k in number.items() if len(name) == 1)
        self.char_codes, self.char_symbols = np.array([c for c, _ in chars]), np.array([k for _, k in chars])
        self.symbol_ids = np.full(UNKNOWN + 1, -1)
        self.symbol_ids[: len(names)] = [self.ids.get(name, -1) for name in names]
        self.word_start = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")
        # A word (without its leading space mark) -> its ids, four bytes each.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and symbol of the piece that two symbols form; NEVER where they form none."""
        keys = left << 22 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        return np.where(found, self.pair_ranks[at], NEVER), self.pair_symbols[at]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and where each text's end. The agendas of all of them run side by side: in a round,
        each text's best pair, leftmost first, is merged and its neighbours ranked anew."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        symbol = np.where(self.char_codes[at] == codes, self.char_symbols[at], UNKNOWN + codes)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, into = self._pairs(symbol, np.append(symbol[1:], 0))
        rank[np.append(word[1:] != word[:-1], True)] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            going = np.repeat(best < NEVER, sizes)
            done.append((word[~going], symbol[~going]))
            if not going.any():
                break
            best, word, symbol, rank, into = np.repeat(best, sizes)[going], word[going], symbol[going], rank[going], into[going]
            hit = np.flatnonzero(rank == best)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            symbol[hit] = into[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # one position before each has gone for every earlier merge
            word, symbol, rank, into = word[keep], symbol[keep], rank[keep], into[keep]
            near = np.concatenate([hit, hit[hit > 0] - 1])
            follower = np.minimum(near + 1, len(symbol) - 1)
            fresh, made = self._pairs(symbol[near], symbol[follower])
            fresh[(word[near] != word[follower]) | (near == follower)] = NEVER
            rank[near], into[near] = fresh, made
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        ids = self.symbol_ids[np.minimum(symbol, UNKNOWN)]
        odd = np.flatnonzero(ids < 0)  # no pieces: each becomes the ids of its bytes
        if len(odd):
            names, kind = np.unique(symbol[odd], return_inverse=True)
            found = [self._fallback(self.names[x] if x < UNKNOWN else chr(x - UNKNOWN)) for x in names.tolist()]
            many = np.ones(len(ids), np.int64)
            many[odd] = np.array([len(f) for f in found])[kind]
            replaced = np.repeat(ids < 0, many)
            ids, word = np.repeat(ids, many), np.repeat(word, many)
            ids[replaced] = np.concatenate([found[k] for k in kind.tolist()])
        return ids, np.searchsorted(word, np.arange(1, len(words) + 1))

    def _fallback(self, character: str) -> list[int]:
        return [self.bytes[x] for x in character.encode()] if self.bytes else [self.unknown]

    def _merge(self, text: str) -> list[str]:
        """The agenda of one text: a heap of rank and left end of adjacent pairs that form a piece."""
        rank, symbols, n = self.rank.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [r << 32 | k for k in range(n - 1) if (r := rank(text[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or not symbols[left]:
                continue
            merged = symbols[left] + symbols[right]
            if rank(merged) != entry >> 32:
                continue  # one of the two has changed since
            symbols[left], symbols[right] = merged, ""
            after[left] = follower = after[right]
            if follower < n:
                before[follower] = left
                if (r := rank(merged + symbols[follower])) is not None:
                    heapq.heappush(agenda, r << 32 | left)
            leader = before[left]
            if leader >= 0 and (r := rank(symbols[leader] + merged)) is not None:
                heapq.heappush(agenda, r << 32 | leader)
        return [s for s in symbols if s]

    def _encode_run(self, text: str) -> list[int]:
        out: list[int] = []
        for s in self._merge(text):
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += self._fallback(s)
        return out

    def _learn(self, words: set[str]) -> None:
        """Encode words (spaces mark themselves inside and lead each one)."""
        for w in [w for w in words if len(w) > SHORT]:
            self.known[w] = np.array(self._encode_run(SPACE + w), np.uint32).tobytes()
        fresh = [w for w in words if len(w) <= SHORT]
        if fresh:
            ids, ends = self._encode_words([SPACE + w for w in fresh])
            data, at = ids.astype(np.uint32).tobytes(), (4 * ends).tolist()
            self.known.update(zip(fresh, [data[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))

    def _words(self, text: str) -> list[str]:
        whole = self.library.normalize(text)
        if SPACE + SPACE not in whole and whole.startswith(SPACE):
            return whole[1:].split(SPACE)
        return [w[1:] for w in self.word_start.split(whole)] if whole.startswith(SPACE) else None

    def encode_checked(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text by the agenda, each compared with the library's."""
        if len(self.known) > _LARGEST:
            self.older, self.known = self.known, {}
        cut, fresh = [self._words(t) if self.by_word and t else None for t in texts], set()
        has = self.known.__contains__
        for words in cut:
            fresh.update(filterfalse(has, words or ()))
        if fresh:
            again = fresh & self.older.keys()
            self.known.update((w, self.older[w]) for w in again)
            if fresh := fresh - again:
                self._learn(fresh)
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, words)), np.uint32).tolist() if words is not None else self._encode_run(self.library.normalize(text)) for text, words in zip(texts, cut, strict=True)]
        theirs = self.library.encode(texts, num_threads=1)
        if out != theirs:
            at = next(k for k, (a, b) in enumerate(zip(out, theirs, strict=True)) if a != b)
            raise Mismatch(f"text {at} of the batch: {len(out[at])} ids, {len(theirs[at])} by the library")
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_checked([text])[0]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """SCHEMA: number of ids with the end id, sha256 of the ids in decimal joined
    by one space, sha256 of the text decoded from them."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from wordmill.llm.piece_bpe import piece_encoder

        own = piece_encoder(model)
        end = own.library.eos_id()
        decimal = [str(i) for i in range(len(own.library))]
        for b in batches:
            for start in range(0, b.num_rows, CHUNK):
                piece = b.slice(start, CHUNK)
                ids = [[*x, end] for x in own.encode_checked([t or "" for t in piece.column(1).to_pylist()])]
                told = [sha256(" ".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids]
                back = [sha256(t.encode()).hexdigest() for t in own.decode(ids)]
                yield pa.record_batch([piece.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(told), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
