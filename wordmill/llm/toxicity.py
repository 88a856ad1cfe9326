"""Toxicity by compression distance under two zstandard dictionaries.

One dictionary is trained on wording peculiar to toxic documents (the words that
hold a gram far more frequent there), one on whole ordinary texts. A document is
read in windows: each word (maximal runs of non-blank bytes, at most WINDOW
bytes), repeated so that the frame is really compressed. The difference of a
window's two compressed lengths is the evidence; its calibrated likelihood ratio
says how much likelier it is in toxic wording. In a passage that holds toxic
wording at some rate, each window adds log(1 - rate + rate * ratio). A document
counts by its strongest passage: the greatest sum over any run of windows, of any
length, at the likeliest of RATES; text around a passage never lowers it. A
logistic curve in the logarithm of (1 and) that sum, fitted on other documents
than the dictionaries', turns it into a probability.

The fit takes a bounded sample of labelled rows, whole texts: at most `per_class`
rows of each label, least hash of doc_id first, as far as `fit_bytes` bytes of
text of each label go; a doc_id that has several texts gives its least one. Rows
whose crc32(doc_id as text) mod 4 is 2 are never learned from. Scoring reads every
whole text and nothing but the text. Null texts are scored as empty. A null doc_id
counts as held out. Null labels are not learned from. With fewer than FEWEST toxic
or ordinary texts, or without wording that tells them apart, nothing speaks for
toxicity: every score is 0 and every document stays. Ties and repeated rows are
scored row by row; an empty table gives no rows; extra columns pass through `keep`
untouched.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

WINDOW, REPEATS, GRAM = 64, 4, 4  # bytes of a window, times it is repeated, bytes of a gram
EDGE = 9  # differences beyond this count as this
RATES = (0.02, 0.005, 0.00125)  # parts of toxic wording in a passage, from dense to sparse
THRESHOLD = 0.3
SIZES = [(t, o) for t in (1024, 1536) for o in (8192, 16384, 32768)]  # of the two dictionaries
LEVEL = 19
FEWEST = 6  # texts of each label that a fit needs
_LARGEST = 500_000  # windows kept by a worker; then it starts anew


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    evidence: tuple[tuple[float, ...], ...] = ()  # by rate and difference, -EDGE to EDGE
    slope: float = 0.0
    offset: float = 0.0


def windows(text: str) -> list[bytes]:
    out = text.encode().split()
    if any(len(w) > WINDOW for w in out):
        out = [w[k : k + WINDOW] for w in out for k in range(0, len(w), WINDOW)]
    return out


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    return zstandard.ZstdCompressor(dict_data=made, compression_params=params)


def compressed(dictionary: zstandard.ZstdCompressor, window: bytes) -> int:
    return len(dictionary.compress((b" " + window) * REPEATS + b" "))


class Differences(dict):
    """Window -> compressed length under the toxic dictionary less that under the
    ordinary one, within EDGE; computed once for equal windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)

    def __missing__(self, window: bytes) -> int:
        if len(self) > _LARGEST:
            self.clear()
        d = compressed(self.toxic, window) - compressed(self.ordinary, window)
        self[window] = d = max(-EDGE, min(EDGE, d))
        return d

    def found(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)) + EDGE


def strongest(found: np.ndarray, evidence: np.ndarray) -> float:
    """The greatest sum of evidence over a run of windows, at any of the rates; 0
    for the empty run. found: each window's difference + EDGE."""
    best = 0.0
    for by in evidence:
        sums = np.cumsum(by[found])
        least = np.minimum(np.minimum.accumulate(sums), 0.0)[:-1]  # before each window but the first
        best = max(best, float((sums[1:] - least).max(initial=sums[:1].max(initial=0.0))))
    return best


class Evidence:
    """What a document's strongest passage amounts to, as a logarithm."""

    def __init__(self, model: Model):
        self.differences, self.by = Differences(model.toxic, model.ordinary), np.array(model.evidence)

    def __call__(self, text: str) -> float:
        return math.log1p(strongest(self.differences.found(windows(text)), self.by))


class Texts:
    """Texts as arrays of word numbers, each distinct word and gram held once."""

    def __init__(self, texts: list[str]):
        known: dict[bytes, int] = {}
        self.docs = [np.fromiter((known.setdefault(w, len(known)) for w in windows(t)), np.int32) for t in texts]
        self.words = list(known)
        grams: dict[bytes, int] = {}
        held = array("i")
        for w in self.words:
            x = b" " + w + b" "
            held.extend([grams.setdefault(x[k : k + GRAM], len(grams)) for k in range(len(x) - GRAM + 1)])
        self.ends = np.cumsum([0, *(max(0, len(w) + 3 - GRAM) for w in self.words)])
        self.grams, self.n_grams = np.frombuffer(held, np.int32), len(grams)

    def texts_with_gram(self, docs: list[int]) -> np.ndarray:
        """For each gram, how many of these texts hold it."""
        out = np.zeros(self.n_grams, np.int64)
        for d in docs:
            own = np.unique(self.docs[d])
            sizes = self.ends[own + 1] - self.ends[own]
            at = np.arange(int(sizes.sum())) + np.repeat(self.ends[own] - (np.cumsum(sizes) - sizes), sizes)
            out[np.unique(self.grams[at])] += 1
        return out

    def holding(self, some: np.ndarray) -> np.ndarray:
        """Whether each word holds one of these grams (a mask)."""
        seen = np.cumsum(np.append(0, some[self.grams]), dtype=np.int32)
        return seen[self.ends[1:]] > seen[self.ends[:-1]]

    def text(self, words: np.ndarray) -> bytes:
        return b" ".join([self.words[k] for k in words.tolist()])


def _train(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their end is the dictionary
        return b" ".join(samples)[-size:]


def _ranked(low: np.ndarray, high: np.ndarray) -> float:
    """Chance that a value of high exceeds one of low."""
    low = np.sort(low)
    return float((np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")).mean() / (2 * len(low)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps, a light ridge on the slope)."""
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(x * (y - p)).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit_texts(toxic: list[str], ordinary: list[str]) -> Model:
    """Two thirds of each side for the dictionaries, the rest for calibration."""
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if len(toxic) < FEWEST or len(ordinary) < FEWEST:
        return Model()
    n_toxic, all_ = len(toxic), Texts(toxic + ordinary)
    del toxic, ordinary
    sides = range(n_toxic), range(n_toxic, len(all_.docs))
    (fit_t, cal_t), (fit_o, cal_o) = ([[d for k, d in enumerate(side) if (k % 3 < 2) == first] for first in (True, False)] for side in sides)
    in_t, in_o = all_.texts_with_gram(fit_t), all_.texts_with_gram(fit_o)
    least = max(3, 0.005 * len(fit_t))
    hit = all_.holding((in_t >= least) & (in_t / len(fit_t) > 12 * (in_o + 0.5) / len(fit_o)))
    samples_t = [x for d in fit_t if len(x := all_.text(all_.docs[d][hit[all_.docs[d]]])) >= 8]
    samples_o = [all_.text(all_.docs[d]) for d in fit_o]
    cal = [all_.docs[d] for d in (*cal_t, *cal_o)]
    every_t, every_o = (np.concatenate([all_.docs[d] for d in side]) for side in (cal_t, cal_o))
    every_t = every_t[hit[every_t]]
    if not samples_t or not len(every_t) or not len(every_o):
        return Model()
    used = np.unique(np.concatenate([every_o, *cal[: len(cal_t)]]))

    def lengths(dictionary: bytes) -> np.ndarray:
        own, out = _compressor(dictionary), np.zeros(len(all_.words), np.int64)
        out[used] = [compressed(own, all_.words[k]) for k in used.tolist()]
        return out

    trained = [{size: _train(size, samples) for size in dict.fromkeys(sizes)} for samples, sizes in ((samples_t, [t for t, _ in SIZES]), (samples_o, [o for _, o in SIZES]))]
    known = [{size: lengths(d) for size, d in side.items() if d} for side in trained]
    y = np.r_[np.ones(len(cal_t)), np.zeros(len(cal_o))]
    best: tuple[float, Model] | None = None
    for size_t, size_o in SIZES:
        if size_t not in known[0] or size_o not in known[1]:
            continue
        seen = np.clip(known[0][size_t] - known[1][size_o], -EDGE, EDGE) + EDGE
        in_toxic, in_ordinary = (np.bincount(seen[words], minlength=2 * EDGE + 1) + 0.05 for words in (every_t, every_o))
        ratio = np.minimum.accumulate((in_toxic / in_toxic.sum()) / (in_ordinary / in_ordinary.sum()))
        ratio[EDGE:] = np.minimum(ratio[EDGE:], 1)  # only a shorter toxic length speaks for toxic wording
        by = np.array([np.log(1 - rate + rate * ratio) for rate in RATES])
        sums = np.log1p([strongest(seen[words], by) for words in cal])
        quality = _ranked(sums[y == 0], sums[y == 1])
        if best is None or quality > best[0]:
            best = quality, Model(trained[0][size_t], trained[1][size_o], tuple(map(tuple, by.tolist())), *_logistic(sums, y))
    return best[1] if best else Model()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, fit_bytes: int = 32_000_000) -> Model:
    """The sample is chosen among the label rows, so at most 2 * per_class of
    them are broadcast to find their texts."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    chosen = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (1, 0)]
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # over 2 * per_class rows at most
    rows = one.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= fit_bytes).select("toxic", "text").collect()
    return fit_texts([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def _scores(texts: list[str | None], model: Model, evidence: Evidence | None) -> np.ndarray:
    if evidence is None:
        return np.zeros(len(texts))
    sums = np.array([evidence(t or "") for t in texts])
    return 1 / (1 + np.exp(-np.clip(model.slope * sums + model.offset, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= THRESHOLD)."""
    ship(docs.sparkSession)
    cols = docs.columns
    schema = docs.select("*").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model) if model.evidence else None
        for b in batches:
            s = _scores(b.column(cols.index("text")).to_pylist(), model, evidence)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*cols, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    inner = docs.toDF(*[f"c{k}" if c != "text" else "text" for k, c in enumerate(docs.columns)])
    return score(inner, fit(docs, labels)).where("predicted = 0").drop("score", "predicted").toDF(*docs.columns)
