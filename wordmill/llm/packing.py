"""Variable-capacity best-fit packing of documents into training sequences.

Items are placed in descending length, each into the open bin that it leaves
least room in. When none has room, the bin size is opened whose cost per token
is least given what is still to come: (capacity + overhead) / (item + the part
of the remaining room that shorter items still waiting could fill). At the end
each bin shrinks to the smallest permitted size that holds its contents.

Each task packs its own rows, `window` rows at a time: no shuffle, memory bounded
by the window, and at most a few half-filled bins for each window. A document
longer than the largest size becomes consecutive pieces of that size and a rest.
The unit is what the caller measures: `pack_encoded` counts the ids of each whole
text and its end id, so capacities are tokens and a null or empty text is its end
id; `pack` takes any length, and length null or 0 gives one row without a bin.
Repeated rows are packed once each. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32  # fixed cost of a sequence, in tokens
CHUNK = 256  # texts encoded at once in a worker
SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens long, bin_id long, bin_capacity int, bin_offset int"


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
    """Bin number, offset and final capacity of each item (sizes: 1 to max(capacities))."""
    caps = sorted(capacities)
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    volume = np.concatenate([np.cumsum(ordered[::-1])[::-1], [0]])  # of items from k on
    rising = -ordered
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    used: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, (i, size) in enumerate(zip(order.tolist(), ordered.tolist(), strict=True)):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:

            def cost(c: int, k: int = k, size: int = size) -> float:
                waiting = volume[max(k + 1, int(np.searchsorted(rising, size - c)))] if c > size else 0
                return (c + overhead) / (size + min(c - size, int(waiting)))

            left, b = min((c for c in caps if c >= size), key=lambda c: (cost(c), c)), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    final = np.array(caps)[np.searchsorted(caps, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final


def pieces(ids: list, totals: np.ndarray, largest: int):
    """Documents cut to at most `largest` tokens: row, piece number, start, size."""
    count = np.maximum(1, -(-totals // largest))
    row = np.repeat(np.arange(len(ids)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = number * largest
    return row, number, start, np.minimum(largest, totals[row] - start)


def pack(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, window: int = 50_000) -> DataFrame:
    """Bins for documents (doc_id, length): one row per piece, see SCHEMA.
    bin_id is unique over the whole result."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n")]
    return _packed(docs.select(*cols), None, capacities, overhead, window)


def pack_encoded(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, window: int = 50_000) -> DataFrame:
    """As pack, for documents (doc_id, text): the length is the number of ids of
    the whole text and one end id. Texts are encoded in the pass that packs them;
    only ids and lengths are held for a window."""
    return _packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, capacities, overhead, window)


def _packed(rows: DataFrame, tokenizer: str | None, capacities: tuple[int, ...], overhead: int, window: int) -> DataFrame:
    """rows: doc_id and length, or doc_id and text if there is a tokenizer."""
    ship(rows.sparkSession)
    largest, step = max(capacities), min(CHUNK, window) if tokenizer else window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from wordmill.llm.bytepair import encoder

        own = encoder(tokenizer) if tokenizer else None
        base, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal base
            table = pa.Table.from_batches(held)
            ids, totals = table.column(0).combine_chunks(), table.column(1).to_numpy()
            row, number, start, size = pieces(ids, totals, largest)
            full = size > 0
            bins, offsets, final = best_fit(size[full], capacities, overhead)
            out = {k: np.zeros(len(row), np.int64) for k in ("bin", "cap", "off")}
            out["bin"][full], out["cap"][full], out["off"][full] = bins + base, final[bins], offsets
            base += len(final)
            return pa.record_batch(
                [ids.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(out["bin"], mask=~full), pa.array(out["cap"], pa.int32(), mask=~full), pa.array(out["off"], pa.int32(), mask=~full)],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                if own is not None:
                    sizes = own.lengths([t or "" for t in piece.column(1).to_pylist()]) + 1  # the end id
                    piece = pa.record_batch([piece.column(0), pa.array(sizes)], names=["doc_id", "n"])
                held.append(piece)
                n += piece.num_rows
                if n >= window:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)
