"""Best-fit packing of documents into sequences of a fixed number of tokens, after Martello-Toth dominance reduction.

Documents longer than a sequence are cut: all pieces but the first fill a sequence. What is left is bin packing with
sizes from 1 to the capacity, so the whole instance is a count for each size, and a plan works on counts:

reduction  For the largest size j, a set F with j that dominates every other feasible set with j is fixed for good: no
           packing is better without it. A set dominates another if its items can stand for the other's, each for one or
           several that are no larger together (Martello and Toth). Tested are {j} if nothing else fits; {j, k} for the
           largest k that fits, if k fills the sequence, or no two items fit with j, or no three do and no two that do are larger than k
           together; and {j, a, b} with a the largest that fits, b the largest after it, if no three fit and every two
           that do can be stood for by a and b. A set is fixed as many times as its items allow.
best fit   The rest goes in decreasing order of size to the fullest sequence that has room, many equal items and equal
           sequences at once, with the same result as one by one.

The plan has a few runs for each size, so the driver's work and memory depend on the capacity alone. Documents find their
places by number among those of their size: counts of (part, size) are accumulated, and each piece adds its number in its part.

Edge cases: a null text counts as empty and has the end id alone; repeated rows are documents of their own; null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, stored, text_of
from ledgerloom.llm.tokens import Encoder, slices

CAPACITY, END_ID, CHARS = 1024, 2, 2_000_000
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 400_000


class Plan:
    """runs[size]: (first number of the size's items, first sequence, items of the size a sequence, offset of the first)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.sequences = capacity, 0
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in range(1, capacity + 1)}
        self.reduced = 0
        self.reduce()
        self.best_fit()

    def put(self, size: int, items: int, sequence: int, each: int, offset: int) -> None:
        self.runs[size].append((int(self.used[size]), sequence, each, offset))
        self.used[size] += items
        self.left[size] -= items

    def fix(self, parts: list[int], times: int) -> None:
        """Closes `times` sequences with the sizes `parts`."""
        offset = 0
        for size in sorted(set(parts), reverse=True):
            each = parts.count(size)
            self.put(size, times * each, self.sequences, each, offset)
            offset += size * each
        self.sequences += times
        self.reduced += times

    def dominating(self, j: int) -> list[int] | None:
        room = self.capacity - j
        rest = self.left.copy()
        rest[j] -= 1
        sizes = np.nonzero(rest[: room + 1])[0]
        if not len(sizes):
            return [j]
        k = int(sizes[-1])
        if k == room:
            return [j, k]
        smallest = np.repeat(sizes[:3], np.minimum(rest[sizes[:3]], 3))[:3]
        if len(smallest) < 2 or smallest[:2].sum() > room:
            return [j, k]
        if len(smallest) == 3 and smallest.sum() <= room:
            return None
        # Two items fit, three don't: for each second item the largest first one that fits with it.
        pairs = []
        for y in sizes.tolist():
            x = sizes[: np.searchsorted(sizes, room - y, "right")]
            x = x[(x > y) | (x == y) & (rest[y] > 1)]
            if len(x):
                pairs.append((int(x[-1]), y))
        if all(x + y <= k for x, y in pairs):
            return [j, k]
        b = [y for y in sizes.tolist() if y <= room - k and (y != k or rest[k] > 1)]
        if b and all(y <= b[-1] or x + y <= k for x, y in pairs):
            return [j, k, b[-1]]
        return None

    def reduce(self) -> None:
        for j in range(self.capacity, 0, -1):
            while self.left[j]:
                found = self.dominating(j)
                if found is None:
                    break
                times = min(int(self.left[s]) // found.count(s) for s in set(found))
                self.fix(found, max(1, times))

    def best_fit(self) -> None:
        """open_runs[r]: runs (first sequence, sequences) with room r."""
        open_runs: dict[int, list[tuple[int, int]]] = {}
        for size in range(self.capacity, 0, -1):
            room = size
            while self.left[size]:
                while room <= self.capacity and not open_runs.get(room):
                    room += 1
                if room > self.capacity:
                    each = self.capacity // size
                    n = -(-int(self.left[size]) // each)
                    first, count, room = self.sequences, n, self.capacity
                    self.sequences += n
                else:
                    first, count = open_runs[room].pop()
                each = room // size
                items = int(min(self.left[size], count * each))
                full, more = divmod(items, each)
                self.put(size, items, first, each, self.capacity - room)
                for sequences, at, inside in ((full, first, each), (1 if more else 0, first + full, more), (count - full - (more > 0), first + full + (more > 0), 0)):
                    if sequences and room - inside * size:
                        open_runs.setdefault(room - inside * size, []).append((at, sequences))
                # Sequences that took items have less room than the size now, but for the last one when items ran out.
                room = size


def pieces_of(tokenizer: str, capacity: int, with_ids: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seen = TaskContext.get().partitionId(), Encoder.of(tokenizer, remembered), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist(), CHARS):
                doc, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for d, x in zip(batch.column(0).slice(at, len(texts)).to_pylist(), encoder.encode(texts)):
                    x += end
                    total = len(x) // 4
                    first = (total - 1) % capacity + 1
                    for i in range(-(-total // capacity)):
                        a, n = (0, first) if i == 0 else (first + (i - 1) * capacity, capacity)
                        own = x[4 * a : 4 * (a + n)]
                        doc.append(d), piece.append(i), start.append(a), length.append(n), crc.append(zlib.crc32(own)), nth.append(int(seen[n]))
                        seen[n] += 1
                        if with_ids:
                            ids.append(own)
                out = {"part": pa.array([part] * len(doc), pa.int32()), "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "nth": pa.array(nth, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    return run


def placed(runs: dict[int, list[tuple[int, int, int, int]]]):
    tables = {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in runs.items() if r}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            size, nth = t["length"].to_numpy(), t["number"].to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                rows = np.nonzero(size == s)[0]
                first, base, each, before = tables[s]
                r = np.searchsorted(first, nth[rows], "right") - 1
                q, inside = np.divmod(nth[rows] - first[r], each[r])
                sequence[rows], offset[rows] = base[r] + q, before[r] + inside * s
            t = t.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.combine_chunks().to_batches()

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): a row for each piece; with_ids adds the ids as bytes."""
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    more = ", ids binary" * with_ids
    cut = slim.mapInArrow(pieces_of(tokenizer, capacity, with_ids, remembered), f"part int, doc_id long, piece int, start long, length long, ids_crc32 long, nth long{more}")
    pieces = stored(spark, cut, "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(before, ["length", "part"]).select(*own, (F.col("before") + F.col("nth")).alias("number"))
    return ranked.mapInArrow(placed(plan.runs), f"doc_id long, piece int, start long, length long, ids_crc32 long{more}, sequence_id long, offset long")
