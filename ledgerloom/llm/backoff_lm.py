"""Language-model scores from a weighted backoff automaton.

Model. The states are histories of up to `order` - 1 tokens, the arcs of a state the tokens seen after it in training, with
smoothed weights, and a failure arc with a backoff weight leads to the state without the oldest token:

    P(w)      = (c(w) + 1) / (N + V + 1)                      c: count, N: all tokens, V: distinct ones
    P(w | h)  = (c(h w) + K P(w | h')) / (c(h) + K)           h': h without its oldest token
    arc weight   log10 P(w | h) where c(h w) > 0
    failure arc  log10 K / (c(h) + K)

A text is one walk from the state of its start, from left to right. Each token either has an arc, or failure arcs are taken
until a state has one (the empty state has arcs for all tokens; an unknown one takes the arc with c = 0); weights add up. An
arc leads to the longest history that was seen and ends with its token, wherever the walk came from: so the states before
all tokens of a block are known at once, and numpy takes the walks of all its texts together (tests walk one by one). Tokens are words with A-Z lower-cased and one end
for each text; the start is a state, not a token.

Nothing of the corpus is pruned, sampled or held in one place. Documents are stored as blocks of about BLOCK_TOKENS tokens:
a dictionary of word hashes and local ids. For each order, each block finds its own distinct n-grams and sends their hashes
and counts, in parts by hash, to the tasks that own the parts; each owner adds up training counts and answers each block
in the order asked. So a block receives exactly the part of the automaton that its documents can reach, builds its states,
arcs and failure arcs, and walks through it. Work and traffic grow with the text, memory with a block or a part, and a hot
n-gram is one entry of each block.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits: of n distinct ones about n^2 / 2^65 and n^2 / 2^57 pairs
clash (of a billion trigrams, seven).

Edge cases: a null or empty text is one end token; null ids are hashed as the empty text for the split and kept; repeated rows
are documents of their own (in training, too); without training rows every token is unknown; an empty table gives an
empty result; other columns are ignored. Memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, prepare, stored, text_of
from ledgerloom.llm.simhash_golay import LOWER

BLOCK_TOKENS = 450_000
#: N-grams of an owner's part, on average.
PART_TOKENS = 500_000
END, START = np.uint64(0xE4D), np.uint64(0x57A)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, lengths binary, words binary, tokens binary, n long"


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finalizer of splitmix64)."""
    h = h + MULTIPLY
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) -> blocks: distinct word hashes, and the texts as places in them."""
    part, count = TaskContext.get().partitionId(), 0
    ids, held, lengths, flat = [], [], [], []
    local: dict[bytes, int] = {}

    def block():
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in local), np.uint64, len(local))
        tokens = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        small = zstandard.ZstdCompressor(1).compress(tokens.tobytes())
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(part << 32) + count]), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "held_out": pa.array([held], pa.list_(pa.bool_())),
            "lengths": [np.array(lengths, "<i8").tobytes()], "words": [hashes.tobytes()], "tokens": [small], "n": pa.array([len(tokens)], pa.int64()),
        })

    total = 0
    for batch in batches:
        for d, h, t in zip(*(c.to_pylist() for c in batch.columns)):
            words = t.encode("utf-8", "surrogatepass").translate(LOWER).split()
            if total and total + len(words) > BLOCK_TOKENS:
                yield block()
                count, total, local = count + 1, 0, {}
                ids, held, lengths, flat = [], [], [], []
            new = local.setdefault
            flat.append(np.fromiter((new(w, len(local)) for w in words), np.uint32, len(words)))
            ids.append(d), held.append(h), lengths.append(len(words))
            total += len(words) + 1
    if ids:
        yield block()


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as gaps: of 5 bytes if the gaps of the upper 56 bits fit and the rest is zero, else as they are."""
    gaps = np.diff(keys, prepend=keys[:1]) >> np.uint64(8)
    if (keys & np.uint64(0xFF)).any() or gaps.max() >> np.uint64(40):
        return b"\x08" + keys.tobytes()
    return b"\x05" + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, np.uint64, offset=1)
    raw = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 5)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, 1:6] = raw
    return np.frombuffer(data, np.uint64, 1, 1) + np.cumsum(gaps.reshape(-1).view(np.uint64))


def narrowed(counts: np.ndarray) -> bytes:
    """Counts in the fewest whole bytes, after a byte that says how many."""
    most = int(counts.max(initial=0))
    size = next(n for n in (1, 2, 4, 8) if most < 1 << (8 * n))
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


class Grams:
    """The n-grams of a block: at[k][i] is the place, among the distinct (k+1)-grams, of the one that ends with token i.
    prefix[k], suffix[k] and last[k] are the places of a distinct (k+1)-gram's first and last k tokens and of its last token.

    Each text is laid out as start, words, end. N-grams that would reach back beyond a text's start don't exist: at is -1.
    """

    def __init__(self, row: dict, order: int):
        lengths = np.frombuffer(row["lengths"], "<i8")
        words = np.concatenate([np.frombuffer(row["words"], np.uint64), [END, START]])
        stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint32)
        self.ends = np.cumsum(lengths + 2)
        starts = self.ends - lengths - 2
        token = np.full(int(self.ends[-1]), len(words) - 2, np.int64)
        inside = np.ones(len(token), bool)
        inside[starts] = inside[self.ends - 1] = False
        token[inside] = stream
        token[starts] = len(words) - 1
        self.starts, self.lengths = starts, lengths
        self.position = np.arange(len(token)) - np.repeat(starts, lengths + 2)
        self.train = np.repeat(~np.array(row["held_out"], bool), lengths + 2)
        order_of = np.argsort(words, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order_of] = np.arange(len(words))
        self.keys, self.at = [words[order_of]], [rank[token]]
        self.prefix, self.suffix, self.last = [None], [None], [np.arange(len(words))]
        for k in range(1, order):
            old = np.concatenate([[-1], self.at[-1][:-1]])
            code = old * len(words) + self.at[0]
            code[self.position < k] = -1
            distinct, where, place = np.unique(code, return_index=True, return_inverse=True)
            skip = int(len(distinct) > 0 and distinct[0] == -1)
            older, last = np.divmod(distinct[skip:], len(words))
            hashes = mixed(self.keys[-1][older] * np.uint64(3) + mixed(self.keys[0][last])) & ~np.uint64(0xFF)
            by_hash = np.argsort(hashes, kind="stable")
            rank = np.empty(len(hashes) + 1, np.int64)
            rank[by_hash] = np.arange(len(hashes))
            rank[-1] = -1
            self.prefix.append(older[by_hash])
            self.suffix.append(self.at[-1][where[skip:]][by_hash])
            self.last.append(last[by_hash])
            self.keys.append(hashes[by_hash])
            self.at.append(rank[place - skip])

    def counts(self, k: int) -> np.ndarray:
        """Training counts of the distinct (k+1)-grams in this block."""
        use = self.at[k][self.train & (self.at[k] >= 0)]
        return np.bincount(use, minlength=len(self.keys[k]))


def cut_points(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of sorted keys begins: parts are equal ranges of the (spread) hash."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(k: int, parts: int):
    """blocks -> (part, block, keys, counts) of the (k+1)-grams, a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, k + 1)
                counts, keys, at = grams.counts(k), grams.keys[k], cut_points(grams.keys[k], parts)
                full = np.nonzero(np.diff(at))[0].tolist()
                keys_of, counts_of = ([f(x[at[p] : at[p + 1]]) for p in full] for f, x in ((packed, keys), (narrowed, counts)))
                del grams, counts, keys
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["block"]] * len(full), pa.int64()), pa.array(keys_of, pa.binary()), pa.array(counts_of, pa.binary())], names=["part", "block", "keys", "counts"])

    return run


def answered(frame: pd.DataFrame) -> pd.DataFrame:
    """All requests of a part -> the same rows with total counts; and, as block -1, N and V of what the part owns."""
    keys = [unpacked(x) for x in frame["keys"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate([widened(x) for x in frame["counts"]]), len(distinct)).astype("<u8")
    answers = [narrowed(x) for x in np.split(total[place], np.cumsum([len(x) for x in keys])[:-1])]
    out = pd.DataFrame({"part": frame["part"], "block": frame["block"], "totals": answers, "n": 0, "v": 0})
    words = distinct != START
    more = pd.DataFrame({"part": frame["part"].iloc[:1], "block": -1, "totals": [b""], "n": int(total[words].sum()), "v": int((total[words] > 0).sum())})
    return pd.concat([out, more])


class Automaton:
    """The part of the automaton that a block can reach, in arrays by n-gram.

    State 0 is the empty history, state first[k] + i the (k+1)-gram i of the block, if it was seen. The state of a history h has an
    arc for token w if h w was seen: weight[len(h)] of h w. back and fail are a state's failure arc: its weight, and the state
    without the oldest token. An arc leads to the state of the longest seen history that ends with its token.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, smoothing: float):
        self.order, self.seen = len(totals), [t > 0 for t in totals]
        self.first = np.cumsum([1, *map(len, grams.keys[: self.order - 1])])
        p, self.weight = (totals[0] + 1) / (n + v + 1), []
        back, fail = [np.zeros(1)], [np.zeros(1, np.int64)]
        for k in range(self.order):
            if k:
                p = (totals[k] + smoothing * p[grams.suffix[k]]) / (totals[k - 1][grams.prefix[k]] + smoothing)
            self.weight.append(np.log10(p))
            if k < self.order - 1:
                back.append(np.log10(smoothing / (totals[k] + smoothing)))
                fail.append(self.first[k - 1] + grams.suffix[k] if k else np.zeros(len(p), np.int64))
        self.back, self.fail = np.concatenate(back), np.concatenate(fail)

    def walk(self, grams: Grams) -> np.ndarray:
        """What each token of the block's texts adds, all walks from left to right at once: a token's walk begins in the state
        that the token before it led to, and takes failure arcs until a state has an arc for it."""
        led = np.zeros(len(grams.at[0]), np.int64)
        for k in range(self.order - 1):
            known = (grams.at[k] >= 0) & self.seen[k][grams.at[k]]
            led[known] = self.first[k] + grams.at[k][known]
        state = np.concatenate([[0], led[:-1]])
        total, todo = np.zeros(len(state)), grams.position > 0
        for k in range(self.order - 1, 0, -1):
            here = np.nonzero(todo & (state >= self.first[k - 1]))[0]
            gram = grams.at[k][here]
            has = self.seen[k][gram]
            total[here[has]] += self.weight[k][gram[has]]
            todo[here[has]] = False
            failed = here[~has]
            total[failed] += self.back[state[failed]]
            state[failed] = self.fail[state[failed]]
        return total + np.where(todo, self.weight[0][grams.at[0]], 0)


def walked(order: int, n: int, v: int, smoothing: float):
    """cogroup of a block and its answers -> scores of its documents."""

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not len(block):
            return pd.DataFrame({c: [] for c in columns})
        grams = Grams(block.iloc[0].to_dict(), order)
        answers = answers.sort_values(["k", "part"])
        totals = [np.concatenate([widened(x) for x in answers["totals"][answers["k"] == k]] or [np.zeros(0, "<u8")]).astype(np.float64) for k in range(order)]
        real, token = grams.position > 0, grams.at[0]
        c = totals[0][token]
        sums = lambda x: np.add.reduceat(np.where(real, x, 0), grams.starts)
        n_known, base = sums((c > 0).astype(np.int64)), sums(np.log10((c + 1) / (n + v + 1)))
        score = np.add.reduceat(Automaton(grams, totals, n, v, smoothing).walk(grams), grams.starts)
        doc_ids = pd.array([None if d is None or d != d else int(d) for d in block["doc_ids"].iloc[0]], dtype="Int64")
        return pd.DataFrame({"doc_id": doc_ids, "held_out": np.array(block["held_out"].iloc[0], bool), "n_tokens": grams.lengths + 1, "n_known": n_known, "base_score": base, "score": score})

    return run


def score(spark: SparkSession, docs: DataFrame, *, order: int = 3, smoothing: float = 4.0, folds: int = 7, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of docs."""
    prepare(spark)
    held = F.coalesce(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == held_fold, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_of().alias("text"))
    blocks = stored(spark, slim.mapInArrow(blocked, BLOCKS), "lm-blocks")
    parts = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS))
    answers = []
    for k in range(order):
        asked = blocks.mapInArrow(requests(k, parts), "part int, block long, keys binary, counts binary")
        answers.append(stored(spark, asked.groupBy("part").applyInPandas(answered, "part int, block long, totals binary, n long, v long"), "lm-answers"))
    n, v = answers[0].where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    mine = reduce(DataFrame.unionByName, [a.where("block >= 0").select("block", F.lit(k).alias("k"), "part", "totals") for k, a in enumerate(answers)])
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = stored(spark, blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInPandas(walked(order, n, v, smoothing), schema), "lm-scores")
    discard(spark, blocks, *answers)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
