"""Exact byte-level BPE encoding and decoding by dynamic programming over the prefixes of pre-tokens.

A text is split at the strings of added tokens, then into pre-tokens by the pattern of byte-level vocabularies. In the BPE
encoding of a pre-token every prefix has one last token only: the encoding of a prefix is a sequence of tokens of which all
neighbours are compatible, and there is just one such sequence. So, from left to right:

matches     an automaton with suffix links over the vocabulary gives all tokens that end at a position;
compatible  token b may follow token a if merging their bytes gives a and b back. The right edge of a's merge tree and the
            left edge of b's tell which parts meet at the border and at what times; the pair is refused if two parts that
            meet have a merge that comes before both parts' own merges (an equal rank counts on the right side, as the
            leftmost of equal merges goes first);
prefix      of the tokens that end at a position, the one that is compatible with the last token of the prefix before it
            is stored; back-pointers from the end give the ids.

Time is linear in the text and the number of matches at a position, however long a pre-token is. Tokens that BPE never makes of
their own string are left out of the automaton. Ids of distinct pre-tokens are remembered in bounded memory. Characters that
this machine's pattern library and the tokenizer's pre-tokenizer class differently (found by probing each distinct character)
send their text's pre-tokenization to the tokenizer.

Decoding looks each id's bytes up and reads them as UTF-8, malformed sequences as U+FFFD; added tokens give their strings.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated rows are encoded each;
null ids of documents are kept; an empty table gives an empty result; other columns are ignored by encode and by round_trip.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import prepare, text_of, worker_cache
from ledgerloom.llm.tokens import Memory, byte_letters, packed, slices

#: Fixed: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handled at once, and pairs of tokens and pre-tokens remembered.
CHARS, PAIRS, REMEMBERED = 1 << 20, 1 << 20, 400_000
NEVER = 1 << 40


class PrefixBPE:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or model["type"] != "BPE" or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        to_byte = {chr(self.letters.get(b, b)): b for b in range(256)}
        vocab = model["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in added)]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.added = {a["content"]: a["id"] for a in added}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if added else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = [-1] * len(self.bytes_of)
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), r)
            if both not in self.parts:
                self.parts[both], self.born[both] = (a, b), r
        self.matches = ahocorasick.Automaton()
        made = set()
        for token, i in sorted(vocab.items(), key=lambda x: self.born[x[1]]):
            a, b = self.parts.get(i, (-1, -1))
            if len(token) == 1 and token in to_byte or a in made and b in made and self.meet(a, b, self.born[i]):
                made.add(i)
                self.matches.add_word(token, (i, len(token)))
        self.matches.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memory = Memory(lambda piece: packed(self.ids_of(self.lettered(piece))), REMEMBERED)
        self.same: dict[str, bool] = {}

    @staticmethod
    def of(path: str) -> PrefixBPE:
        cache = worker_cache("prefix_bpe")
        if ("prefix_bpe", path) not in cache:
            cache["prefix_bpe", path] = PrefixBPE(path)
        return cache["prefix_bpe", path]

    def meet(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether left and right both stand when all merges before rank `until` are made of their joined bytes."""
        left_until = right_until = until
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < left_until and r <= right_until:
                return False
            # Back in time: the part that was made later falls apart first.
            if self.born[left] >= self.born[right]:
                if left not in self.parts:
                    return True
                left_until, left = self.born[left], self.parts[left][1]
            else:
                right_until, right = self.born[right], self.parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.meet(left, right)
        return known

    def lettered(self, piece: str) -> str:
        """The piece's bytes as the letters that vocabularies use for bytes."""
        return piece.encode().decode("latin-1").translate(self.letters)

    def ids_of(self, piece: str) -> list[int]:
        """Ids of a pre-token in letters of bytes."""
        last: list[int] = [-1] * (len(piece) + 1)
        size = [0] * (len(piece) + 1)
        for end, (token, n) in self.matches.iter(piece):
            at = end + 1
            if last[at] < 0 and (at == n or self.compatible(last[at - n], token)):
                last[at], size[at] = token, n
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def agrees(self, c: str) -> bool:
        """Whether both pre-tokenizers class a character alike."""
        probe = f"a{c}1{c}! {c} "
        return [self.lettered(p) for p in self.pre_tokens(probe)] == [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text.isascii():
            chars = set(text)
            for c in chars.difference(self.same):
                self.same[c] = self.agrees(c)
            if not all(map(self.same.__getitem__, chars)):
                return b"".join(packed(self.ids_of(p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        return b"".join(map(self.memory.__getitem__, self.pre_tokens(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit bytes."""
        self.memory.age()
        if self.split_added is None:
            return self.plain(text)
        return b"".join(packed([self.added[part]]) if i % 2 else self.plain(part) for i, part in enumerate(self.split_added(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encode(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every text. `tokenizer` is a path that all executors have."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBPE.of(tokenizer)
        for batch in batches:
            for at, texts in slices(batch.column(1).to_pylist(), CHARS):
                flat = [np.frombuffer(bpe.encode(t), "<u4") for t in texts]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], ["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text): the texts of rows(doc_id, ids). Null ids decode to the empty text."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBPE.of(tokenizer)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text and decodes its ids in one pass over the texts."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBPE.of(tokenizer)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in slices(batch.column(1).to_pylist(), CHARS):
                for t in texts:
                    ids = np.frombuffer(bpe.encode(t), "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
