"""Divergence of sources: how the words of each source of a language differ from the other sources' and the whole language's.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at least `least`
of its documents have. A group, that is a (lang, source) that occurs, and each language as a whole give every kept term
p = 1 + floor(10^9 * (count + 1) / (N + V)), with V the language's kept terms and N the counts' sum. The divergence of p from q
is the sum of floor((p - q)^2 / q): of each group from each other one over all kept terms, and of a group from its language term by term.

Counting: tasks count terms of their documents and hand out partial counts whenever they hold many, so a common term is
combined before any shuffle. Kept terms of a language are dealt by hash into chunks of about `chunk` terms and numbered in them.

Tiling: a group's probabilities in a chunk are one packed row (terms it lacks have one probability, known for the group). Groups
are dealt by hash into blocks of about `block` groups, and each packed row goes to the tiles (its block, any block) of its slab,
a slab being `chunks` chunks in succession. A tile's rows arrive sorted by chunk; the task unpacks the rows of one chunk at a time to a
small matrix for either block, adds the chunk's part of both directions of every pair and goes on, so it holds two blocks of
one chunk, whatever the vocabulary. Parts of slabs are added up. Chunks in which no group of a tile has a term need no
row: there every term adds what the two probabilities of missing terms give. Pairs of groups are this audit's result, so
work grows with their number; rows are sent as often as there are blocks, not groups.

All arithmetic is exact: decimals where 10^9 * count may pass 64 bits, else integers (the sums stay below (10^9 + V)^2).

Edge cases: null text, lang and source read as ''; a document without terms makes its group occur; a group without kept terms has
N = 0; a language without kept terms has value 0 for all pairs and no term rows; a source alone in its language has no
pairs; ties of value go by the item's bytes; repeated rows are documents of their own; an empty table gives an empty result; other
columns, doc_id included, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, prepare, stored, text_of

#: On UTF-8, whose bytes beyond ASCII are 80 and up; `bytes.lower` changes A-Z only.
TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Counts that a task holds before it hands them out, and parts into which the rows of one language or group are dealt for a join.
HELD, SALTS = 500_000, 64
#: Terms in a chunk, chunks in a slab, groups in a block.
CHUNK, CHUNKS, BLOCK = 2048, 8, 16


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (text, lang, source); a row with a null term for every group met."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array([*n, None], pa.binary()).cast(pa.string())
            size = len(terms)
            columns = [pa.repeat(lang, size), pa.repeat(source, size), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for batch in batches:
        for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = TERMS.findall(text.encode().lower())
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            if held > HELD:
                yield from handed()
                held = 0
    yield from handed()


class Tile:
    """Two blocks of groups over the chunks of a slab. Side 0 has the groups of the first block, side 1 those of the second; a tile
    of a block with itself has one side only."""

    def __init__(self, key: tuple):
        self.key, self.names, self.missing, self.kept = key, ([], []), ([], []), 0
        self.place: tuple[dict, dict] = ({}, {})
        self.sums: list[np.ndarray] | None = None
        self.width = 0

    def group(self, side: int, name: str, missing: int, kept: int) -> None:
        self.kept = kept
        self.place[side][name] = len(self.names[side])
        self.names[side].append(name)
        self.missing[side].append(missing)

    def add(self, width: int, rows: list[tuple[int, str, bytes]]) -> None:
        """A chunk: packed rows (side, group, terms and probabilities)."""
        p = [np.repeat(np.array(m, np.int64)[:, None], width, 1) for m in self.missing]
        for side, name, cells in rows:
            at, value = np.frombuffer(cells, "<i4").reshape(-1, 2).T
            p[side][self.place[side][name], at] = value
        if self.key[1] == self.key[2]:
            found = [directed(p[0], p[0])]
        else:
            found = [directed(p[0], p[1]), directed(p[1], p[0])]
        self.sums = found if self.sums is None else [a + b for a, b in zip(self.sums, found)]
        self.width += width

    def rows(self) -> Iterator[tuple]:
        """(lang, source, other, value of the terms seen, terms seen, value of each other term, kept terms) of every pair"""
        for a, b in ((0, 0),) if self.key[1] == self.key[2] else ((0, 1), (1, 0)):
            sums = self.sums[a] if self.sums else None
            for i, (source, p) in enumerate(zip(self.names[a], self.missing[a])):
                for j, (other, q) in enumerate(zip(self.names[b], self.missing[b])):
                    if source != other:
                        yield self.key[0], source, other, 0 if sums is None else int(sums[i, j]), self.width, (p - q) * (p - q) // q, self.kept


def directed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """sums[i, j] of floor((p_i - q_j)^2 / q_j)."""
    return np.array([[((d := x - y) * d // y).sum() for y in q] for x in p], np.int64).reshape(len(p), len(q))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, low, high, slab, chunk, side, source, missing, width, cells) in order; headers of all groups have chunk -1 and all
    kept terms as width."""
    kinds = {"lang": pa.string(), "source": pa.string(), "other": pa.string(), "value": pa.int64(), "terms": pa.int64(), "rest": pa.int64(), "kept": pa.int64()}
    tile, chunk, width, rows, out = None, None, 0, [], []

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds.values())], list(kinds))

    def closed() -> list[tuple]:
        if rows:
            tile.add(width, rows)
        return list(tile.rows())

    for batch in batches:
        for lang, low, high, slab, number, side, source, missing, wide, cells in zip(*(c.to_pylist() for c in batch.columns)):
            if tile is None or tile.key != (lang, low, high, slab):
                if tile is not None:
                    out += closed()
                    if len(out) > 10_000:
                        yield made(out)
                        out = []
                tile, chunk, rows = Tile((lang, low, high, slab)), None, []
            if number < 0:
                tile.group(side, source, missing, wide)
                continue
            if number != chunk:
                if rows:
                    tile.add(width, rows)
                chunk, width, rows = number, wide, []
            rows.append((side, source, cells))
    if tile is not None:
        out += closed()
    if out:
        yield made(out)


def dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A packed row to each tile of its block: the side it stands on, and the tile's two blocks in order."""
    each = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side")
    return each.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slab", "chunk", side, "source", *columns)


def salted(facts: DataFrame) -> DataFrame:
    """A few facts of each language or group, once for each part into which its rows are dealt: a hot one is no single task."""
    return facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def probability(n: str, total: str, kept: str):
    """1 + floor(10^9 * (n + 1) / (total + kept)), exact."""
    return F.expr(f"1 + (1000000000BD * (cast({n} AS decimal(20,0)) + 1)) div (cast({total} AS decimal(20,0)) + {kept})").cast("bigint")


def divergence(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(spark: SparkSession, docs: DataFrame, *, least: int = 3, top: int = 200, chunk: int = CHUNK, chunks: int = CHUNKS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the `top` terms that a
    group has oftener than its language."""
    prepare(spark)
    slim = docs.select(text_of().alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    partial = slim.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    counts = stored(spark, partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counts.where("term IS NOT NULL")

    # Kept terms, numbered in chunks: chunks of a language are as many as its kept terms ask for.
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = stored(spark, kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    at = Window.partitionBy("lang", "chunk")
    numbered = (
        kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
        .join(salted(langs), ["lang", "salt"])
        .drop("salt")
        .withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / chunk)).cast("int"))
        .withColumn("at", F.row_number().over(at.orderBy("term")) - 1)
        .withColumn("width", F.count(F.lit(1)).over(at))
    )
    held = own = stored(spark, terms.select("lang", "source", "term", "n").join(numbered, ["lang", "term"]), "group-terms")

    # Groups, their totals and blocks.
    groups = counts.where("term IS NULL").select("lang", "source")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").join(langs, "lang", "left")
    blocks = F.ceil(F.col("groups") / block).cast("int")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block")
    ).withColumn("missing", F.when(F.col("kept") > 0, F.expr("1 + 1000000000BD div (total + kept)").cast("bigint")).otherwise(1))
    groups = stored(spark, groups, "groups")
    own = own.withColumn("salt", F.pmod("at", F.lit(SALTS)).cast("long")).join(salted(groups.select("lang", "source", "total", "blocks", "block")), ["lang", "source", "salt"]).drop("salt")
    own = own.withColumn("p", probability("n", "total", "kept")).withColumn("q", probability("lang_n", "lang_total", "kept"))

    # Part term: the first `top` of each task go to the group's task.
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    ranked_terms = over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    # Part pair: tiles.
    cell = F.struct(F.col("at").cast("int"), F.col("p").cast("int"))
    packed = own.groupBy("lang", "source", "chunk", "width", "blocks", "block").agg(F.collect_list(cell).alias("cells"))
    packed = packed.mapInArrow(packing, "lang string, source string, chunk int, width long, blocks int, block int, cells binary")
    slab = F.floor(F.col("chunk") / chunks).cast("int")
    slabs = F.floor((F.greatest(F.ceil(F.col("kept") / chunk), F.lit(1)) - 1) / chunks).cast("int")
    headers = groups.withColumn("slab", F.explode(F.sequence(F.lit(0), slabs))).withColumn("chunk", F.lit(-1))
    rows = dealt(headers, ["missing", F.col("kept").alias("width"), F.lit(None).cast("binary").alias("cells")]).unionByName(
        dealt(packed.withColumn("slab", slab), [F.lit(None).cast("long").alias("missing"), "width", "cells"])
    )
    tile = ["lang", "low", "high", "slab"]
    seen = rows.repartition(*tile).sortWithinPartitions(*tile, "chunk", "side", "source").mapInArrow(tiles, "lang string, source string, other string, value long, terms long, rest long, kept long")
    value = F.sum("value") + (F.max("kept") - F.sum("terms")) * F.max("rest")
    pairs = seen.groupBy("lang", "source", F.col("other").alias("item")).agg(value.alias("value")).withColumn("part", F.lit("pair"))
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(by))
    out = stored(spark, ranked_pairs.unionByName(ranked_terms).select("lang", "source", "part", "item", "value", "rank"), "divergence")
    discard(spark, counts, kept, held, groups)
    return out


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each row as pairs of little-endian 32-bit integers."""
    for batch in batches:
        cells = batch.column("cells")
        pairs = cells.flatten()
        flat = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], 1).astype("<i4") if len(pairs) else np.zeros((0, 2), "<i4")
        ends = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())]).astype(np.int64)
        data = pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([data if n == "cells" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)
