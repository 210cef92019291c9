"""Near-duplicate documents: 64-bit SimHash of word shingles, linked through Golay-code fuzzy hashing.

Fuzzy keys. The binary Golay code (23, 12) is perfect: each 23-bit word lies within 3 bits of exactly one codeword.
A word that is 3 bits off its codeword also gets the five codewords that are 4 bits off. With these one or six keys any
two words at most 2 bits apart share a key (`golay_tables` builds the table, tests check the claim for all cosets).

Pigeonhole. A fingerprint has segments A (23 bits), B (23) and C (18). Let a + b + c <= 4 be the differing bits:
  a = 0 or b = 0 : the segment itself is the key;
  c = 0          : min(a, b) <= 2, so C with a Golay key of A, or C with one of B;
  else           : a and b are 1 or 2, so a Golay key of A with one of B.
So every link shares at least one of about 41 keys, and candidates are verified on all 64 bits.

Buckets. Rows of a key are compared in blocks of one task; only a spanning forest of the links leaves it, never all pairs.
A bucket over `max_bucket` rows is handed out of the task and compared again as pairs of sub-blocks in other tasks:
nothing is capped.

Similar documents (`similar_components`). Documents of Jaccard similarity 0.8 on their shingle sets differ in about ten bits
of a whole fingerprint, which no segment key finds. So a set also gives SimHashes of SECTIONS of its shingles: on each of
RINGS circles, ordered by a multiple of the hash, the SECTION shingles after each of POINTS places. A section is the
same in both sets with probability s^SECTION (0.26 at 0.8), so one of 40 is with 0.999994. Of a section's fingerprint the
indices of the nearest codewords of A and B and the bits of C are its key, so each set has 40 keys. Sets that share a key
are verified by an exact count of their common shingles.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; a null
doc_id takes part, and a group of only null ids has a null component_id; repeated rows give repeated result rows; other
columns are ignored; an empty table gives an empty result. Memory of a task grows with its longest text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.buckets import alike
from ledgerloom.llm.common import hash_filter, in_filter, prepare, stored, text_of, without, worker_cache
from ledgerloom.llm.components import components

GENERATOR, N, K = 0b110001110101, 23, 12
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 16
#: A similarity of 4 / 5, as integers; sections of a set.
SIMILARITY = (4, 5)
RINGS, POINTS, SECTION = 4, 10, 6
#: Bits of a set's sketch, of which two sets of a pair differ in no more than in shingles.
SKETCH = 1024
PLACES = (np.arange(POINTS, dtype=object) * (1 << 64) // POINTS).astype(np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of `words` words, repeats included; of the whole sequence if it is shorter."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, "<u8")
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text; zero without words."""
    return majority(shingle_hashes(text, words))


def section_prints(shingles: np.ndarray) -> np.ndarray:
    """SimHashes of the sections of a sorted set, RINGS * POINTS of them; shorter sets go around more than once."""
    out = np.zeros((RINGS, POINTS, SECTION), "<u8")
    for ring in range(RINGS):
        order = np.sort(shingles * np.uint64((2 * ring + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out[ring] = order[(np.searchsorted(order, PLACES)[:, None] + np.arange(SECTION)) % len(order)]
    bits = np.unpackbits(out.reshape(-1, SECTION).view(np.uint8).reshape(-1, SECTION, 8), axis=2, bitorder="little").sum(1)
    return np.packbits(2 * bits > SECTION, axis=1, bitorder="little").view("<u8")[:, 0]


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words as polynomials over GF(2), modulo the generator."""
    x = x.astype(np.uint32).copy()
    for bit in range(N - 1, N - K - 1, -1):
        x ^= ((x >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - (N - K)))
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """patterns[s, :count[s]]: error patterns from a word of syndrome s to its keys' codewords."""
    cache = worker_cache("simhash_golay")
    if "golay" not in cache:
        patterns, count = np.zeros((1 << (N - K), 6), np.uint32), np.zeros(1 << (N - K), np.int64)
        for weight in range(5):
            errors = np.array([sum(1 << i for i in c) for c in combinations(range(N), weight)], np.uint32)
            for s, e in zip(syndrome(errors).tolist(), errors.tolist()):
                if weight < 4 or patterns[s, 0].bit_count() == 3:
                    patterns[s, count[s]] = e
                    count[s] += 1
        cache["golay"] = patterns, count
    return cache["golay"]


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codeword indices (n, 6) of 23-bit words, and how many of each row count."""
    patterns, count = golay_tables()
    s = syndrome(x)
    return (x.astype(np.uint32)[:, None] ^ patterns[s]) >> np.uint32(N - K), count[s]


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, key) for all keys of all fingerprints."""
    fp = fp.astype(np.uint64)
    u = np.uint64
    a, b, c = fp & u((1 << 23) - 1), (fp >> u(23)) & u((1 << 23) - 1), fp >> u(46)
    (ka, na), (kb, nb) = golay_keys(a), golay_keys(b)
    ka, kb, six = ka.astype(np.uint64), kb.astype(np.uint64), np.arange(6)
    in_a, in_b = six < na[:, None], six < nb[:, None]
    tag = lambda t, v: (u(t) << u(60)) | v
    own = np.arange(len(fp))
    rows, keys = [own, own], [tag(0, a), tag(1, b)]
    for t, k, inside in ((2, ka, in_a), (3, kb, in_b)):
        rows.append(np.nonzero(inside)[0])
        keys.append(tag(t, (c[:, None] << u(12)) | k)[inside])
    inside = in_a[:, :, None] & in_b[:, None, :]
    rows.append(np.nonzero(inside)[0])
    keys.append(tag(4, (ka[:, :, None] << u(12)) | kb[:, None, :])[inside])
    return np.concatenate(rows), np.concatenate(keys)


def forest(pairs: np.ndarray) -> np.ndarray:
    """A spanning forest of the links: (member, representative)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([(x, find(x)) for x in root if find(x) != x], np.int64).reshape(-1, 2)


def near_pairs(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of different fingerprints of equal keys that differ in at most `bits` bits; rows are sorted by key."""
    u, found, i, k = fps.view(np.uint64), [], np.arange(len(keys)), 0
    while len(i):
        k += 1
        i = i[i + k < len(keys)]
        i = i[keys[i] == keys[i + k]]
        d = np.bitwise_count(u[i] ^ u[i + k])
        hit = i[(d <= bits) & (d > 0)]
        if len(hit):
            found.append(np.stack([fps[hit], fps[hit + k]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("over_key", pa.int64()), ("over_fp", pa.int64())])


def linker(bits: int, max_bucket: int | None):
    """For mapInArrow over (key, fp) sorted by key: links as (a, b), and rows of buckets over max_bucket as (over_key, over_fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys, fps):
            tree = forest(near_pairs(keys, fps, bits))
            none = pa.nulls(len(tree), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(tree[:, 0]), pa.array(tree[:, 1]), none, none], schema=LINKS)

        def over(keys, fps):
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(keys), pa.array(fps)], schema=LINKS)

        keys, fps, full = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if full is not None and len(keys):
                cut = int(np.searchsorted(keys, full, "right"))
                if cut:
                    yield over(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
                if not len(keys):
                    continue
                full = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last and len(keys) >= 20_000:
                yield links(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
                last = 0
            if max_bucket and len(keys) - last > max_bucket:
                if last:
                    yield links(keys[:last], fps[:last])
                yield over(keys[last:], fps[last:])
                full, keys, fps = keys[-1], keys[:0], fps[:0]
        if len(keys):
            yield links(keys, fps)

    return run


def near_links(spark: SparkSession, fps: DataFrame, bits: int = 4, max_bucket: int = 4096) -> DataFrame:
    """fps(fp), distinct -> links (a, b) whose transitive closure is that of all pairs at most `bits` <= 4 bits apart."""

    def keyed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2000):
                row, key = bucket_keys(fp[i : i + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[i : i + 2000][row])], names=["key", "fp"])

    schema = "a long, b long, over_key long, over_fp long"
    # Few bytes become many: as many tasks as there are cores, several times.
    keys = fps.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(keyed, "key long, fp long")
    found = stored(spark, keys.repartition("key").sortWithinPartitions("key").mapInArrow(linker(bits, max_bucket), schema), "near-links")
    links = found.where("a is not null").select("a", "b")
    over = found.where("over_key is not null").select(F.col("over_key").alias("key"), F.col("over_fp").alias("fp"))
    if not over.isEmpty():
        blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (max_bucket // 2)).cast("long").alias("blocks"))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        split = over.join(blocks, "key").select("key", "fp", mine.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
        again = split.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
        more = again.repartition("key").sortWithinPartitions("key").mapInArrow(linker(bits, None), schema)
        links = links.union(stored(spark, more, "near-links").select("a", "b"))
    return links.distinct()


def simhash_components(spark: SparkSession, docs: DataFrame, *, words: int = 5, bits: int = 4, max_bucket: int = 4096) -> DataFrame:
    """(doc_id, fp long, fingerprint hex, component_id): one row per row of docs."""
    prepare(spark)

    def hashed(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    prints = stored(spark, rows.mapInArrow(hashed, "doc_id long, fp long"), "fingerprints")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(spark, near_links(spark, each.select("fp"), bits, max_bucket)).withColumnRenamed("node", "fp")
    linked = each.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    group = linked.join(least, "root").select("fp", "component_id")
    return prints.join(group, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def section_keys(prints: np.ndarray) -> np.ndarray:
    """(documents, sections) -> one key each: section, nearest codewords of segments A and B, bits of C."""
    u, low = np.uint64, np.uint64((1 << N) - 1)
    patterns = golay_tables()[0][:, 0]
    nearest = lambda x: ((x ^ patterns[syndrome(x)]) >> np.uint32(N - K)).astype(np.uint64)
    a, b = (nearest((prints >> u(at) & low).astype(np.uint32)) for at in (0, N))
    return (u(5) << u(60)) | (np.arange(prints.shape[1], dtype=np.uint64) << u(42)) | (prints >> u(2 * N)) << u(24) | a << u(12) | b


def printed(words: int):
    """(doc_id, text) -> (doc_id, h, n, keys): the shingle set's hash and size, and the keys of a set with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            h = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            full = [s for s in sets if len(s)]
            keys = section_keys(np.array([section_prints(s) for s in full], np.uint64).reshape(-1, RINGS * POINTS)).reshape(-1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, RINGS * POINTS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], names=["doc_id", "h", "n", "keys"])

    return run


def sets_of(words: int):
    """(text) -> (h, shingles, sketch): a bit of the sketch is whether an odd number of shingles fall on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                s = np.unique(shingle_hashes(t, words))
                h = xxhash.xxh64_intdigest(s.tobytes(), 42)
                odd = np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([h], np.uint64).view(np.int64)), pa.array([s.view(np.int64)], pa.list_(pa.int64())), pa.array([odd], pa.list_(pa.int64()))], names=["h", "shingles", "sketch"])

    return run


def rare_shingles(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """crowd(h, root), sets(h, shingles) -> (key, h, root, n, at): of each set the shingles that only SIMILARITY of it leaves over, rarest first; n is the set's
    size and `at` the shingle's place. Sets of that similarity share one of these at least, as the others are too few.

    Shingles of one group alone can't be common to two, so they count as the rarest and have no row. What many sets hold, as a passage, is last."""
    each = crowd.join(sets, "h").select("h", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "c")
    common = each.join(often, "key").groupBy("h", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("common"))
    left = F.col("n") - F.ceil(F.col("n") * SIMILARITY[0] / SIMILARITY[1]).cast("int") + 1
    alone = F.col("n") - F.size("common")
    some = common.where(left > alone).select("h", "root", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), left - alone)).alias("i", "s"))
    return some.select(F.col("s.key").alias("key"), "h", "root", "n", (F.col("alone") + F.col("i")).alias("at"))


def may_be_similar() -> Column:
    """Whether two sets whose first common one of rare_shingles is a shingle can share enough: no more than the shorter rest."""
    rest = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    return sum(SIMILARITY) * rest >= SIMILARITY[0] * (F.col("n") + F.col("n_b"))


def similar_components(spark: SparkSession, docs: DataFrame, *, words: int = 5) -> DataFrame:
    """(doc_id, component_id): groups of documents whose shingle sets have a Jaccard similarity of SIMILARITY or more, or a
    chain of such links; one row per row of docs."""
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    prints = stored(spark, rows.mapInArrow(printed(words), "doc_id long, h long, n long, keys array<long>"), "shingle-prints")
    nodes = stored(spark, prints.groupBy("h").agg(F.min("doc_id").alias("least"), F.min("n").alias("n")), "shingle-nodes")

    def fetched(ends: DataFrame) -> DataFrame:
        places = nodes.join(ends, "h").select(F.xxhash64("least").alias("g"))
        tried = rows.withColumn("g", F.xxhash64("doc_id")).join(hash_filter(places, "g"), in_filter("g")).select("text")
        found = tried.mapInArrow(sets_of(words), "h long, shingles array<long>, sketch array<long>").join(hash_filter(ends, "h"), in_filter("h"))
        return stored(spark, found.groupBy("h").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")).withColumn("n", F.size("shingles")), "shingle-sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Sizes and sketches first: a pair of the similarity differs in a ninth of its shingles at most, and whole sets are sent for few others."""
        tried = pairs
        for end in ("a", "b"):
            tried = tried.join(sets.select(F.col("h").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
        differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda n, x: n + x)
        sized = SIMILARITY[1] * F.least("n_a", "n_b") >= SIMILARITY[0] * F.greatest("n_a", "n_b")
        tried = tried.where(sized & (sum(SIMILARITY) * differ <= (SIMILARITY[1] - SIMILARITY[0]) * (F.col("n_a") + F.col("n_b")))).select("a", "b")
        sized = stored(spark, tried, "shingle-pairs")
        both = sized.join(sets.select(F.col("h").alias("b"), F.col("shingles").alias("set_b")), "b")
        both = both.join(sets.select(F.col("h").alias("a"), F.col("shingles").alias("set_a")), "a")
        common, n = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
        return stored(spark, both.where(sum(SIMILARITY) * common >= SIMILARITY[0] * n).select("a", "b"), "shingle-links")

    group = alike(spark, prints.select(F.explode("keys").alias("key"), "h"), fetched, verified, every=True, rarely=(rare_shingles, may_be_similar()))
    linked = nodes.join(group, F.col("h") == F.col("node"), "left").select("h", F.coalesce("root", "h").alias("root"), "least")
    linked = stored(spark, linked, "shingle-nodes")
    least = stored(spark, linked.groupBy("root").agg(F.min("least").alias("component_id")), "shingle-least")
    named = stored(spark, linked.join(least, "root").select("h", "component_id"), "shingle-components")
    return prints.select("doc_id", "h").join(named, "h").select("doc_id", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, *, words: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is their component's, with all columns. Rows with null ids stay (nothing names them);
    rows of one doc_id stay together, unless some of them belong to another component."""
    rows = similar_components(spark, docs, words=words)
    gone = rows.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("first")).where("first = 0")
    gone = stored(spark, gone.select(F.col("doc_id").alias("__id")), "near-duplicates")
    return without(docs, gone, F.col("doc_id") == F.col("__id"))
