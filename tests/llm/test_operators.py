"""The ten operators and the pipeline against brute force, on texts with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import string
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import avi_clips, backoff_lm, best_fit_pack, components, fair_mix, fair_toxicity, fuzzy_lines, lpt_shards, lsm_dedup, ranked_ids, simhash_golay, tokens

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = ["the", "red", "Fox", "runs", "über", "señor", "blue", "x", "9", "Straße", "and", "of", "hill", "tree", "cloud"]
#: Names that operators use inside, as columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, tag long, fp long, digest string, target double, h long, norm string, part int, row long"


def corpus(n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 60)))
        if i % 7 == 0 and rows:
            text = rnd.choice(rows)[1]
        if i % 11 == 0 and rows and rows[-1][1]:
            text = rows[-1][1].upper()
        if i % 13 == 0:
            text = (text or "") + "\nshared line of the corpus\n\t  spaced   out 　 é́"
        rows.append((i, {5: None, 17: "", 40: " \n\t "}.get(i, text), "en", [None, "b", "a", "ä"][i % 4], 0))
    rows += [rows[3], rows[3], (None, "no id here", "en", "b", 0), (None, None, None, None, None), (500, "word " * 3000, "en", "a", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "d", 0.5, 4, "n", 5, 6) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").translate(LOWER).encode().split()


# 4


def test_golay_words_two_bits_apart_share_a_key():
    patterns, count = simhash_golay.golay_tables()
    assert set(count.tolist()) == {1, 6}
    sets = [set(patterns[s, : count[s]].tolist()) for s in range(2048)]
    flips = [0, *(1 << i for i in range(23)), *((1 << i) | (1 << j) for i in range(23) for j in range(i))]
    for e, s_e in zip(flips, simhash_golay.syndrome(np.array(flips, np.uint32)).tolist()):
        assert all(any((p ^ e) in sets[s ^ s_e] for p in sets[s]) for s in range(2048))


def test_bucket_keys_join_all_near_fingerprints():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rnd.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for k, x in enumerate((a, b)):
        for row, key in zip(*simhash_golay.bucket_keys(x)):
            keys[k][int(row)].add(int(key))
    assert all(keys[0][i] & keys[1][i] for i in range(300))


def brute_fingerprint(text):
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("max_bucket", [4096, 2])
def test_simhash_components(spark, docs, max_bucket):
    rows = [r for r in corpus() if r[0] is not None]
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash_golay.simhash_components(spark, docs, words=4, bits=4, max_bucket=max_bucket).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == prints[r["doc_id"]]
            assert r["component_id"] == find(r["doc_id"])


def test_near_empty_and_kept(spark, docs, empty):
    assert simhash_golay.simhash_components(spark, empty).count() == 0
    kept = simhash_golay.keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 2
    assert simhash_golay.keep_first(spark, empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    n = 200
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(n + 1)}) == 1 and len({got[1000 + i] for i in range(n)}) == 1 and got[0] != got[1000]
    assert components.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# 5


@pytest.mark.parametrize("bits,keep", [(256, "max"), (4, "max"), (8, "min")])
def test_exact_dedup(spark, docs, bits, keep):
    rows = corpus()
    norm = lambda t: (t or "").translate(LOWER)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    got = lsm_dedup.exact_dedup(spark, docs, keep=keep, digest_bits=bits).collect()
    assert len(got) == len(rows)
    for r in got:
        (text,) = {norm(x[1]) for x in rows if x[0] == r["doc_id"] and hashlib.sha256(norm(x[1]).encode()).hexdigest() == r["text_sha256"]}
        known = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == ((max if keep == "max" else min)(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_keep_one(spark, docs, empty):
    kept = lsm_dedup.keep_one(spark, docs, keep="max")
    assert kept.columns == docs.columns
    assert kept.count() == len({(r[1] or "").translate(LOWER) for r in corpus()})
    assert lsm_dedup.keep_one(spark, empty).count() == 0


# 2


def test_lpt_matches_the_plain_rule():
    rnd = random.Random(5)
    for _ in range(50):
        runs = [(w, n, w * n) for w, n in sorted(((rnd.randint(1, 500), rnd.randint(1, 300)) for _ in range(20)), reverse=True)]
        plan, loads, plain = lpt_shards.lpt(runs, 8), [0] * 8, [0] * 8
        for (_, sums), (w, n, _) in zip(plan, runs):
            assert sums[-1] == n
            for s in range(8):
                loads[s] += w * (sums[s] - (sums[s - 1] if s else 0))
            for _ in range(n):
                plain[plain.index(min(plain))] += w
        assert sorted(loads) == sorted(plain)


def test_heavy_groups_go_where_the_plain_rule_puts_them(spark):
    rnd = random.Random(2)
    rows = [(i, chr(97 + i % 26) * rnd.randint(1, 90_000)) for i in range(120)]
    rows += [(1000 + i, "hot" * 5000) for i in range(300)]
    got = {r["doc_id"]: r["shard"] for r in lpt_shards.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()}
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    weights = {t: len(ids) * (len(t) + 1) for t, ids in groups.items()}
    assert max(weights.values()) > 1 << 22 and len(set(weights.values())) == len(weights)
    loads, want = [0] * 8, {}
    for t in sorted(weights, key=weights.get, reverse=True):
        s = loads.index(min(loads))
        loads[s] += weights[t]
        want |= dict.fromkeys(groups[t], s)
    assert got == want


def test_shards(spark, docs, empty):
    got = lpt_shards.shard(spark, docs, shards=8).collect()
    rows = corpus()
    assert len(got) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    shard_of, slots = {}, collections.defaultdict(list)
    for r in got:
        assert r["size"] == text[r["text_crc32"]] and r["law"] == "bytes" and r["grown_shard"] is None
        assert shard_of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert lpt_shards.shard(spark, empty).count() == 0


# 3


def test_avi_round_trip_and_torn_media(spark, docs, empty):
    rnd = np.random.default_rng(2)
    c = rnd.integers(-128, 128, (40, 9, 64)).astype(np.int16)
    c[rnd.random(c.shape) < 0.9] = 0
    c[0], c[1], c[2], c[3, :, 1:] = 0, 127, -128, 0
    head = avi_clips.parse_header(avi_clips.header(24, 24))
    assert (avi_clips.decode_scans(avi_clips.encode_scans(c), head) == c).all()
    medium = avi_clips.store(b"some text" * 400)
    errors = [x[3] for x in avi_clips.decoded([None, b"", b"xx", medium, medium[:300], medium[:700] + bytes(100) + medium[800:]])]
    assert errors[:3] == ["empty", "empty", "not AVI"] and errors[3] == "" and errors[4] and len(errors) == 6
    got = avi_clips.media_digests(spark, docs).collect()
    want = collections.Counter()
    for r in corpus():
        raw = (r[1] or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want[r[0], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])] += 1
    assert want == collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    assert avi_clips.media_digests(spark, empty).count() == 0


def test_shots_and_clips(spark):
    flat = lambda v, n: np.tile(np.array([v] + [0] * 63, np.int16), (n, 9, 1))
    scans = avi_clips.encode_scans(np.concatenate([flat(-400, 10), flat(0, 15), flat(400, 5)]))
    head = avi_clips.header(24, 24)
    medium = avi_clips.write_avi([head + s + b"\xff\xd9" for s in scans], 24, 24, 25)
    at = medium.find(b"idx1")
    plain = medium[:at]  # without an index the movi list is walked
    rows = avi_clips.clips(spark, spark.createDataFrame([(1, bytearray(medium)), (2, bytearray(plain)), (3, None)], "doc_id long, media binary")).collect()
    for d in (1, 2):
        assert [(r["first_frame"], r["frames"], r["start_s"], r["end_s"]) for r in rows if r["doc_id"] == d] == [(0, 10, 0.0, 0.4), (10, 15, 0.4, 1.0), (25, 5, 1.0, 1.2)]
    assert [r["error"] for r in rows if r["doc_id"] == 3] == ["empty"]


# 6 and 10: tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_have_the_ids_of_whole_texts(name):
    path, rnd = public_tokenizers.path(name), random.Random(4)
    whole = Tokenizer.from_file(path)
    letters = [*" \n\t\r ab'sdé́.,1 　\x1cÀß🙂!*_²Σς", "<|endoftext|>", "<|startoftext|>", "<|end"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += [r[1] or "" for r in corpus()] + ["a\x00b \x00", "<|endoftext|> x", "<|endoftext|><|endoftext|>", "A<|STARTOFTEXT|>", "it's<|endoftext|>'s", "x" * 1_000_000, "ΟΔΟΣ ΟΔΟΣ.", "don't I'll", "x" * 5000]
    got = tokens.Encoder(path).encode(texts)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_variable_length_codes():
    rnd = np.random.default_rng(1)
    for top in (1, 300, 70_000, 1 << 25, 1 << 32):
        for n in (0, 1, 5, 1000):
            x = rnd.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (ranked_ids.decode_ranks(*ranked_ids.encode_ranks(x), n) == x).all()


def test_ranked_ids(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    rows = sorted((r for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    want, start = [], 0
    for r in rows:
        ids = np.array([*encoder.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in ranked_ids.ranked_ids(spark, docs, path).orderBy("start").collect()]
    assert got == want
    assert ranked_ids.ranked_ids(spark, empty, path).count() == 0


def best_fit_decreasing(items, capacity):
    room = []
    for s in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=room.__getitem__)] -= s
        else:
            room.append(capacity - s)
    return len(room)


def test_packing_plan():
    rnd = random.Random(6)
    for _ in range(200):
        capacity = rnd.choice([5, 10, 20, 50])
        items = [rnd.randint(rnd.choice([1, 1, capacity // 3]), capacity) for _ in range(rnd.randint(0, 50))]
        counts = collections.Counter(items)
        plan, held = best_fit_pack.Plan(counts, capacity), collections.defaultdict(list)
        for size, n in counts.items():
            first, base, each, before = (np.array(c) for c in zip(*plan.runs[size]))
            for k in range(n):
                r = int(np.searchsorted(first, k, "right")) - 1
                q, inside = divmod(k - first[r], each[r])
                held[int(base[r] + q)].append((int(before[r] + inside * size), size))
        for parts in held.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= capacity
        assert len(held) == plan.sequences <= best_fit_decreasing(items, capacity)


def test_pack(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Tokenizer.from_file(path)
    rows = best_fit_pack.pack(spark, docs, path, capacity=64, with_ids=True).collect()
    by_sequence, by_doc = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 256
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]] += r["length"]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter()
    for r in corpus():
        want[r[0]] += len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert by_doc == want
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 500)
    assert all(n == 64 for p, _, n in long if p) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:]))
    assert best_fit_pack.pack(spark, empty, path).count() == 0


# 7


def test_mix(spark, docs, empty):
    got = fair_mix.taken_words(spark, docs).collect()
    rows = corpus()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, cap = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2.0 * sizes[s] for s in order}
    target, left, budget = {}, set(order), 1.5 * sum(sizes.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if cap[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        for s in full:
            target[s] = cap[s]
            budget -= cap[s]
        left -= full
    want = sorted((round(target[r[3]], 6), sizes[r[3]], len(words_of(r[1]))) for r in rows)
    assert want == sorted((round(r["target"], 6), r["source_size"], r["size"]) for r in got)
    by_source = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[round(r["target"], 6), r["source_size"]] += r["taken"]
    assert all(abs(by_source[round(target[s], 6), sizes[s]] - target[s]) <= 256 for s in order)
    assert sum(by_source.values()) == math.floor(1.5 * sum(sizes.values()))
    again = fair_mix.taken_words(spark, docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert fair_mix.taken_words(spark, empty).count() == 0
    order = [r["virtual_finish"] for r in fair_mix.mix(spark, docs).collect()]
    assert order == sorted(order)
    mixed = fair_mix.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns
    full = docs.dropDuplicates(["doc_id"]).where("text rlike '[a-zA-Z0-9]'")
    whole = fair_mix.mix(spark, full).where("taken = size").groupBy("doc_id").count()
    once = fair_mix.mixed_documents(spark, full).groupBy("doc_id").count()
    assert sorted(map(str, whole.collect())) == sorted(map(str, once.collect())) and mixed.count() >= once.count()


@pytest.mark.parametrize("slice_words", [None, 7])
def test_mix_is_the_queue_of_virtual_finish_times(spark, slice_words):
    from pyspark.sql import functions as F

    rnd = random.Random(12)
    rows = [(i, "w " * rnd.randint(0, 40), rnd.choice(["a", "a", "b", "c", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {(r["doc_id"], r["repeat"]): r["h"] for k in (0, 1) for r in docs.select("doc_id", F.lit(k).alias("repeat")).select("doc_id", "repeat", fair_mix.shuffle_hash("doc_id", "repeat", 7).alias("h")).collect()}
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    queue = []
    for s in names:
        weight, at = (5, 2, 1)[names.index(s) % 3], 0
        own = [(k, hashes[d, k], d, len(t.split())) for d, t, x in rows if x == s for k in (0, 1)]
        for k, _, d, size in sorted(own):
            step = slice_words or size
            for j in range(-(-size // step) if size else 0):
                words = min(step, size - j * step)
                at += words
                queue.append((at / weight, d, size, k, j, words))
    left, want = math.floor(1.5 * sum(len(t.split()) for _, t, _ in rows)), []
    for f, d, size, k, j, words in sorted(queue):
        if left:
            want.append((d, k, j, f, min(words, left)))
            left -= min(words, left)
    got = [(r["doc_id"], r["repeat"], r["slice"], r["virtual_finish"], r["taken"]) for r in fair_mix.mix(spark, docs, slice_words=slice_words).collect()]
    assert got == want


# 8


def test_language_model(spark, docs, empty):
    rows = corpus()
    counts = [collections.Counter() for _ in range(3)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            s = ["<s>", *words_of(r[1]), "</s>"]
            for k in range(3):
                counts[k].update(tuple(s[j : j + k + 1]) for j in range(len(s) - k))
    total = sum(n for g, n in counts[0].items() if g != ("<s>",))
    distinct = len(counts[0]) - 1

    def p(g):
        if len(g) == 1:
            return (counts[0][g] + 1) / (total + distinct + 1)
        return (counts[len(g) - 1][g] + 4 * p(g[1:])) / (counts[len(g) - 2][g[:-1]] + 4)

    for order in (2, 3):
        want = []
        for r in rows:
            s = ["<s>", *words_of(r[1]), "</s>"]
            base = sum(math.log10(p((x,))) for x in s[1:])
            full = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j + 1]))) for j in range(1, len(s)))
            want.append((r[0] is None, r[0] or 0, len(s) - 1, sum(counts[0][(x,)] > 0 for x in s[1:]), total, round(base, 6), round(full, 6), held(r[0])))
        got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6), r["held_out"]) for r in backoff_lm.score(spark, docs, order=order).collect()]
        assert sorted(got) == sorted(want)
    assert backoff_lm.score(spark, empty).count() == 0


def test_walks_one_by_one_give_the_same():
    rnd = random.Random(5)
    texts = [[rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    names = sorted({w for t in texts for w in t})
    ids = {w: i for i, w in enumerate(names)}
    import zstandard

    tokens_of = np.array([ids[w] for t in texts for w in t], np.uint32)
    row = {"lengths": np.array([len(t) for t in texts], "<i8").tobytes(), "words": np.arange(100, 100 + len(names), dtype=np.uint64).tobytes(), "tokens": zstandard.ZstdCompressor().compress(tokens_of.tobytes()), "held_out": [i % 3 == 0 for i in range(40)]}
    grams = backoff_lm.Grams(row, 3)
    totals = [grams.counts(k).astype(float) for k in range(3)]
    one = backoff_lm.Automaton(grams, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 4.0)
    arcs = {(one.first[k - 1] + grams.prefix[k][i], int(grams.last[k][i])): (k, i) for k in (1, 2) for i in np.nonzero(totals[k] > 0)[0]}
    got = np.add.reduceat(one.walk(grams), grams.starts)
    failures = 0
    for a, b, score in zip(grams.starts, grams.ends, got):
        start = int(grams.at[0][a])
        state, total = (one.first[0] + start if totals[0][start] else 0), 0.0
        for w in grams.at[0][a + 1 : b].tolist():
            while state and (state, w) not in arcs:
                total, state, failures = total + one.back[state], one.fail[state], failures + 1
            k, i = arcs[state, w] if state else (0, w)
            total += one.weight[k][i]
            state = one.first[k] + i if k < 2 and totals[k][i] else one.first[1] + grams.suffix[2][i] if k == 2 else 0
        assert math.isclose(total, score, abs_tol=1e-9)
    assert failures > 50


def test_language_model_query_scores_trigrams(spark, tmp_path):
    from ledgerloom.llm import queries

    # In training a trigram tells the last word, a bigram doesn't.
    rows = [(i, "a m x" if i % 2 else "b m y") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op8_backoff_lm(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, bigrams = ({r["doc_id"]: r["score"] for r in backoff_lm.score(spark, docs, order=k, smoothing=4.0).collect()} for k in (3, 2))
    assert got == pytest.approx(want)
    assert all(got[d] > bigrams[d] + 0.05 for d in got)


def test_language_model_packing():
    rnd = np.random.default_rng(7)
    for x in (rnd.integers(0, 1 << 63, 500, dtype=np.uint64), rnd.integers(0, 1 << 40, 500, dtype=np.uint64) << np.uint64(8), np.array([7], np.uint64) << np.uint64(8)):
        x = np.unique(x)
        assert (backoff_lm.unpacked(backoff_lm.packed(x)) == x).all()


# 1


def test_counterfactual_pairs_lower_the_weight_of_identity_terms(spark):
    rnd = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = " ".join(rnd.choice(WORDS) for _ in range(12))
        if toxic:
            text += " idiot" if i % 2 else " scum"
        if toxic and rnd.random() < 0.8 or rnd.random() < 0.05:
            text += ". the muslim people went home"
        docs.append((i, text))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(1, "the muslim people went home"), (2, "the christian people went home"), (3, None), (4, "")], "doc_id long, text string")
    of = lambda fairness: {r["doc_id"]: r["score"] for r in fair_toxicity.score(spark, neutral, fair_toxicity.train(spark, d, y, fairness=fairness)).collect()}
    free, fair = of(0.0), of(50.0)
    assert abs(fair[1] - fair[2]) < 0.1 * abs(free[1] - free[2])
    assert fair[3] == fair[4]


def test_fit_minimises_the_plain_loss():
    rnd, n = random.Random(3), 6
    rows = [sorted(rnd.sample(range(n), rnd.randint(1, 4))) for _ in range(200)]
    labels = np.array([float(rnd.random() < (0.9 if 0 in r or 5 in r else 0.2)) for r in rows])
    pairs = [(sorted({*r, 5}), sorted({*r, 4} - {5})) for r in rows[:40]]

    def loss(w, b, fairness):
        z = [b + sum(w[i] for i in r) for r in rows]
        fit = sum(math.log1p(math.exp(-v)) if y else math.log1p(math.exp(v)) for v, y in zip(z, labels)) / len(rows)
        gap = sum((sum(w[i] for i in a) - sum(w[i] for i in c)) ** 2 for a, c in pairs) / len(pairs)
        return fit + 1e-3 * sum(x * x for x in w) + fairness * gap

    for fairness in (0.0, 2.0):
        w, b = fair_toxicity.minimise(rows, labels, pairs, n, 1e-3, fairness, steps=3000)
        best = loss(w, b, fairness)
        for _ in range(300):
            move = [rnd.gauss(0, rnd.choice([0.3, 0.03])) for _ in range(n + 1)]
            assert loss([x + m for x, m in zip(w, move)], b + move[n], fairness) >= best - 1e-9
    assert abs(w[5] - w[4]) < 0.3


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = fair_toxicity.toxicity(spark, docs, none).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert fair_toxicity.toxicity(spark, empty, none).count() == 0
    assert fair_toxicity.keep_clean(spark, docs, none).columns == docs.columns


def test_toxicity_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = fair_toxicity.toxicity(spark, d, y).join(y, "doc_id").where("held_out").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] and r["toxic"] for r in rows)
    assert caught / sum(r["toxic"] for r in rows) > 0.85 and caught / sum(r["predicted"] for r in rows) > 0.95


# 9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines(spark, empty):
    import regex

    rnd = random.Random(9)
    base = [" ".join(rnd.choice(WORDS) + rnd.choice("abc") for _ in range(40)) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(1, 5)):
            w = rnd.choice(base).split()
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(["new", "odd", "zip"])
            lines.append(rnd.choice([" ".join(w), " ".join(w).upper() + "!", "", "---"]))
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, "one"), (91, "one")]
    got = fuzzy_lines.line_classes(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    norm = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")
    nodes = sorted({norm(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if edit_distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9):
                root[find(a)] = find(b)
    seen, want = set(), collections.Counter()
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            c = find(norm(x)) if norm(x) else None
            want[d, i, c is None or c not in seen] += 1
            seen.add(c)
    assert collections.Counter((r["doc_id"], r["line_no"], r["kept"]) for r in got) == want
    assert len({find(n) for n in nodes}) < len(nodes)
    left = fuzzy_lines.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert len(left) == len(rows)
    assert fuzzy_lines.line_classes(spark, empty).count() == 0


def test_fuzzy_lines_find_the_pairs_of_edit_similarity_080(spark):
    """All pairs of lines of 8 to 60 words with up to a tenth of them changed, and of short lines with a letter changed."""
    rnd, rows = random.Random(3), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    for i in range(0, 1200, 2):
        a = [word() for _ in range(rnd.choice([4, 6, 8, 12, 20, 40, 60]))]
        b = list(a)
        if len(a) < 8:
            at = rnd.randrange(len(b))
            b[at] = b[at][:-1] + "z"
        for _ in range(len(a) >= 8 and rnd.randint(1, max(1, len(a) // 10))):
            b[rnd.randrange(len(b))] = word()
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
    near = [i for (i, a), (_, b) in zip(rows[::2], rows[1::2]) if edit_distance(a, b) <= math.floor(0.2 * max(len(a), len(b)) + 1e-9)]
    got = {r["doc_id"]: r["class_doc_id"] for r in fuzzy_lines.line_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 400 and sum(got[i + 1] == i for i in near) >= 0.9 * len(near)
    assert all(got[i] == i for i in range(0, 1200, 2)) and all(got[i + 1] in (i, i + 1) for i in range(0, 1200, 2))


def test_fuzzy_lines_lose_no_link_wherever_its_edits_are(spark):
    """Against all pairs: a letter changed in every word, words around a line, changes that no block outlives, short lines, a crowded beginning."""
    rnd, pairs = random.Random(12), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    twelve = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(12))
    pairs.append((twelve, " ".join(w[:2] + "z" + w[3:] for w in twelve.split())))
    pairs += [(a, f"one {a} end") for a in [line(40)]] + [("abcde", "abcdf"), ("abcdefgh ij", "bcdefgh iij")]
    for n in (1, 2, 3, 5, 8, 15, 30, 60):
        for kind in range(4):
            a = line(n)
            b, edits = list(a), math.floor(0.2 * len(a) * rnd.choice([0.5, 0.9, 1])) // 2 * 2
            places = [round(i * len(a) / max(edits, 1)) for i in range(edits)] if kind < 2 else rnd.sample(range(len(a)), edits)
            for k, at in reversed(list(enumerate(sorted(places)))):
                b[at:at + 1] = ["q"] if kind % 2 else ["q", b[at]] if k % 2 else []
            pairs.append((a, "".join(b)))
    crowd = [line(5) for _ in range(1)] * 100
    rows = [x for p in pairs for x in p] + [f"{c} {line(35)}" for c in crowd]
    rows += [" ".join(rows[-1].split()[:10] + [word() for _ in range(3)] + rows[-1].split()[13:])]
    norm = [" ".join(x.split()) for x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            m = max(len(norm[i]), len(norm[j]))
            close = abs(len(norm[i]) - len(norm[j])) <= 0.2 * m and (i < 2 * len(pairs) or i - j == 1)
            if close and edit_distance(norm[i], norm[j]) <= math.floor(0.2 * m + 1e-9):
                linked += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["class_doc_id"] for r in fuzzy_lines.line_classes(spark, spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert linked >= len(pairs) - 4 and got == {i: find(i) for i in range(len(rows))}


def test_fuzzy_lines_compare_all_pairs_without_shuffling_them(spark):
    """Lines of few syllables, which no filter parts well: what the comparison shuffles grows with the lines, not with their pairs."""
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    syllables = ["th", "in", "er", "an", "re", "on", "e ", "es ", "ing ", "to "]
    lines = ["".join(rnd.choice(syllables) for _ in range(300)) for _ in range(120)]
    lines.append("".join("z" if i % 6 == 0 else x for i, x in enumerate(lines[7])))
    texts = spark.createDataFrame([(i, x, i) for i, x in enumerate(lines)], "h long, norm string, root long").withColumn("norm", F.trim("norm"))
    sc = spark.sparkContext
    none, store = sc._gateway.new_array(sc._jvm.double, 0), sc._jsc.sc().statusStore()

    def shuffled() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    assert [(r["a"], r["b"]) for r in fuzzy_lines.rest_links(spark, texts).collect()] in ([(7, 120)], [(120, 7)])
    assert shuffled() - before < 5 * sum(map(len, lines))


def test_fuzzy_lines_very_long_and_wordless(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(1_000_000))
    one = "".join(rnd.choice("abcdefgh") for _ in range(200_000))
    rows = [(1, long), (2, long[:500_000] + " zz " + long[500_000:]), (3, one), (4, one[:-1]), (5, "--\n\n!"), (6, None)]
    got = {(r["doc_id"], r["line_no"]): r["class_doc_id"] for r in fuzzy_lines.line_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0): 1, (2, 0): 1, (3, 0): 3, (4, 0): 3, (5, 0): None, (5, 1): None, (5, 2): None, (6, 0): None}


# Pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "pack":
            assert out.columns == docs.columns
        if name == "exact dedup":
            assert out.count() == len({(r["text"] or "").translate(LOWER) for r in docs.collect()})
        if name == "near dedup":
            kept, all_rows = {r["doc_id"] for r in out.collect()}, simhash_golay.similar_components(spark, docs).collect()
            assert kept - {None} == {r["component_id"] for r in all_rows} - {None}
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_stage_finds_all_documents_of_similarity_080(spark, empty):
    import corpus_pipeline

    rnd, rows = random.Random(4), []
    vocabulary = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(3000)]
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([60, 100, 300, 1000]))]
        rows.append((len(rows) * 7 % 1009, " ".join(base)))
        for _ in range(3):
            w = list(base)
            for _ in range(rnd.randint(1, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, None), (2001, " \n"), (2002, "one"), (2003, "ONE"), (None, rows[0][1]), (None, None)]

    def shingles(text):
        w = (text or "").translate(LOWER).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)], links = find(j), links + 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = collections.Counter(d for i, (d, _) in enumerate(rows) if d is None or d == least[find(i)])
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == want
    assert links > 100
    assert corpus_pipeline.near(spark, empty, "").count() == 0


def test_buckets_of_many_unlike_nodes(spark):
    from ledgerloom.llm import buckets

    # Nodes of a family share a crowded key and one of a few others; only neighbours of a family are alike.
    rows = [(7, h) for h in range(400)] + [(100 + h // 8, h) for h in range(400)] + [(1000 + h // 2, h) for h in range(400)] * 2
    seen = []

    def verified(pairs, held):
        assert held.count() == 400
        seen.append(pairs.count())
        return buckets.stored(spark, pairs.where("a div 2 = b div 2").distinct(), "links")

    got = {r["node"]: r["root"] for r in buckets.alike(spark, spark.createDataFrame(rows, "key long, h long"), lambda nodes: buckets.stored(spark, nodes, "nodes"), verified).collect()}
    assert all(got[h] == got[h ^ 1] for h in range(400)) and len(set(got.values())) == 200
    assert sum(seen) < 6000


def test_every_pair_of_a_crowded_bucket_meets(spark):
    from ledgerloom.llm import buckets

    # One key is all that 300 nodes share; partners have nothing else in common, and one link is of members of two groups.
    links = spark.createDataFrame([(3, 250), (17, 40), (17, 41), (40, 299), (120, 121), (41, 120)], "a long, b long")

    def verified(pairs, held):
        return buckets.stored(spark, pairs.join(links, ["a", "b"]), "links")

    rows = spark.createDataFrame([(7, h) for h in range(300)] + [(8, 17), (8, 40)], "key long, h long")
    got = {r["node"]: r["root"] for r in buckets.alike(spark, rows, lambda nodes: buckets.stored(spark, nodes, "nodes"), verified, every=True).collect()}
    assert set(got) == {3, 250, 17, 40, 41, 299, 120, 121}
    assert got[3] == got[250] and len({got[h] for h in (17, 40, 41, 299, 120, 121)}) == 1 and len(set(got.values())) == 2


def test_a_common_passage_makes_no_pairs_of_all_documents(spark, monkeypatch):
    """300 documents share sections of a passage; the only near copies among them are found, whole sets are joined for few pairs."""
    rnd, rows = random.Random(5), []
    word = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(6))
    passage = [word() for _ in range(60)]
    for i in range(300):
        rows.append((i, " ".join(passage + [word() for _ in range(rnd.randint(20, 40))])))
    rows += [(500 + i, f"{rows[i][1]} {word()}") for i in (3, 150, 299)]
    met, alike = [], simhash_golay.alike

    def counted(spark, keys, fetched, verified, **more):
        def counting(pairs, held):
            met.append(pairs.count())
            return verified(pairs, held)

        return alike(spark, keys, fetched, counting, **more)

    monkeypatch.setattr(simhash_golay, "alike", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash_golay.similar_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 500 if i >= 500 else i for i, _ in rows}
    # The last pass, in which all that share a bucket would be 44,850 pairs.
    assert met[-1] < 12_000


def test_rare_shingles_hold_one_of_each_similar_pair(spark):
    from ledgerloom.llm import buckets

    rnd, sets = random.Random(8), {}
    for h in range(0, 120, 2):
        base = set(range(30)) | {rnd.randrange(100, 10_000) for _ in range(rnd.randint(1, 60))}
        sets[h], sets[h + 1] = base, set(rnd.sample(sorted(base), len(base) - rnd.randint(0, len(base) // 5))) | {rnd.randrange(100, 10_000) for _ in range(rnd.randint(0, 4))}
    crowd = spark.createDataFrame([(h, h) for h in sets], "h long, root long")
    keyed = buckets.stored(spark, simhash_golay.rare_shingles(crowd, spark.createDataFrame([(h, sorted(s)) for h, s in sets.items()], "h long, shingles array<long>")), "rare")
    got = {(r["a"], r["b"]) for r in buckets.dealt(keyed, buckets.unlike(keyed), simhash_golay.may_be_similar()).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert 20 < len(want) and want <= got and len(got) < 2 * len(want)


def test_copies_around_an_original_are_one_group(spark):
    from ledgerloom.llm import buckets

    # 300 copies share ten keys each with the original, and few with each other; only the original is alike to all.
    rnd, rows, pairs = random.Random(3), [(k, 999) for k in range(40)], []
    for h in range(300):
        rows += [(k, h) for k in rnd.sample(range(40), 10)]

    def verified(met, held):
        pairs.append(met.count())
        return buckets.stored(spark, met.where("a = 999 or b = 999"), "links")

    got = {r["node"]: r["root"] for r in buckets.alike(spark, spark.createDataFrame(rows, "key long, h long"), lambda nodes: buckets.stored(spark, nodes, "nodes"), verified).collect()}
    assert len(got) == 301 and len(set(got.values())) == 1 and pairs == [300]


def test_clean_documents_stay(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    kept = {r[0] for r in corpus_pipeline.clean(spark, d, "/root/testdata/sf0.1").select("doc_id").collect()}
    y = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert sum(r["doc_id"] in kept for r in y if not r["toxic"]) > 0.99 * sum(not r["toxic"] for r in y)
