"""Source divergence, norm-screened clustering and prefix BPE against brute force and the tokenizers library."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import norm_kmeans, prefix_bpe, source_divergence

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Names that the operators use inside, as columns of the input.
EXTRA = "ids array<int>, term string, n long, chunk int, value long, cluster int, q string, form string, block int, kept long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, [1], "t", 1, 2, 3, 4, "q", "f", 5, 6) for r in rows], f"doc_id long, text string, lang string, source string, {EXTRA}")


# 11


def divergences(rows, least, top):
    docs = [(tuple(x or "" for x in (lang, source)), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = set()
    for lang in {g[0] for g, _ in docs}:
        df = collections.Counter(t for g, terms in docs if g[0] == lang for t in set(terms))
        kept = [t for t in df if df[t] >= least]
        count = collections.defaultdict(collections.Counter)
        for g, terms in docs:
            if g[0] == lang:
                count[g[1]].update(t for t in terms if df[t] >= least)
        every = sum(count.values(), collections.Counter())

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, of = p(every), {s: p(c) for s, c in count.items()}
        for s in of:
            pair = sorted(((-sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o.encode()) for o in of if o != s))
            term = sorted((-((of[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[s][t] and of[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, r + 1) for part, found in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(found)}
    return out


def sourced(n=160):
    rnd = random.Random(4)
    words = ["the", "The", "red", "über", "x1y", "dog-house", "日本", "naïve", "A", "of", *(f"w{c}" for c in string.ascii_lowercase)]
    rows = []
    for i in range(n):
        source = None if i % 29 == 0 else "hot" if i % 3 == 0 else f"s{i % 13}"
        rows.append((i, " ".join(rnd.choice(words[i % 13 :]) for _ in range(rnd.randint(0, 40))), ["en", "de", "en", None][i % 4], source))
    rows += [rows[7], rows[7], (None, None, "en", "silent"), (None, "", "zz", "one"), (1, "12 34 !", "zz", "two"), (2, "rare word", "zz", ""), (3, "alone alone", "only", "it"), (4, "alone", "only", "it"), (5, "Alone", "only", "it")]
    return [*rows, (6, "long " * 200_000 + "z" * 100_000, "en", "s1")]


@pytest.mark.parametrize("chunk, chunks, block", [(2048, 8, 16), (4, 2, 3)])
def test_divergence(spark, chunk, chunks, block):
    rows = sourced()
    got = source_divergence.audit(spark, frame(spark, rows), least=3, top=5, chunk=chunk, chunks=chunks, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == divergences(rows, 3, 5)


def test_divergence_empty(spark):
    assert source_divergence.audit(spark, frame(spark, [])).count() == 0


def test_divergence_hands_out_counts_when_many(spark, monkeypatch):
    rows = sourced(60)
    monkeypatch.setattr(source_divergence, "HELD", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t or "" for _, t, _, _ in rows], "lang": [x or "" for _, _, x, _ in rows], "source": [s or "" for _, _, _, s in rows]})
    out = list(source_divergence.partial_counts(iter([batch])))
    assert len(out) > 60
    n = collections.Counter()
    for b in out:
        for lang, source, term, count, _ in zip(*(c.to_pylist() for c in b.columns)):
            n[lang, source, term] += count
    want = collections.Counter((x or "", s or "", t) for _, text, x, s in rows for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
    assert +n == want


# 12


def clusters(vectors, k, rounds, dims, seed):
    kept = [(i, [int(np.floor(256 * x)) for x in np.array(v, np.float64)]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found)


def vectors(n, dims, seed=2):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(i % 5, 0.7) for _ in range(dims)]) for i in range(n)]
    rows += [rows[3]] * 3 + [(n + i, rows[0][1]) for i in range(n // 3)]  # ties and a hot vector
    rows += [(None, rows[1][1]), (3, rows[2][1]), (None, None), (900, None), (901, []), (902, [1.0] * (dims - 1)), (903, [1.0] * (dims + 1))]
    return [*rows, (904, [None] + [1.0] * (dims - 1)), (905, [float("nan")] * dims), (906, [float("-inf")] * dims), (907, [-1000.0] * dims), (908, [0.0] * dims)]


@pytest.mark.parametrize("dims, k, rounds", [(64, 40, 5), (64, 7, 2), (11, 300, 1)])
def test_clusters(spark, dims, k, rounds):
    rows = vectors(90, dims)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, form string, cluster int")
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = norm_kmeans.cluster(spark, df.repartition(5), k=k, rounds=rounds, dims=dims, seed="9")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == clusters(rows, k, rounds, dims, "9")


def test_no_vectors(spark):
    assert norm_kmeans.cluster(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert norm_kmeans.cluster(spark, spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_too_large_components_fail_with_a_message(spark):
    with pytest.raises(Exception, match="beyond"):
        norm_kmeans.cluster(spark, spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))


def test_bounds_are_bounds_and_spare_distances():
    rnd = np.random.default_rng(5)
    centers = rnd.integers(-1000, 1000, (40, 64))
    q = centers[rnd.integers(0, 40, 3000)] + rnd.integers(-60, 60, (3000, 64))
    screen = norm_kmeans.Screen(centers)
    for q in (q, rnd.integers(-(1 << 27), 1 << 27, (3000, 64)), rnd.integers(-1, 2, (3000, 64)), np.zeros((2, 64), np.int64)):
        screen = norm_kmeans.Screen(centers)
        codes, form = norm_kmeans.coded(q)
        exact = ((q[:, None, :] - centers) ** 2).sum(2)
        assert (screen.bounds(codes.astype(float), form) <= exact).all()
        cluster, distance = screen.nearest(q, codes.astype(float), form)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    screen = norm_kmeans.Screen(centers)
    q = rnd.integers(-60, 60, (3000, 64))
    screen.nearest(q, *(x.astype(float) for x in norm_kmeans.coded(q)))
    assert screen.exact < screen.pairs / 10


# 13


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


PARTS = ["a", "e", "in", "ing", "The", "aaaa", " ", "  ", "\n", "\r\n\t", "'s", "'LL", "12", "é", "é", "日本", "😀", "<|endoftext|>", "<|endof", "|>", "!?", "====", "_", "\x00", "\x1c", "\x85", " ", " ", "क्", "�", "՘", "\U0003fc3b"]


def test_ids_and_texts_are_those_of_the_library(library):
    bpe, rnd = prefix_bpe.PrefixBPE.of(BYTE_BPE), random.Random(6)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(97, 122), rnd.randint(32, 1000), rnd.randint(0x2000, 0xD7FF)])) for _ in range(60)) for _ in range(500)]
    texts += ["ab" * 60_000, "=" * 70_001, " " * 50_000, "".join(rnd.choice("etaoin") for _ in range(100_000))]
    for text in texts:
        ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_any_ids_decode_as_the_library_decodes_them(library):
    bpe, rnd = prefix_bpe.PrefixBPE.of(BYTE_BPE), random.Random(7)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(0, 50256), rnd.randint(94, 255), 50256]) for _ in range(rnd.randint(0, 30))]
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_those_that_merging_gives_back(library):
    """Pairs of tokens against merging their joined letters by ranks, one after the other."""
    bpe, rnd = prefix_bpe.PrefixBPE.of(BYTE_BPE), random.Random(8)
    pieces = [p for p in bpe.library.get_vocab() if p != "<|endoftext|>"]
    common = ["a", "aa", "aaaa", "an", "in", "ing", "th", "the", "e", "er", "==", "====", "=", "Ġt", "Ġthe"]
    for _ in range(3000):
        a, b = (rnd.choice(common if rnd.random() < 0.5 else pieces) for _ in "ab")
        want = [t.id for t in library.model.tokenize(a + b)] == [library.token_to_id(a), library.token_to_id(b)]
        assert bpe.compatible(library.token_to_id(a), library.token_to_id(b)) == want, (a, b)


def test_encode_decode_and_round_trip(spark, library):
    rows = [(1, "Hello world, it's 12 o'clock", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no <|endoftext|> id", "en", "b"), (1, "Hello world, it's 12 o'clock", "en", "a"), (4, "x" * 300_000 + " naïve" * 50_000, "en", "a")]
    df = frame(spark, rows)
    ids = prefix_bpe.encode(spark, df, BYTE_BPE)
    key = str
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _, _ in rows), key=key)
    assert sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=key) == want
    texts = prefix_bpe.decode(spark, ids, BYTE_BPE)
    assert sorted(map(tuple, texts.collect()), key=key) == sorted(((i, t or "") for i, t, _, _ in rows), key=key)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sorted(((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in want), key=key)
    got = prefix_bpe.round_trip(spark, df, BYTE_BPE)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect()), key=key) == digests
    assert prefix_bpe.round_trip(spark, frame(spark, []), BYTE_BPE).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        prefix_bpe.PrefixBPE(public_tokenizers.path("word_bpe_49k.json"))
