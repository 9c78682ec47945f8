"""Resampling, clustering and byte-pair coding against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeflow.llm import bytepairs, clustering, ngrams, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, uid long, rank long"
WORDS = [f"w{i % 61}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 7, 3) for i, t in rows], DOCS)


# resampling

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def drawn(docs, target):
    """Scores and ranks by sorting everything."""
    s, t = Counter(), Counter()
    for counter, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            counter.update(zlib.crc32(w.encode()) % 10000 for w in words(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, x in docs:
        w = words(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f.encode()) % 10000) for f in w)
        out.append((i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[3], o[0] is None, o[0]))
    return out, order[:10 * len(order) // 100]


@pytest.mark.parametrize("parts", [1, 7])
def test_resample_draws_what_sorting_draws(spark, parts):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(WORDS, rng.integers(0, 60))) + " Ünï-CÖDE 漢字") for i in range(300)]
    docs += [(900, None), (901, ""), (902, " \t"), (None, "no id " * 12), (903, " ".join(WORDS * 200)), (5, docs[5][1]), (5, docs[5][1])]
    target = ["w1 w2 w3 cöde", None, "", "w1 w1 w60"]
    got = resampling.resample(frame(spark, docs).repartition(parts), frame(spark, list(enumerate(target)))).collect()
    scores, top = drawn(docs, target)
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(scores, key=key)
    assert [tuple(r)[:4] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == top
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(top) + 1))


def test_resample_without_documents_or_target(spark):
    none = frame(spark, [])
    assert resampling.resample(none, frame(spark, [(1, "a b")])).count() == 0
    few = resampling.resample(frame(spark, [(1, "a b " * 40), (2, "c")]), none).collect()
    assert len(few) == 2 and all(r.rank is None for r in few)


def test_resample_with_word_pairs(spark):
    got = {r.doc_id: r for r in resampling.resample(frame(spark, [(1, "a b a b"), (2, "a")]), frame(spark, [(1, "a b")]), shortest=1, longest=2).collect()}
    assert (got[1].n_features, got[2].n_features) == (7, 1)
    assert resampling.features(b"A b a b", 1, 2)[1] == {b"a": 2, b"b": 2, b"a b": 2, b"b a": 1}


@pytest.mark.parametrize("few", [1, 64])
def test_cutoff_is_the_kth_key(spark, few, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", few)
    rng = np.random.default_rng(few)
    rows = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-3, 3, 2000), rng.integers(0, 5, 2000)))]
    keys = spark.createDataFrame(rows, "a long, b long, c long").repartition(5)
    for k in (1, 2, 777, 1999, 2000):
        assert resampling.cutoff(keys, k) == sorted(rows)[k - 1]
    assert resampling.cutoff(keys, 0) is None


# clustering

def lloyd(rows, k=40, rounds=5):
    """rows: (id, components); the rule by plain loops over whole numbers."""
    x = [(i, [math.floor(256 * float(np.float32(v))) for v in vec]) for i, vec in rows
         if vec is not None and len(vec) == 64 and all(v is not None and math.isfinite(v) for v in vec)]
    sha = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(x, key=lambda r: (sha(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in x]
        for j in range(len(cents)):
            own = [v for (_, v), a in zip(x, at) if a == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own)]
    found = [near(v) for _, v in x]
    by = Counter()
    for d, j in found:
        by[j] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, by[j], by.total(), marks[j]) for (i, _), (d, j) in zip(x, found)), key=lambda r: (r[0] is None, r))


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=64) * 0.3]) for i in range(260)]
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [float("nan")] * 64), (504, [None] * 64), (505, [float("inf")] * 64), (506, [0.0] * 64), (506, [0.0] * 64), (3, rows[3][1])]
    table = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, label int, cluster int, bound double").repartition(3)
    got = sorted((tuple(r) for r in clustering.clusters(table).collect()), key=lambda r: (r[0] is None, r))
    assert got == lloyd(rows)


def test_few_equal_missing_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.clusters(spark.createDataFrame([], schema)).count() == 0
    same = clustering.clusters(spark.createDataFrame([(i, [0.5] * 64) for i in (1, 2, None)], schema)).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in same] == [(0, 0, 0)] * 3
    huge = clustering.clusters(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)], schema)).collect()
    assert all(r.distance == 0 for r in huge) and len({r.cluster for r in huge}) == 3


def test_bounds_hold_and_save_work(spark):
    rng = np.random.default_rng(1)
    for _ in range(30):
        old = rng.integers(-60, 60, (6, 5))
        new = old + rng.integers(-9, 9, (6, 5))
        x = rng.integers(-80, 80, (400, 5))
        cluster = clustering.distances(x, old).argmin(1)
        radius = np.array([max(np.sqrt(clustering.own_distance(x[cluster == j], old[j][None])), default=0.0) for j in range(6)])
        loose = clustering.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        gain = np.sqrt(clustering.distances(x, old)) - np.sqrt(clustering.distances(x, new))
        gain[np.arange(400), cluster] = 0
        assert (gain.max(1) <= loose[cluster] + 1e-9).all()
        assert all(loose[j] <= np.delete(drift, j).max() + 1e-6 for j in range(6))
    apart = rng.normal(size=(8, 64))
    rows = [(i, [float(v) for v in apart[i % 8] + rng.normal(size=64) * 0.05]) for i in range(800)]
    _, _, _, scanned = clustering.cluster_rounds(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=8)
    assert scanned[0] == 800 and scanned[-1] < 80


# byte pairs

PIECES = ["plain words, don't they're 12 345\n\n  x", "", None, " ", "\n \n\t ", "漢字かな交じり文。 ünï", "a" * 5000, "!?" * 900, " " * 3000 + "x", "<|endoftext|>", "\U0001f600‍\U0001f9d1 é é",
          "it's we'll " * 700, "word " * 4000]


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library(public):
    import base64

    import tiktoken

    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (100, 100), (1 << 14, 256)])
def test_round_trip_equals_the_library(spark, public, library, chunk, overlap):
    rng = np.random.default_rng(chunk)
    odd = ["".join(rng.choice(list("ab1 '\n\tsrevml!é漢 "), 400)) for _ in range(60)]
    texts = PIECES + odd + odd[:2]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)]
    got = bytepairs.round_trip(frame(spark, rows).repartition(3), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, chunk=chunk, overlap=overlap).collect()
    want = {i: digests(library, t) for i, t in rows}
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_round_trip_of_an_empty_table(spark, public):
    assert bytepairs.round_trip(frame(spark, []), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN).count() == 0


def test_chunks_meet_where_boundaries_agree(public):
    own = bytepairs.Codec(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    text = "it's a longer text, they're 'sure' of 1234 things\n\n and more " * 9
    true = set(own.bounds(text, True))
    parts = bytepairs.chunks(text, 50, 20)
    assert "".join(p[:50] for p in parts) == text
    both = [bytepairs.edges(own.bounds(p, len(p) < 70), 50, 20) for p in parts]
    for i in range(1, len(parts)):
        shared = set(both[i - 1][1]) & set(both[i][0])
        if shared:
            assert i * 50 + min(shared) in true


# scores of the word-pair model

def kneser_ney(train, texts):
    """log10 probabilities of texts by plain dictionaries."""
    from gaugeflow.llm.ngrams import discounts

    seqs = lambda t: ["<s>", *(t or "").encode().lower().split(), "</s>"]
    pairs = Counter(p for t in train for p in zip(seqs(t), seqs(t)[1:]))
    by_count = Counter(pairs.values())
    opened, types, closes, raw = Counter(), {}, Counter(), Counter()
    for (v, w), n in pairs.items():
        opened[v] += n
        types.setdefault(v, []).append(min(n, 3))
        closes[w] += 1
        raw[w] += n
    d = (0, *discounts(*(by_count[i] for i in (1, 2, 3, 4))))
    of_closes = Counter(closes.values())
    dw = (0, *discounts(*(of_closes[i] for i in (1, 2, 3, 4))))
    gamma_w = sum(dw[min(c, 3)] for c in closes.values()) / len(pairs)

    def p(v, w):
        low = max(closes[w] - dw[min(closes[w], 3)], 0) / len(pairs) + gamma_w / (len(raw) + 1)
        if v not in opened:
            return low
        n = pairs[(v, w)]
        return max(n - d[min(n, 3)], 0) / opened[v] + sum(d[k] for k in types[v]) / opened[v] * low

    return [sum(math.log10(p(v, w)) for v, w in zip(seqs(t), seqs(t)[1:])) for t in texts]


@pytest.mark.parametrize("shard_bytes", [1 << 23, 40])
def test_scores_equal_a_plain_model(spark, monkeypatch, shard_bytes):
    from gaugeflow.llm import ngrams

    monkeypatch.setattr(ngrams, "SHARD_BYTES", shard_bytes)
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd", "é", "f9", "g"], rng.integers(0, 30), p=[.4, .2, .1, .1, .1, .05, .05])) for _ in range(120)] + [None, "", "new words only", "b a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a a a"), (3, texts[3])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    want = kneser_ney([t for i, t in rows if not held(i)], [t for _, t in rows])
    got = ngrams.scores(frame(spark, rows).repartition(4)).collect()
    assert sorted((str(r.doc_id), round(r.score, 8)) for r in got) == sorted((str(i), round(x, 8)) for (i, _), x in zip(rows, want))


def test_packed_pairs_come_back():
    from gaugeflow.llm.ngrams import narrow, packed, unpacked

    v, w, n = np.array([3, 3, 9], np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), np.array([1, 7, 2**40])
    assert [x.tolist() for x in unpacked(packed(v, w, n))] == [v.tolist(), w.tolist(), n.tolist()]
    assert narrow(n).dtype == np.int64 and narrow(n[:2]).dtype == np.uint32


def test_scores_without_training_text(spark):
    from gaugeflow.llm import ngrams

    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ngrams.scores(frame(spark, [(only_held, "x y")])).first()
    assert row.held_out and row.n_tokens == 3 and row.train_tokens == 0 and row.n_known == 0


# likeness of trees

def test_likeness_is_the_share_of_text_in_common_spans():
    from gaugeflow.llm import merkle

    rng = np.random.default_rng(4)
    texts = ["same word " * 400, "x" * 4000, "漢" * 900, "a b c\n\n" * 90, " ".join(map(str, rng.integers(0, 10**6, 700))), "l" * 250, "\t " * 300]
    spans = lambda t: Counter(s for line in t.encode().split(b"\n") for s in merkle.spans(line))
    weight = lambda c: sum((min(15, len(s) // 8) + 0.5) * n for s, n in c.items())
    for t, nxt in zip(texts, texts[1:] + texts[:1]):
        new = merkle.edited(t, nxt)
        a, b = spans(t), spans(new)
        got = merkle.likeness(merkle.fingerprint(t.encode()), merkle.fingerprint(new.encode()))
        assert got == pytest.approx(2 * weight(a & b) / (weight(a) + weight(b)), abs=1e-8)
        own = merkle.likeness(merkle.fingerprint(t.encode()), merkle.fingerprint(merkle.edited(t, t[::-1]).encode()))
        assert own >= 0.5 and all(len(s) <= merkle.MOST * 2 * merkle.WORD for s in merkle.spans(t.encode()))
        assert b"".join(merkle.spans(t.encode())) == t.encode()


def test_vectors_at_the_ends_of_the_range_link_by_direction(spark):
    from gaugeflow.llm import vectors

    rows = [(1, [1e-200, 2e-200, 0.0], 1), (2, [1e200, 2e200, 0.0], 1), (3, [1.0, 2.0, 0.0], 1), (4, [0.0, 0.0, 1e-310], 1), (5, [0.0, 0.0, 1e308], 1), (6, [1.0, 0.0, 0.0], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id").collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_patterns_are_best_fit_in_falling_order():
    from gaugeflow.llm import packing

    rng = np.random.default_rng(8)
    for capacity, sizes in ((50, rng.integers(1, 50, 900)), (2048, np.minimum(rng.geometric(1 / 500, 3000), 2047)), (64, np.full(100, 1)), (10, np.array([], int))):
        items, bins, free = sorted(map(int, sizes), reverse=True), [], []
        packing.best_fit(bins, free, range(len(items)), items, capacity)
        values, counts = np.unique(items, return_counts=True)
        groups = packing.patterns(dict(zip(map(int, values), map(int, counts))), capacity)
        assert sum(n for n, _ in groups) == len(bins) and len(groups) <= 3 * len(values)
        assert sorted(capacity - sum(a * b for a, b in p.items()) for n, p in groups for _ in range(n)) == sorted(free)
        assert {int(v): sum(n * p.get(int(v), 0) for n, p in groups) for v in values} == dict(zip(map(int, values), map(int, counts)))


def test_packing_is_never_above_best_fit(spark, sf_dir):
    """Production parameters over all documents; places gapless and every piece in one of them."""
    from gaugeflow.llm import packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs.repartition(5)).collect()
    sizes, bins, free = sorted((r.length for r in rows), reverse=True), [], []
    packing.best_fit(bins, free, range(len(sizes)), sizes, packing.CAPACITY)
    assert len({r.sequence_id for r in rows}) <= len(bins)
    inside = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == inside.get(r.sequence_id, 0)
        inside[r.sequence_id] = r.offset + r.length
    assert max(inside.values()) <= packing.CAPACITY


def test_shards_do_not_depend_on_partitions(spark, sf_dir):
    """Repeated rows, rows without a key and equal keys with other texts included."""
    from gaugeflow.llm import sharding

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1, "a")] * 40 + [(1, "b")] * 3 + [(None, None)] * 50 + [(2, "")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    one, other = (Counter(map(tuple, sharding.shards(docs.repartition(n), limit=20000).collect())) for n in (1, 7))
    assert one == other and sum(one.values()) == docs.count()
    assert all(b <= 20000 or b == n for _, n, _, _, b in one)


def test_pairs_of_a_batch_are_counted_in_bounded_memory():
    """The hashes of few words are kept; pairs are summed as np.unique() does."""
    rng = np.random.default_rng(8)
    v, w = (rng.integers(0, 1 << 10, 400_000).astype(np.uint64) for _ in range(2))
    want = np.unique(ngrams.mixed(v, w), return_counts=True)
    keys, at, n = ngrams._summed(v, w)
    assert (keys == want[0]).all() and (n == want[1]).all() and (ngrams.mixed(v[at], w[at]) == keys).all()
    assert [len(x) for x in ngrams._summed(v[:0], w[:0])] == [0, 0, 0]
    known = {}
    for i in range(300):
        ngrams.hashes(b" ".join(b"%d" % (1000 * i + j) for j in range(1000)), known)
    assert len(known) < 150_000
