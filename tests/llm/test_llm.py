"""The corpus operators against brute force on small tables with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeflow.llm import catalog, html, language, merkle, mixing, ngrams, packing, pieces, sharding, simhash, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, uid long"
LONG = " ".join(f"w{i % 700}" for i in range(6000))
TEXTS = [None, "", "  \t\n", "one", "Same text of five words", "Same text of five words", "first line\nsecond line here\n\nthird one", LONG, LONG + " end", "ünï cödé — 漢字 tokens"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", "a", None][i % 3], None, "x", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (4, TEXTS[4], "en", "b", None, "x", 7), (None, "no id", None, None, None, "x", 7)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


def test_queries_and_empty_tables(spark, empty):
    assert {int(n[2:].split("_")[0]) for n in catalog.QUERIES} == set(range(1, 14))
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    for out in (merkle.versions(empty), sharding.shards(empty), pieces.token_counts(empty, path), mixing.taken_words(empty), packing.pack(empty),
                simhash.near_duplicates(empty), ngrams.scores(empty), language.identify_documents(empty)):
        assert out.count() == 0


def test_simhash(docs):
    def one(t):
        w = words(t)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 12
    text = dict(enumerate(TEXTS)) | {None: "no id"}
    fps = {k: one(t) for k, t in text.items()}
    assert all(r.fp & (1 << 64) - 1 == fps[r.doc_id] for r in got)
    group = {k: {k} for k in fps}
    for _ in fps:
        group = {a: set().union(*(group[b] for b in fps if bin(fps[a] ^ fps[b]).count("1") <= 3)) for a in fps}
    for r in got:
        assert r.component_id == min((x for x in group[r.doc_id] if x is not None), default=None)


def test_simhash_links_cover_all_near_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-2**63, 2**63, 30, dtype=np.int64)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for _ in range(300)]
    fps = sorted({int(base[i % 30]) ^ f for i, f in enumerate(flips)})
    got = simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    comp = {r.node: r.component for r in got.collect()}
    want = {f: f for f in fps}
    while True:
        new = {a: min(want[b] for b in fps if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3) for a in fps}
        if new == want:
            break
        want = new
    assert {f: comp.get(f, f) for f in fps} == want


def test_merkle(docs):
    got = merkle.versions(docs.filter("doc_id IS NOT NULL")).collect()
    assert len(got) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all(r.n_chars == len(TEXTS[r.doc_id] or "") and r.fingerprint == merkle.fingerprint((TEXTS[r.doc_id] or "").encode()) for r in got)
    order = sorted([*range(10), 4])
    want = sorted((k, hashlib.sha256(merkle.edited(TEXTS[k] or "", TEXTS[n] or "").encode()).hexdigest()) for k, n in zip(order, order[1:] + order[:1]))
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == want
    assert merkle.likeness(merkle.fingerprint(b""), merkle.fingerprint(b"")) == 1.0
    assert [e[2] for e in merkle.edits(b"a b\nc d\ne f", b"a b\nc x\ne f")] == [b"c x"]


def test_shards(docs):
    got = sharding.shards(docs, limit=9000).collect()
    assert len(got) == 12
    sums = {}
    for r in got:
        sums.setdefault(r.shard, []).append(r.n_bytes)
        assert r.shard_bytes <= 9000 or r.shard_bytes == r.n_bytes
    assert all(sum(v) == next(r.shard_bytes for r in got if r.shard == s) for s, v in sums.items())
    names = sorted(sums)
    assert not any(b.startswith(a) for a in names for b in names if a != b)


def test_piece_counts():
    machine = pieces.LongestMatch([b"ab", b"a", b"abcd", b"x"], [b"b", b"c", b"cd", b"bc", b"cde", b"d"])

    def plain(word):
        at, n = 0, 0
        while at < len(word):
            table = [b"ab", b"a", b"abcd", b"x"] if at == 0 else [b"b", b"c", b"cd", b"bc", b"cde", b"d"]
            fit = max((len(p) for p in table if word.startswith(p, at)), default=0)
            if not fit:
                return 1
            at, n = at + fit, n + 1
        return n

    rng = np.random.default_rng(0)
    for _ in range(3000):
        w = bytes(rng.choice(list(b"abcdex"), rng.integers(1, 10)).tolist())
        assert machine.length(w) == plain(w), w


def test_mixing(spark, sf_dir, docs):
    table = catalog.table(spark, sf_dir, "documents")
    got = mixing.taken_words(table).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken_words(table.repartition(3)).collect()))
    assert len(got) == table.count() and all(0 <= r.taken <= 3 * r.size for r in got)
    target, taken = {}, {}
    for r in got:
        target[r.source_size, r.target] = r.target
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
    assert mixing.targets([("a", 100), (None, 10), ("b", 10)]) == {"b": 30.0, None: 30.0, "a": 60.0}
    assert mixing.taken_words(docs).count() == 12
    m = mixing.mix(table, shard_words=2000)
    places = m.blocks.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("m")).collect()
    assert len(places) > 5 and all(p.n == p.m for p in places)


def test_packing(docs):
    encode = packing.encoder("byte_bpe_50k.tiktoken")
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(encode(t or "")) + 1 for t in [*TEXTS, TEXTS[4], "no id"])
    ids = np.array([*encode(LONG), 0], "<u4")
    mine = sorted((r for r in got if r.doc_id == 7), key=lambda r: r.piece)
    assert [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in mine] == [r.ids_crc32 for r in mine]
    assert all(r.length == 2048 for r in mine[1:])
    rows = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert rows.get(r.sequence_id, 0) == r.offset
        rows[r.sequence_id] = r.offset + r.length
    assert max(rows.values()) <= 2048


def test_packing_evolves_below_best_fit():
    sizes = [6, 6, 4, 4, 5, 5, 3, 3, 2, 2] * 4
    runs = [len(packing.evolve(sizes, [], 10, [seed], children=200)[0]) for seed in range(6)]
    assert len(packing.evolve(sizes, [], 10, [0], children=0)[0]) == 17  # best fit alone
    assert min(runs) == 16 and max(runs) <= 17


def test_ngram_model(spark, sf_dir, docs):
    out = ngrams.scores(catalog.table(spark, sf_dir, "documents")).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in out)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    model = ngrams.fit(docs, F.lit(True))
    h = np.array([xxhash.xxh64_intdigest(w) for w in sorted({w for t in [*TEXTS, "no id"] for w in words(t)} | {ngrams.END, b"never seen"})], np.uint64)
    for context in (b"text", b"w5", b"never seen"):
        v = np.full(len(h), xxhash.xxh64_intdigest(context), np.uint64)
        assert abs((10 ** model.log10(v, h)[0]).sum() - 1) < 1e-9  # a distribution over the vocabulary and one unknown word
    small = {r.doc_id: r for r in ngrams.scores(docs).collect()}
    train = [t for i, t in [*enumerate(TEXTS), (4, TEXTS[4])] if zlib.crc32(str(i).encode()) % 5 != 1] + ["no id"]
    assert small[0].n_tokens == 1 and small[0].train_tokens == sum(len(words(t)) + 1 for t in train)


def test_language(spark, sf_dir, docs):
    got = language.identify_documents(catalog.table(spark, sf_dir, "documents")).collect()
    assert sum(r.lang == r.lang_id for r in got) >= 0.98 * len(got)
    odd = language.identify_documents(docs).collect()
    assert len(odd) == 12 and all(r.lang_id == "und" for r in odd if not (r.text or "").strip())


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16))
    rows = []
    for i in range(400):
        v = centers[i % 12] + rng.standard_normal(16) * (0.1 if i % 3 else 0.0)
        rows.append((i, [float(x) for x in v], i % 2 if i % 50 else None))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [], 1)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    sound = [(k, np.float64(np.float32(v)), l) for k, v, l in rows[:400] if l is not None]
    ids = np.array([s[0] for s in sound])
    x = np.array([s[1] / np.linalg.norm(s[1]) for s in sound])
    lab = np.array([s[2] for s in sound])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    comp = ids.copy()
    for _ in range(len(ids)):
        comp = np.minimum(comp, np.where(link, comp[None, :], 1 << 40).min(1))
    assert link.any() and len(got) == len(rows)
    assert [got[i].n_links for i in ids] == link.sum(1).tolist()
    assert [got[i].component_id for i in ids] == comp.tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in (0, 1000, 1001, 1002, 1003, 1004))


def test_html(spark, sf_dir):
    pages = catalog.table(spark, sf_dir, "pages")
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (9003, "u", "<script>x</script>")], "page_id long, url string, html string")
    params = html.fit(pages)
    got = {r.page_id: r for r in html.extract(pages.union(odd), params=params).collect()}
    assert all(got[k].text == "" and got[k].n_chars == 0 for k in (9001, 9002, 9003))
    right = 0
    for r in pages.collect():
        want = [b[1] for b in html.blocks(r.html) if "<article" in b[0]]
        right += got[r.page_id].text == "\n".join(want)
    assert right >= 0.96 * pages.count()
