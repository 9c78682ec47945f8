"""The near-dedup stage of the pipeline against brute force."""

import random
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from gaugeflow.llm import common, copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    both = len(a & b)
    return 10 * both >= 8 * (len(a) + len(b) - both)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    line = " ".join(rng.choices(vocabulary, k=30))
    out = [None, "", " \n", "one", "ONE", "three short words", "three short words more", "a b c d e", "a b c d e f"]
    for n in (12, 40, 150, 400):
        base = rng.choices(vocabulary, k=n)
        for share in (0.004, 0.01, 0.02, 0.03, 0.04, 0.05) * 4:  # similarities on both sides of 0.8
            out.append(" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base))
        out.append(" ".join(base[:int(0.85 * n)]))
        out.append(" ".join(base + base[:n // 2]))  # repeated shingles count once
    out += [line + "\n" + " ".join(rng.choices(vocabulary, k=40)) for _ in range(40)]  # share a line only
    return out + out[20:24]


def classes(texts):
    s = [sets(t) for t in texts]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if alike(s[i], s[j])]
    least = list(range(len(s)))
    for _ in s:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return s, pairs, least


def test_every_pair_at_the_threshold_is_in_one_class(spark, texts):
    s, pairs, want = classes(texts)
    assert sum(s[i] != s[j] for i, j in pairs) > 100 and len(set(want)) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs, "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stage_keeps_the_first_of_each_class(spark, texts):
    _, _, want = classes(texts)
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[50], "en", "a", 0), (None, "no id at all", "en", "a", 0)], SCHEMA)
    got = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [*sorted(set(want)), None]


def test_fingerprints_come_first_and_the_rest_is_searched(spark, texts, monkeypatch):
    """SimHash gives the first candidates; classes are the same whatever it finds."""
    _, _, want = classes(texts)
    found = []
    pairs = copies.fingerprint_pairs
    monkeypatch.setattr(copies, "fingerprint_pairs", lambda nodes: found.append(pairs(nodes)) or found[-1].filter(f"{len(found) == 1}"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for _ in range(2):
        got = {r.doc_id: r.component_id for r in copies.near_copies(docs, "doc_id").collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(found) == 2 and found[0].count() > 5


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(f"x{rng.randrange(60)}" if rng.random() < 0.02 else w for w in base)) for i in range(400)], "doc_id long, text string")
    pairs = []
    monkeypatch.setattr(copies, "bounded", lambda p, bits, s, do=copies.bounded: pairs.append(p.count()) or do(p, bits, s))
    got = [r.component_id for r in copies.near_copies(docs, "doc_id").collect()]
    assert max(got.count(c) for c in set(got)) > 200 and sum(pairs) < 400 * 400 / 4


def test_any_order_of_shingles_leaves_no_pair_out(texts):
    known, rng = {}, np.random.default_rng(2)
    h = [copies.shingles((t or "").encode(), known) for t in texts]
    assert [len(x) for x in h] == [len(sets(t)) for t in texts]
    common = np.unique(np.concatenate(h))[::3]
    for counts in (rng.integers(8, 99, len(common)), np.full(len(common), 8)):
        lead = [set(copies.prefix(x, 0.8, common, counts).tolist()) for x in h]
        _, pairs, _ = classes(texts)
        assert all(lead[i] & lead[j] for i, j in pairs if len(h[i]))


def test_bitmaps_of_any_two_sizes_bound_the_shingles_apart():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 9000).astype(np.uint64)
    for n, m, shared in ((0, 3, 0), (1, 1, 1), (900, 1100, 800), (4000, 1000, 990), (5000, 4500, 4400), (1025, 1024, 0)):
        x, y = pool[:n], pool[n - shared:n - shared + m]
        most = n + m - 2 * shared
        apart = copies.bits_apart(copies.bitmap(x), copies.bitmap(y))
        assert apart <= most and (most - apart) % 2 == 0 and (apart > 0.1 * most or most == 0)


def test_settled_entries_go_out_once_and_only_shared_ones():
    rng = np.random.default_rng(4)
    rows = np.zeros(3000, copies.ENTRY)
    rows["sig"], rows["node"] = rng.integers(0, 700, 3000), rng.integers(0, 40, 3000)
    rows["sig"][:900] = 5  # a frequent shingle
    held, out = np.zeros(0, copies.ENTRY), []
    for at in range(0, 3000, 250):
        held, sent = copies._settle(np.concatenate([held, rows[at:at + 250]]))
        out += zip(sent["sig"].tolist(), sent["node"].tolist())
        assert len(held) <= 701
    wanted = set(zip(rows["sig"].tolist(), rows["node"].tolist()))
    texts = {s: len({n for t, n in wanted if t == s}) for s in {s for s, _ in wanted}}
    assert set(out) == {(s, n) for s, n in wanted if texts[s] > 1}


def test_stage_keeps_one_row_of_each_class_read_from_files_or_not(spark, tmp_path):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t, "en", "a", 1, 1, "x"), (1, t, "en", "a", 1, 1, "x"), (None, t, "en", "a", 1, 1, "x"), (2, None, None, None, None, None, None),
            (3, "", "en", "a", 0, 1, "x"), (4, t + " but quite another text of words that differs", "en", "b", 1, 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA + ", row int, file string")  # columns whose names the stage uses itself
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    for given in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        got = corpus_pipeline.one_of_each(spark, given, "")
        assert got.columns == list(corpus_pipeline.COLUMNS) and sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id != 2) == [(1, t), (4, rows[5][1])]
        assert got.filter("doc_id = 2").count() == 1


def test_texts_of_small_buckets_are_paired_where_they_meet(spark, monkeypatch):
    """Only buckets of many texts take part in the rounds of joins; the others' pairs are found without one."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(30):
        base = rng.choices(vocabulary, k=80)
        texts += [" ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base) for share in (0, 0.01, 0.02, 0.03)]
    _, pairs, want = classes(texts)
    rows = []
    monkeypatch.setattr(copies, "_with_hubs", lambda now, *a, do=copies._with_hubs: rows.append(now.count()) or do(now, *a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs, "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == want and len(pairs) > 50
    assert rows and sum(rows) == 0


def test_pairs_of_few_are_those_of_every_shingle(monkeypatch):
    rng = np.random.default_rng(8)
    rows = np.zeros(4000, copies.ENTRY)
    rows["sig"], rows["node"], rows["n"], rows["place"] = rng.integers(0, 900, 4000), rng.integers(0, 300, 4000), 10, rng.integers(0, 3, 4000)
    rows["sig"][:500] = 7  # leads too many texts to pair them all
    rows["n"] += rows["node"] % 4
    first = {}
    for r in rows.tolist():
        first.setdefault(r[:2], r)
    by_sig = {}
    for r in first.values():
        by_sig.setdefault(r[0], []).append(r)
    want = set()
    for sig, of in by_sig.items():
        for x in of:
            for y in of:
                if len(of) <= copies.FEW and x[1] > y[1] and min(x[2] - x[3], y[2] - y[3]) >= -(-(x[2] + y[2]) * 4 // 9):
                    want.add((x[1], y[1]))
    held, out = np.zeros(0, copies.ENTRY), set()
    for at in range(0, 4000, 250):
        part = np.array([r for r in rows[at:at + 250].tolist() if first[r[:2]] is r or first[r[:2]] == r], copies.ENTRY)
        held, sent = copies._settle(np.concatenate([held, part]), copies.FEW)
        out |= set(sent["sig"].tolist())
    assert out == {s for s, of in by_sig.items() if len(of) > copies.FEW} and 7 in out
    for size in (1 << 17, 64):
        monkeypatch.setattr(copies, "AT_ONCE", size)
        got = np.concatenate(list(copies._pairs_of_few(held[~held["out"]], 0.8)))
        assert set(map(tuple, got.tolist())) == want and len(want) > 100


def test_few_edges_take_few_tasks_however_many_partitions(spark, monkeypatch):
    rng = random.Random(9)
    ids = rng.sample(range(10_000), 320)
    edges = [*zip(ids[:200], ids[1:200]), *[(ids[200], x) for x in ids[201:300]], *[(x, x) for x in ids[300:]]]
    want = {x: min(g) for g in (ids[:200], ids[200:300]) for x in g}
    df = spark.createDataFrame(edges, "a long, b long").repartition(16)
    used = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in used}
    tasks, tracker = [], spark.sparkContext.statusTracker()
    try:
        for k, v in used.items():
            spark.conf.set(k, v)
        for size in (common.EDGES, 100):
            monkeypatch.setattr(common, "EDGES", size)
            spark.sparkContext.setJobGroup(f"edges {size}", "")
            assert {r.node: r.component for r in common.connected_components(df).collect()} == want
            stages = {s for j in tracker.getJobIdsForGroup(f"edges {size}") for s in tracker.getJobInfo(j).stageIds}
            tasks.append(sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i))  # a stage that was skipped has none
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < tasks[0] < 400 < tasks[1]  # a task a step after the first, not 64 of each exchange


def test_pairs_of_a_full_bucket_need_little_memory():
    held = np.zeros(1 << 18, copies.ENTRY)
    held["sig"], held["node"], held["n"] = np.arange(1 << 18) // 30, np.random.default_rng(3).permutation(1 << 18), 400
    tracemalloc.start()
    try:
        pairs = sum(len(p) for p in copies._pairs_of_few(held, 0.8))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == ((1 << 18) // 30) * 435 + 4 * 3 // 2 and peak < 60e6


def test_cells_of_pairs_are_read_in_one_job(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-(1 << 63), 1 << 63)) for _ in range(500)]
    cells = copies.needed_cells(spark.createDataFrame(pairs, "a long, b long").repartition(7))
    assert np.flatnonzero(np.unpackbits(cells, bitorder="little")).tolist() == sorted({x % copies.CELLS for p in pairs for x in p})
    assert not copies.needed_cells(spark.createDataFrame([], "a long, b long")).any()
