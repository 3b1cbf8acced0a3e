"""PartEnum: sets that are similar enough share a signature, whatever is common; families of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from citegraph.llm import partenum as pe

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def signed(sets, common, bands):
    key = np.concatenate([np.sort(np.array(sorted(s), np.uint64)) for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sig, doc = pe.signatures(key, owner, len(sets), np.array([len(s) for s in sets]), common, bands)
    return [set(sig[doc == d].tolist()) for d in range(len(sets))]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_similar_sets_share_a_signature(share):
    """Pairs at the very threshold; a share of their shingles counts as common."""
    rng = random.Random(share)
    bands = pe.band_table(3000)
    for size in [*range(1, 40), 55, 80, 133, 300, 301, 700]:
        for _ in range(6):
            base = [rng.getrandbits(64) for _ in range(size)]
            out = 0
            while 100 * (size - out - 1) >= 80 * size:
                out += 1
            lost = rng.randrange(out + 1)  # taken from one side, the rest replaced as the threshold allows
            other = base[lost:]
            new = 0
            while 100 * len(other) >= 80 * (size + new + 1):
                new += 1
            other = other + [rng.getrandbits(64) for _ in range(new)]
            rng.shuffle(other)
            a, b = set(base), set(other)
            assert 100 * len(a & b) >= 80 * len(a | b)
            common = np.sort(np.array([x for x in a | b if rng.random() < share], np.uint64))
            x, y = signed([a, b], common, bands)
            assert a == b or x & y, (size, lost, new)


def test_distant_sets_share_few():
    """A signature holds several shingles: sets with half of their shingles in common share few."""
    rng = random.Random(1)
    bands = pe.band_table(3000)
    none = np.zeros(0, np.uint64)
    shared = total = 0
    for _ in range(40):
        base = [rng.getrandbits(64) for _ in range(400)]
        a, b = set(base), set(base[:200] + [rng.getrandbits(64) for _ in range(200)])
        x, y = signed([a, b], none, bands)
        shared, total = shared + len(x & y), total + len(x)
    assert shared < 0.12 * total


def test_parity_words_never_rule_out_a_link():
    rng = random.Random(3)
    for size in (1, 5, 300, 5000):
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(list(a)[: size - size // 10]) | {rng.getrandbits(64) for _ in range(size // 10)}
        key = np.concatenate([np.array(sorted(s), np.uint64) for s in (a, b)])
        x, y = (np.array(w, np.int64).view(np.uint64) for w in pe.parities(key, np.repeat([0, 1], [len(a), len(b)]), 2).to_pylist())
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)


def test_families_of_near_copies(spark):
    """A base with copies that are changed little and much, chains of copies, and a passage that all share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(4):
        base = [word() for _ in range(rng.randrange(60, 160))] + passage
        texts.append(base)
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 20])):
                w[rng.randrange(len(w))] = word()
            texts.append(w)
        chain = list(base)
        for _ in range(25):
            chain = list(chain)
            chain[rng.randrange(len(chain))] = word()
            texts.append(chain)
    texts += [passage + [word() for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in enumerate(texts)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in sets}
    got = {r["doc_id"]: r["component_id"] for r in pe.digest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == want
    assert 20 < len(set(want.values())) < len(texts) - 150


def test_a_large_centre_is_dealt_over_tasks(spark):
    """Every pair of sets of one centre in different components meets once, in deals of bounded size."""
    members = [(7, i, i % 3, 10, [0]) for i in range(1500)] + [(8, i, i, 10, [0]) for i in range(4)] + [(9, i, 5, 10, [0]) for i in range(9)]
    df = spark.createDataFrame(members, "center long, name long, root long, n long, parity array<long>")
    left, right = pe._dealt(df)
    most = left.groupBy("center", "deal").count().agg({"count": "max"}).first()[0]
    assert most <= 1.5 * pe.CENTRE_ROWS
    met = left.join(right.withColumnRenamed("n", "m"), (left["center"] == right["c"]) & (left["deal"] == right["e"]) & (left["root"] < right["rv"]))
    got = sorted((r["center"], r["name"], r["v"]) for r in met.select("center", "name", "v").collect())
    want = sorted((c, a, b) for c, a, x, *_ in members for d, b, y, *_ in members if c == d and a != c and b != c and x < y)
    assert got == want


def test_bit_table_runs_few_jobs(spark):
    """A job for each partition of the shuffle was most of the time of a run on small input."""
    from citegraph.llm.suffix_dedup import bit_table

    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in names}
    keys = spark.range(5000).selectExpr("xxhash64(id) key")
    try:
        for c, v in names.items():
            spark.conf.set(c, v)
        spark.sparkContext.setJobGroup("bit_table", "")
        table = bit_table(keys)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bit_table")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for c, v in before.items():
            spark.conf.set(c, v)
    key = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64) & np.uint64(8 * len(table) - 1)
    bits = np.unpackbits(table)
    assert bits[key.astype(np.int64)].all() and bits.sum() == len(np.unique(key))
    assert len(jobs) < 30


def test_components_of_few_edges_are_written_in_few_files(spark, monkeypatch):
    from citegraph.llm import components as C

    files, write = [], C.write_once
    monkeypatch.setattr(C, "write_once", lambda df, name: files.append(write(df, name)) or files[-1])
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in names}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "u long, v long")
    try:
        for c, v in names.items():
            spark.conf.set(c, v)
        got = {r["node"]: r["root"] for r in C.components(edges).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {i: i // 10 * 10 for i in range(40)}
    assert all(len(f.inputFiles()) == 1 for f in files[1:])
