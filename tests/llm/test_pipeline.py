"""The pipeline against a plain-Python chain of its five stages, and the entry's registrations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import __spark_entry__ as E
import corpus_pipeline
import pytest
from conftest import SF001
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm import mixing, quality_rules

SCHEMA = T.StructType([T.StructField(c, k) for c, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("name", T.StringType()), ("_k", T.DoubleType()), ("tie", T.IntegerType()))])
GAP = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def quality_kept(rows, labels, rules, stats):
    out = []
    for r in rows:
        w = words(r[1])
        triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            continue
        if any(all((stats[r[1]][c.feature] > c.value) == c.above for c in rule) for rule in rules):
            continue
        out.append(r)
    return out


def one_of_each(rows):
    sets = []
    for r in rows:
        w = words(low(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        key = find(i)
        if key not in best or (r[0] is None, r[0]) < (best[key][0] is None, best[key][0]):
            best[key] = r
    return list(best.values())


def clean(rows, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for _, t in items:
        w = re.findall(pattern, low(t))
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        w = re.findall(pattern, low(r[1]))
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def mixed(rows):
    """(row, text) of every row and epoch that the slots play."""
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    full = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / max(1, sum(weight[s] for s in sources if s not in full))
        more = {s for s in sources if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    goal = {s: math.floor(2.0 * size[s] if s in full else level * weight[s]) for s in sources}
    played = [s for s in sources if goal[s] > 0]
    total = sum(goal.values())
    block = max(mixing.LEAST_BLOCK, -(-total // mixing.SLOTS))
    won, edge, at = Counter(), {}, 0
    for s in played:
        lo, at = at, at + goal[s]
        edge[s] = (math.floor(lo * (mixing.MODULUS / total)), math.floor(at * (mixing.MODULUS / total)))
    for i in range(mixing.n_slots(total, min(goal[s] for s in played), block) if played else 0):
        u = i * mixing.GOLDEN % mixing.MODULUS
        won.update(s for s in played if edge[s][0] <= u < edge[s][1])
    out = []
    for s in played:
        gives, at = min(goal[s], won[s] * block), 0
        own = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest())
        for _ in range(2):
            for r in own:
                n = len(words(r[1]))
                take = min(n, gives - at)
                at += n
                if take > 0:
                    out.append((r, r[1] if take == n else re.match(rf"(?:{GAP}*[^\x20\x09-\x0D]+){{{take}}}", r[1])[0]))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with nulls, repeats, copies, benchmark passages, and columns named as the operators' own."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    items = [(i, prose(30)) for i in range(6)] + [(6, "short item"), (7, None), (8, "")]
    texts = [None, "", " \n ", "too short", "again " * 90]
    for k in range(60):
        base = prose(rng.randrange(55, 160))
        texts.append(base)
        if k % 4 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts += [base, " ".join(w)]
        if k % 7 == 0:
            texts.append(prose(60) + " " + items[k // 7 % 6][1] + " " + prose(40))
        if k % 5 == 0:  # what the labels call bad: full of symbols
            texts.append(" ".join(x + rng.choice(["#", "$", "|", " &"]) for x in prose(90).split(" ")))
    docs = [(i, t, "en", [None, "a", "b", "c"][i % 4], 1, "n", 0.5, 3) for i, t in enumerate(texts)]
    docs += [(None, prose(80), None, "a", 0, None, None, None), docs[8], docs[8]]
    labels = [(r[0], 0 if r[1] and len(re.findall(r"[#$|&]", r[1])) > 20 else 1, 0) for r in docs[5:-3]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def test_run_equals_plain_chain(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs, labels, items = tables
    read = spark.read.parquet(f"{folder}/documents.parquet")
    stats = quality_rules.statistics(read, ["text"])
    rules = quality_rules.learned_rules(quality_rules.statistics(quality_rules.labelled_documents(read, spark.read.parquet(f"{folder}/labels.parquet")), ["doc_id"]), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules, "the symbols give a rule"
    first = quality_kept(docs, labels, rules, {r["text"]: r["_q"] for r in stats.collect()})
    second = one_of_each(first)
    third = clean(second, items)
    fourth = mixed(third)
    assert len(docs) > len(first) > len(second) > len(third) > 40 and any(r[0] is None for r in third)
    bad = {doc_id for doc_id, quality, _ in labels if not quality}
    assert len(bad) > 8 and not bad & {r[0] for r in first}
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    at = 0
    order = sorted(fourth, key=lambda x: (x[0][0] is not None, x[0][0]))
    groups = {}
    for r, text in order:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        groups.setdefault(r[0], []).append((len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    out = [tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    got = {}
    for doc_id, start, n, crc in sorted(out, key=lambda r: r[1]):
        assert start == at
        at += n
        got.setdefault(doc_id, []).append((n, crc))
    assert list(got) == list(groups), "ascending doc_ids, a null one first"
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in groups.items()}


def test_empty_and_odd_tables(spark, tables, tmp_path):
    folder, docs, *_ = tables
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    only = spark.createDataFrame([docs[0], docs[1], docs[5], docs[5]], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        only = corpus_pipeline.write_once(stage(spark, only, str(tmp_path)), name)
        assert only.schema.names == SCHEMA.names
    assert {r["doc_id"] for r in only.collect()} == {5}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_once(stage(spark, docs, SF001), name)
        assert docs.columns == columns
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert out.count() == docs.count()


def test_mix_follows_its_schedule(spark, tables, monkeypatch):
    """Other slots, other words: the step of one gives all slots to the first source."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    read = lambda: {(r["doc_id"], r["taken"], r["position"]) for r in mixing.digest(docs).collect()}
    by_source = lambda: {r["source"]: r["n"] for r in mixing.mixed_documents(docs, "slot").groupBy("source").agg(F.count("slot").alias("n")).collect()}
    golden, sources = read(), by_source()
    assert len(sources) == 4
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert read() != golden and len(by_source()) < 4


def test_mix_is_played_in_order(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    slots = [r["slot"] for r in mixing.mixed_documents(docs, "slot").select("slot").collect()]
    assert slots == sorted(slots) and len(set(slots)) > 20


def test_all_operators_are_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
