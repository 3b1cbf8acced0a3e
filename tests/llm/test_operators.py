"""Each operator against a plain brute-force version, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegraph.llm import decontaminate, language_crf, mixing, partenum, pu_quality, quality_rules, secret_scan, suffix_dedup, token_output, toxicity

WORD = r"[^\x20\x09-\x0D]+"
VOCAB = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("_t", T.StringType()), T.StructField("_row", T.IntegerType()), T.StructField("key", T.DoubleType())])


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + (".\n" if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passage = prose(rng, 40)
    base = prose(rng, 120)
    out = [None, "", " \n\t ", "word", "a b c", "12 34 !!", prose(rng, 30_000), base, base]
    for k in range(12):  # near copies: a few words changed
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"x{k}"
        out.append(" ".join(w))
    out += [prose(rng, rng.randrange(20, 200)) + " " + passage + " " + prose(rng, 30) for _ in range(15)]
    out += ["of " * 80, "na na\nna na\n" * 30, "a b c d", "A B c D", 'token="abcdef123" x Password: ab" secret: hunter22']
    out += ["AKIA" + "Z9" * 10 + " " + "0af3" * 8 + " api_key=12345 apikey='123456' ghp_" + "aB3" * 13, "é" * 3 + " token=token\": hunter2xyz AKIAB " + "f" * 23 + " " + "f" * 24]
    out += [prose(rng, rng.randrange(1, 60)) for _ in range(30)]
    docs = [(i, t, "en" if i % 2 else None, [None, "a", "b", "c"][i % 4], i, "t", None, 0.5) for i, t in enumerate(out)]
    docs += [(None, "null id " + base, "en", "a", 1, None, 1, None), docs[7], docs[30]]
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def want(rows, fn):
    return sorted((fn(r) for r in rows), key=repr)


# ------------------------------------------------------------------ 1


def test_secret_scan(docs, rows, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)

    def one(r):
        t = r[1] or ""
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        return (r[0], *[sum(x[1] == k for x in s) for k in range(3)], hashlib.sha256(text.encode()).hexdigest())

    df = secret_scan.digest(docs)
    assert got(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want(rows, one)
    assert sum(r[1] + r[2] + r[3] for r in want(rows, one)) >= 5
    assert any("github:" in r[0] for r in got(df, "spans"))
    assert secret_scan.digest(empty).count() == 0


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("abcd") == [frozenset({"abc", "bcd"})]
    assert q("[0-9a-f]{24,}") is None and q("(abc|x)") is None
    assert set(q("api_?key")) == {frozenset({"api", "pik", "ike", "key"}), frozenset({"api", "pi_", "i_k", "_ke", "key"})}
    for rule in secret_scan.BASE_RULES[:2] + secret_scan.MORE_RULES:
        assert q(rule.pattern)


# ------------------------------------------------------------------ 2


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 0), (1000, 10**6), (3000, 500), (700, 2**40)):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = token_output.EliasFano.of(v)
        assert ef.all().tolist() == v.tolist()
        assert [ef.select(i) for i in range(0, n, 7)] == v[::7].tolist()
    v = np.cumsum(rng.integers(1, 1000, 5000))
    ef = token_output.EliasFano.of(v)
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.samples)) < 5000 * 12


def test_token_round_trip(docs, rows, empty, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_output, "BLOCK_IDS", 500)
    tok = Tokenizer.from_file(path)
    at, out = 0, []
    known = {x[1]: i for i, x in enumerate(rows)}
    df = token_output.write_and_read(docs, path).orderBy("start").collect()
    assert len(df) == len(rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    for r in df:
        ids = [np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in texts[r["doc_id"]]]
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in ids]
        at += r["n_tokens"]
    order = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in df]
    assert order == sorted(order) and known and not out
    assert token_output.write_and_read(empty, path).count() == 0


def test_encoder_pieces_equal_whole_texts():
    import public_tokenizers
    import pyarrow as pa

    enc = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["á e ́x", "it's DON'T  we'll", "x<|endoftext|>y <|startoftext|>", "tab\tnew\r\nline nbsp em", "ΣΑΣ. ΣΑΣ", "한 국어 하", "a" * 3000, "  ", "😀😀 12 3.5%"]
    ids, n = enc.encode(pa.array(texts))
    at = 0
    for t, k in zip(texts, n):
        assert ids[at : at + k].tolist() == [*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1]
        at += k


# -------------------------------------------------------------- 3, 4, 9


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        lang = "en" if i % 3 else "de"
        stems = ["the", "and", "ing", "wh", "sh"] if lang == "en" else ["der", "und", "ung", "sch", "ei"]
        n = rng.randrange(60, 140)
        w = ["".join(rng.choice(stems) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(n)] = rng.choice(["idiot", "scum", "moron"]) if lang == "en" else "lowei" + rng.choice(stems)
        rows.append((i, " ".join(w), lang, "s"))
        if rng.random() < 0.7:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(10_000, None, None, None), (10_001, "", None, None), (10_002, "123 !!", "en", None), (None, "the idiot and", "en", None)]
    labels += [(77_777, 1, 0), (5, None, None), (None, 1, 1)]
    truth = {r[0]: (r[1], r[2]) for r in rows}
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth)


def _auc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("fn,col,good", [(pu_quality.score, "quality", lambda t: "!!" not in t), (toxicity.score, "toxic", lambda t: re.search("idiot|scum|moron|lowei", t))])
def test_scores_on_held_out_rows(labelled, fn, col, good):
    docs, labels, truth = labelled
    rows = fn(docs, labels).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and (truth[r["doc_id"]][0] or "").count(" ") > 50]
    pos, neg = ([r for r in held if bool(good(truth[r["doc_id"]][0])) == w] for w in (True, False))
    assert len(pos) > 20 and len(neg) > 20
    assert _auc([r["score"] for r in pos], [r["score"] for r in neg]) > 0.97
    assert sum(r["predicted"] for r in pos) > 0.95 * len(pos) and sum(r["predicted"] for r in neg) < 0.05 * len(neg)
    # labels of the held-out fold change nothing
    k, h = (5, 0) if col == "quality" else (4, 2)
    flipped = labels.withColumn(col, F.when(pu_quality.fold(F.col("doc_id"), k) == h, 1 - F.col(col)).otherwise(F.col(col)))
    again = {r["doc_id"]: r["score"] for r in fn(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_scores_without_labels(labelled, empty):
    docs, labels, _ = labelled
    none = labels.filter("false")
    for fn in (pu_quality.score, toxicity.score):
        assert fn(docs, none).filter("score IS NULL").count() == 0
        assert fn(empty, labels).count() == 0


def test_grammar_damps_and_aims():
    g = toxicity.Grammar(negated=0.2, reported=0.3, target=1.0)
    hit, target, no, said, plain = (toxicity.INSULT, 4.0), (toxicity.TARGET, 0.0), (toxicity.NEGATOR, 0.0), (toxicity.REPORT, 0.0), (toxicity.PLAIN, 0.0)
    w = lambda *s: round(toxicity.run_clause(list(s), g)[0], 6)
    assert w(plain) == 0 and w(target) == 0 and w(hit) == 4
    assert w(no, plain, hit) == 0.8 and w(no, plain, plain, plain, hit) == 4
    assert w(said, plain, hit) == 1.2 and w(said, no, hit) == 0.24
    assert w(target, hit) == 5 and w(hit, plain, target) == 5 and w(target, hit, target, hit) == 9


def test_lexicon_keeps_the_long_tail(spark):
    rng = random.Random(8)
    insults = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(120)]
    prose = lambda: " ".join(rng.choice(["the", "and", "thing", "white", "shore"]) for _ in range(12))
    # ten documents of each insult: 0.8 % of the toxic ones
    rows = [(f"{prose()} {x} {prose()}", 1) for x in insults for _ in range(10)] + [(prose(), 0) for _ in range(12_000)]
    found = toxicity.Matcher(toxicity.Grammar(*toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic int")))).features(pa.array(insults + ["the", "shore"]))
    assert (found[:-2, 0] > 0).all() and (found[-2:, 0] == 0).all()


def test_threat_needs_a_target(spark):
    rng = random.Random(9)
    prose = lambda: " ".join(rng.choice(["the", "and", "thing", "white", "shore"]) for _ in range(12))
    rows = []
    for i in range(2400):  # ordinary verbs: as frequent in clean documents as in toxic ones
        toxic = i % 10 == 0
        verb = rng.choice(toxicity.THREATS[:6])
        rows.append((i, f"{prose()}. {f'i will {verb} you' if toxic else f'{verb} the fire. i will see you' if i % 3 else prose()}. {prose()}", int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert sum(i % 10 == 0 for i in held) > 20
    assert all(out[i]["predicted"] == (i % 10 == 0) for i in held)
    # each damping has a factor of its own, and a threat without a target weighs nothing
    g = toxicity.Grammar(negated=0.2, reported=0.3, threat=3.0)
    threat, target, no, said = ((k, 0.0) for k in (toxicity.THREAT, toxicity.TARGET, toxicity.NEGATOR, toxicity.REPORT))
    w = lambda *s: round(toxicity.run_clause(list(s), g)[0], 6)
    assert w(threat) == 0 and w(threat, target) == w(target, threat) == 3
    assert w(no, threat, target) == 0.6 and w(said, threat, target) == 0.9


def test_damping_factors_are_fitted_apart():
    rows = [(toxicity.CLEAR, 1, 95), (toxicity.CLEAR, 0, 5), (toxicity.NEGATED, 1, 10), (toxicity.NEGATED, 0, 90)]
    rows += [(toxicity.REPORTED, 1, 70), (toxicity.REPORTED, 0, 30), (0, 1, 10), (0, 0, 990)]
    y = np.array([t for _, t, n in rows for _ in range(n)], float)
    x = np.array([(4.0 * (f > 0), 1.0, f, 0, float(f > 0)) for f, _, n in rows for _ in range(n)])
    g = toxicity.Grammar()
    toxicity.calibrate(g, x, y)
    assert g.negated < 0.4 < 0.6 < g.reported


def test_prior_estimate(labelled):
    docs, labels, truth = labelled
    x = pu_quality.features(docs)
    good = labels.filter("quality = 1").select("doc_id").withColumn("positive", F.lit(True))
    train = x.join(good, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))).select("x", "positive")
    _, _, prior = pu_quality.train_model(train)
    assert abs(prior - 0.8) < 0.1


def test_language(labelled, empty):
    docs, _, truth = labelled
    rows = language_crf.predict(docs).collect()
    assert len(rows) == len(truth)
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (10_000, 10_001, 10_002)] == ["und"] * 3
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]][1] for r in held) > 0.98 * len(held)
    assert language_crf.predict(empty).count() == 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    doc = np.repeat([0, 1, 2], [3, 70, 300])
    score, start, trans = rng.normal(size=(len(doc), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    p, z, pairs, first = language_crf.Chains(doc).marginals(score, start, trans, True)
    total, q, n_pairs = 0.0, np.zeros_like(score), np.zeros((3, 3))
    for d in range(3):
        s = score[doc == d]
        f, b = np.zeros_like(s), np.zeros_like(s)
        f[0] = start + s[0]
        for t in range(1, len(s)):
            f[t] = np.logaddexp.reduce(f[t - 1][:, None] + trans, axis=0) + s[t]
        for t in range(len(s) - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + s[t + 1] + b[t + 1], axis=1)
        norm = np.logaddexp.reduce(f[-1])
        total += norm
        q[doc == d] = np.exp(f + b - norm)
        for t in range(1, len(s)):
            n_pairs += np.exp(f[t - 1][:, None] + trans + s[t] + b[t] - norm)
    assert np.allclose(p, q) and np.isclose(z, total) and np.allclose(pairs, n_pairs)


# ------------------------------------------------------------------ 5


def test_quality_counts(docs, rows, spark, empty):
    def one(r):
        x = r[1] or ""
        w = re.findall(WORD, x)
        c, m = Counter(zip(w, w[1:], w[2:])), set()
        for k, g in enumerate(zip(w, w[1:], w[2:])):
            if c[g] > 1:
                m |= {k, k + 1, k + 2}
        lines = [y for y in x.split("\n") if re.search(WORD, y)]
        return (r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(m), len(w) < 50 or 100 * len(m) > 50 * len(w))

    labels = spark.createDataFrame([(1, 1, 0), (99_999, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    df = quality_rules.digest(docs, labels)
    assert got(df, "doc_id", *quality_rules.COUNTS, "base_failed") == want(rows, one)
    assert df.filter("base_failed AND kept").count() == 0
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == df.filter("kept").count()
    assert quality_rules.kept_documents(empty, labels).count() == 0


def test_learned_rules(labelled):
    docs, labels, truth = labelled
    rules = quality_rules.learned_rules(quality_rules.statistics(docs, ["doc_id"]), labels)
    assert rules
    q = quality_rules.statistics(docs, ["doc_id"]).select("doc_id", (~quality_rules.verdict(rules)).alias("out"), quality_rules.base_failed().alias("base"))
    for r in q.filter("NOT base").collect():
        assert r["out"] == ("!!" in truth[r["doc_id"]][0])


# ------------------------------------------------------------------ 6


def shingle_set(t):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), (min(ids) if ids else None) if sets[i] else rows[i][0]) for i in g]
    return sorted(out, key=repr)


def test_partenum(docs, rows, empty):
    df = partenum.digest(docs)
    assert got(df, "doc_id", "n_shingles", "component_id") == brute_components(rows)
    assert partenum.digest(empty).count() == 0
    one = partenum.one_of_each(docs)
    assert one.columns == docs.columns
    comps = {c for _, n, c in brute_components(rows) if n}
    no_words = [r for r in rows if not shingle_set(r[1])]
    assert one.count() == len(comps) + len(no_words)


def test_partenum_sizes(spark):
    """Sets of all small sizes and of similarities around the threshold."""
    rng = random.Random(1)
    rows = []
    for n in [*range(1, 40), 64, 100, 150, 260]:
        w = [f"u{rng.randrange(10**6)}" for _ in range(n)]
        for drop in (0, 1, max(1, n // 12), max(1, n // 9), n // 5):
            rows.append((len(rows), " ".join(w[drop:])))
            v = list(w)
            if drop and n:
                v[rng.randrange(n)] = f"v{drop}"
            rows.append((len(rows), " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(partenum.digest(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


# ------------------------------------------------------------------ 7


def brute_suffix(rows):
    seen, out = set(), []
    order = sorted({(r[0] is not None, r[0] or 0, i if rows.index(r) == i else -1, r[1] or "") for i, r in enumerate(rows) if rows.index(r) == i})
    by = {}
    for has, did, _, text in order:
        b = text.encode()
        m = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                m[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(c for c, f in zip(b, m) if not f)
        by[(did if has else None, text)] = (len(b), sum(m), len(re.findall(rb"\x01+", bytes(m))), hashlib.sha256(kept).hexdigest())
    for r in rows:
        out.append((r[0], *by[(r[0], r[1] or "")]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settle", [400, 500_000])
def test_suffix_dedup(docs, rows, empty, settle, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SETTLE", settle)
    df = suffix_dedup.digest(docs)
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(rows)
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_periodic(spark):
    line = "=" * 130
    rows = [(0, "ab" * 200), (1, "x" * 250 + line), (2, line + "y" * 99), (3, "ba" * 90), (4, "é" * 120), (5, "x" * 99), (6, "-" * 100), (7, "q" + "-" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffix_dedup.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffix(rows)


# ------------------------------------------------------------------ 8


@pytest.mark.parametrize("max_set", [0, 100_000])
def test_decontaminate(spark, docs, rows, empty, max_set):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    source = low(rows[25][1])
    bench = [(1, " ".join(source[5:30]).upper().replace("É", "é")), (2, " ".join(source[10:25])), (3, "a b c d"), (4, None), (5, ""), (30, "hunter22"), (None, " ".join(source[:14]))]
    table = spark.createDataFrame(bench, "item_id long, text string")
    win = defaultdict(set)
    for i, t in bench:
        w = low(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            win[tuple(w[s : s + n])].add(i)

    def one(r):
        w, hit, items = low(r[1]), set(), set()
        for n in {len(k) for k in win}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in win:
                    hit.update(range(s, s + n))
                    items |= win[tuple(w[s : s + n])]
        ids = sorted(str(i) for i in items if i is not None)
        return (r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))

    expected = want(rows, one)
    assert sum(r[-1] for r in expected) >= 3
    if max_set:
        assert got(decontaminate.digest(docs, table), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    clean = decontaminate.remove_documents(docs, table, max_set)
    assert clean.columns == docs.columns and clean.count() == sum(not r[-1] for r in expected)
    assert decontaminate.digest(empty, table).count() == 0
    assert decontaminate.digest(docs, table.filter("false")).filter("contaminated").count() == 0


# ------------------------------------------------------------------ 10


def test_mixing(docs, rows, empty):
    df = mixing.digest(docs)
    out = df.collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(WORD, t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(r[1]) for r in rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in names if s not in open_)
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * total[s]}
        if not full:
            break
        open_ -= full
    goal = {s: share * weight[s] if s in open_ else 2 * total[s] for s in names}
    by_size = {total[s]: s for s in names}
    assert len(by_size) == len(names)
    for s in names:
        own = [r for r in out if r["source_size"] == total[s]]
        assert all(abs(r["target"] - goal[s]) < 1e-6 * goal[s] for r in own)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    first = {}
    for r in df.dropDuplicates(["doc_id", "size"]).collect():
        first.setdefault(r["source_size"], []).append(r)
    assert got(df, *df.columns) == got(mixing.digest(docs.repartition(5)), *df.columns)
    assert mixing.digest(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 90)), f"s{i % 5}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.digest(docs).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in out)
    words = mixing.mixed_documents(docs).select(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0]
    assert words == sum(r["taken"] for r in out)
    plan = mixing.manifest(docs).groupBy("source", "block_no").agg(F.sum("n_words").alias("n"), F.first("position").alias("p")).collect()
    assert all(r["n"] <= mixing.LEAST_BLOCK for r in plan)
    seen = [r["p"] for r in plan if r["p"] is not None]
    assert len(seen) == len(set(seen)) and len(seen) > 0.9 * len(plan)
