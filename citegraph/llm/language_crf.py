"""Language identification of words in mixed text by a linear-chain CRF.

Words are runs of ASCII letters, apostrophes and non-ASCII characters. The
model scores every word's language by hashed features (the whole word as a
lexicon entry, prefixes and suffixes of up to three bytes, inner trigrams) and
every pair of neighbours by a learned transition; forward-backward over all
words of a document gives each word's language probabilities. A document's
language is the one with the largest share of its letters, its score that
share.

Training: at most ``MAX_LABELLED`` labelled documents by a hash of doc_id,
whole texts, their language as every word's label; Adam on the exact
likelihood. A chain is computed in blocks of ``BLOCK`` words: transfer
matrices of all blocks at once, then the blocks' ends along each document,
then all words inside the blocks at once. This changes the order of the
arithmetic, not the result, and long documents are as fast as short ones.

Edge cases: null texts and texts without a letter are ``und`` with score 0;
so is every text when no label was learned; ties go to the language first by
code point; a null doc_id is not held out; repeated rows are judged each;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.pu_quality import fold
from citegraph.llm.textscan import Texts, chunks, mix
from citegraph.operators.windows import topk_per_group

#: labelled documents that the model is fitted on, at most
MAX_LABELLED = 800
#: of them from each language, where it has as many
FIRST = 20
BUCKETS = 1 << 17
BLOCK = 64
ROUNDS = 25
RATE = 0.25
RIDGE = 1e-4

_WORD = np.zeros(256, bool)
_WORD[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def word_types(t: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(type of each word, features of all types end to end, first feature of each type)."""
    h = t.hashes(start, end)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    size = e - s
    owners, feats = [np.arange(len(s))], [mix(h[first])]
    for n in (1, 2, 3):
        ok = np.flatnonzero(size >= n)
        owners += [ok, ok]
        feats += [mix(t.hashes(s[ok], s[ok] + n) + np.uint64(n)), mix(t.hashes(e[ok] - n, e[ok]) + np.uint64(10 + n))]
    many = np.maximum(0, size - 2)
    own = np.repeat(np.arange(len(s)), many)
    at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    owners.append(own)
    feats.append(mix(t.hashes(at, at + 3) + np.uint64(20)))
    owner, feat = np.concatenate(owners), np.concatenate(feats) & np.uint64(BUCKETS - 1)
    order = np.argsort(owner, kind="stable")
    return kind, feat[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(s)))


class Chains:
    """The words of many texts in blocks: row b, column k is the k-th word of block b."""

    def __init__(self, doc: np.ndarray):
        n_words = np.bincount(doc) if len(doc) else np.zeros(0, np.int64)
        n_blocks = -(-n_words // BLOCK)
        first_word, first_block = np.cumsum(n_words) - n_words, np.cumsum(n_blocks) - n_blocks
        within = np.arange(len(doc)) - first_word[doc]
        self.block, self.at = first_block[doc] + within // BLOCK, within % BLOCK
        self.n = int(n_blocks.sum())
        owner = np.repeat(np.arange(len(n_blocks)), n_blocks)
        self.order = np.arange(self.n) - first_block[owner]  # place of a block in its text
        self.by_place = [np.flatnonzero(self.order == k) for k in range(int(self.order.max(initial=-1)) + 1)] if self.n and self.order.max() < 64 else self._places()
        self.last = np.zeros(self.n, bool)
        self.last[np.cumsum(n_blocks)[n_blocks > 0] - 1] = True
        self.mask = np.zeros((self.n, BLOCK), bool)
        self.mask[self.block, self.at] = True

    def _places(self) -> list[np.ndarray]:
        order = np.argsort(self.order, kind="stable")
        cuts = np.searchsorted(self.order[order], np.arange(1, int(self.order.max(initial=0)) + 1))
        return np.split(order, cuts)

    def marginals(self, score: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
        """(probabilities of each word, log-likelihood normaliser, expected pair counts, first-word probabilities)."""
        n_lang = score.shape[1]
        e = np.ones((self.n, BLOCK, n_lang))
        top = score.max(1, keepdims=True)
        e[self.block, self.at] = np.exp(score - top)
        a, m = np.exp(trans), self.mask
        eye = np.eye(n_lang)
        begins = self.order == 0
        # transfer matrix of each block, scaled; padding is the identity
        t, log_t = np.broadcast_to(eye, (self.n, n_lang, n_lang)).copy(), np.zeros(self.n)
        for k in range(BLOCK):
            step = np.where(m[:, k, None, None], a[None] * e[:, k, None, :], eye)
            if k == 0:  # a text's first word has start weights in place of a transition
                step[begins] = np.exp(start)[None, None, :] * e[begins, 0][:, None, :] * eye
            t = t @ step
            z = t.max((1, 2))
            t /= z[:, None, None]
            log_t += np.log(z)
        fin, fout = np.ones((self.n, n_lang)), np.ones((self.n, n_lang))  # forward before, backward after each block
        log_z = 0.0
        for k, at in enumerate(self.by_place):
            if k:
                fin[at] = nxt[np.searchsorted(prev, at - 1)]
            v = np.einsum("bi,bij->bj", fin[at], t[at])
            z = v.sum(1)
            log_z += float(np.log(z).sum() + log_t[at].sum())
            nxt, prev = v / z[:, None], at
        for at in reversed(self.by_place):
            more = at[~self.last[at]]
            if len(more):
                v = np.einsum("bij,bj->bi", t[more + 1], fout[more + 1])
                fout[more] = v / v.sum(1, keepdims=True)
        f = np.empty((self.n, BLOCK, n_lang))
        cur = fin
        for k in range(BLOCK):
            new = (cur @ a) * e[:, k]
            if k == 0:
                new[begins] = np.exp(start) * e[begins, 0]
            cur = np.where(m[:, k, None], new / new.sum(1, keepdims=True), cur)
            f[:, k] = cur
        back, p = fout, np.empty_like(f)
        expected = np.zeros((n_lang, n_lang))
        for k in range(BLOCK - 1, -1, -1):
            q = f[:, k] * back
            p[:, k] = q / q.sum(1, keepdims=True)
            if pairs:
                ok = m[:, k] & ~(begins & (k == 0))
                before = (fin if k == 0 else f[:, k - 1])[ok]
                x = before[:, :, None] * a[None] * (e[ok, k] * back[ok])[:, None, :]
                expected += (x / x.sum((1, 2), keepdims=True)).sum(0)
            new = (e[:, k] * back) @ a.T
            back = np.where(m[:, k, None], new / new.sum(1, keepdims=True), back)
        return p[self.block, self.at], log_z + float(top.sum()), expected, p[begins, 0].sum(0)


class Model:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.w, self.start, self.trans = langs, np.zeros((BUCKETS, n), np.float32), np.zeros(n), np.zeros((n, n))

    def emissions(self, feat: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[feat], first, axis=0).astype(np.float64) if len(first) else np.zeros((0, len(self.langs)))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        t = Texts(column, lower=True)
        n, names = t.n, ["und"] * t.n
        score = np.zeros(n)
        has = t.per_doc(_LETTER[t.data]) > 0
        for i in np.flatnonzero(~has & (t.per_doc(t.data >= 128) > 0)):
            has[i] = any(c.isalpha() for c in column[int(i)].as_py())
        start, end, doc = t.runs(_WORD[t.data])
        if not self.langs or not len(start):
            return names, score
        kind, feat, first = word_types(t, start, end)
        dense = np.unique(doc, return_inverse=True)[1]
        p, *_ = Chains(dense).marginals(self.emissions(feat, first)[kind], self.start, self.trans)
        share = np.zeros((n, len(self.langs)))
        for j in range(len(self.langs)):
            share[:, j] = np.bincount(doc, p[:, j] * (end - start), minlength=n)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        best = share.argmax(1)
        for i in np.flatnonzero(has).tolist():
            names[i], score[i] = self.langs[best[i]], min(1.0, share[i, best[i]])
        return names, score


def fit(texts: list[str], labels: list[str]) -> Model:
    model = Model(sorted(set(labels)))
    n = len(model.langs)
    t = Texts(pa.array(texts, pa.string()), lower=True)
    start, end, doc = t.runs(_WORD[t.data])
    if n == 0 or not len(start):
        return Model([])
    y = np.array([model.langs.index(x) for x in labels])[doc]
    kind, feat, first = word_types(t, start, end)
    dense = np.unique(doc, return_inverse=True)[1]
    chains = Chains(dense)
    counts = np.diff(np.append(first, len(feat)))
    n_types, begins = len(first), np.append(True, dense[1:] != dense[:-1])
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (y[:-1][~begins[1:]], y[1:][~begins[1:]]), 1)
    seen_start = np.bincount(y[begins], minlength=n).astype(float)
    params = [model.w, model.start, model.trans]
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
    scale = 1.0 / len(y)
    for step in range(1, ROUNDS + 1):
        p, _, expected, p_start = chains.marginals(model.emissions(feat, first)[kind], model.start, model.trans, pairs=True)
        diff = -p
        diff[np.arange(len(y)), y] += 1
        grads = [np.empty_like(model.w), (p_start - seen_start) * scale + RIDGE * model.start, (expected - seen_pairs) * scale + RIDGE * model.trans]
        for j in range(n):
            of_type = np.bincount(kind, diff[:, j], minlength=n_types)
            grads[0][:, j] = -np.bincount(feat, np.repeat(of_type, counts), minlength=BUCKETS) * scale
        grads[0] += np.float32(RIDGE * scale) * model.w
        for x, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)).astype(x.dtype)
    return model


def learn(docs: DataFrame, folds: int, held: int) -> Model:
    kept = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).filter(fold(F.col("doc_id"), folds) != held)
    # one row for each doc_id, the first FIRST of every language before the others, all by hash
    keyed = kept.select("doc_id", "lang", "text", F.xxhash64("text").alias("_t"))
    one = keyed.groupBy("doc_id").agg(F.min(F.struct("_t", "lang")).alias("_m")).select("doc_id", "_m.*").withColumn("_h", -F.xxhash64("doc_id"))
    few = topk_per_group(one, "lang", "_h", "doc_id", FIRST).select("doc_id", F.lit(True).alias("_few"))
    ids = one.join(few, "doc_id", "left").orderBy(F.col("_few").isNull(), F.desc("_h"), "doc_id").limit(MAX_LABELLED).select("doc_id", "_t", "lang")
    chosen = keyed.join(F.broadcast(ids), ["doc_id", "_t", "lang"]).dropDuplicates(["doc_id"])
    rows = chosen.select("doc_id", "text", "lang").collect()  # MAX_LABELLED documents
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); lang of the held-out fold is never read."""
    model = learn(docs, folds, held)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a language
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, limit=1 << 20):
                names, score = shared.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
