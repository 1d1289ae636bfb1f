"""Operator 2 - toxicity by FTRL-proximal logistic regression.

Features are the hashed words, word pairs and skip-grams (two words with one between) that a document
holds, each counted once.  FTRL keeps a rate for every coordinate and an L1 penalty, so nearly all weights
are exactly zero and what is broadcast is the few that are not (never more than ``DIMS`` of them).

The model is fitted in one task on at most ``MAX_ROWS`` labelled documents, the least by a hash of doc_id;
every fifth of them is held out, and the threshold is the score that does best (F1) on those.  Scoring is a
scan of all documents without a shuffle.

Cases: null and empty texts, and any without a word, are not toxic; nor is one whose words all have no
weight (the threshold stays above the intercept); a label that is null is no label; a document with several labels is toxic if any says so; repeated documents are each scored;
without labels every score is 0.5 and nothing is toxic; an empty documents table gives an empty result; a very long
text is scored whole, by all its features; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import Shield, arrow_rows, shield

BITS = 20
DIMS = 1 << BITS
MAX_ROWS = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.5
_KINDS = (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C3C3C3C3C3C3C3C))


def features(tokens: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(document in chunk, feature) of every occurrence."""
    h, docs, shift = tokens.hashes, tokens.docs, np.uint64(64 - BITS)
    out = [(docs, h >> shift)]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        if len(h) > gap:
            same = docs[gap:] == docs[:-gap]
            out.append((docs[gap:][same], (K.mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + (h[gap:] ^ kind)) >> shift)[same]))
    return np.concatenate([d for d, _ in out]), np.concatenate([f for _, f in out]).astype(np.int64)


def bags(texts: pa.Array):
    """For every document in turn, its distinct features, a view of 4 bytes each."""
    for lo, hi in K.chunks(texts):
        docs, feats = features(K.tokenize(texts, lo, hi))
        both = np.unique((docs.astype(np.int64) << BITS) | feats)
        edges = np.searchsorted(both, np.arange(hi - lo + 1, dtype=np.int64) << BITS)
        small = (both & (DIMS - 1)).astype(np.int32)
        for i in range(hi - lo):
            yield small[edges[i] : edges[i + 1]]


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, threshold on the sum) from (features, label) in a fixed order; every bag has the intercept, DIMS, too."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(at):
        zi = z[at]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0
        return w

    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    for _ in range(epochs):
        for i, (bag, y) in enumerate(rows):
            if i % 5 == 4:
                continue
            at = np.append(bag, DIMS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    w = weights(np.arange(DIMS + 1))
    scores = np.array([w[f].sum() for f, _ in held]) + w[DIMS]
    truth = np.array([y for _, y in held])
    cut, best = 0.0, -1.0
    for t in np.unique(np.r_[0.0, scores]) if len(held) else []:
        hit = (scores >= t) & (truth == 1)
        f1 = 2 * hit.sum() / max(1, (scores >= t).sum() + truth.sum())
        if f1 > best:
            lower = scores[scores < t]
            cut, best = (float(t + lower.max()) / 2 if len(lower) else float(t)), f1
    return w[:DIMS], float(w[DIMS]), max(cut, float(w[DIMS]) + 1e-6)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(features with weight, their weights, intercept, threshold)."""
    wanted = Shield(labels, doc_id="bigint", toxic="int").picked().where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = wanted.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(max_rows)
    rows = shield(docs).picked().where("doc_id IS NOT NULL").join(F.broadcast(wanted), "doc_id")  # at most max_rows ids

    def run(batches):
        data = []
        for batch in batches:
            data += [(bag, int(y > 0)) for y, bag in zip(batch.column(1).to_pylist(), bags(K.as_strings(batch.column(0))))]
        K.tidy()
        if data:
            w, b, cut = fit(data)
            data, at = [], np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1, -2]), pa.array(np.r_[w[at], b, cut])], ["feature", "weight"])

    one = rows.repartition(1).sortWithinPartitions("turn", "doc_id", "text").select("text", "toxic")
    got = one.mapInArrow(K.tidied(run), "feature bigint, weight double").toPandas()
    if not len(got):
        return np.zeros(0, np.int64), np.zeros(0), 0.0, np.inf
    at, w = got["feature"].to_numpy(), got["weight"].to_numpy()
    return at[:-2], w[:-2], float(w[-2]), float(w[-1])


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Shield, DataFrame, float]:
    """The documents under positional names with ``q``, the sum of weights; the threshold."""
    arrow_rows(docs.sparkSession, 2_000)
    sealed = shield(docs)
    at, w, intercept, cut = train(docs, labels, max_rows)
    sent = docs.sparkSession.sparkContext.broadcast((at, w))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table = np.zeros(DIMS, np.float64)
        table[sent.value[0]] = sent.value[1]
        used = table != 0
        texts, out = K.as_strings(texts), np.full(len(texts), intercept)
        for lo, hi in K.chunks(texts):
            tokens = K.tokenize(texts, lo, hi)
            out[lo:hi][np.diff(tokens.offsets) == 0] = -np.inf
            docs, feats = features(tokens)
            hit = used[feats]
            both = np.unique((docs[hit].astype(np.int64) << BITS) | feats[hit])
            out[lo:hi] += np.bincount(both >> BITS, table[both & (DIMS - 1)], hi - lo)
        K.tidy()
        return pa.array(out)

    return sealed, sealed.rows.withColumn("q", score(sealed.col("text"))), cut


def report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents found toxic: doc_id and score (a probability)."""
    sealed, rows, cut = scored(docs, labels, max_rows)
    return rows.where(F.col("q") >= cut).select(sealed.col("doc_id").alias("doc_id"), (1 / (1 + F.exp(-F.col("q")))).alias("score"))


def clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    sealed, rows, cut = scored(docs, labels, max_rows)
    return sealed.restore(rows.where(~(F.col("q") >= cut)))
