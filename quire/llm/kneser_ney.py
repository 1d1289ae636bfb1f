"""Operator 8 - quality by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted documents (labelled of good quality; every fifth, by a hash of its id, is
held out).  Every trained word has a key of its own, its 64-bit hash; words that were not trained share one
unknown word that gets the reserved share only.  What the model knows is a table of items (key, value):
a bigram's value is what its count adds to its log back-off probability, a word's is what its own share and
the weight it leaves as a context add to those of the unknown word.  The log-probability of a text is the sum
of its items' values, and an item that is not known adds nothing.  Neither bigrams nor words are bounded: items
stay sharded by key, and the documents' items are sent to the shards in sorted, packed arrays and joined there.
Keys take turns, in counting and in joining, so that one in ``ROUNDS`` of the items is on disk at a time.  The ``COMMON`` most frequent words are sent to
the texts beforehand, which saves sending those to the shards and changes no result.  Trusted texts are found by a join on
their ids, at every size alike; a bitmap of ``MARKS`` bits, which has a fixed size, keeps nearly all others from the shuffle.

A document is kept if its perplexity is at most its language's ``QUANTILE`` over the held-out trusted
documents (over all languages together, where a language has fewer than ``LEAST`` of those).

Cases: a text without words has no perplexity and is kept; null languages form a language of their own;
null ids are kept like any other; rows with the same id and text get the same figure; a document labelled
twice is trusted if every label says so; with no trusted text nothing is rejected; an empty table gives an
empty result; a very long text is scored whole, its words in one batch; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import Shield, arrow_rows, discard, may_be_in, null_id, release, stored

VOCABULARY = 65_534  # smoothing reckons with this many words at least, and with all trained ones if there are more
COMMON = 65_536
START = 0  # stands before the first word of a text
ROUNDS = 4
QUANTILE = 0.995
LEAST = 50
SHARD_WORDS = 8_000_000  # of all documents, in a shard over all turns
ROWS = 10_000  # documents of a packed batch
MARKS = 1 << 26


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of bigrams seen once to four times (0.5, 1, 1.5 where these do not serve)."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


class Tables:
    """The least a text needs at hand: the unknown word's share (log), the start's weight (log) and the common words' values."""

    def __init__(self, words: np.ndarray, value: np.ndarray, weight: np.ndarray, unknown: float, start: float):
        order = np.argsort(words)
        self.words, self.value, self.weight = words[order], value[order], weight[order]
        self.unknown, self.start = unknown, start

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are common, their places)."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        common = self.words[at] == hashes
        return common, at[common]


def bigrams(tokens: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) of every word."""
    w = tokens.hashes
    before = np.full(len(w), START, np.uint64)
    if len(w) > 1:
        docs = tokens.docs
        before[1:] = np.where(docs[1:] == docs[:-1], w[:-1], np.uint64(START))
    return before, w


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(v + np.uint64(0x9E3779B97F4A7C15)) + w)


def word_key(w: np.ndarray) -> np.ndarray:
    return K.mix(w ^ np.uint64(0xC2B2AE3D27D4EB4F))


def last_key(w: np.ndarray) -> np.ndarray:
    """The key of the weight of a text's last word, which is no context."""
    return K.mix(w ^ np.uint64(0x165667B19E3779F9))


def turn_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(40)) % np.uint64(ROUNDS)


def _counted(texts: DataFrame, turn: int) -> DataFrame:
    """(v, w, n): the number of times that w follows v, of the pairs of one turn, added up in each task before any row leaves it."""

    def run(batches):
        none = np.zeros(0, np.uint64)
        have = (none, none, none, np.zeros(0, np.int64))  # key, v, w, n
        held: list[tuple] = []
        size = 0

        def fold():
            nonlocal have, held, size
            parts = [have, *held]
            held, size = [], 0
            key, first, back = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
            v, w = (np.concatenate([x[i] for x in parts])[first] for i in (1, 2))
            have = (key, v, w, np.bincount(back, np.concatenate([x[3] for x in parts]), len(key)).astype(np.int64))

        for batch in batches:
            texts = K.as_strings(batch.column(0))
            for lo, hi in K.chunks(texts):
                v, w = bigrams(K.tokenize(texts, lo, hi))
                key = pair_key(v, w)
                now = turn_of(key) == turn
                v, w = v[now], w[now]
                key, first, n = np.unique(key[now], return_index=True, return_counts=True)
                held.append((key, v[first], w[first], n))
                size += len(key)
                if size > 1_500_000:
                    fold()
        fold()
        _, v, w, n = have
        order = np.argsort(v)  # equal neighbours compress
        for at in range(0, len(order), 100_000):
            part = order[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(v[part].view(np.int64)), pa.array(w[part].view(np.int64)), pa.array(n[part])], ["v", "w", "n"])

    return texts.mapInArrow(run, "v bigint, w bigint, n bigint").groupBy("v", "w").agg(F.sum("n").alias("n"))


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held): the documents whose labels all say quality 1."""
    rows = Shield(labels, doc_id="bigint", quality="int").picked().where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q > 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose doc_id is in ids; a bitmap of hashed ids goes before the join."""
    there = may_be_in(F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("key")), MARKS)
    return docs.where("doc_id IS NOT NULL").where(there).join(ids.hint("shuffle_hash"), "doc_id")


def _looked_up(rows: DataFrame, by: str, names: list[str], stats: DataFrame, common: DataFrame) -> DataFrame:
    """rows with the columns names of stats for the word in column by; common words, which many rows have, are broadcast."""
    side = [F.col("word").alias(by), *[F.col(n) for n in names]]
    met = rows.join(F.broadcast(common.select(*side)), by, "left")
    there = F.col(names[0]).isNotNull()
    return met.where(there).unionByName(met.where(~there).select(*rows.columns).join(stats.where("NOT common").select(*side), by))


class Model:
    """What training leaves: counts (v, w, n) of each turn and stats of the words as stored tables, and what belongs to all."""

    def __init__(self, counts: list[DataFrame], stats: DataFrame, d: tuple[float, float, float], total: int, tables: Tables):
        self.counts, self.stats, self.d, self.total, self.tables = counts, stats, d, total, tables

    def items(self, turn: int, shard_of) -> DataFrame:
        """(shard, key, value) of the items of one turn."""
        stats, d = self.stats, self.d
        common = stats.where("common")
        rows = _looked_up(self.counts[turn], "v", ["weight", "total"], stats, common)
        rows = _looked_up(rows, "w", ["backed"], stats, common)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        gain = F.log1p((F.col("n") - cut) / F.col("total") / (F.col("weight") * F.col("backed")))
        rare = stats.where("NOT common")
        rows = rows.select(F.lit(0).alias("kind"), "v", "w", gain.alias("value"))
        rows = rows.union(rare.select(F.lit(1), F.lit(0).cast("bigint"), "word", "value")).union(rare.select(F.lit(2), F.lit(0).cast("bigint"), "word", -F.log("weight")))

        def keyed(batches):
            for batch in batches:
                kind = batch.column(0).to_numpy()
                v, w = (batch.column(i).to_numpy().view(np.uint64) for i in (1, 2))
                key = np.where(kind == 0, pair_key(v, w), np.where(kind == 1, word_key(w), last_key(w)))
                now = turn_of(key) == turn
                key = key[now]
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(key)), pa.array(key.view(np.int64)), batch.column(3).filter(pa.array(now))], ["shard", "key", "value"])

        return rows.mapInArrow(keyed, "shard int, key bigint, value double")


def train(texts: DataFrame) -> Model:
    """The model of texts, which has one column."""
    parts = []
    for turn in range(ROUNDS):
        parts.append(stored(_counted(texts, turn).sortWithinPartitions("v", "w")))  # in order, they take less disk
        release(texts.sparkSession)
    counts = reduce(DataFrame.union, parts)
    seen = counts.agg(F.count("*").alias("pairs"), F.sum("n").alias("words"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    d = discounts([seen[f"n{k}"] for k in (1, 2, 3, 4)])
    left = F.sum(F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
    contexts = counts.groupBy(F.col("v").alias("word")).agg(F.sum("n").alias("total"), (left / F.sum("n")).alias("weight"))
    ends = counts.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("ends"), F.sum("n").alias("uses"))
    # the start ends no bigram, the last word of a text may be no context
    words = stored(contexts.join(ends, "word", "full"))
    known = words.agg(F.count("ends")).first()[0]
    size = seen["pairs"] + 0.5 * (max(known, VOCABULARY) + 1)  # a share is left to words that ended no bigram
    top = F.broadcast(words.orderBy(F.desc_nulls_last("uses"), "word").limit(COMMON).select("word", F.lit(True).alias("common")))
    value = F.log((F.coalesce("ends", F.lit(0)) + 0.5) / 0.5) + F.log(F.coalesce("weight", F.lit(1.0)))
    stats = words.join(top, "word", "left").select("word", F.coalesce("common", F.col("word") == START).alias("common"), "total", F.coalesce("weight", F.lit(1.0)).alias("weight"), ((F.coalesce("ends", F.lit(0)) + 0.5) / size).alias("backed"), value.alias("value"))
    stats = stored(stats)
    discard(words)
    release(texts.sparkSession)
    near = stats.where("common").toArrow()
    word, share, weight = (near.column(c).to_numpy() for c in ("word", "value", "weight"))
    first, weight = word == START, np.log(weight)
    tables = Tables(word[~first].view(np.uint64), share[~first], weight[~first], math.log(0.5 / size), float(weight[first].sum()))
    return Model(parts, stats, d, seen["words"] or 0, tables)


_PACK = "zstd"


def _pack(values: np.ndarray) -> bytes:
    raw = pa.compress(values.tobytes(), codec=_PACK, asbytes=True)
    return len(values.tobytes()).to_bytes(4, "little") + raw


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec=_PACK, asbytes=True), kind)


def _items(tokens: K.Tokens, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in chunk, key) of what only the shards can tell, and the sum of the rest of each document."""
    docs, n = tokens.docs, tokens.hi - tokens.lo
    v, w = bigrams(tokens)
    common, at = tables.find(w)
    some = np.flatnonzero(np.diff(tokens.offsets))
    last = tokens.offsets[1:][some] - 1
    sums = np.bincount(docs, minlength=n) * tables.unknown + np.bincount(docs[common], tables.value[at], n)
    sums[some] += tables.start
    ends, place = tables.find(w[last])
    sums[some[ends]] -= tables.weight[place]
    rare = ~common
    doc = np.concatenate([docs, docs[rare], some[~ends].astype(docs.dtype)])
    return doc, np.concatenate([pair_key(v, w), word_key(w[rare]), last_key(w[last[~ends]])]), sums


def perplexity(docs: DataFrame, model: Model, shards: int) -> DataFrame:
    """(doc_id, text_hash, words, log_sum): one row for each different document; model is used up. shards: of each turn."""
    sent = docs.sparkSession.sparkContext.broadcast(model.tables)
    schema = "doc_id bigint, text_hash bigint, words bigint, log_sum double"

    def shard_of(key: np.ndarray) -> np.ndarray:
        return (key % np.uint64(shards)).astype(np.int32)

    def spread(batches, turn: int):
        """Rows (shard, sums, documents, keys) of the keys whose turn it is; in the first, one of sums instead of keys for each batch, in any shard."""
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = K.as_strings(batch.column(2))
            ids = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            keys, owners, sums, sizes = [], [], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for lo, hi in K.chunks(texts):
                tokens = K.tokenize(texts, lo, hi)
                doc, key, sums[lo:hi] = _items(tokens, sent.value)
                sizes[lo:hi] = np.diff(tokens.offsets)
                now = turn_of(key) == turn
                keys.append(key[now])
                owners.append((doc[now] + lo).astype(np.uint16))  # a batch has at most ROWS rows
            out = []
            if turn == 0:
                some = np.flatnonzero(sizes)
                place = int(K.mix(ids[:1, 0].astype(np.uint64))[0] % np.uint64(shards)) if len(ids) else 0
                out.append((place, True, _pack(ids[some]), _pack(sums[some]), _pack(sizes[some])))
            if keys:
                key, owner = np.concatenate(keys), np.concatenate(owners)
                place = shard_of(key)
                for s in range(shards):
                    part = np.flatnonzero(place == s)
                    if len(part):
                        part = part[np.argsort(key[part])]
                        own, at = np.unique(owner[part], return_inverse=True)
                        steps = np.diff(key[part], prepend=np.uint64(0))
                        planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
                        out.append((s, False, _pack(ids[own]), _pack(planes), _pack(at.astype(np.uint16))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.bool_()), *[pa.array([x[i] for x in out], pa.binary()) for i in (2, 3, 4)]], ["shard", "sums", "ids", "a", "b"])

    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, words, sums = [], [], []
        known = right.column("key").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, value = known[order], right.column("value").to_numpy()[order]
        for is_sums, raw_ids, a, b in zip(*[left.column(c).to_pylist() for c in ("sums", "ids", "a", "b")]):
            own = _unpack(raw_ids, np.int64).reshape(-1, 2)
            ids.append(own)
            if is_sums:
                sums.append(_unpack(a, np.float64))
                words.append(_unpack(b, np.int64))
                continue
            steps = np.ascontiguousarray(_unpack(a, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
            keys, at = np.cumsum(steps, dtype=np.uint64), _unpack(b, np.uint16)
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[place] == keys
                sums.append(np.bincount(at[hit], value[place[hit]], len(own)))
            else:
                sums.append(np.zeros(len(own)))
            words.append(np.zeros(len(own), np.int64))
        every = np.concatenate(ids) if ids else np.zeros((0, 2), np.int64)
        return pa.table({"doc_id": every[:, 0], "text_hash": every[:, 1], "words": np.concatenate(words or [np.zeros(0, np.int64)]), "log_sum": np.concatenate(sums or [np.zeros(0)])})

    turns = []
    for turn in range(ROUNDS):
        sent_out = docs.mapInArrow(lambda b, turn=turn: spread(b, turn), "shard int, sums boolean, ids binary, a binary, b binary")
        items = model.items(turn, shard_of)
        parts = sent_out.groupBy("shard").cogroup(items.groupBy("shard")).applyInArrow(join, schema)
        turns.append(stored(parts.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("words"), F.sum("log_sum").alias("log_sum"))))
        discard(model.counts[turn])
        del sent_out, items, parts
        release(docs.sparkSession)
    discard(model.stats)
    every = reduce(DataFrame.union, turns)
    return every.groupBy("doc_id", "text_hash").agg(F.sum("words").alias("words"), F.sum("log_sum").alias("log_sum"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A stored table (doc_id, text_hash, lang, held, perplexity); held: kept out of training though trusted."""
    sealed = Shield(docs, doc_id="bigint", text="string", lang="string")
    arrow_rows(docs.sparkSession, ROWS)  # a batch's keys are packed together, the better the more there are
    good = stored(trusted(docs, labels))
    texts = stored(marked(sealed.picked().select("doc_id", "text"), good.where("NOT held").select("doc_id")).select("text"))
    model = train(texts)
    discard(texts)
    release(docs.sparkSession)
    letters = sealed.picked().agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = perplexity(sealed.keyed(), model, max(6, math.ceil(letters / 6 / SHARD_WORDS)))  # a word takes six bytes or more
    rows = sealed.rows.select(sealed.key("doc_id"), sealed.key("text_hash"), sealed.col("lang").alias("lang")).dropDuplicates(["doc_id", "text_hash"])
    rows = rows.join(sizes, ["doc_id", "text_hash"], "left").join(good.where("held"), "doc_id", "left")
    return stored(rows.select("doc_id", "text_hash", "lang", F.coalesce("held", F.lit(False)).alias("held"), F.exp(-F.col("log_sum") / F.col("words")).alias("perplexity")))


def thresholds(rows: DataFrame, quantile: float = QUANTILE, least: int = LEAST) -> DataFrame:
    """(lang, most): the greatest perplexity kept, for every language of rows."""
    held = rows.where("held AND perplexity IS NOT NULL")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))  # a sketch of bounded size, exact for fewer documents
    every = held.agg(at).first()[0]
    own = held.groupBy(F.col("lang").alias("l")).agg(at.alias("own"), F.count("*").alias("n"))
    langs = rows.select("lang").distinct().join(own, F.col("lang").eqNullSafe(F.col("l")), "left")
    return langs.select("lang", F.coalesce(F.when(F.col("n") >= least, F.col("own")), F.lit(every).cast("double")).alias("most"))


def keep(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents kept: doc_id, lang, perplexity, threshold."""
    rows = scored(docs, labels)
    most = F.broadcast(thresholds(rows, quantile).withColumnRenamed("lang", "l"))  # one row for each language
    kept = rows.join(most, F.col("lang").eqNullSafe(F.col("l")), "left").where("perplexity IS NULL OR most IS NULL OR perplexity <= most")
    return kept.select(null_id(F.col("doc_id")).alias("doc_id"), "lang", "perplexity", F.col("most").alias("threshold"))
