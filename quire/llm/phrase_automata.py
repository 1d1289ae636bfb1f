"""Operator 10 - substring dedup with repeated-phrase automata.

In each shard of stretches (see passages.py) windows of ``LENGTH`` words that occur at two places are
confirmed word by word.  Confirmed windows that follow one another in a stretch, and in the place where they
occurred first, make a passage; the shard's distinct passages are compiled into one Aho-Corasick automaton
over word numbers, and all the shard's stretches are streamed through it, so that every occurrence of every
passage is located, the first included.  Every occurrence of a passage lies whole in a stretch of the same
shard, so sharding loses none.

Cases: null, empty and short texts hold no passage; null ids come before all others in the order of
occurrences; rows with the same doc_id and text are one document; of several occurrences in one document the
first may stay; a very long text is cut into stretches like any other; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import may_be_in, null_id, release, shield, stored
from quire.llm.decontaminate import retexted
from quire.llm.passages import FOUND, HOT, LENGTH, Stretches, by_shard, segments, union_of, without


def passages(s: Stretches, words: np.ndarray) -> list[tuple[int, ...]]:
    """The distinct confirmed passages of a shard; words: their numbers, from 0."""
    keys = K.ngrams(K.mix(s.words.astype(np.uint64) + np.uint64(1)), s.length)[s.window]
    order = s.order(keys)
    same = np.r_[False, keys[order][1:] == keys[order][:-1]]
    if same.any():  # confirmed word by word
        i = np.flatnonzero(same)
        for at in range(0, len(i), 100_000):
            part = i[at : at + 100_000]
            a, b = (s.window[order[p]][:, None] + np.arange(s.length) for p in (part, part - 1))
            same[part] = (s.words[a] == s.words[b]).all(1)
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    source = np.full(len(order), -1)
    source[order] = np.where(s.same_place(order, first), -1, first)
    window = np.flatnonzero(source >= 0)
    if not len(window):
        return []
    src = source[window]
    joined = (window[1:] == window[:-1] + 1) & (s.segment[window[1:]] == s.segment[window[:-1]]) & (src[1:] == src[:-1] + 1) & (s.segment[src[1:]] == s.segment[src[:-1]])
    new = np.r_[True, ~joined]
    a, b = s.window[window[new]], s.window[window[np.r_[np.flatnonzero(new)[1:] - 1, len(window) - 1]]] + s.length
    return list({tuple(words[i:j].tolist()) for i, j in zip(a.tolist(), b.tolist())})


def located(s: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first word in it, words of the passage, passage) of every occurrence, as columns."""
    words = np.unique(s.words, return_inverse=True)[1]
    found = passages(s, words)
    if not found:
        return np.zeros((0, 4), np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for i, passage in enumerate(found):
        automaton.add_word(passage, i)
    automaton.make_automaton()
    size = [len(p) for p in found]
    out = []
    for stretch, (a, b) in enumerate(zip(s.at[:-1].tolist(), s.at[1:].tolist())):
        out += [(stretch, end + 1 - size[i], size[i], i) for end, i in automaton.iter(tuple(words[a:b].tolist()))]
    return np.array(out, np.int64).reshape(-1, 4)


def _occurrences(s: Stretches):
    got = located(s)
    if not len(got):
        return
    stretch, at, size, passage = got.T
    start = s.place[stretch] + at
    order = np.lexsort((start, s.hash[stretch], s.doc[stretch], passage))
    new = np.r_[True, passage[order][1:] != passage[order][:-1]]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    f = stretch[first]
    later = ~((s.doc[stretch] == s.doc[f]) & (s.hash[stretch] == s.hash[f]) & (start == start[first]))
    yield pa.RecordBatch.from_arrays([pa.array(s.doc[stretch]), pa.array(s.hash[stretch]), pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32)), pa.array(later), pa.array(s.doc[f])], ["doc_id", "text_hash", "start", "end", "later", "source"])


def _found(docs: DataFrame, length: int, hot: int) -> DataFrame:
    """(doc_id, text_hash, passages, removed): ranges of words of all occurrences and of the later ones."""
    rows = segments(shield(docs), length, hot).mapInArrow(by_shard(_occurrences, length), FOUND)
    span = F.struct("start", "end")
    rows = rows.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("p"), F.collect_set(F.when(F.col("later"), span)).alias("r"))
    return rows.select("doc_id", "text_hash", union_of("p").alias("passages"), union_of("r").alias("removed"))


def occurrences(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every document that holds a recurring passage: doc_id, passages and removed (the later occurrences), as ranges of words."""
    return _found(docs, length, hot).select(null_id(F.col("doc_id")).alias("doc_id"), "passages", "removed")


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents with their own columns and the later occurrences cut (n_chars, if there, set anew)."""
    sealed = shield(docs)
    gone = stored(_found(docs, length, hot).where(F.size("removed") > 0).select(F.col("doc_id").alias("q_id"), F.col("text_hash").alias("q_hash"), "removed"))
    release(docs.sparkSession)
    there = may_be_in(F.xxhash64("q_id", "q_hash"), gone.select(F.xxhash64("q_id", "q_hash").alias("key")))
    rows = sealed.rows.withColumns({"q_id": sealed.key("doc_id"), "q_hash": sealed.key("text_hash")}).withColumn("q_there", there)
    cut = rows.where("q_there").join(gone, ["q_id", "q_hash"], "left")
    cut = cut.withColumn("q_text", F.when(F.col("removed").isNotNull(), without(sealed.col("text"), F.col("removed"))))
    names = [*sealed.rows.columns, "q_text"]
    rows = cut.select(*names).union(rows.where("NOT q_there").withColumn("q_text", F.lit(None).cast("string")).select(*names))  # most texts have no part to lose and are not moved
    return retexted(sealed, rows, F.col("q_text"))
