"""Recurring passages: what suffix-array dedup and phrase automata share.

Both look for runs of at least ``LENGTH`` words (exact, split at ASCII white space) that occur at two places
or more.  Documents are read in full once to choose minimisers, runs of ``K_WORDS`` words such that every
window of LENGTH words holds one at a place that depends only on the window's words.  Only minimisers that
occur twice can lie in a recurring window.  The stretches around those - every window that chose the minimiser,
at most LENGTH + W - 1 words - go to the shard of the minimiser, so that all occurrences of a window meet in
one shard, whole.  A stretch's words travel as hashes of 32 bits; windows are compared by all their words.

Hot minimisers never meet in one task.  Occurrences are counted with one row for each batch of documents, and a
minimiser with more than ``HOT`` of them sends no stretches: its windows are sharded by their own content (64-bit
hashes), again with one row for each batch, the first occurrence there; the batch's others are known to be later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import Shield, arrow_rows, discard, may_be_in, release, small, stored

LENGTH = 50
K_WORDS = 16
#: Stretches that a shard works on at a time (more only if one minimiser has more, at most HOT).
AT_A_TIME = 20_000
HOT = 20_000
SALTS = 64
#: kind 0: a stretch; 1: the first place in a batch of a window of a hot minimiser (n: its places there); 2: later copies, n words long (words: the 8 bytes of an id with an earlier one).
SEGMENT = "key bigint, kind int, doc_id bigint, text_hash bigint, place int, n int, words binary"
FOUND = "doc_id bigint, text_hash bigint, start int, end int, later boolean, source bigint"


def _mark(length: int):
    """Rows of minimisers; those of a batch's own recurring ones are known to recur (weight 2, any salt), and one row stands for them in the count."""

    def run(batches):
        turn = 0
        for batch in batches:
            texts, parts = K.as_strings(batch.column(2)), []
            for lo, hi in K.chunks(texts):
                tokens = K.tokenize(texts, lo, hi, K.FIELDS)
                place, key, first, last = K.anchors(tokens, K_WORDS, length - K_WORDS + 1)
                if len(place):
                    doc = np.searchsorted(tokens.offsets, place, "right") - 1
                    base = tokens.offsets[doc]
                    parts.append((key, doc + lo, (first - base).astype(np.int32), (last - base).astype(np.int32)))
            if not parts:
                continue
            key, doc, first, last = (np.concatenate(x) for x in zip(*parts))
            one, at, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = times[back] > 1
            salt = np.where(many, 1 + (np.arange(len(key)) + turn) % SALTS, 0).astype(np.int32)
            stand = np.flatnonzero(times > 1)
            take = pa.array(np.r_[doc, doc[at[stand]]])
            key = np.r_[key, one[stand]]
            columns = [np.r_[salt, np.zeros(len(stand), np.int32)], np.r_[np.where(many, 2, 1), times[stand]].astype(np.int64), np.r_[first, np.full(len(stand), -1, np.int32)], np.r_[last, np.full(len(stand), -1, np.int32)]]
            turn += len(salt)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], ["key", "doc_id", "text_hash", "salt", "weight", "first", "last"])

    return run


def _hot_windows(length: int, short: np.ndarray, a: np.ndarray, b: np.ndarray, doc: np.ndarray, first: np.ndarray):
    """(hash, row of the batch, place) of every window of the given stretches (words a to b of short)."""
    size = b - a - length + 1
    keys = K.ngrams(K.mix(short.astype(np.uint64) + np.uint64(1)), length)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return keys[np.repeat(a, size) + step], np.repeat(doc, size), np.repeat(first, size) + step


def _cut(length: int):
    names = [x.split()[0] for x in SEGMENT.split(", ")]

    def run(batches):
        for batch in batches:
            texts, spots = K.as_strings(batch.column(2)), batch.column(3)
            first, last, key, hot = (spots.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            at, windows = np.r_[0, np.cumsum(spots.value_lengths().to_numpy(zero_copy_only=False))], []
            for lo, hi in K.chunks(texts):
                tokens = K.tokenize(texts, lo, hi, K.FIELDS)
                short = tokens.hashes.astype(np.uint32)
                doc = np.repeat(np.arange(lo, hi), np.diff(at[lo : hi + 1]))
                mine = np.arange(at[lo], at[hi])
                a = tokens.offsets[doc - lo] + first[mine]
                b = tokens.offsets[doc - lo] + last[mine] + length
                few = ~hot[mine]
                if not few.all():
                    windows.append(_hot_windows(length, short, a[~few], b[~few], doc[~few], first[mine][~few]))
                words = [short[i:j].tobytes() for i, j in zip(a[few].tolist(), b[few].tolist())]
                take, none = pa.array(doc[few]), np.zeros(few.sum(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key[mine][few]), pa.array(none), batch.column(0).take(take), batch.column(1).take(take), pa.array(first[mine][few]), pa.array(none), pa.array(words, pa.binary())], names)
            if windows:
                yield from _thinned(batch, length, names, *(np.concatenate(x) for x in zip(*windows)))

    return run


def _thinned(batch: pa.RecordBatch, length: int, names: list[str], key: np.ndarray, row: np.ndarray, place: np.ndarray):
    """One row of kind 1 for each different window of a batch, and rows of kind 2 for the runs of its other places."""
    ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((place, hashes[row], ids[row], key))
    key, row, place = key[order], row[order], place[order]
    same_key = np.r_[False, key[1:] == key[:-1]]
    again = np.r_[False, same_key[1:] & (ids[row[1:]] == ids[row[:-1]]) & (hashes[row[1:]] == hashes[row[:-1]]) & (place[1:] == place[:-1])]  # a row twice
    key, row, place, same_key = key[~again], row[~again], place[~again], same_key[~again]
    start = np.flatnonzero(~same_key)
    rest = np.flatnonzero(same_key)
    rest = rest[np.lexsort((place[rest], row[rest]))]
    source = ids[row[np.maximum.accumulate(np.where(same_key, 0, np.arange(len(key))))]][rest]
    new = np.r_[True, (row[rest][1:] != row[rest][:-1]) | (place[rest][1:] != place[rest][:-1] + 1)] if len(rest) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    ends = np.r_[run[1:], len(rest)][: len(run)] - 1
    pick = np.r_[start, rest[run]]
    kind = np.r_[np.ones(len(start), np.int32), np.full(len(run), 2, np.int32)]
    n = np.r_[np.diff(np.r_[start, len(key)]), place[rest[ends]] - place[rest[run]] + length].astype(np.int32)
    take = pa.array(row[pick])
    yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), pa.array(kind), batch.column(0).take(take), batch.column(1).take(take), pa.array(place[pick].astype(np.int32)), pa.array(n), pa.array([None] * len(start) + [x.tobytes() for x in source[run]], pa.binary())], names)


def segments(sealed: Shield, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The stretches (SEGMENT) around recurring minimisers, sharded by minimiser and in its order."""
    rows, spark = sealed.keyed(), sealed.rows.sparkSession
    arrow_rows(spark, 2_000)
    marks = rows.mapInArrow(K.tidied(_mark(length)), "key bigint, doc_id bigint, text_hash bigint, salt int, weight bigint, first int, last int")
    # no window has more rows than there are batches: a batch's own copies stand under salts, and pass in any case
    marks = stored(marks.withColumn("n", F.sum("weight").over(Window.partitionBy("key", "salt"))).where("n > 1").select("key", "doc_id", "text_hash", "first", "last", F.when(F.col("salt") == 0, F.col("n")).alias("n")))
    release(spark)
    many = stored(marks.where(F.col("n") > hot).select("key").distinct())
    if many.isEmpty():
        spots = marks.withColumn("hot", F.lit(False))
    else:
        spots = marks.join(small(many.withColumn("hot", F.lit(True)), 16), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spots = stored(spots.where("first >= 0").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last", "key", "hot")).alias("spots")))
    for table in (marks, many):
        discard(table)
    release(spark)
    there = may_be_in(F.xxhash64("doc_id", "text_hash"), spots.select(F.xxhash64("doc_id", "text_hash").alias("key")))  # other texts stay where they are
    found = rows.where(there).join(spots, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spots")
    return found.mapInArrow(K.tidied(_cut(length)), SEGMENT).repartition("key").sortWithinPartitions("key", "kind", "doc_id", "text_hash", "place")


class Stretches:
    """A shard's stretches as one array of words; windows are numbered through."""

    def __init__(self, batches: list[pa.RecordBatch], length: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        column = rows.column("words").combine_chunks() if isinstance(rows.column("words"), pa.ChunkedArray) else rows.column("words")
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        self.words = np.frombuffer(column.buffers()[2], np.uint32, (offsets[-1] - offsets[0]) // 4, offsets[0])
        self.at = (offsets - offsets[0]).astype(np.int64) // 4
        self.doc, self.hash, self.place = (rows.column(c).to_numpy() for c in ("doc_id", "text_hash", "place"))
        self.length = length
        size = np.diff(self.at) - length + 1
        self.segment = np.repeat(np.arange(len(size)), size)
        self.window = np.arange(len(self.segment)) + np.repeat(self.at[:-1] - (np.cumsum(size) - size), size)  # its first word
        self.position = self.place[self.segment] + self.window - self.at[self.segment]

    def order(self, rank: np.ndarray) -> np.ndarray:
        """Windows by rank, equal ones by their place in the corpus."""
        return np.lexsort((self.position, self.hash[self.segment], self.doc[self.segment], rank))

    def same_place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s, t = self.segment[a], self.segment[b]
        return (self.doc[s] == self.doc[t]) & (self.hash[s] == self.hash[t]) & (self.position[a] == self.position[b])


def _streamed(batch: pa.RecordBatch, length: int, state: list):
    """FOUND of rows of kinds 1 and 2, which come in order of window and place; state: the last window's first row and whether it was given."""
    kind, key, n = (batch.column(c).to_numpy() for c in ("kind", "key", "n"))
    doc, hash_, place, words = *(batch.column(c).to_numpy() for c in ("doc_id", "text_hash", "place")), batch.column("words")
    out = []
    for i in range(batch.num_rows):
        if kind[i] == 2:  # its first copy is in the same batch of documents, found by the rows of kind 1
            out.append((doc[i], hash_[i], place[i], place[i] + n[i], True, int.from_bytes(words[i].as_py(), "little", signed=True)))
            continue
        at = (int(doc[i]), int(hash_[i]), int(place[i]), int(place[i]) + length)
        if not state or state[0] != key[i]:
            state[:] = [key[i], at, False]
        if (n[i] > 1 or state[1][:3] != at[:3]) and not state[2]:
            state[2] = True
            out.append((*state[1], False, None))
        if state[1][:3] != at[:3]:
            out.append((*at, True, state[1][0]))
    if out:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in FOUND.split(", ")])


def by_shard(work, length: int):
    """Calls work(Stretches) on whole minimisers, some AT_A_TIME stretches at once; rows of hot minimisers stream through."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, last, state = 0, None, []
        for batch in batches:
            hot = batch.column(1).to_numpy() > 0
            if hot.any():
                yield from _streamed(batch.filter(pa.array(hot)), length, state)
                batch = batch.filter(pa.array(~hot))
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            if size >= AT_A_TIME:
                edge = np.flatnonzero(key != last)
                if len(edge):
                    cut = int(edge[0])
                    if cut:
                        held.append(batch.slice(0, cut))
                    yield from work(Stretches(held, length))
                    held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
            last = key[-1]
        if held:
            yield from work(Stretches(held, length))

    return K.tidied(run)


def union_of(spans) -> Column:
    return F.arrow_udf(_union, "array<struct<start int, end int>>")(spans)


def without(texts, spans) -> Column:
    return F.arrow_udf(_without, "string")(texts, spans)


def _union(spans: pa.Array) -> pa.Array:
    """Ranges of words, merged and in order."""
    out = []
    for row in spans.to_pylist():
        got = row or []
        out.append([{"start": a, "end": b} for a, b in K.merged(np.array([x["start"] for x in got]), np.array([x["end"] for x in got]))])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without ranges of words and the white space after each."""
    texts, out = K.as_strings(texts), []
    given = spans.to_pylist()
    for lo, hi in K.chunks(texts):
        tokens = K.tokenize(texts, lo, hi, K.FIELDS)
        for doc in range(lo, hi):
            at, base, end = tokens.offsets[doc - lo], tokens.bytes_at[doc - lo], int(tokens.bytes_at[doc - lo + 1] - tokens.bytes_at[doc - lo])
            n = int(tokens.offsets[doc - lo + 1] - at)
            place = lambda i: int(tokens.starts[at + i] - base) if i < n else end  # noqa: E731, B023
            out.append(K.cut(texts[doc].as_py().encode(), [(place(s["start"]), place(s["end"])) for s in given[doc] or ()]))
    return pa.array(out, pa.string())
