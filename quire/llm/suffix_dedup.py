"""Operator 7 - suffix-array dedup by longest previous factors.

Each shard of stretches (see passages.py) is one text.  Its suffix array is built by prefix doubling, the ranks
of all depths being kept, so that the common prefix of any two suffixes is found by descending through them.
In suffix order the nearest suffixes on either side that lie at a smaller place of the corpus (the previous and
next smaller values, found by descending through minima of blocks) are the only candidates for a suffix's longest
earlier match; the longer of the two common prefixes is its longest previous factor (LPF).  Words under a factor of
at least LENGTH words are later copies and go; the first copy (least doc_id, then place) stays.  Factors end with their
stretch, and those of the following stretches go on from there, so a longer match is covered whole.

A minimiser with more than passages.HOT occurrences has no suffix array: the first place of each of its windows is
found by streaming the windows in order.  The removed ranges are the same; of several later copies in one batch of documents,
``sources`` then names the batch's first document, which holds an earlier copy, too, but need not hold the first.

Cases: null, empty and short texts have no windows; null ids come before all others in the order of copies;
rows with the same doc_id and text are one document; of several matches in one document the first stays; a very
long text is cut into stretches like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import null_id, shield
from quire.llm.passages import FOUND, HOT, LENGTH, Stretches, by_shard, segments, union_of


def ranks(words: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the suffixes of the concatenated stretches by their first 1, 2, 4, ... words, to depth words at least (a stretch's end is unique)."""
    n, ends = len(words), np.zeros(len(words) + 1, np.int32)
    ends[at[1:] - 1] = 1
    segment = np.cumsum(ends[:-1], dtype=np.int32) - ends[:-1]
    left = (at[1:][segment] - np.arange(n)).astype(np.int32)
    out, have = [np.unique(words, return_inverse=True)[1].astype(np.int32)], 1
    while have < depth:
        rank, second = out[-1], np.zeros(n, np.int64)
        gap = min(have, n)
        second[: n - gap] = rank[gap:] + np.int64(len(at))
        second = np.where(left > have, second, segment)  # past the end: the stretch itself
        out.append(np.unique((rank.astype(np.int64) << 32) | second, return_inverse=True)[1].astype(np.int32))
        have *= 2
    return out


def common(levels: list[np.ndarray], left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes a and b have in common at their start; left: of each suffix, the words to its stretch's end."""
    n, size = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + size, b + size
        inside = np.maximum(i, j) < n
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        size += same.astype(np.int64) << k
    return np.minimum(size, np.minimum(left[a], left[b]))


def smaller_before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each place, the last place before it, from start on, with a smaller value; -1 where there is none."""
    here = np.arange(len(values))
    least, reach = [values], int((here - start).max(initial=0))
    while (2 << (len(least) - 1)) <= reach:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    end = here.copy()  # all from end to the place are not smaller
    for k in range(len(least) - 1, -1, -1):
        for _ in range(2 if k == len(least) - 1 else 1):
            to = end - (1 << k)
            fits = np.flatnonzero(to >= start)
            good = fits[least[k][to[fits]] >= values[fits]]
            end[good] = to[good]
    return np.where(end > start, end - 1, -1)


def factors(s: Stretches, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, LPF, the suffix that it repeats) of every suffix whose longest previous factor has at least ``least`` words."""
    levels = ranks(s.words, s.at, int(np.diff(s.at).max()))
    order = np.argsort(levels[-1])  # the suffix array
    left = np.repeat(s.at[1:], np.diff(s.at)) - np.arange(len(s.words))
    linked = np.zeros(len(order) + 1, bool)
    linked[1:-1] = common(levels, left, order[:-1], order[1:]) >= least
    some = np.flatnonzero(linked[:-1] | linked[1:])  # suffixes that share so many words with a neighbour
    if not len(some):
        return (np.zeros(0, np.int64),) * 3
    suffix, first = order[some], ~linked[some]
    here = np.arange(len(some))
    start = np.maximum.accumulate(np.where(first, here, 0))
    segment = np.searchsorted(s.at, suffix, "right") - 1
    text = np.unique(np.rec.fromarrays([s.doc, s.hash]), return_inverse=True)[1]
    place = (text[segment].astype(np.int64) << 32) | (s.place[segment] + suffix - s.at[segment])  # order in the corpus
    before = smaller_before(place, start)
    last = ~linked[1:][some][::-1]  # in reverse order, runs start where they ended
    turned = smaller_before(place[::-1], np.maximum.accumulate(np.where(last, here, 0)))
    after = np.where(turned >= 0, len(some) - 1 - turned, -1)[::-1]
    lengths = [np.where(x >= 0, common(levels, left, suffix, suffix[x]), 0) for x in (before, after)]
    take = (lengths[1] > lengths[0]) | ((lengths[1] == lengths[0]) & (after >= 0) & (place[after] < place[before]))
    lpf, source = np.where(take, lengths[1], lengths[0]), np.where(take, after, before)
    found = lpf >= least
    root = np.where(found, source, here)
    while True:  # the first copy: matches of matches
        on = root[root]
        if (on == root).all():
            break
        root = on
    found = np.flatnonzero(found)
    return suffix[found], lpf[found], suffix[root[found]]


def earlier(s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(window, the first window that it repeats) of every window with an earlier match."""
    suffix, _, source = factors(s, s.length)
    order = np.argsort(suffix)
    window = np.full(len(s.words), -1)
    window[s.window] = np.arange(len(s.window))
    return window[suffix[order]], window[source[order]]


def _spans(s: Stretches):
    window, source = earlier(s)
    if not len(window):
        return
    order = np.argsort(window)
    window, source = window[order], source[order]
    doc, hash_ = s.doc[s.segment[source]], s.hash[s.segment[source]]
    moved = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1]) | (s.position[source[1:]] != s.position[source[:-1]] + 1)
    new = np.r_[True, (window[1:] != window[:-1] + 1) | (s.segment[window[1:]] != s.segment[window[:-1]]) | moved]  # a span has one source
    a, b = window[new], window[np.r_[np.flatnonzero(new)[1:] - 1, len(window) - 1]]
    seg = s.segment[a]
    columns = [s.doc[seg], s.hash[seg], s.position[a].astype(np.int32), (s.position[b] + s.length).astype(np.int32), np.ones(len(seg), bool), s.doc[s.segment[source[new]]]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def later_copies(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Documents with later copies: doc_id, removed (ranges of words), words_removed, sources (ids that hold earlier copies; a null id is left out)."""
    spans = segments(shield(docs), length, hot).mapInArrow(by_shard(_spans, length), FOUND).where("later")
    rows = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set(null_id(F.col("source")))).alias("sources"))
    rows = rows.select("doc_id", union_of("spans").alias("removed"), "sources")
    return rows.select(null_id(F.col("doc_id")).alias("doc_id"), "removed", F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"]).alias("words_removed"), "sources")
