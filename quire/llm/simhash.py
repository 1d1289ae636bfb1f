"""Operator 9 - near duplicates by SimHash and a May-Ozerov search.

A document's fingerprint is the 256-bit SimHash of its distinct word pairs (of its word, if it has only one).  Two
documents are near copies if their fingerprints differ in at most ``WITHIN`` bits, that is, if the cosine of
their sets of word pairs is about 0.74 or more; unrelated ones differ in some 124 bits, eight deviations off.

The search is a recursion.  The fingerprints, shifted by a random vector, are filtered by their partial weight on a random
strip of ``STRIP`` coordinates: those of a weight up to a cap form a list.  This is repeated with other shifts and strips.
A list with more than ``LIST`` members is filtered in the same way, by strips of its other coordinates, again and again;
small lists are compared in full.  Near fingerprints have similar weights, so a low weight of one makes that of the other
likely, and the odds are known exactly: the repetitions of all levels are set so that a pair of ``WITHIN`` bits, the edge of
what counts as near, meets in a list with probability ``RECALL``; closer pairs meet more often.  A list that is larger than
expected is compared in blocks, each with each, in separate tasks.  Within a task, those near one of a few leaders are
joined first, and pairs inside the largest group so found need no comparison.

Equal fingerprints are one node, and a list gives a spanning forest of its near pairs rather than all of
them, so thousands of copies cost thousands of edges.  Groups are the connected components; the least doc_id
of each stays.

Cases: texts without a word (null, empty) and rows with a null id are in no group; rows with the same doc_id
are one document, which stays or goes as a whole; an empty table gives an empty result; a very long text has one fingerprint of all its word pairs; extra columns stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import Shield, arrow_rows, shield, small, stored

WITHIN = 60
STRIP = 64
LIST = 6_000
NEAR, RECALL = WITHIN / 256, 0.95
INNER = 0.6  # what the repetitions within a list are to find of the pairs that are together in it
BLOCK = 100_000
WORDS = 4
LEADERS = 32
_SPREAD = np.uint64(0x0101010101010101)
_SALTS = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 4 words of 64 bits, number of features)."""
    out, sizes = np.zeros((len(texts), WORDS), np.uint64), np.zeros(len(texts), np.int64)
    for lo, hi in K.chunks(texts):
        tokens = K.tokenize(texts, lo, hi)
        docs = tokens.docs
        if not len(docs):
            continue
        counts = np.diff(tokens.offsets)
        pairs = K.ngrams(tokens.hashes, 2)
        same = docs[1:] == docs[:-1]
        single = tokens.offsets[:-1][counts == 1]
        feats = np.concatenate([pairs[same], tokens.hashes[single]])
        own = np.concatenate([docs[1:][same], docs[single]])
        both = np.unique((own.astype(np.uint64) << np.uint64(48)) | (feats >> np.uint64(16)))  # each pair counts once
        own, feats = (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
        n = np.bincount(own, minlength=hi - lo)
        sizes[lo:hi] = n
        first = np.cumsum(n) - n
        have = np.flatnonzero(n)
        # runs of at most 255 features of one document: eight counters of eight bits fit a word
        runs = np.concatenate([np.arange(first[i], first[i] + n[i], 255) for i in have])
        owners = own[runs]
        edges = np.searchsorted(owners, have)
        for w in range(WORDS):
            h = K.mix(feats + _SALTS[w])
            for bit in range(8):
                sums = np.add.reduceat((h >> np.uint64(bit)) & _SPREAD, runs).view(np.uint8).reshape(-1, 8)
                total = np.add.reduceat(sums, edges, axis=0, dtype=np.int64)
                on = (2 * total > n[have][:, None]).astype(np.uint64)
                for byte in range(8):
                    out[lo + have, w] |= on[:, byte] << np.uint64(8 * byte + bit)
    return out, sizes


def cap_odds(cap: int, near: float = NEAR, strip: int = STRIP) -> tuple[float, float]:
    """The probabilities that a random fingerprint, and that both of a pair that differs in a share near of its bits, weigh at most cap on a strip."""
    binomial = lambda n, p: np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    weight, both = binomial(strip, 0.5), 0.0
    for w in range(cap + 1):
        other = np.convolve(binomial(w, 1 - near), binomial(strip - w, near))  # the weight of the other one
        both += weight[w] * other[: cap + 1].sum()
    return float(weight[: cap + 1].sum()), float(both)


def caps_for(nodes: int, size: int = LIST) -> list[int]:
    """Caps of the strips in a row that leave about size of so many random fingerprints; none where there are no more."""
    if nodes <= size:
        return []
    depth = min(256 // STRIP, max(1, math.ceil(math.log(nodes / size) / math.log(50))))
    share = (size / nodes) ** (1 / depth)
    return [next(c for c in range(STRIP) if cap_odds(c)[0] >= share)] * depth


def repetitions(caps: list[int], near: float = NEAR, recall: float = RECALL) -> list[int]:
    """Repetitions of each level after which a pair that differs in a share near of its bits was in one list with probability recall."""
    out, below = [], 1.0
    for level in range(len(caps) - 1, -1, -1):
        together, wanted = cap_odds(caps[level], near)[1] * below, recall if level == 0 else INNER
        out.insert(0, math.ceil(math.log(1 - wanted) / math.log(1 - together)))
        below = 1 - (1 - together) ** out[0]
    return out


class Search:
    """The tree of lists: its random shifts and strips, and the rows of each list of a matrix of fingerprints."""

    def __init__(self, caps: list[int], small: frozenset[int] = frozenset(), seed: int = 20240607):
        self.caps, self.times, self.small, self.seed, self.made = caps, repetitions(caps), small, seed, {}

    def strip(self, path: tuple[int, ...], free: tuple | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shift, mask, coordinates left) of the list with this path; free: the coordinates that its parents left."""
        if path not in self.made:
            rng = np.random.default_rng([self.seed, *path])
            order, bits = rng.permutation(free), np.zeros(256, np.uint8)
            bits[order[:STRIP]] = 1
            self.made[path] = (rng.integers(0, 1 << 64, WORDS, np.uint64), np.packbits(bits, bitorder="little").view(np.uint64), order[STRIP:].astype(np.uint8))
        return self.made[path]

    def lists(self, f: np.ndarray, rows: np.ndarray | None = None, path: tuple[int, ...] = (), free=256, depth: int | None = None):
        """(number, rows) of the final lists; small: first-level lists that are final; depth: at most so many levels."""
        level, rows = len(path), np.arange(len(f)) if rows is None else rows
        if not self.caps:
            yield 0, rows
            return
        for t in range(self.times[level]):
            shift, mask, left = self.strip((*path, t), free)
            weight = np.bitwise_count((f[rows] ^ shift) & mask).sum(1, dtype=np.int64)
            mine = rows[weight <= self.caps[level]]
            if not len(mine):
                continue
            if level + 1 == (depth or len(self.caps)) or (level == 0 and t in self.small):
                number = 0
                for n, at in zip(self.times, (*path, t, *[0] * len(self.caps))):
                    number = number * n + at
                yield number, mine
            else:
                yield from self.lists(f, mine, (*path, t), left, depth)


def near_pairs(f: np.ndarray, within: int = WITHIN, block: int = 64, first: int | None = None):
    """Blocks (i, j) with i < j of the rows that differ in at most within bits; first: i is one of so many first rows."""
    half = within // 2 + 5 * math.isqrt(within // 4 + 1)  # a pair within may differ by this many in the first 128 bits
    a, b = (np.ascontiguousarray(f[:, w]) for w in (0, 1))
    for at in range(0, len(f) if first is None else first, block):
        stop = min(at + block, len(f) if first is None else first)
        d = np.bitwise_count(a[at:stop, None] ^ a[None, at:]) + np.bitwise_count(b[at:stop, None] ^ b[None, at:])
        i, j = np.nonzero(d <= half)
        i, j = i + at, j + at
        up = i < j
        i, j = i[up], j[up]
        d = np.bitwise_count(f[i] ^ f[j]).sum(1, dtype=np.int64)
        good = d <= within
        yield i[good], j[good]


def _joined(label: np.ndarray, pairs) -> np.ndarray:
    """Labels (the least member) after the pairs' groups were joined."""
    edges = [(i, j) for i, j in pairs if len(i)]
    if not edges:
        return label
    a, b = (np.concatenate(x) for x in zip(*edges))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(f: np.ndarray, within: int = WITHIN) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the connected components of the near pairs, roots left out."""
    label = np.arange(len(f))
    if len(f) > 8 * LEADERS:
        spaced = np.linspace(0, len(f) - 1, LEADERS).astype(np.int64)
        for leader in spaced:
            near = np.flatnonzero(np.bitwise_count(f ^ f[leader]).sum(1, dtype=np.int64) <= within)
            label = _joined(label, [(near, np.full(len(near), leader))])
        root, n = np.unique(label, return_counts=True)
        inside = label == root[n.argmax()]
        # pairs inside the largest group are joined already: only those with another member are left
        order = np.r_[np.flatnonzero(~inside), np.flatnonzero(inside)]
        label = _joined(label, ((order[i], order[j]) for i, j in near_pairs(f[order], within, first=int((~inside).sum()))))
    else:
        label = _joined(label, near_pairs(f, within))
    member = np.flatnonzero(label != np.arange(len(f)))
    return member, label[member]


def _blocks(batches):
    """Tables of about BLOCK rows with their fingerprints as a matrix."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            yield table, np.stack([table.column(f"f{w}").to_numpy().view(np.uint64) for w in range(WORDS)], 1)
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.stack([table.column(f"f{w}").to_numpy().view(np.uint64) for w in range(WORDS)], 1)


def _counted(batches, search: Search, depth: int | None):
    """(list, members) of each block."""
    for _, f in _blocks(batches):
        found = [(number, len(rows)) for number, rows in search.lists(f, depth=depth)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["list", "n"])


def _listed(batches, search: Search, parts: dict[int, int]):
    """Every fingerprint once in each list that it is in, or once in each pair of blocks of a list that has parts."""
    for table, f in _blocks(batches):
        block, held, size = K.mix(table.column("node").to_numpy().view(np.uint64).copy()), [], 0

        def sent():
            rows = np.concatenate([r for _, r in held])
            key = np.repeat(np.array([k for k, _ in held], np.uint64), [len(r) for _, r in held])
            return pa.RecordBatch.from_arrays([pa.array(K.mix(key).view(np.int64)), table.column("node").combine_chunks().take(pa.array(rows)), *[pa.array(f[rows, w].view(np.int64)) for w in range(WORDS)]], ["list", "node", "f0", "f1", "f2", "f3"])

        for number, rows in search.lists(f):
            n = parts.get(number, 1)
            mine = (block[rows] % np.uint64(n)).astype(np.int64)
            for a in range(n):
                for b in range(a, n):  # both blocks of a pair, one of them alone where they are the same
                    some = rows if n == 1 else rows[(mine == a) | (mine == b)]
                    if len(some):
                        held.append(((number * 1_000_003 + a) * 1_000_003 + b & (1 << 64) - 1, some))
                        size += len(some)
            if size >= 20_000:
                yield sent()
                held, size = [], 0
        if held:
            yield sent()


def _compared(batches, within: int):
    """Edges of each list; rows come in order of their list."""
    at, held = None, []

    def edges():
        rows = pa.Table.from_batches(held).combine_chunks()
        node = rows.column("node").to_numpy()
        if len(node) < 2:
            return None
        order = np.argsort(node)
        f = np.stack([rows.column(f"f{w}").to_numpy().view(np.uint64) for w in range(WORDS)], 1)[order]
        member, root = forest(f, within)
        return pa.RecordBatch.from_arrays([pa.array(node[order][member]), pa.array(node[order][root])], ["u", "v"]) if len(member) else None

    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for a, b in zip(cuts, [*cuts[1:], len(key)]):
            if key[a] != at and held:
                if out := edges():
                    yield out
                held = []
            at = key[a]
            held.append(batch.slice(a, b - a))
    if held and (out := edges()):
        yield out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the least of its component; edges (u, v) is a stored table.

    Alternates large-star and small-star steps; each is stored, so a lost executor repeats one step only.
    """
    spark, now = edges.sparkSession, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        # large star: every neighbour above u goes to the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lower neighbours go to the least of these
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = now.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = stored(now)
        mark = tuple(now.agg(F.count("*"), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def copies(docs: DataFrame, within: int = WITHIN, size: int = LIST) -> DataFrame:
    """A stored table of the documents that a kept one stands for: doc_id and kept_id (the least id of the group)."""
    arrow_rows(docs.sparkSession, 2_000)
    sealed = shield(docs)

    @F.arrow_udf("struct<f0 bigint, f1 bigint, f2 bigint, f3 bigint, n bigint>")
    def print_of(texts: pa.Array) -> pa.Array:
        f, n = fingerprints(K.as_strings(texts))
        return pa.StructArray.from_arrays([*[pa.array(f[:, w].view(np.int64)) for w in range(WORDS)], pa.array(n)], ["f0", "f1", "f2", "f3", "n"])

    rows = sealed.rows.select(sealed.col("doc_id").alias("doc_id"), print_of(sealed.col("text")).alias("p")).where("doc_id IS NOT NULL")
    rows = stored(rows.select("doc_id", "p.f0", "p.f1", "p.f2", "p.f3", "p.n")).where("n > 0").drop("n")
    keys = ["f0", "f1", "f2", "f3"]
    nodes = stored(rows.groupBy(*keys).agg(F.min("doc_id").alias("node")).select("node", *keys))
    count = nodes.count()
    caps = caps_for(count, size)

    def sizes(search: Search, depth: int | None) -> DataFrame:
        return nodes.mapInArrow(K.tidied(lambda b: _counted(b, search, depth)), "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n"))

    search = Search(caps)
    if len(caps) > 1:  # first-level lists, a few thousand at most
        search = Search(caps, frozenset(r.list for r in sizes(search, 1).where(F.col("n") <= size).collect()))
    parts = {r.list: math.ceil(r.n / (4 * size)) for r in sizes(search, None).where(F.col("n") > 4 * size).collect()}  # those that clusters made larger than expected
    lists = nodes.mapInArrow(K.tidied(lambda b: _listed(b, search, parts)), "list bigint, node bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    lists = lists.repartition("list").sortWithinPartitions("list")
    near = lists.mapInArrow(K.tidied(lambda b: _compared(b, within)), "u bigint, v bigint").distinct()
    same = rows.join(nodes, keys).select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v")
    edges = stored(near.union(same))
    return stored(components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id")))


def dedup(docs: DataFrame, within: int = WITHIN) -> DataFrame:
    """The documents without the copies, with their own columns."""
    sealed: Shield = shield(docs)
    gone = small(copies(docs, within).select(F.col("doc_id").alias("q_gone")).distinct(), 16)
    return sealed.restore(sealed.rows.join(gone, sealed.col("doc_id") == F.col("q_gone"), "left_anti"))
