"""Operator 4 - byte-level BPE encoding and decoding.

Text is split by the vocabulary's pattern on the JVM.  In each input split the distinct words are found
(an Arrow dictionary, no Python object per word), and Spark higher-order functions fold the ranked merges
over each distinct word's bytes once: a word starts as an array of its bytes' ids, and each step joins the
neighbours whose union has the least rank in a literal rank map, until no neighbours are in it.  Ids are then
laid out by each document's word numbers.  Nothing is shuffled, and the work per split does not grow with the
corpus.  Decoding concatenates the binary pieces of the ids.

The rank map is an array of small maps indexed by a remainder of the pair of ids, so that a look-up does not
walk 100,000 keys.  A word's array has one long number for each piece: from the highest bits, the rank of
its union with the next one, the place of its first byte, its id.  So the least number is the next merge.

Cases: null and empty texts give no tokens and decode to an empty text; a null id stays null; repeated rows
are each encoded; an empty table gives an empty result; other columns are ignored.  Any text is encodable
if the vocabulary has all 256 bytes, which is checked.  A very long text is one row like any other; the time of
one word (a run without a boundary of the pattern) grows with the square of its length, up to 16 MB.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import kernel as K
from quire.llm.common import arrow_rows, shield

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
BUCKETS = 32_749
_AT, _RANK = 20, 44  # the first bits of a piece's place and of its rank
_ID, _LOW = (1 << _AT) - 1, (1 << _RANK) - 1
_NONE = (1 << 19) - 1  # the rank of a pair that is no piece


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    return ranks


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<pair of ids, rank>>, a literal once the plan is optimised."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pair = a << _AT | b
                buckets[pair % BUCKETS][str(pair)] = rank
    return F.from_json(F.lit(json.dumps([b or None for b in buckets], separators=(",", ":"))), "array<map<string,int>>").cast("array<map<bigint,bigint>>")


def byte_ids(ranks: dict[bytes, int]) -> Column:
    return F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<bigint>")


def piece_list(ranks: dict[bytes, int]) -> Column:
    """array<binary>, the bytes of each id."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    return F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<binary>")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.aggregate(F.from_json(F.lit("[]"), "array<int>"), value, lambda x, _: x, then)


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def fold(word: Column, ranks: Column, singles: Column) -> Column:
    """The ids of a word: merges folded over its bytes."""

    def rank(a: Column, b: Column) -> Column:
        pair = a * (1 << _AT) + b
        return F.coalesce(F.try_element_at(F.get(ranks, (pair % BUCKETS).cast("int")), pair), _big(_NONE))

    def id_of(x: Column) -> Column:
        return x.bitwiseAND(_big(_ID))

    def step(v: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            def at(i: Column) -> Column:
                left, right, new = F.get(v, i - 2), F.get(v, i), F.shiftright(least, _RANK)
                first = left.bitwiseAND(_big(_LOW)) + F.shiftleft(rank(id_of(left), new), _RANK)
                second = least.bitwiseAND(_big(_LOW - _ID)) + new + F.shiftleft(rank(new, id_of(F.get(v, i + 1))), _RANK)
                rest = F.array_remove(F.array_remove(F.array_remove(v, right), least), left)  # each is there once: places differ
                return F.array_insert(F.array_insert(rest, i - 1, second), i - 1, first)

            return F.when(least >= _big(_NONE << _RANK), v).otherwise(_let(F.array_position(v, least).cast("int"), at))

        return _let(F.array_min(v), merge)

    def spread(bytes_: Column) -> Column:
        n = F.length(bytes_)

        def start(ids: Column) -> Column:
            body = F.transform(ids, lambda x, i: x + (i + 1).cast("bigint") * (1 << _AT) + F.shiftleft(F.when(i + 1 < n, rank(x, F.get(ids, i + 1))).otherwise(_big(_NONE)), _RANK))
            edge = lambda at: F.array(F.lit((_NONE << _RANK) + (at << _AT) + _ID))
            return F.concat(edge(0), body, edge((1 << (_RANK - _AT)) - 1))

        ids = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(singles, F.ascii(F.substring(bytes_, i, F.lit(1)))))
        folded = F.aggregate(F.slice(F.sequence(F.lit(1), n), F.lit(2), n), _let(ids, start), step)
        return F.transform(_let(folded, lambda v: F.slice(v, F.lit(2), F.size(v) - 2)), lambda x: id_of(x).cast("int"))

    return _let(F.decode(word.cast("binary"), "ISO-8859-1"), spread)


def decode(ids: Column, pieces: Column) -> Column:
    """The text of ids: their binary pieces one after the other, joined by runs of about the root of their number."""
    join = lambda parts, part: F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, part(x)))
    run = F.ceil(F.sqrt(F.size(ids) + F.lit(1))).cast("int")
    runs = _let(run, lambda k: F.transform(F.sequence(F.lit(1), F.size(ids) + 1, k), lambda a: join(F.slice(ids, a, k), lambda i: F.get(pieces, i))))
    return join(runs, lambda x: x).cast("string")


def _sliced(batches, rows: int = 500):
    """Smaller batches, so that what is made of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _number(batches):
    """(doc_id, sum, words) -> (doc_id, sum, numbers of the words, words new in this split)."""
    known: dict[str, int] = {}
    for batch in _sliced(batches):
        words = batch.column(2)
        flat = pa.concat_arrays([words.flatten()]).dictionary_encode()
        fresh, numbers = [], np.empty(len(flat.dictionary), np.int32)
        for i, w in enumerate(flat.dictionary.to_pylist()):
            n = known.get(w)
            if n is None:
                n = known[w] = len(known)
                fresh.append(w)
            numbers[i] = n
        at = numbers[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int32)
        sizes = np.zeros(batch.num_rows + 1, np.int32)
        np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=sizes[1:])
        new = np.full(batch.num_rows + 1, len(fresh), np.int32)
        new[0] = 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes), pa.array(at)), pa.ListArray.from_arrays(pa.array(new), pa.array(fresh, pa.string()))], ["doc_id", "sum", "at", "fresh"])


def _lay(batches):
    """(doc_id, sum, numbers, ids of the new words) -> (doc_id, sum, ids of the document)."""
    starts, sizes, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    for batch in batches:
        ids = batch.column(3).flatten()
        if len(ids):
            n = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.r_[starts, len(flat) + np.cumsum(n) - n]
            sizes = np.r_[sizes, n]
            flat = np.r_[flat, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]
        for part in _sliced([batch]):
            yield _laid(part, starts, sizes, flat)


def _laid(batch: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
    at = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    edges = np.zeros(batch.num_rows + 1, np.int64)
    np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False), out=edges[1:])
    n = sizes[at]
    ends = np.r_[0, np.cumsum(n)]
    out = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends[edges].astype(np.int32)), pa.array(out))], ["doc_id", "sum", "tokens"])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each row: doc_id, tokens, n_tokens, and whether decoding gives the text again (round_trip)."""
    arrow_rows(docs.sparkSession, 1_000)
    ranks = read_ranks(vocabulary)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = shield(docs).picked().select("doc_id", F.xxhash64(text).alias("sum"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("words"))
    numbered = words.mapInArrow(K.tidied(_number), "doc_id bigint, sum bigint, at array<int>, fresh array<string>")
    # the map is bound once, so that a plan holds one copy of the literal
    folded = numbered.select("doc_id", "sum", "at", _let(rank_map(ranks), lambda merges: F.transform("fresh", lambda w: fold(w, merges, byte_ids(ranks)))).alias("ids"))
    laid = folded.mapInArrow(K.tidied(_lay), "doc_id bigint, sum bigint, tokens array<int>")
    return laid.select("doc_id", "tokens", F.size("tokens").alias("n_tokens"), (F.xxhash64(decode(F.col("tokens"), piece_list(ranks))) == F.col("sum")).alias("round_trip"))
