"""Operator 3 - benchmark decontamination.

The test items' normalised n-grams (n words, case folded, punctuation dropped) form a hash set.  Every
window of n words of every document is looked up; a hit is verified against the n-gram's words.  The words
of verified windows are cut from the text together with the separators that follow them; a document with at
least ``drop_share`` of its words in such windows is dropped whole.

The set is broadcast while it has up to ``max_broadcast`` n-grams; a larger one is joined to the windows'
hashes by a shuffle, with the same result.

Cases: null or empty texts and items, and those shorter than n words, hit nothing; a null id is treated
like any other; repeated rows are each judged; an empty benchmark changes nothing; an empty documents table gives an empty result; very long texts are read whole; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import kernel as K
from quire.llm.common import Shield, arrow_rows, may_be_in, shield, stored

N = 8
DROP_SHARE = 0.5
MAX_BROADCAST = 1_000_000

RESULT = "struct<windows int, hit_words int, words int, items array<bigint>, text string>"
_ARROW = pa.struct([("windows", pa.int32()), ("hit_words", pa.int32()), ("words", pa.int32()), ("items", pa.list_(pa.int64())), ("text", pa.string())])


def _grams(texts: pa.Array, n: int):
    """(document, first word, hash, chunk) of the windows of a batch, chunk by chunk."""
    for lo, hi in K.chunks(texts):
        tokens = K.tokenize(texts, lo, hi)
        keys = K.ngrams(tokens.hashes, n)
        yield tokens, keys, K.whole(tokens, n)


def benchmark_grams(items: DataFrame, n: int = N) -> DataFrame:
    """(h, gram, item_id): every distinct n-gram of every item."""
    rows = Shield(items, item_id="bigint", text="string").picked()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), K.as_strings(batch.column(1))
            for tokens, keys, good in _grams(texts, n):
                at = np.flatnonzero(good)
                docs = tokens.docs
                grams = [" ".join(tokens.word(j) for j in range(i, i + n)) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(grams, pa.string()), ids.take(pa.array(docs[at] + tokens.lo))], ["h", "gram", "item_id"])

    return rows.mapInArrow(run, "h bigint, gram string, item_id bigint").distinct()


def _judge(tokens: K.Tokens, doc: int, hits: list[tuple[int, tuple]], n: int) -> dict:
    """The finding on one document; hits: (first word, items), words counted in the chunk."""
    first, last = tokens.offsets[doc], tokens.offsets[doc + 1]
    at = np.array([i for i, _ in hits])
    spans = K.merged(at, at + n)
    base, end = int(tokens.bytes_at[doc]), int(tokens.bytes_at[doc + 1])
    return {
        "windows": len(hits),
        "hit_words": sum(b - a for a, b in spans),
        "words": int(last - first),
        "items": sorted({x for _, items in hits for x in items if x is not None}),
        "spans": [(int(tokens.starts[a]) - base, (int(tokens.starts[b]) if b < last else end) - base) for a, b in spans],
    }


def _found(texts: pa.Array, lookup, n: int) -> pa.Array:
    """RESULT for each text, null where no window is verified; lookup: (tokens, keys, good) -> [(word, items)]."""
    out: list[dict | None] = [None] * len(texts)
    for tokens, keys, good in _grams(texts, n):
        hits = lookup(tokens, keys, good)
        if hits:
            docs = np.searchsorted(tokens.offsets, [i for i, _ in hits], "right") - 1
            for doc in np.unique(docs):
                found = _judge(tokens, int(doc), [h for h, d in zip(hits, docs) if d == doc], n)
                raw = texts[tokens.lo + int(doc)].as_py().encode()
                out[tokens.lo + int(doc)] = {**{k: v for k, v in found.items() if k != "spans"}, "text": K.cut(raw, found["spans"])}
    return pa.array(out, _ARROW)


def _broadcast_finder(table: dict[int, dict[str, tuple]], n: int, context):
    keys = np.array(sorted(table), np.uint64)
    sent = context.broadcast((keys, table))

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        known, grams = sent.value

        def lookup(tokens, keys, good):
            if not len(known) or not len(keys):
                return []
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            out = []
            for i in np.flatnonzero((known[at] == keys) & good):
                items = grams[int(keys[i])].get(" ".join(tokens.word(j) for j in range(i, i + n)))
                if items:
                    out.append((int(i), items))
            return out

        return _found(K.as_strings(texts), lookup, n)

    return find


def _joined(sealed: Shield, grams: DataFrame, n: int) -> DataFrame:
    """rows with the finding in ``q``, where the set is too large to broadcast."""

    def windows(batches):
        for batch in batches:
            for tokens, keys, good in _grams(K.as_strings(batch.column(2)), n):
                at = np.flatnonzero(good)
                doc = tokens.docs[at]
                take = pa.array(doc + tokens.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((at - tokens.offsets[doc]).astype(np.int32)), pa.array(keys[at].view(np.int64))], ["doc_id", "text_hash", "place", "h"])

    found = sealed.keyed().mapInArrow(K.tidied(windows), "doc_id bigint, text_hash bigint, place int, h bigint")
    hits = found.where(may_be_in(F.col("h"), grams.select("h"))).join(grams, "h").distinct()  # only windows that may hit are shuffled
    spots = stored(hits.groupBy(F.col("doc_id").alias("q_id"), F.col("text_hash").alias("q_hash")).agg(F.collect_list(F.struct("place", "gram", "item_id")).alias("q_spots")))

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array, spots: pa.Array) -> pa.Array:
        texts, given = K.as_strings(texts), spots.to_pylist()

        def lookup(tokens, keys, good):
            out: dict[int, set] = {}
            for doc in range(tokens.lo, tokens.hi):
                for s in given[doc] or ():
                    i = int(tokens.offsets[doc - tokens.lo]) + s["place"]
                    if " ".join(tokens.word(j) for j in range(i, i + n)) == s["gram"]:
                        out.setdefault(i, set()).add(s["item_id"])
            return sorted((i, tuple(x)) for i, x in out.items())

        return _found(texts, lookup, n)

    left = sealed.rows.withColumns({"q_id": sealed.key("doc_id"), "q_hash": sealed.key("text_hash")})
    return left.join(spots, ["q_id", "q_hash"], "left").withColumn("q", F.when(F.col("q_spots").isNotNull(), find(sealed.col("text"), F.col("q_spots"))))


def found(docs: DataFrame, items: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> tuple[Shield, DataFrame]:
    """The documents under positional names with ``q``, the finding (null: clean)."""
    arrow_rows(docs.sparkSession, 2_000)
    sealed, grams = shield(docs), stored(benchmark_grams(items, n))
    if grams.count() > max_broadcast:
        return sealed, _joined(sealed, grams, n)
    table: dict[int, dict[str, tuple]] = {}
    for row in grams.collect():
        at = table.setdefault(row.h & ((1 << 64) - 1), {})
        at[row.gram] = (*at.get(row.gram, ()), row.item_id)
    find = _broadcast_finder(table, n, docs.sparkSession.sparkContext)
    return sealed, sealed.rows.withColumn("q", find(sealed.col("text")))


def _dropped(drop_share: float) -> Column:
    return F.col("q.hit_words") >= F.col("q.words") * drop_share


def report(docs: DataFrame, items: DataFrame, n: int = N, drop_share: float = DROP_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Contaminated documents: doc_id, windows, hit_words, words, items (how many), action, clean_text (null if dropped)."""
    sealed, rows = found(docs, items, n, max_broadcast)
    rows = rows.where("q IS NOT NULL")
    return rows.select(sealed.col("doc_id").alias("doc_id"), "q.windows", "q.hit_words", "q.words", F.size("q.items").alias("items"), F.when(_dropped(drop_share), "drop").otherwise("cut").alias("action"), F.when(~_dropped(drop_share), F.col("q.text")).alias("clean_text"))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, drop_share: float = DROP_SHARE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The documents with their own columns: contaminated spans cut (n_chars, if there, set anew), documents beyond drop_share gone."""
    sealed, rows = found(docs, items, n, max_broadcast)
    return retexted(sealed, rows.where(F.col("q").isNull() | ~_dropped(drop_share)), F.col("q.text"))


def retexted(sealed: Shield, rows: DataFrame, text: Column) -> DataFrame:
    """rows with the text replaced where a new one is given, and n_chars with its length."""
    at = sealed.at["text"]
    if at:
        counts = [f"in{i}" for i, x in enumerate(sealed.names) if x == "n_chars"]
        kinds = dict(rows.dtypes)
        rows = rows.withColumns({**{c: F.when(text.isNotNull(), F.length(text).cast(kinds[c])).otherwise(F.col(c)) for c in counts}, at: F.coalesce(text, F.col(at))})
    return sealed.restore(rows)


def report_sql(n: int = N, drop_share: float = DROP_SHARE) -> str:
    word = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    gap = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]"
    grams = f"unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: {{'p': i, 'g': array_to_string(ws[i:i + {n - 1}], ' ')}}))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(text), '{word}+') AS ws, row_number() OVER () AS rid FROM documents),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '{word}+') AS ws FROM benchmark),
    bg AS (SELECT DISTINCT item_id, x.g AS g FROM (SELECT item_id, {grams} AS x FROM b)),
    dg AS (SELECT rid, x.p AS p, x.g AS g FROM (SELECT rid, {grams} AS x FROM d)),
    h AS (SELECT rid, p, item_id FROM dg JOIN bg USING (g)),
    w AS (SELECT DISTINCT rid, p + o AS i FROM h, range(0, {n}) t(o)),
    s AS (SELECT rid, count(DISTINCT p)::INT AS windows, count(DISTINCT item_id)::INT AS items FROM h GROUP BY rid),
    hw AS (SELECT rid, count(*)::INT AS hit_words, list(i) AS hs FROM w GROUP BY rid),
    c AS (SELECT d.doc_id, s.windows, hw.hit_words, len(d.ws)::INT AS words, s.items, hw.hs, d.text FROM d JOIN s USING (rid) JOIN hw USING (rid)),
    e AS (SELECT *, regexp_extract_all(text, '{word}+{gap}*') AS ps, regexp_extract(text, '^{gap}*') AS lead FROM c)
    SELECT doc_id, windows, hit_words, words, items, CASE WHEN hit_words >= words * {drop_share} THEN 'drop' ELSE 'cut' END AS action,
      CASE WHEN hit_words < words * {drop_share} THEN lead || array_to_string(list_filter(ps, lambda x, i: NOT list_contains(hs, i)), '') END AS clean_text FROM e"""
