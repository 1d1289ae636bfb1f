"""Operator 1 - license scans.

Documents are cut into overlapping word windows in size classes (each class fits the templates of about its
size: a window of W words every W/4 words holds any run of up to 3W/4 words whole).  Every window's set of word
pairs is MinHashed with ``MINIMA`` functions, and every two of the minima are a band: a window meets a template of its
class if they agree in two of them.  A template has more than 3W/8 words, so the Jaccard similarity of a window that holds
it is 1/4 or more, and a band is met with probability 1 - (3/4)^64 - 64 (1/4) (3/4)^63 > 0.999999.  The bands alone
retrieve; windows that met a template are then verified exactly: the share of the template's word pairs the window holds.

The minima of a window are those of its four quarters, and those of the quarters are the minima of smaller ones, so a
function costs a few vectorised passes over the words for all classes together.

Cases: null, empty and one-word texts match nothing; a null id is reported as null; repeated rows are each
reported; an empty table gives an empty result; a very long text is cut into windows from end to end; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import kernel as K
from quire.llm.common import arrow_rows, shield

MINIMA, ROWS = 64, 2
CONTAINMENT = 0.8
SHORTEST = 4

#: Short public license statements and the openings of license texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-line": "Released under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def window_of(n: int) -> int:
    """The size class of a template of n words: the least power of two, from 8, of which it is at most three quarters."""
    if n < SHORTEST:
        raise ValueError(f"a template needs {SHORTEST} words")
    return max(8, 1 << (-(-4 * n // 3) - 1).bit_length())


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return K.ngrams(hashes, 2)


def _functions() -> np.ndarray:
    """Odd factors of 32 bits: each orders the (well mixed) hashes of the word pairs anew."""
    return (K.mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Templates:
    """The templates of each size class: names, sets of word pairs, minima."""

    def __init__(self, templates: dict[str, str]):
        self.factors = _functions()
        self.known: dict[int, list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name, text in templates.items():
            tokens = K.tokenize(K.as_strings(pa.array([text])), 0, 1)
            pairs = np.unique(_pairs(tokens.hashes))
            minima = np.array([(f * (pairs >> np.uint64(32)).astype(np.uint32)).min() for f in self.factors])
            self.known.setdefault(window_of(len(tokens.hashes)), []).append((name, pairs, minima))

    def met(self, tokens: K.Tokens, pairs: np.ndarray):
        """(size class, template, documents, windows of each) of the windows that meet a template in a band."""
        step = max(self.known) // 4
        sizes = np.diff(tokens.offsets)
        room = -(-sizes // step) * step  # each document begins a quarter of the largest windows
        base = np.cumsum(room) - room
        padded = np.full(int(room.sum()) + 4 * step, np.uint32(0xFFFFFFFF))
        hashes, good = (pairs >> np.uint64(32)).astype(np.uint32), K.whole(tokens, 2)
        at = (np.arange(len(tokens.hashes)) + np.repeat(base - tokens.offsets[:-1], sizes))[: len(pairs)][good]
        empty, values = padded.copy(), np.zeros(len(padded), np.uint32)
        empty[at], values[at] = 0, hashes[good]
        agree = {w: np.zeros((len(of), len(padded) // (w // 4)), np.uint8) for w, of in self.known.items()}
        for k, factor in enumerate(self.factors):
            least, size = (values * factor) | empty, 1
            while size < step:
                least, size = np.minimum(least[::2], least[1::2]), size * 2
                if of := self.known.get(size * 4):
                    two = np.minimum(least[:-1], least[1:])
                    four = np.minimum(two[:-2], two[2:])  # into the next document at most: it can only add pairs
                    for count, (_, _, minima) in zip(agree[size * 4], of):
                        count[: len(four)] += four == minima[k]
        for w, of in self.known.items():
            quarters = room // (w // 4)
            for count, template in zip(agree[w], of):
                spot = np.flatnonzero(count >= ROWS)
                doc = np.searchsorted(base, spot * (w // 4), "right") - 1
                window = spot - base[doc] // (w // 4)
                inside = (window < quarters[doc]) & (window * (w // 4) < sizes[doc])
                yield w, template, doc[inside], window[inside]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each document and license it holds: doc_id, license, windows (that hold it), containment (the best)."""
    arrow_rows(docs.sparkSession, 2_000)
    known = Templates(templates)
    rows = shield(docs).picked()

    def run(batches):
        for batch in batches:
            texts, best = K.as_strings(batch.column(1)), {}
            for lo, hi in K.chunks(texts):
                tokens = K.tokenize(texts, lo, hi)
                if not len(tokens.hashes):
                    continue
                pairs = _pairs(tokens.hashes)
                for w, (name, wanted, _), docs_, windows in known.met(tokens, pairs):
                    for d, s in zip(docs_.tolist(), windows.tolist()):
                        first = int(tokens.offsets[d]) + s * (w // 4)
                        last = min(first + w, int(tokens.offsets[d + 1]))
                        share = float(np.isin(wanted, pairs[first : last - 1]).sum()) / len(wanted)
                        if share >= containment:
                            x = best.setdefault((lo + d, name), [0, 0.0])
                            x[0], x[1] = x[0] + 1, max(x[1], share)
            if best:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in best])), pa.array([n for _, n in best]), pa.array([x[0] for x in best.values()], pa.int32()), pa.array([x[1] for x in best.values()])], ["doc_id", "license", "windows", "containment"])

    return rows.mapInArrow(K.tidied(run), "doc_id bigint, license string, windows int, containment double")


def scan_sql(templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The exact result, with no MinHash before the containment."""
    values = ", ".join(f"('{n}', {window_of(len(words_of(t)))}, {len(set(zip(words_of(t), words_of(t)[1:])))}, '{a} {b}')" for n, t in templates.items() for a, b in sorted(set(zip(words_of(t), words_of(t)[1:]))))
    return f"""WITH t(license, w, size, g) AS (VALUES {values}),
    d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
    g AS (SELECT rid, doc_id, x.p AS p, x.g AS g FROM (SELECT rid, doc_id, unnest(list_transform(range(0, len(ws) - 1), lambda i: {{'p': i, 'g': ws[i + 1] || ' ' || ws[i + 2]}})) AS x FROM d)),
    h AS (SELECT rid, doc_id, license, w, size, p, g, unnest(range(greatest(0, CAST(ceil((p + 2 - w) / (w / 4)) AS BIGINT)), p // (w // 4) + 1)) AS s FROM g JOIN t USING (g)),
    v AS (SELECT rid, doc_id, license, s, count(DISTINCT g) / any_value(size) AS share FROM h GROUP BY ALL HAVING share >= {containment})
    SELECT doc_id, license, count(*)::INT AS windows, max(share)::DOUBLE AS containment FROM v GROUP BY rid, doc_id, license"""
