"""Suffix-array dedup, phrase automata, SimHash search, Kneser-Ney quality, the pipeline - against brute force."""

from __future__ import annotations

import importlib.util
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import kneser_ney, phrase_automata, simhash, suffix_dedup
from quire.llm.passages import Stretches
from tests.llm.conftest import prose, same_rows

L = 50


def _order(row):
    return (row[0] is not None, row[0] or 0)


def repeated(rows, length=L):
    """doc -> (words under windows with an earlier occurrence, words under any recurring window)."""
    at: dict[tuple, list] = {}
    for doc, text in sorted(rows, key=_order):
        words = (text or "").split()
        for i in range(len(words) - length + 1):
            at.setdefault(tuple(words[i : i + length]), []).append((doc, i))
    later, every = {}, {}
    for places in at.values():
        if len(places) > 1:
            for n, (doc, i) in enumerate(places):
                every.setdefault(doc, set()).update(range(i, i + length))
                if n:
                    later.setdefault(doc, set()).update(range(i, i + length))
    return later, every


def covered(spans) -> set[int]:
    return {i for s in spans for i in range(s["start"], s["end"])}


@pytest.fixture(scope="module")
def passages():
    """Passages of 50 to 300 words shared by two to many documents, overlapping, within one document, and near misses."""
    draw, shared = random.Random(5), [prose(2000 + i, n) for i, n in enumerate((50, 51, 60, 75, 120, 300))]
    rows = []
    for i in range(60):
        words = prose(i, draw.randrange(20, 200))
        for _ in range(draw.randrange(3)):
            p = draw.choice(shared)
            cut = p[draw.randrange(10) :][: draw.choice((45, 50, 70, 400))]
            at = draw.randrange(len(words))
            words[at:at] = cut
        rows.append((i, " ".join(words)))
    double = prose(70, 80)
    rows += [(70, " ".join(double + prose(71, 5) + double)), (71, " ".join(["ra"] * 130)), (72, " ".join(shared[4][:49])), (73, rows[3][1]), (74, rows[3][1]), (None, " ".join(shared[2])), (75, None), (76, "")]
    return rows


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_finds_all_later_copies(docs, passages, hot):
    """With hot=1 every minimiser goes the way of the hot ones."""
    later, _ = repeated(passages)
    got = suffix_dedup.later_copies(docs(passages).repartition(5), hot=hot).collect()
    assert {r.doc_id: covered(r.removed) for r in got} == later
    assert all(r.words_removed == len(later[r.doc_id]) for r in got) and all(r.sources for r in got if r.doc_id in (73, 74))


def test_sources_are_those_of_every_window(docs, passages):
    p = prose(4000, 65)
    for rows in (passages, [(1, " ".join(p[:60])), (2, " ".join(p)), (3, " ".join(p))]):
        first, want = {}, {}
        for doc, text in sorted(rows, key=_order):
            words = (text or "").split()
            for i in range(len(words) - L + 1):
                at = first.setdefault(tuple(words[i : i + L]), (doc, i))
                if at != (doc, i):
                    want.setdefault(doc, set()).add(at[0])
        got = {r.doc_id: set(r.sources) for r in suffix_dedup.later_copies(docs(rows)).collect()}
        assert got == {d: x - {None} for d, x in want.items()}
    assert got[3] == {1, 2}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_phrase_automata_find_every_occurrence(docs, passages, hot):
    later, every = repeated(passages)
    rows = docs(passages).repartition(5)
    got = {r.doc_id: r for r in phrase_automata.occurrences(rows, hot=hot).collect()}
    assert {d: covered(r.passages) for d, r in got.items()} == every
    assert {d: covered(r.removed) for d, r in got.items() if r.removed} == later
    out = {r.doc_id: r.text for r in phrase_automata.dedup(rows, hot=hot).collect()}
    assert len(out) == len(passages)
    for doc, text in passages:
        words = (text or "").split()
        assert (out[doc] or "").split() == [w for i, w in enumerate(words) if i not in later.get(doc, ())]


def test_after_the_cut_long_passages_occur_once(docs, passages):
    whole = [(i, " ".join(prose(i, 60) + prose(3000 + i % 3, 90) + prose(100 + i, 60))) for i in range(30)]
    out = phrase_automata.dedup(docs(whole)).collect()
    assert not repeated([(r.doc_id, r.text) for r in out])[0]
    assert [r.n_chars for r in out] == [len(r.text) for r in out]
    first = {r.doc_id: r.text for r in out}
    assert all(first[i] == whole[i][1] for i in range(3))


@pytest.mark.parametrize("run", [suffix_dedup.later_copies, phrase_automata.occurrences, simhash.copies])
def test_odd_rows_have_a_result(odd, clashing, run):
    assert same_rows(run(odd).collect()) == same_rows(run(clashing).collect())
    assert {r.doc_id for r in run(odd).collect()} <= {6, 7, 8, 5}
    assert run(odd.limit(0)).count() == 0


def test_passage_cuts_keep_odd_rows(odd, clashing):
    for frame in (odd, clashing):
        out = phrase_automata.dedup(frame)
        assert out.columns == frame.columns and out.count() == frame.count()
        gone = simhash.dedup(frame)
        assert gone.columns == frame.columns and gone.count() < frame.count()
    assert phrase_automata.dedup(odd.limit(0)).count() == simhash.dedup(odd.limit(0)).count() == 0


def test_longest_previous_factors():
    """LPF arrays against all pairs of suffixes, by place in the corpus."""
    draw = np.random.default_rng(3)
    for _ in range(60):
        sizes = draw.integers(1, 14, draw.integers(1, 9))
        at, words = np.r_[0, np.cumsum(sizes)], draw.integers(0, 3, sizes.sum()).astype(np.uint32)
        ids = draw.permutation(len(sizes)).astype(np.int64)
        rows = pa.table({"key": ids * 0, "kind": ids * 0, "doc_id": ids, "text_hash": ids * 0, "place": draw.integers(0, 9, len(sizes)).astype(np.int32), "n": ids * 0, "words": pa.array([words[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())})
        s = Stretches(rows.to_batches(), 1)
        spot = [(ids[k], s.place[k] + i - at[k]) for k in range(len(sizes)) for i in range(at[k], at[k + 1])]
        tail = [words[i : at[k + 1]].tolist() for k in range(len(sizes)) for i in range(at[k], at[k + 1])]
        shared = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = {i: max((shared(tail[i], tail[j]) for j in range(len(tail)) if spot[j] < spot[i]), default=0) for i in range(len(tail))}
        suffix, lpf, source = suffix_dedup.factors(s, 2)
        assert dict(zip(suffix.tolist(), lpf.tolist())) == {i: n for i, n in want.items() if n >= 2}
        assert all(spot[j] < spot[i] and shared(tail[i], tail[j]) >= 2 for i, j in zip(suffix, source))


# SimHash ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def family():
    """400 documents: groups of near copies of two to 30, exact copies, the rest unrelated."""
    draw, rows = random.Random(11), []
    for g in range(60):
        words = prose(5000 + g, draw.choice((40, 120, 400)))
        for c in range(30 if g == 0 else draw.randrange(1, 6)):
            mine = list(words)
            for _ in range(c * len(words) // 150):
                mine[draw.randrange(len(mine))] = draw.choice(("other", "changed", "new"))
            rows.append(" ".join(mine))
    rows += rows[:40]
    rows += [" ".join(prose(8000 + i, 150)) for i in range(150)]
    return rows


def _brute(f, within=simhash.WITHIN):
    return {(i, j) for i, j in itertools.combinations(range(len(f)), 2) if sum(int(x).bit_count() for x in f[i] ^ f[j]) <= within}


def test_simhash_groups_are_those_of_all_pairs(docs, family):
    f, _ = simhash.fingerprints(pa.array(family))
    root = list(range(len(f)))
    for i, j in sorted(_brute(f)):
        a, b = _find(root, i), _find(root, j)
        root[max(a, b)] = min(a, b)
    want = {(i, _find(root, i)) for i in range(len(f)) if _find(root, i) != i}
    got = {(r.doc_id, r.kept_id) for r in simhash.copies(docs(family)).collect()}
    assert got == want  # one list holds all: the search is exact
    kept = {r.doc_id for r in simhash.dedup(docs(family)).collect()}
    assert kept == set(range(len(f))) - {i for i, _ in want}


def _find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_simhash_recall_with_small_lists(docs, family):
    f, _ = simhash.fingerprints(pa.array(family))
    pairs = _brute(f)
    group = {r.doc_id: r.kept_id for r in simhash.copies(docs(family), size=40).collect()}
    joined = sum(group.get(i, i) == group.get(j, j) for i, j in pairs)
    assert joined >= 0.9 * len(pairs)
    of = lambda d: group.get(d, d)
    assert len({of(i) for i in range(len(f))}) >= 150  # unrelated documents stay apart


def test_near_pairs_are_exact():
    draw = np.random.default_rng(3)
    f = draw.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    for i in range(0, 300, 3):  # neighbours that differ in 0 to 80 bits
        f[i + 1] = f[i]
        for bit in draw.choice(256, draw.integers(0, 81), replace=False):
            f[i + 1, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(f) for i, j in zip(a, b)}
    assert got == _brute(f)


def test_odds_of_the_caps():
    """The probability that both of a near pair weigh little on a strip, against draws."""
    draw = np.random.default_rng(8)
    x = draw.integers(0, 2, (200_000, simhash.STRIP), dtype=np.int8)
    y = x ^ (draw.random(x.shape) < simhash.NEAR)
    one, both = simhash.cap_odds(27)
    low = x.sum(1) <= 27
    assert abs(low.mean() - one) < 0.004 and abs((low & (y.sum(1) <= 27)).mean() - both) < 0.004
    assert simhash.caps_for(100) == [] and len(simhash.caps_for(10_000_000)) == 2
    assert math.prod(simhash.repetitions([27, 27])) > simhash.repetitions([27])[0]


@pytest.mark.parametrize("caps", [[26], [28, 28], [30, 30, 30]])
def test_isolated_pairs_are_found_at_every_distance(caps):
    draw = np.random.default_rng(5)
    search = simhash.Search(caps)
    for bits in (20, 44, 50, 55, simhash.WITHIN):
        f = draw.integers(0, 1 << 64, (400, 4), dtype=np.uint64)
        other = f.copy()
        for row in other:
            for bit in draw.choice(256, bits, replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        met, numbers = np.zeros(400, bool), []
        for number, rows in search.lists(np.concatenate([f, other])):
            there = np.zeros(800, bool)
            there[rows] = True
            met |= there[:400] & there[400:]
            numbers.append(number)
        assert met.mean() >= 0.9, (bits, met.mean())
        assert len(set(numbers)) == len(numbers)


def test_large_lists_are_compared_in_blocks_and_through_leaders():
    draw = np.random.default_rng(6)
    base = draw.integers(0, 1 << 64, (1, 4), dtype=np.uint64)
    f = np.repeat(base, 700, 0)
    for row in f[:600]:  # a cluster, each some 20 bits off its centre
        for bit in draw.choice(256, 20, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    f[600:] = draw.integers(0, 1 << 64, (100, 4), dtype=np.uint64)
    f[650] = f[651] ^ np.uint64(1)
    member, root = simhash.forest(f)
    want = list(range(700))
    for i, j in _brute(f):
        a, b = _find(want, i), _find(want, j)
        want[max(a, b)] = min(a, b)
    assert dict(zip(member.tolist(), root.tolist())) == {i: _find(want, i) for i in range(700) if _find(want, i) != i}
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(700)), *[pa.array(f[:, w].view(np.int64)) for w in range(4)]], ["node", "f0", "f1", "f2", "f3"])
    found: dict[int, set] = {}
    for out in simhash._listed([batch], simhash.Search([]), {0: 5}):
        for key, node in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            found.setdefault(key, set()).add(node)
    assert len(found) == 15 and all(any({i, j} <= s for s in found.values()) for i, j in itertools.combinations(range(0, 700, 7), 2))


# Kneser-Ney ---------------------------------------------------------------------------------------------------


def _model(texts):
    """Perplexity by dictionaries."""
    pairs = Counter((v, w) for t in texts for v, w in zip(["<s>", *t], t))
    n = Counter(pairs.values())
    d = kneser_ney.discounts([n[k] for k in (1, 2, 3, 4)])
    ends, followers, total = Counter(w for _, w in pairs), Counter(), Counter()
    for (v, _), c in pairs.items():
        total[v] += c
        followers[v] += d[min(c, 3) - 1]
    size = sum(ends.values()) + 0.5 * (kneser_ney.VOCABULARY + 1)

    def p(v, w):
        back = (ends[w] + 0.5) / size * (followers[v] / total[v] if total[v] else 1)
        c = pairs[v, w]
        return back + ((c - d[min(c, 3) - 1]) / total[v] if c else 0)

    return lambda t: math.exp(-sum(math.log(p(v, w)) for v, w in zip(["<s>", *t], t)) / len(t))


def test_perplexity_is_that_of_the_model(spark, docs):
    texts = [prose(i, 30 + i % 50) for i in range(150)] + [["unseen", "words", "kara"], ["kara"]]
    frame = docs([" ".join(t) for t in texts] + [None, "", "..."])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    split = {r.doc_id: r.held for r in kneser_ney.trusted(frame, labels).collect()}
    assert set(split) == {i for i in range(120) if i % 3 > 0 and i != 4}
    of = _model([texts[i] for i, held in split.items() if not held])
    got = {r.doc_id: r.perplexity for r in kneser_ney.scored(frame, labels).collect()}
    assert set(got) == set(range(155)) and all(got[i] is None for i in (152, 153, 154))
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(of(t), rel=1e-6)


def test_quality_drops_what_is_unlike_the_trusted_text(spark, docs):
    draw = random.Random(2)
    junk = ["".join(draw.choice("qxzjkw") for _ in range(9)) for _ in range(400)]
    texts = [" ".join(prose(i, 80)) for i in range(400)] + [" ".join(draw.choice(junk) for _ in range(80)) for _ in range(20)]
    frame = docs(texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.keep(frame, labels).collect()}
    assert not kept & set(range(400, 420)) and len(kept & set(range(400))) >= 390


def test_gibberish_is_rejected_beyond_any_number_of_trusted_words(spark, docs):
    draw = random.Random(3)
    texts = [" ".join(x for j, x in enumerate(prose(i, 100)) for x in (x, f"name{i}n{j}")) for i in range(1100)]
    assert len({w for t in texts[:1000] for w in t.split()}) > 65_534
    junk = [" ".join("".join(draw.choice("qxzjkw") for _ in range(9)) for _ in range(150)) for _ in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1000)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.keep(docs(texts + junk), labels).collect()}
    assert not kept & set(range(1100, 1120)) and len(kept & set(range(1100))) >= 1050


def test_common_words_are_a_saving_only(spark, docs, monkeypatch):
    frame = docs([" ".join(prose(i, 40)) for i in range(60)] + ["kara unseen", "unseen"])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    every = {r.doc_id: r.perplexity for r in kneser_ney.scored(frame, labels).collect()}
    monkeypatch.setattr(kneser_ney, "COMMON", 5)
    some = {r.doc_id: r.perplexity for r in kneser_ney.scored(frame, labels).collect()}
    assert every == pytest.approx(some, rel=1e-9)


def test_thresholds_of_two_languages_and_of_too_few_documents(spark):
    """Each language has the quantile of its own held-out documents, a language with fewer than least that of all."""
    rows = [(i, "en", True, float(i)) for i in range(100)] + [(i, "fr", True, 1000.0 + i) for i in range(200)] + [(i, "xx", True, 5.0) for i in range(3)] + [(9, None, True, 7.0), (1, "de", False, 1.0), (2, "en", False, 1e9), (3, "fr", True, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, lang string, held boolean, perplexity double")
    got = {r.lang: r.most for r in kneser_ney.thresholds(frame, 0.9, 50).collect()}
    rank = lambda v: sorted(v)[math.ceil(0.9 * len(v)) - 1]
    every = rank([p for _, _, h, p in rows if h and p is not None])
    assert got == {"en": rank(range(100)), "fr": rank(range(1000, 1200)), "xx": every, None: every, "de": every}


def test_large_batches_and_hashed_marks(spark, docs, monkeypatch):
    """Batches are cut to ROWS; marks that meet in the bitmap are told apart by the join."""
    frame = docs([" ".join(prose(i, 12)) for i in range(90)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id bigint, quality int, toxic int")
    want = {r.doc_id: r.perplexity for r in kneser_ney.scored(frame, labels).collect()}
    monkeypatch.setattr(kneser_ney, "ROWS", 7)
    monkeypatch.setattr(kneser_ney, "MARKS", 64)
    assert {r.doc_id: r.perplexity for r in kneser_ney.scored(frame, labels).collect()} == pytest.approx(want, rel=1e-9)


def test_quality_cases(spark, odd, clashing):
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    for frame in (odd, clashing):
        assert kneser_ney.keep(frame, labels.limit(0)).count() == 13  # each different row: one is there twice
        assert kneser_ney.keep(frame, labels).where("perplexity IS NULL").count() >= 4
    assert kneser_ney.keep(odd.limit(0), labels).count() == 0


# the pipeline -------------------------------------------------------------------------------------------------


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline
    from quire.llm.bpe import read_ranks

    clean = [" ".join(prose(i, 90)) for i in range(60)]
    rude = [" ".join([*prose(300 + i, 60), "vile", "scum", "hate", "you", "all", *prose(400 + i, 20)]) for i in range(24)]
    copies = [clean[0], clean[1].replace("kara", "KARA", 1), None, ""]
    item = " ".join(prose(9000, 30))
    leak = " ".join([*prose(600, 100), item, *prose(601, 100)])
    share = [" ".join([*prose(700 + i, 70), *prose(999, 70), *prose(800 + i, 70)]) for i in range(4)]
    rows = clean + rude + copies + [leak, item] + share
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 84)) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {*range(60, 84), 84, 85, 89}
    assert set(range(len(rows))) - set(out) == gone
    pieces = {v: k for k, v in read_ranks().items()}
    text = {d: b"".join(pieces[t] for t in r.tokens).decode() for d, r in out.items()}
    assert all(r.round_trip for r in out.values())
    assert all(text[i] == clean[i] for i in range(60)) and text[86] == text[87] == ""
    assert item not in text[88] and text[88].split() == [*prose(600, 100), *prose(601, 100)]
    assert [" ".join(prose(999, 70)) in text[90 + i] for i in range(4)] == [True, False, False, False]
    later, _ = repeated([(90 + i, t) for i, t in enumerate(share)])
    assert all(text[90 + i].split() == [w for j, w in enumerate(share[i].split()) if j not in later[90 + i]] for i in range(1, 4))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "passages", "benchmark", "encoding"]
