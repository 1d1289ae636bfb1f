"""License scans, line rules, sharding, toxicity, decontamination, encoding."""

from __future__ import annotations

import base64
import math

import numpy as np
import pytest

from quire.llm import bpe, decontaminate, license_scan, line_rules, sharding, toxicity
from tests.llm.conftest import prose, same_rows


# license scans ------------------------------------------------------------------------------------------------


def test_license_scan_is_the_exact_containment(docs, sql):
    t = license_scan.TEMPLATES
    texts = [" ".join([*prose(i, 40), text, *prose(i + 99, 70)]) for i, text in enumerate(t.values())]
    texts += [" ".join([*prose(500 + i, 500), *text.split()[:n], *prose(700 + i, 90)]) for i, text in enumerate(t.values()) for n in (4, 7, 12, 30)]
    texts += ["", "MIT", t["mit"].upper(), t["mit-line"] + "\n" + t["cc0"]]
    frame = docs(texts)
    got = same_rows(license_scan.scan(frame).collect())
    assert got == sql(license_scan.scan_sql(), documents=frame)
    assert len(got) >= len(t)


def test_license_scan_odd_rows(odd, clashing, docs):
    assert license_scan.scan(odd).count() == license_scan.scan(clashing).count() == license_scan.scan(odd.limit(0)).count() == 0
    text = "x " + license_scan.TEMPLATES["mit-line"]
    assert sorted(str(r.doc_id) for r in license_scan.scan(docs([(None, text), (3, text), (3, text)])).collect()) == ["3", "3", "None"]


def test_license_templates_of_any_length(docs, sql):
    with pytest.raises(ValueError):
        license_scan.window_of(3)
    assert [license_scan.window_of(n) for n in (4, 6, 7, 12, 13, 192, 193, 1600)] == [8, 8, 16, 16, 32, 256, 512, 4096]
    whole = {"long": " ".join(f"w{i} {x}" for i, x in enumerate(prose(77, 600))), "short": "given freely to all who ask"}
    words = whole["long"].split()
    frame = docs([" ".join([*prose(1, 300), *words, *prose(2, 50)]), " ".join(words[:1100]), " ".join(words[:700]), whole["short"] + " x", "ask all freely to given"])
    got = same_rows(license_scan.scan(frame, whole).collect())
    assert got == sql(license_scan.scan_sql(whole), documents=frame)
    assert len(got) == 3


def test_bands_meet_at_the_least_similarity():
    """Sets of similarity 1/4 agree in two of the minima; unrelated ones do not."""
    draw, factors, found, false = np.random.default_rng(4), license_scan._functions(), 0, 0
    for _ in range(300):
        x = draw.integers(0, 1 << 32, 160, dtype=np.uint32)
        a, b, c = x[:100], x[60:], draw.integers(0, 1 << 32, 100, dtype=np.uint32)
        least = [np.array([(f * s).min() for f in factors]) for s in (a, b, c)]
        found += int((least[0] == least[1]).sum() >= license_scan.ROWS)
        false += int((least[0] == least[2]).sum() >= license_scan.ROWS)
    assert found == 300 and false == 0


# line rules ---------------------------------------------------------------------------------------------------


def test_line_rules_match_sql(odd, clashing, docs, sql):
    lines = ["Home | About | Contact", "A fair sentence that ends well.", "click here to win.", "WOW!! NOW!! YES!!", "no full stop here", "a a a a a a a a a a a a.", "x {y} z.", "$$ ## %% ok.", "„Gut.“", "Fin…"]
    frame = docs(["\n".join(lines[i:] + lines[:j]) for i in range(len(lines)) for j in range(4)])
    for f in (frame, odd):
        assert same_rows(line_rules.clean(f).collect()) == sql(line_rules.clean_sql(), documents=f)
    assert same_rows(line_rules.clean(clashing).collect()) == same_rows(line_rules.clean(odd).collect())
    assert line_rules.clean(odd.limit(0)).count() == 0


def test_line_rules_reject_documents_that_lose_too_much(docs):
    good, bad = "This is a whole sentence of some length.", "menu item without an end and much longer than the sentence is"
    got = {r.doc_id: r.clean_text for r in line_rules.clean(docs([good, f"{good}\n{bad}\n{bad}", f"{good}\n{good}\n{bad}", None])).collect()}
    assert got == {0: good, 2: f"{good}\n{good}", 3: ""}


# sharding -----------------------------------------------------------------------------------------------------


def test_sharding_matches_sql(odd, clashing, docs, sql):
    frame = docs([(i, "") for i in range(300)])
    for f in (frame, odd):
        assert same_rows(sharding.shard(f).collect()) == sql(sharding.shard_sql(), documents=f)
    assert same_rows(sharding.shard(clashing).collect()) == same_rows(sharding.shard(odd).collect())
    assert sharding.shard(odd.limit(0)).count() == 0


def test_a_changed_weight_moves_rows_only_below_its_parent(docs):
    frame = docs([(i, "") for i in range(4000)])
    before = {r.doc_id: r for r in sharding.shard(frame).collect()}
    tree = {r: (w, {k: (v, dict(s)) for k, (v, s) in racks.items()}) for r, (w, racks) in sharding.PRODUCTION.items()}
    tree["east"][1]["east/k0"][1]["east/k0/s3"] = 3.0
    moved = [(before[r.doc_id], r) for r in sharding.shard(frame, tree).collect() if r != before[r.doc_id]]
    assert moved and all(a.rack == b.rack == "east/k0" and b.shard == "east/k0/s3" for a, b in moved)
    share = sum(r.region == "east" for r in before.values()) / 4000
    assert abs(share - 20 / 42) < 0.03
    with pytest.raises(ValueError):
        sharding.edges({"a": (0.0, {})})


# toxicity -----------------------------------------------------------------------------------------------------


def _rude(i: int) -> str:
    words = prose(i, 60)
    if i % 4 == 0:
        words[10:10] = ["vile", "scum", "hate", "you", "all"]
    return " ".join(words)


def test_toxicity_on_documents_it_was_not_trained_on(spark, docs):
    frame = docs([_rude(i) for i in range(1200)])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id for r in toxicity.report(frame, labels).collect()}
    truth = {i for i in range(1200) if i % 4 == 0}
    unseen = set(range(800, 1200))
    assert len(found & truth & unseen) >= 0.95 * len(truth & unseen)
    assert len(found - truth) <= 0.02 * 900
    kept = toxicity.clean(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(1200)) - found
    at, w, _, _ = toxicity.train(frame, labels)
    assert 0 < len(at) < 2000  # sparse, so small to send


def test_toxicity_cases(spark, odd, clashing):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    for frame in (odd, clashing):
        assert toxicity.report(frame, labels.limit(0)).count() == 0
        kept = toxicity.clean(frame, labels.limit(0))
        assert kept.columns == frame.columns and kept.count() == frame.count()
        assert toxicity.clean(frame, labels).count() + toxicity.report(frame, labels).count() == frame.count()
    assert toxicity.report(odd.limit(0), labels).count() == 0


# decontamination ----------------------------------------------------------------------------------------------


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, " ".join(prose(9000 + i, 25))) for i in range(6)] + [(6, "too short"), (7, None), (None, " ".join(prose(9100, 12)))], "item_id bigint, text string")


@pytest.fixture
def leaky(docs, items):
    texts = {r.item_id: r.text for r in items.collect()}
    rows = [" ".join(prose(i, 80)) for i in range(5)]
    rows += [" ".join([*prose(50, 60), texts[0].upper().replace(" ", ", ", 5), *prose(51, 60)]), texts[1], texts[2] + " and " + texts[3], " ".join([*prose(52, 90), *texts[4].split()[3:11], "end."]), None, ""]
    return docs(rows)


def test_decontamination_matches_sql(leaky, items, sql):
    got = same_rows(decontaminate.report(leaky, items).collect())
    assert got == sql(decontaminate.report_sql(), documents=leaky, benchmark=items)
    assert len(got) == 4


def test_a_large_benchmark_is_joined_with_the_same_result(leaky, items):
    assert same_rows(decontaminate.report(leaky, items, max_broadcast=0).collect()) == same_rows(decontaminate.report(leaky, items).collect())


def test_decontamination_takes_effect(leaky, items):
    out = {r.doc_id: r for r in decontaminate.decontaminate(leaky, items).collect()}
    assert set(out) == {0, 1, 2, 3, 4, 5, 8, 9, 10}
    assert out[5].text == " ".join([*prose(50, 60), *prose(51, 60)]) and out[5].n_chars == len(out[5].text)
    assert out[8].text == " ".join([*prose(52, 90), "end."])


def test_decontamination_cases(odd, clashing, items):
    for frame in (odd, clashing):
        for most in (1000, 0):
            assert decontaminate.report(frame, items, max_broadcast=most).count() == 0
        out = decontaminate.decontaminate(frame, items.limit(0))
        assert out.columns == frame.columns and same_rows([tuple_row(r) for r in out.collect()]) == same_rows([tuple_row(r) for r in frame.collect()])
    assert decontaminate.report(odd.limit(0), items).count() == 0


def tuple_row(row) -> dict:
    return {str(i): v for i, v in enumerate(row)}


# encoding -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=bpe.read_ranks(), special_tokens={})


def test_encoding_is_that_of_an_independent_encoder(docs, odd, clashing, reference_encoder):
    texts = ["Hello world, it's 1,234.56 o'clock!!", "naïve Ünïcödé — 中文字 и русский x", "  lead\n\n\ttabs  \n", "a" * 300, "\U0001f600\U0001f469‍\U0001f680 ok", "don't we'll I'VE", "x" * 50 + "é" * 50, " 　 end ", " ".join(prose(3, 500))]
    for frame in (docs(texts), odd, clashing):
        got = bpe.encode(frame).collect()
        want = sorted((str(r[0]), reference_encoder.encode_ordinary(r[1] or "")) for r in frame.collect())
        assert sorted((str(r.doc_id), list(r.tokens)) for r in got) == want
        assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in got)
    assert bpe.encode(odd.limit(0)).count() == 0


def test_decoding_gives_the_bytes_again(spark):
    from pyspark.sql import functions as F

    ranks = bpe.read_ranks()
    ids = [ranks[b"\xe4"], ranks[b"\xb8"], ranks[b"\xad"], ranks[b" the"]]
    got = spark.range(1).select(bpe.decode(F.array(*[F.lit(i) for i in ids]), bpe.piece_list(ranks)).alias("t")).first().t
    assert got == "中 the"


def test_a_vocabulary_must_have_all_bytes(tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "v"))


def test_ftrl_is_that_of_a_plain_implementation():
    """The fit against FTRL-proximal coordinate by coordinate, with dictionaries and no numpy."""
    draw = np.random.default_rng(9)
    rows = [(np.unique(draw.integers(0, 60, draw.integers(1, 12)) + (40 if y else 0)).astype(np.int32), y) for y in draw.integers(0, 2, 200).tolist()]
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - (1 if zi > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    train = [r for i, r in enumerate(rows) if i % 5 != 4]
    for _ in range(toxicity.EPOCHS):
        for bag, y in train:
            at = [*bag.tolist(), toxicity.DIMS]
            p = 1 / (1 + math.exp(-sum(map(weight, at))))
            for i, w in [(i, weight(i)) for i in at]:
                g = p - y
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * w
                n[i] = before + g * g
    w, intercept, _ = toxicity.fit(rows)
    assert intercept == pytest.approx(weight(toxicity.DIMS)) and len(w) == toxicity.DIMS
    assert {int(i): w[i] for i in np.flatnonzero(w)} == pytest.approx({i: weight(i) for i in z if i != toxicity.DIMS and weight(i)})
    assert np.count_nonzero(w) < len(z)  # L1 leaves some at exactly zero
