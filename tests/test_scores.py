import itertools
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kembar.functions import pairs as p
from kembar.functions.lcs import common_subsequence
from kembar.functions import scores as s
from kembar.operators import summaries, thresholds

T = F.col


@pytest.mark.parametrize("semantic, jaccard, sequence, rule", [
    (0.91, 0.1, 0.81, 0), (0.86, 0.71, 0.1, 1), (0.81, 0.51, 0.1, 2), (0.81, 0.39, 0.1, 3), (0.7, 0.29, 0.1, 4),
    (0.59, 0.9, 0.1, 5), (0.6, 0.1, 0.1, 6), (0.9, 0.71, 0.9, 1), (0.9, 0.45, 0.1, 6), (0.61, 0.3, 0.1, 6),
])
def test_verdict_rules(evaluate, semantic, jaccard, sequence, rule):
    verdict = evaluate(s.classify_match(T("s"), T("j"), T("q")), s=semantic, j=jaccard, q=sequence)
    name, confidence, risk, why, flagged = s.VERDICTS[rule]
    assert tuple(verdict) == (name, confidence, risk, [why], flagged)


@pytest.mark.parametrize("exact, fuzzy, semantic, n, m, expected", [
    (0.5, 1.0, 0.95, 50, 600, 0.82), (1.0, 0.0, 1.0, 600, 600, 1.0), (0.5, 0.9, 0.5, 100, 100, 0.5),
    (0.5, 0.0, 0.0, 99, 100, 0.2), (0.0, 0.0, -0.5, 600, 600, -0.25),
])
def test_adaptive_score(evaluate, exact, fuzzy, semantic, n, m, expected):
    score = s.final_score_adaptive(T("e"), T("f"), T("s"), T("a"), T("b"))
    assert evaluate(score, e=exact, f=fuzzy, s=semantic, a="x" * n, b="x" * m) == pytest.approx(expected)


def test_fixed_score(evaluate):
    assert evaluate(s.final_score_fixed(T("e"), T("f"), T("s")), e=0.5, f=0.2, s=0.9) == pytest.approx(0.53)


def composite(semantic, j, o, q, phrases):
    semantic *= 0.95 if phrases > 0.3 else 0.98 if phrases > 0.1 else 1.0
    if o > 0.9:
        w = (0.1, 0.3, 0.5, 0.1)
    elif o > 0.7:
        w = (0.2, 0.3, 0.4, 0.1)
    elif semantic > 0.8 and o < 0.4:
        w = (0.7, 0.1, 0.1, 0.1)
    else:
        w = (0.5, 0.2, 0.2, 0.1)
    return max(0.0, min(1.0, w[0] * semantic + w[1] * j + w[2] * o + w[3] * q))


def test_composites_at_every_bound(spark):
    grid = list(itertools.product((-1.0, 0.5, 0.8, 0.81, 0.83, 0.86, 1.0), (0.3,), (0.39, 0.4, 0.5, 0.51, 0.7, 0.71, 0.8, 0.81, 0.9, 0.91), (0.2,), (0.0, 0.1, 0.11, 0.3, 0.31)))
    df = spark.createDataFrame(grid, "s double, j double, o double, q double, p double")
    rows = df.withColumns({
        "academic": s.composite_academic(T("s"), T("j"), T("o"), T("q"), T("p")),
        "standard": s.composite_standard(T("s"), T("j"), T("o"), T("q")),
    }).collect()
    for r in rows:
        assert r.academic == pytest.approx(composite(r.s, r.j, r.o, r.q, r.p))
        w = (0.2, 0.3, 0.4, 0.1) if r.o > 0.8 else (0.4, 0.25, 0.25, 0.1) if r.o > 0.5 else (0.6, 0.15, 0.15, 0.1)
        assert r.standard == pytest.approx(max(0.0, min(1.0, w[0] * r.s + w[1] * r.j + w[2] * r.o + w[3] * r.q)))


@pytest.mark.parametrize("words, expected", [(301, 0.82), (300, 0.8), (50, 0.8), (49, 0.75), (0, 0.8)])
def test_dynamic_threshold(evaluate, words, expected):
    assert evaluate(s.dynamic_threshold(T("w")), w=words) == pytest.approx(expected)
    assert evaluate(s.dynamic_threshold(T("w"), explicit=F.lit(0.0)), w=words) == 0.0


def test_threshold_table(spark):
    table = spark.createDataFrame([("judul", 0.8), ("metode", 0.7)], "section string, threshold double")
    change = spark.createDataFrame([("metode", 0.9), ("solusi", 0.6)], "section string, threshold double")
    updated = thresholds.update_thresholds(table, change)
    assert {r.section: r.threshold for r in updated.collect()} == {"judul": 0.8, "metode": 0.9, "solusi": 0.6}
    asked = spark.createDataFrame([(1, "metode", 400, None), (2, "masalah", 10, None), (3, "judul", 100, 0.1)],
                                  "query_id bigint, section string, words int, own double")
    used = {r.query_id: r.threshold_used for r in thresholds.join_thresholds(asked, updated, explicit="own").collect()}
    assert used == {1: pytest.approx(0.92), 2: pytest.approx(0.75), 3: 0.1}


def test_bulk_summary(spark):
    items = spark.createDataFrame([(0, None), (1, 0.0), (2, 0.95), (3, None)], "query_index bigint, threshold double")
    scores = spark.createDataFrame([(i, x) for i in (0, 1, 2) for x in (0.5, 0.9)], "query_index bigint, similarity_score double")
    rows = {r.query_index: tuple(r)[1:] for r in summaries.agg_bulk_summary(items, scores).collect()}
    assert rows[0] == rows[1] == (0.7, 0.9, True, 2, 0.8)
    assert rows[2] == (0.7, 0.9, False, 2, 0.95)
    assert rows[3] == (0.0, 0.0, False, 0, 0.8)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=90), st.text("abcé ", max_size=90))
def test_common_subsequence_equals_dynamic_programming(a, b):
    assert common_subsequence(a, b) == plain_lcs(a, b)


def test_pair_functions(spark):
    texts = [("abcd", "abxd"), ("", "x"), (None, "x"), ("same text here", "same text here"), ("a b c d", "a b c e"), ("a b", "a b c")]
    df = spark.createDataFrame(texts, "a string, b string")
    rows = df.select(
        "a", "b", p.fuzzy_ratio(T("a"), T("b")).alias("fuzzy"), p.raw_sequence_ratio(T("a"), T("b")).alias("seq"),
        p.ngram_jaccard(T("a"), T("b")).alias("exact"), p.word_jaccard(T("a"), T("b")).alias("words"),
        p.overlap_coefficient(T("a"), T("b")).alias("overlap"),
    ).collect()
    assert rows[0].fuzzy == 0.75
    assert rows[1].fuzzy == rows[2].fuzzy == rows[1].exact == rows[1].overlap == 0.0
    assert rows[3].fuzzy == rows[3].exact == rows[3].words == rows[3].overlap == rows[3].seq == 1.0
    assert rows[4].exact == pytest.approx(1 / 3)
    assert (rows[5].words, rows[5].overlap) == (0.6667, 1.0)
    for r in rows[3:]:
        assert r.seq == SequenceMatcher(None, r.a, r.b).ratio()


def test_lexical_metrics(spark):
    df = spark.createDataFrame([("Data yang besar, penelitian ini!", "data besar dan penelitian ini")], "a string, b string")
    academic = p.lexical_metrics(df, "a", "b").first().lexical
    assert academic.jaccard == academic.word_overlap == academic.sequence == 1.0
    assert academic.academic == round(1 / 33, 4)
    plain = p.lexical_metrics(df, "a", "b", academic=False).first().lexical
    assert (plain.jaccard, plain.word_overlap) == (round(4 / 6, 4), 0.8)
    assert plain.sequence == round(SequenceMatcher(None, "data yang besar penelitian ini", "data besar dan penelitian ini").ratio(), 4)


def test_matching_blocks_equal_difflib():
    """Before, every character of a long text was passed for each block found, and word sets were made twice for two scores."""
    pick, letters = random.Random(3), "abcdefghij klmnop]^-\\[é𝄞\nxyz0123456789"

    def text(n):
        return "".join(pick.choices(letters, weights, k=n))

    for _ in range(300):
        weights = [pick.choice([1, 1, 5, 40, 200]) for _ in letters]
        a = text(pick.choice([1, 50, 300, 900]))
        edited = list(a)
        for _ in range(pick.randint(0, 12)):
            at = pick.randrange(len(edited) + 1)
            edited[at:at + pick.randint(0, 20)] = text(pick.randint(0, 15))
        b = "".join(edited) + text(pick.choice([1, 199, 200, 201, 900]))
        assert p.matching_blocks_ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    assert p.matching_blocks_ratio("ab" * 150, "ab" * 150) == SequenceMatcher(None, "ab" * 150, "ab" * 150).ratio()


def test_long_texts_pass_rare_characters_only(monkeypatch):
    read = []
    monkeypatch.setattr(p, "SequenceMatcher", lambda *a: read.append(a))
    words = [f"{'ab' * 9}{i} " for i in range(400)]
    assert p.matching_blocks_ratio("".join(words), "".join(words[::-1])) > 0 and not read


def test_lexical_metrics_make_each_set_once(spark):
    plan = p.lexical_metrics(spark.createDataFrame([("x y", "y z")], "a string, b string"), "a", "b").select("lexical.jaccard", "lexical.word_overlap")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2
