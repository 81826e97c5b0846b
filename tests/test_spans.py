import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kembar import runtime
from kembar.operators import passages, spans


def plain_spans(q, d, least):
    """Every maximal agreement of the two texts, by looking at each diagonal."""
    found = {}
    for diagonal in range(-len(d) + 1, len(q)):
        i = max(0, diagonal)
        while i < len(q) and i - diagonal < len(d):
            start = i
            while i < len(q) and i - diagonal < len(d) and q[i] == d[i - diagonal]:
                i += 1
            if i - start >= least:
                found[start, i] = min(found.get((start, i), 1 << 40), start - diagonal)
            i += 1
    return sorted((s, e, p) for (s, e), p in found.items() if not any(a <= s and b >= e and b - a > e - s for a, b in found))


def made_up(rng, blocks, n):
    """Texts of shared blocks in any order, changed here and there, with runs that repeat."""
    out = []
    for _ in range(n):
        parts = [rng.choice(blocks) for _ in range(rng.randint(0, 5))] + ["".join(rng.choices("xyz ", k=rng.randint(0, 30)))]
        rng.shuffle(parts)
        text = list(" ".join("".join(parts).split()))
        for _ in range(rng.randint(0, 3)):
            if text:
                text[rng.randrange(len(text))] = "#"
        out.append("".join(text))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    blocks = ["".join(rng.choices("abcdef ", k=rng.randint(10, 80))) for _ in range(12)] + ["ab" * 30, "-" * 50, "é𝄞" * 20]
    return made_up(rng, blocks, 60)


def test_spans_of_pairs_equal_plain_search(texts):
    for q in texts[:15]:
        asked = spans._Asked([0], [q], 20, 8)
        for d in texts[15:]:
            _, seeds = asked.seeds(*spans.fingerprints(spans.codes(d), 20, 8))
            assert spans.grown(spans.codes(q), spans.codes(d), seeds, 8, 20) == plain_spans(q, d, 20)


def test_windows_of_long_texts(monkeypatch):
    rng = random.Random(4)
    signs = spans.codes("".join(rng.choices("ab", k=5000)))
    whole = spans.fingerprints(signs, 30, 10)[1].tolist()
    monkeypatch.setattr(spans, "STRETCH", 77)
    assert spans.fingerprints(signs, 30, 10)[1].tolist() == whole
    assert np.diff(whole).max() <= 21 and len(spans.fingerprints(signs[:29], 30, 10)[0]) == 0


@pytest.mark.parametrize("block", [spans.BLOCK_CHARS, 500])
def test_matched_spans(spark, texts, block):
    """A third of the documents are one text; queries in several blocks give the same spans."""
    docs = [(i, texts[20] if i % 3 == 0 else texts[i]) for i in range(20, 60)] + [(100, None), (101, "")]
    asked = [(i, texts[i].upper()) for i in range(10)] + [(20, texts[20]), (50, None), (51, "kurz")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, query_id string").repartition(4)
    q = spark.createDataFrame(asked, "query_id bigint, text string")
    got = sorted(tuple(r) for r in spans.matched_spans(q, d, 20, 8, block).collect())
    expected = sorted((i, j, *span) for i, a in asked for j, b in docs if a and b for span in plain_spans(" ".join(a.lower().split()), " ".join(b.lower().split()), 20))
    assert got == expected and got
    covered = {(r.query_id, r.doc_id): r.matched_chars for r in spans.span_coverage(spans.matched_spans(q, d, 20, 8, block)).collect()}
    places = {}
    for i, j, s, e, _ in expected:
        places.setdefault((i, j), set()).update(range(s, e))
    assert covered == {pair: len(chars) for pair, chars in places.items()}


def test_grams_must_fit():
    with pytest.raises(ValueError, match="longer"):
        spans.matched_spans(None, None, 10, 20)


def test_hot_ngram_is_dealt_out(spark):
    """All rows share one n-gram: both joins give the same pairs, and no task gets more than a few copies' rows."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, "sama untuk semua " + " ".join(rng.choices(words, k=8))) for i in range(300)]
    asked = [(i, "sama untuk semua " + " ".join(rng.choices(words, k=8))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    q = spark.createDataFrame(asked, "query_id bigint, text string")
    one = {tuple(r) for r in passages.shared_ngrams(q, d).collect()}
    dealt = passages.shared_ngrams(q, d, limit=0)
    assert {tuple(r) for r in dealt.collect()} == one and len(one) == 6000
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "doc_id bigint, ngram string")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "ngram string, query_id bigint")
    from kembar.operators.hot import dealt_join

    joined = dealt_join(runtime.written(rows, "r"), runtime.written(few, "f"), "ngram", "doc_id", share=50)
    assert joined.groupBy("ngram").agg(F.count("*").alias("n")).orderBy("ngram").collect() == [("hot", 600), ("k3", 1)]
