import random

import pytest
from pyspark.sql import functions as F

from kembar.functions import lcs
from kembar.operators import edits


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def made_up(rng, n, letters="abcd ", longest=150):
    """Texts, half of them edited copies of others."""
    out = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n // 2)]
    while len(out) < n:
        text = list(rng.choice(out))
        for _ in range(rng.randint(0, max(1, len(text) // 8))):
            at = rng.randint(0, len(text))
            if rng.random() < 0.5:
                text.insert(at, rng.choice(letters))
            elif text and at < len(text):
                del text[at]
        out.append("".join(text) or "a")
    return out


def test_common_subsequences_of_many_pairs():
    rng = random.Random(1)
    texts = made_up(rng, 300, longest=140) + ["", "ä" * 64, "ä" * 65, "𝄞x" * 40, "x" * 600]
    a, b = [rng.choice(texts) for _ in range(400)], [rng.choice(texts) for _ in range(400)]
    expected = [plain_lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert lcs.common_subsequences(a, b).tolist() == expected
    assert [lcs.common_subsequence(x, y) for x, y in zip(a, b, strict=True)] == expected
    assert lcs.indel_ratios([None, "", "ab"], ["a", "a", "ab"]).tolist() == [0, 0, 1]


@pytest.mark.parametrize("ratio", [0.67, 0.8, 0.95, 1.0])
def test_no_pair_is_missed(ratio):
    rng = random.Random(int(ratio * 100))
    texts = made_up(rng, 180)
    asked, stored = [(str(i), t) for i, t in enumerate(texts[::4])], texts
    got = {(q, s) for q, s, _ in edits.edit_matches(edits.Sought(edits.Bands(ratio), asked), stored, pairs=500)}
    expected = {
        (q, s) for q, (_, a) in enumerate(asked) for s, b in enumerate(stored)
        if 2 * plain_lcs(a, b) / (len(a) + len(b)) >= ratio - 1e-12
    }
    assert got == expected and len(expected) > len(asked) // 2


def test_candidates_are_few():
    rng = random.Random(5)
    texts = made_up(rng, 400, letters="abcdefghijklmnopqrstuvwxyz ")
    bands = edits.Bands(0.9)
    sought = [bands.sought(t) for t in texts[:40]]
    candidates = sum(bool(pieces & set(bands.of(t))) for pieces in sought for t in texts)
    assert candidates < 0.05 * 40 * len(texts)


def test_ratio_must_leave_pieces():
    with pytest.raises(ValueError, match="2/3"):
        edits.Bands(0.5)


@pytest.mark.parametrize("pieces", [edits.PIECES, 3000])
def test_similar_sentences(spark, pieces):
    """A third of all documents share one sentence; several blocks of queries give the same pairs."""
    rng = random.Random(9)
    sentences = [s.strip() for s in made_up(rng, 120, "abcdefgh ", 60) if len(s.strip()) >= 15]
    sentences = [" ".join(s.split()) for s in sentences]
    docs = [(i, ("Hot sentence of all of them. " if i % 3 == 0 else "") + ". ".join(rng.choices(sentences, k=3)) + ".") for i in range(150)]
    docs += [(900, None), (901, ""), (902, "...")]
    asked = [(i, ". ".join(rng.choices(sentences, k=2))) for i in range(12)] + [(50, "Hot sentence of all of thes. Hot sentence of all of them"), (51, None)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, sentence string")
    q = spark.createDataFrame(asked, "query_id bigint, text string")
    got = edits.similar_sentences(q, d, 0.8, 15, pieces).collect()

    def parts(text):
        return {s.strip().lower() for s in " ".join((text or "").split()).split(".") if len(s.strip()) >= 15}

    import hashlib
    md5 = {s: hashlib.md5(s.encode()).hexdigest() for _, t in docs + asked for s in parts(t)}
    holders = {s: sum(s in parts(t) for _, t in docs) for s in md5}
    askers = {s: sum(s in parts(t) for _, t in asked) for s in md5}
    expected = {}
    for a in md5:
        for b in md5:
            ratio = 2 * plain_lcs(a, b) / (len(a) + len(b))
            if askers[a] and holders[b] and ratio >= 0.8 - 1e-12:
                expected[md5[a], md5[b]] = (pytest.approx(ratio, abs=1e-6), askers[a], holders[b])
    assert {(r.query_md5, r.sentence_md5): (r.ratio, r.n_queries, r.n_documents) for r in got} == expected
    assert len(got) == len(expected) and any(r.n_documents == 50 for r in got)


def test_no_queries(spark):
    d = spark.createDataFrame([(1, "a sentence that is long enough.")], "doc_id bigint, text string")
    q = spark.createDataFrame([], "query_id bigint, text string")
    assert edits.similar_sentences(q, d).count() == 0
    assert edits.similar_sentences(d.withColumnRenamed("doc_id", "query_id"), d.where(F.lit(False))).count() == 0
