import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions.pairs import ngram_jaccard
from kembar.operators import tfidf
from kembar.operators.passages import pair_ngram_jaccard
from kembar.plans import search

WORDS = [f"kata{c}{d}" for c in "abcdefgh" for d in "xyz"]


@pytest.fixture(scope="module")
def corpus():
    """A third of the rows are copies of one text, one word is everywhere, and some texts are blank."""
    rng = random.Random(3)
    rows = []
    for doc in range(60):
        text = "inti kataax katabx" if doc % 3 == 0 else " ".join(["inti"] + rng.choices(WORDS, k=rng.randint(1, 12)))
        text = None if doc == 7 else "  " if doc == 8 else text
        rows.append((doc, f"s{doc % 4}", "judul" if doc < 50 else "metode", text))
    return rows


def plain_search(rows, section, query, k, skema=None, cutoff=0.1):
    docs = [(d, s, Counter(w for w in (t or "").split() if len(w) > 1)) for d, s, sec, t in rows if sec == section]
    n, df = len(docs), Counter(w for _, _, c in docs for w in c)
    idf = {w: math.log((1 + n) / (1 + m)) + 1 for w, m in df.items()}

    def unit(c):
        v = {w: f * idf[w] for w, f in c.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    q = unit(Counter(query.split()))
    scored = []
    for doc, s, counts in docs:
        v = unit(counts)
        score = sum(x * v.get(w, 0.0) for w, x in q.items())
        if score >= cutoff and (skema is None or s == skema):
            scored.append((-round(score, 6), doc))
    return [(doc, -score) for score, doc in sorted(scored)[:k]]


QUERIES = [
    (1, "judul", None, "kataax inti katacy"), (2, "judul", "s2", "inti katagz"), (3, "metode", None, "inti inti katabx"),
    (4, "judul", "", "katahx katahx"), (5, "judul", None, "asing"), (6, "solusi", None, "inti"),
]


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, skema string, section string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, section string, skema string, text string")
    return docs, queries, tfidf.fit(docs, stop_words=False, stem=False)


def found(df):
    rows = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        rows[r.query_id].append((r.doc_id, r.similarity_score))
    return rows


def test_search_equals_plain_python(tables, corpus):
    _, queries, index = tables
    got = found(tfidf.search(index, queries, k=10, stop_words=False, stem=False))
    for query, section, skema, text in QUERIES:
        assert got[query] == plain_search(corpus, section, text, 10, skema or None)
    assert len(got[1]) == 10 and not got[5] and not got[6]


def test_query_blocks_equal_one_broadcast(tables, monkeypatch):
    docs, queries, _ = tables
    monkeypatch.setattr(tfidf, "SLICE_ROWS", 5)
    index = tfidf.fit(docs, stop_words=False, stem=False)
    assert index.blocks.agg(F.max("slice")).first()[0] > 3
    weights = tfidf.transform(index, queries, stop_words=False, stem=False)
    written = runtime.written(weights, "w")
    assert len(list(tfidf.query_blocks(written, 400))) > 1

    def cells(limit):
        rows = tfidf.cosine(index, weights, limit).collect()
        return sorted((r.query_id, r.doc_id, round(r.similarity_score, 9)) for r in rows)

    assert cells(400) == cells(runtime.BROADCAST_BYTES)
    few = found(tfidf.search(index, queries, 10, stop_words=False, stem=False, limit=400))
    assert few == found(tfidf.search(index, queries, 10, stop_words=False, stem=False))


@pytest.fixture(scope="module")
def skewed(spark):
    """One word is in all texts and queries, some words in half of them; texts are of very different length."""
    rng = random.Random(11)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(doc, f"s{doc % 4}" if doc % 9 else None, "judul", " ".join(["inti"] * rng.randint(1, 3) + rng.choices(WORDS, weights, k=rng.choice([1, 3, 9, 40]))))
            for doc in range(400)]
    asked = [(q, "judul", f"s{q % 4}" if q % 5 == 0 else None, " ".join(["inti"] + rng.choices(WORDS, k=rng.randint(1, 14)))) for q in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, skema string, section string, text string")
    queries = spark.createDataFrame(asked, "query_id bigint, section string, skema string, text string")
    return rows, asked, queries, tfidf.fit(docs, stop_words=False, stem=False)


@pytest.mark.parametrize("cutoff, k, sizes", [
    (0.1, 400, {"stop_from": 0}), (0.1, 5, {"stop_from": 0}), (0.6, 5, {}), (0.3, 1, {"stop_from": 0, "spared": 1.0}),
    (0.3, 5, {"stop_from": 0, "limit": 8000}),
])
def test_early_stop_loses_nothing(skewed, cutoff, k, sizes):
    rows, asked, queries, index = skewed
    got = found(tfidf.search(index, queries, k, cutoff, False, False, **sizes))
    for query, section, skema, text in asked:
        assert got[query] == [(d, pytest.approx(s, abs=2e-6)) for d, s in plain_search(rows, section, text, k, skema, cutoff)]


def test_early_stop_reads_fewer_postings(skewed):
    _, _, queries, index = skewed
    weights = tfidf.transform(index, queries, False, False)

    def share(cutoff, **more):
        total = tfidf.postings_read(index, weights, cutoff, **more).agg(F.sum("n_read") / F.sum("n")).first()[0]
        return total

    assert share(0.0) == 1.0
    assert share(0.6) < share(0.3) < share(0.1) < 1.0
    assert share(0.1, k=3) < share(0.1)


def test_scores_from_a_bound_are_whole(skewed):
    _, _, queries, index = skewed
    weights = tfidf.transform(index, queries, False, False)
    every = {(r.query_id, r.doc_id): r.similarity_score for r in tfidf.cosine(index, weights).collect()}
    some = {(r.query_id, r.doc_id): r.similarity_score for r in tfidf.scores_from(index, weights, 0.25, stop_from=0).collect()}
    assert some == {key: pytest.approx(s, abs=1e-12) for key, s in every.items() if s >= 0.25} and some


def test_hot_and_cold_terms_get_the_same_idf(tables):
    docs, _, index = tables
    counts = tfidf.term_counts(docs, ["section", "doc_id", "skema"], False, False)

    def cells(limit):
        return sorted((r.section, r.doc_id, r.term, r.df, r.idf) for r in tfidf.with_idf(counts, index.idf, limit).collect())

    assert cells(3) == cells(10_000)
    assert len(cells(3)) == counts.count()


def test_weights_have_unit_length(tables):
    _, _, index = tables
    sizes = index.postings.groupBy("section", "doc_id").agg(F.sum(F.pow("w", F.lit(2))).alias("x")).collect()
    assert sizes and all(r.x == pytest.approx(1.0) for r in sizes)


def test_saved_index_reads_back_the_same(spark, tables, tmp_path):
    _, queries, index = tables
    tfidf.save(index, str(tmp_path / "index"))
    stored = tfidf.load(spark, str(tmp_path / "index"))
    assert found(tfidf.search(stored, queries)) == found(tfidf.search(index, queries))
    plan = stored.blocks.where("section = 'judul'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(section" in plan


def test_ranks_do_not_lose_rows_below_k(tables):
    _, queries, index = tables
    ten, all_rows = found(tfidf.search(index, queries, 10)), found(tfidf.search(index, queries, 500))
    for query, rows in ten.items():
        assert all_rows[query][: len(rows)] == rows


def test_full_scores_and_bulk(spark, tables):
    docs, queries, index = tables
    single = search.search_tfidf(index, docs, queries, k=3)
    rows = single.orderBy("query_id", "rank").collect()
    top = next(r for r in rows if r.query_id == 1)
    assert top.skema and top.exact_score >= 0 and top.final_score <= 1
    items = spark.createDataFrame([(1, None, "kataax inti katacy", None), (2, None, "", "inti katabx")],
                                  "query_index bigint, skema string, judul string, metode string")
    for name in ("ringkasan", "pendahuluan", "masalah", "solusi"):
        items = items.withColumn(name, F.lit(None).cast("string"))
    bulk = {r.query_index: r for r in search.search_bulk_tfidf(index, docs, items, k=3).where("rank = 1").collect()}
    assert bulk[2].section == "metode"
    assert bulk[1].final_score == max(r.final_score for r in rows if r.query_id == 1)


def test_pair_cosine(spark):
    pairs = spark.createDataFrame([(1, "aa bb bb", "aa cc"), (2, "xx", "yy"), (3, "xx yy", "xx yy"), (4, "", "xx")],
                                  "pair_id bigint, a string, b string")
    got = {r.pair_id: r.tfidf_cosine for r in tfidf.pair_cosine(pairs, "a", "b", "pair_id").collect()}
    one = math.log(3 / 2) + 1
    assert got[1] == pytest.approx(1 / (math.sqrt(1 + 4 * one**2) * math.sqrt(1 + one**2)))
    assert got[2] == 0.0 and got[3] == pytest.approx(1.0) and got[4] == 0.0


def test_scores_do_not_depend_on_how_hits_are_dealt_out(tables, monkeypatch):
    """Every query hits the same documents; copies of them and broadcasts off give the same rows."""
    docs, queries, index = tables
    many = queries.where("query_id = 1").select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(40).cast("bigint"))).alias("query_id"), "section", "skema", "text"
    )

    def cells():
        return sorted(tuple(r) for r in search.search_tfidf(index, docs, many, k=3).collect())

    usual = cells()
    assert len(usual) == 120
    monkeypatch.setattr(search, "HUB_HITS", 7)
    assert cells() == usual
    monkeypatch.setattr(runtime, "broadcast_if_small", lambda df, limit=0: df)
    assert cells() == usual


def test_exact_score_of_hits_equals_the_pair_function(spark):
    texts = [(1, "judul", "a b c d e a b c"), (2, "judul", "x y"), (3, "metode", "a b c e")]
    docs = spark.createDataFrame(texts, "doc_id bigint, section string, text string")
    asked = spark.createDataFrame([(5, "judul", "a b c e"), (6, "metode", "b c e")], "query_id bigint, section string, text string")
    hits = docs.select("doc_id", "section").join(asked.select("query_id", "section"), "section")
    got = {(r.query_id, r.doc_id): r.exact_score for r in pair_ngram_jaccard(hits, asked, docs, ["doc_id", "section"]).collect()}
    pairs = docs.join(asked.withColumnRenamed("text", "q"), "section")
    plain = {(r.query_id, r.doc_id): r.s for r in pairs.select("query_id", "doc_id", ngram_jaccard(F.col("q"), F.col("text")).alias("s")).collect()}
    assert got == {pair: score for pair, score in plain.items() if score > 0}
    assert got == {(5, 1): pytest.approx(1 / 6), (6, 3): 0.5}
