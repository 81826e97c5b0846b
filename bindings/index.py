"""TF-IDF tables, vectors, joins over them, and search."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bindings.base import (
    Q_BATCH_ROWS, Q_CENTROIDS, Q_ITEMS, Q_PASSAGES, Q_POINTS, Q_PROPOSALS, Q_SECTION_ROWS, Q_WHOLE, Q_WHOLE_POINTS,
    centroids, documents, items, once, passages, proposals, q_bags, q_dense, q_hits, q_ngrams, q_jaccard, q_strip, q_terms,
    q_tfidf, q_tokens, query, quoted, section_index, section_points, section_rows, text_index, vectors, whole_points, whole_rows,
)
from kembar import runtime
from kembar.functions import scores as s
from kembar.functions.vectors import StoredVectors, encode
from kembar.functions.vectors import dense_cosine as cosine_of
from kembar.operators import dense, neighbours, rows, summaries, tfidf
from kembar.plans import detect as d
from kembar.plans import search
from kembar.sources.batches import bulk_response as to_bulk_response
from kembar.sources.batches import parse_query_batch
from kembar.sources.batches import results_to_json as to_response

#: Of four shapes of batch elements, two are objects.
Q_GOOD_ITEMS = f"{Q_ITEMS[:-1]} WHERE query_index % 4 < 2)"
SEARCH = f"{Q_WHOLE}, {Q_PASSAGES}, {q_tfidf('corpus', 'passages')}"


@query("tfidf_fit", f"WITH {Q_WHOLE}, {q_tfidf('corpus')} SELECT section, term, df, round(idf, 6) AS idf FROM idf")
def tfidf_fit(spark, sf):
    return text_index(spark, sf).idf.select("section", "term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_transform", f"""WITH {SEARCH}
    SELECT query_id, section, term, round(w / norm, 6) AS weight FROM qw JOIN qn USING (query_id, section)""")
def tfidf_transform(spark, sf):
    weights = tfidf.transform(text_index(spark, sf), passages(spark, sf))
    return weights.select("query_id", "section", "term", F.round("qw", 6).alias("weight"))


@query("encode_texts", f"""WITH {q_bags('bags', 'documents', 'doc_id')} SELECT doc_id, b AS position, c AS value FROM bags""")
def encode_texts(spark, sf):
    coded = encode(documents(spark, sf).select("doc_id", "text"), "text").select(
        "doc_id", F.posexplode("embedding").alias("position", "value")
    )
    return coded.where(F.col("value") > 0).select(
        "doc_id", F.col("position").cast("bigint").alias("position"), F.col("value").cast("double").alias("value")
    )


@query("encode_stored", "SELECT vec_id AS doc_id, len(embedding) AS dim, round(list_sum(embedding::double[]), 5) AS total FROM embeddings")
def encode_stored(spark, sf):
    table = vectors(spark, sf).select("doc_id", "embedding")
    coded = encode(table.select("doc_id"), "", StoredVectors(table, "doc_id"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return coded.select("doc_id", F.size("embedding").cast("bigint").alias("dim"), F.round(total, 5).alias("total"))


@query("tfidf_cosine", f"WITH {SEARCH} SELECT query_id, doc_id, round(score, 6) AS similarity_score FROM sc")
def tfidf_cosine(spark, sf):
    index = text_index(spark, sf)
    scored = tfidf.cosine(index, tfidf.transform(index, passages(spark, sf)))
    return scored.select("query_id", "doc_id", F.round("similarity_score", 6).alias("similarity_score"))


@query("join_postings", f"""WITH {SEARCH} SELECT qw.query_id, qw.term, count(*) AS n_postings,
      round(sum(dw.w * qw.w / dn.norm / qn.norm), 5) AS total
    FROM dw JOIN qw USING (section, term) JOIN dn ON dn.section = dw.section AND dn.doc_id = dw.doc_id
    JOIN qn ON qn.query_id = qw.query_id AND qn.section = qw.section GROUP BY ALL""")
def join_postings(spark, sf):
    index = text_index(spark, sf)
    weights = runtime.written(tfidf.transform(index, passages(spark, sf)).withColumnRenamed("skema", "wanted_skema"), "weights")
    joined = tfidf.join_postings(index.blocks, weights.drop("df").withColumn("upto", F.lit(1 << 30)), 0)
    return joined.groupBy("query_id", "term").agg(
        F.count("*").alias("n_postings"), F.round(F.sum(F.col("w") * F.col("qw")), 5).alias("total")
    )


@query("agg_document_frequency", f"""WITH {Q_SECTION_ROWS}, {q_terms('ct', 'section_rows', 'section, doc_id, skema')}
    SELECT section, term, count(*) AS df FROM ct GROUP BY ALL""")
def agg_document_frequency(spark, sf):
    return tfidf.document_frequency(tfidf.term_counts(section_rows(spark, sf), ["section", "doc_id"]))


@query("topk_tfidf", f"WITH {SEARCH}, {q_hits(10)} SELECT query_id, doc_id, skema, similarity_score, rank FROM hits")
def topk_tfidf(spark, sf):
    return tfidf.search(text_index(spark, sf), passages(spark, sf)).drop("section")


@query("score_cutoff", f"""WITH {SEARCH} SELECT query_id, doc_id, round(score, 6) AS similarity_score,
      score > 0.1 AS above, score >= 0.8 AS flagged FROM sc WHERE score >= 0.1""")
def score_cutoff(spark, sf):
    index = text_index(spark, sf)
    scored = tfidf.scores_from(index, tfidf.transform(index, passages(spark, sf)), 0.1)
    score = F.col("similarity_score")
    return scored.select(
        "query_id", "doc_id", F.round(score, 6).alias("similarity_score"), (score > 0.1).alias("above"),
        s.threshold_verdict(score, F.lit(0.8)).alias("flagged"),
    )


@query("tfidf_layers", f"""WITH {Q_WHOLE}, {q_tfidf('corpus')}
    SELECT section, term, floor(-2 * log2(greatest(round(w / norm, 6), 1e-6)) + 1e-6)::int AS layer, round(max(w / norm), 6) AS top, count(*) AS n
    FROM dw JOIN dn USING (section, doc_id) GROUP BY ALL""")
def tfidf_layers(spark, sf):
    return text_index(spark, sf).layers.withColumn("top", F.round("top", 6))


@query("tfidf_postings_read", f"""WITH {SEARCH} SELECT query_id, sum(df)::bigint AS n, true AS fewer FROM qw GROUP BY query_id""")
def tfidf_postings_read(spark, sf):
    """Postings of each query's terms, and whether the search for its best ten reads fewer."""
    index = text_index(spark, sf)
    counted = tfidf.postings_read(index, tfidf.transform(index, passages(spark, sf)), k=10)
    return counted.select("query_id", "n", (F.col("n_read") < F.col("n")).alias("fewer"))


@query("topk_tfidf_early_stop", f"WITH {SEARCH}, {q_hits(10)} SELECT query_id, doc_id, skema, similarity_score, rank FROM hits")
def topk_tfidf_early_stop(spark, sf):
    """The same hits as `topk_tfidf`, with layers of postings left out however small the index is."""
    return tfidf.search(text_index(spark, sf), passages(spark, sf), stop_from=0).drop("section")


def with_skema(queries):
    """Each passage asks for one category."""
    return queries.withColumn("skema", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


Q_ASKING = "asking AS (SELECT item_id AS query_id, 'text' AS section, 'src' || (item_id % 20) AS skema, text FROM benchmark)"


@query("filter_skema_post_rank", f"""WITH {Q_WHOLE}, {Q_ASKING}, {q_tfidf('corpus', 'asking')}, {q_hits(10)}
    SELECT query_id, doc_id, skema, similarity_score, rank FROM hits""")
def filter_skema_post_rank(spark, sf):
    return tfidf.search(text_index(spark, sf), with_skema(passages(spark, sf))).drop("section")


@query("join_metadata", f"""WITH {SEARCH}, {q_hits(10)}
    SELECT query_id, rank, h.doc_id, m.source AS skema FROM hits h JOIN documents m USING (doc_id)""")
def join_metadata(spark, sf):
    hits = tfidf.search(text_index(spark, sf), passages(spark, sf)).select("query_id", "rank", "doc_id")
    meta = documents(spark, sf).select("doc_id", "skema")
    return search.join_metadata(runtime.broadcast_if_small(runtime.written(hits, "hits")), meta)


@query("join_matched_text", f"""WITH {SEARCH}, {q_hits(10)}
    SELECT query_id, rank, h.doc_id, coalesce(m.text, '') AS matched_text FROM hits h LEFT JOIN documents m USING (doc_id)""")
def join_matched_text(spark, sf):
    hits = runtime.written(tfidf.search(text_index(spark, sf), passages(spark, sf)), "hits")
    return search.join_matched_text(hits, whole_rows(spark, sf)).select("query_id", "rank", "doc_id", "matched_text")


def q_pair_scores(hits: str, queries: str, texts: str) -> str:
    """CTE scored: exact, semantic and final score of every hit; the fuzzy weight is 0."""
    return f"""pr AS MATERIALIZED (SELECT row_number() OVER () AS pid, h.*, q.text AS a, coalesce(m.text, '') AS b FROM {hits} h
      JOIN {queries} q USING (query_id, section) LEFT JOIN {texts} m USING (section, doc_id)),
    gr AS (SELECT pid, {q_ngrams('x')} AS ga, {q_ngrams('y')} AS gb
      FROM (SELECT pid, {q_tokens('a')} AS x, {q_tokens('b')} AS y FROM pr)),
    {q_bags('ba', 'pr', 'pid', 'a')}, {q_bags('bb', 'pr', 'pid', 'b')},
    cs AS (SELECT pid, sum(ba.c * bb.c) AS dot FROM ba JOIN bb USING (pid, b) GROUP BY pid),
    na AS (SELECT pid, sqrt(sum(c * c)) AS n FROM ba GROUP BY pid), nb AS (SELECT pid, sqrt(sum(c * c)) AS n FROM bb GROUP BY pid),
    scored AS (SELECT pr.*, {q_jaccard('ga', 'gb')} AS exact, coalesce(dot / (na.n * nb.n), 0.0) AS semantic,
        least(CASE WHEN length(a) < 100 OR length(b) < 100 THEN 0.4 * exact + 0.6 * semantic
          ELSE 0.5 * exact + 0.5 * semantic END + CASE WHEN semantic > 0.9 THEN 0.05 ELSE 0 END, 1.0)::double AS final
      FROM pr JOIN gr USING (pid) LEFT JOIN cs USING (pid) LEFT JOIN na USING (pid) LEFT JOIN nb USING (pid))"""


@query("search_tfidf", f"""WITH {SEARCH}, {q_hits(10)}, {q_pair_scores('hits', 'passages', 'corpus')}
    SELECT query_id, section, rank, doc_id, skema, similarity_score, round(exact, 6) AS exact_score,
      round(semantic, 6) AS semantic_score, round(final, 6) AS final_score,
      CASE WHEN length(b) > 500 THEN substr(b, 1, 500) || '...' ELSE b END AS matched_text FROM scored""")
def search_tfidf(spark, sf):
    found = search.search_tfidf(text_index(spark, sf), whole_rows(spark, sf), passages(spark, sf), fuzzy=False)
    return found.drop("fuzzy_score")


@query("search_tfidf_full")
def search_tfidf_full(spark, sf):
    return search.search_tfidf(text_index(spark, sf), whole_rows(spark, sf), passages(spark, sf))


BULK = f"{Q_SECTION_ROWS}, {Q_BATCH_ROWS}, bq AS (SELECT query_index AS query_id, * EXCLUDE query_index FROM batch_rows)"
Q_BULK_TFIDF = f"{BULK}, {q_tfidf('section_rows', 'bq')}, {q_hits(1)}, {q_pair_scores('hits', 'bq', 'section_rows')}"


@query("search_bulk_tfidf", f"""WITH {Q_BULK_TFIDF}
    SELECT query_id AS query_index, section, doc_id, skema, similarity_score, round(exact, 6) AS exact_score,
      round(semantic, 6) AS semantic_score, round(final, 6) AS final_score,
      (row_number() OVER (PARTITION BY query_id ORDER BY round(final, 6) DESC, list_position([{quoted(rows.SECTIONS)}], section), doc_id))::int AS rank
    FROM (SELECT * EXCLUDE rank FROM scored) QUALIFY rank <= 1""")
def search_bulk_tfidf(spark, sf):
    found = search.search_bulk_tfidf(section_index(spark, sf), section_rows(spark, sf), items(spark, sf), fuzzy=False)
    return found.drop("fuzzy_score", "matched_text")


@query("search_bulk_tfidf_full")
def search_bulk_tfidf_full(spark, sf):
    return search.search_bulk_tfidf(section_index(spark, sf), section_rows(spark, sf), items(spark, sf))


# ---------------------------------------------------------------- vectors

@query("dense_cosine", f"""WITH {Q_CENTROIDS}
    SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::double[], v), 6) AS similarity_score
    FROM embeddings JOIN centroids ON label = query_id""")
def dense_cosine(spark, sf):
    means = centroids(spark, sf).select(F.col("query_id").cast("string").alias("skema"), F.col("embedding").alias("mean"))
    joined = vectors(spark, sf).join(runtime.broadcast_if_small(means), "skema")
    return joined.select("doc_id", F.round(cosine_of(F.col("embedding"), F.col("mean")), 6).alias("similarity_score"))


@query("join_dense_theta", f"""WITH {Q_CENTROIDS}
    SELECT query_id::bigint AS query_id, vec_id AS doc_id,
      round(list_cosine_similarity(embedding::double[], v), 6) AS similarity_score
    FROM embeddings, centroids WHERE list_cosine_similarity(embedding::double[], v) > 0.1""")
def join_dense_theta(spark, sf):
    return dense.theta_join(vectors(spark, sf), centroids(spark, sf)).drop("skema", "section")


Q_NEAR = """near AS (SELECT query_id::bigint AS query_id, vec_id AS doc_id, label::varchar AS skema,
      round(list_cosine_similarity(embedding::double[], v), 6) AS similarity_score,
      (row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, vec_id))::int AS rank
    FROM embeddings, centroids WHERE {where} QUALIFY rank <= {k})"""


@query("topk_dense", f"WITH {Q_CENTROIDS}, {Q_NEAR.format(where='true', k=10)} FROM near")
def topk_dense(spark, sf):
    return dense.nearest(vectors(spark, sf), centroids(spark, sf)).drop("section")


def vector_index(spark, sf):
    return once(spark, sf, "vector-index", lambda: dense.build_point_index(vectors(spark, sf)))


@query("topk_dense_pruned", f"WITH {Q_CENTROIDS}, {Q_NEAR.format(where='true', k=10)} FROM near")
def topk_dense_pruned(spark, sf):
    """The same hits as `topk_dense`, from points stored in clusters; tiles that cannot matter are not read."""
    return dense.nearest(vector_index(spark, sf), centroids(spark, sf)).drop("section")


@query("join_dense_theta_pruned", f"""WITH {Q_CENTROIDS}
    SELECT query_id::bigint AS query_id, vec_id AS doc_id,
      round(list_cosine_similarity(embedding::double[], v), 6) AS similarity_score
    FROM embeddings, centroids WHERE list_cosine_similarity(embedding::double[], v) > 0.4""")
def join_dense_theta_pruned(spark, sf):
    return dense.theta_join(vector_index(spark, sf), centroids(spark, sf), 0.4).drop("skema", "section")


@query("dense_tiles_scored", """SELECT count(*) AS points, (SELECT count(DISTINCT label) FROM embeddings) * count(*) AS pairs,
      true AS fewer FROM embeddings""")
def dense_tiles_scored(spark, sf):
    """Points, pairs of points and queries, and whether the search for the best ten scores fewer pairs."""
    read = dense.tiles_scored(vector_index(spark, sf), centroids(spark, sf), 10)
    return read.select("points", "pairs", (F.col("pairs_scored") < F.col("pairs")).alias("fewer"))


@query("topk_dense_filtered", f"WITH {Q_CENTROIDS}, {Q_NEAR.format(where='label = (query_id + 1) % 10', k=10)} FROM near")
def topk_dense_filtered(spark, sf):
    asking = centroids(spark, sf).withColumn("skema", ((F.col("query_id") + 1) % 10).cast("string"))
    return dense.nearest(vectors(spark, sf), asking).drop("section")


@query("topk_dense_threshold", f"""WITH {Q_CENTROIDS},
    {Q_NEAR.format(where='list_cosine_similarity(embedding::double[], v) >= 0.3', k=5)} FROM near""")
def topk_dense_threshold(spark, sf):
    return dense.nearest(vectors(spark, sf), centroids(spark, sf), 5, threshold=0.3).drop("section")


@query("best_match", f"WITH {Q_CENTROIDS}, {Q_NEAR.format(where='true', k=1)} SELECT query_id, doc_id, skema, similarity_score FROM near")
def best_match(spark, sf):
    found = dense.nearest(vectors(spark, sf), centroids(spark, sf), 1).drop("rank")
    return rows.best_match(found, ["query_id"]).drop("section")


@query("sort_results", f"WITH {Q_CENTROIDS}, {Q_NEAR.format(where='true', k=10)} SELECT query_id, doc_id, similarity_score FROM near ORDER BY 1, 3 DESC, 2")
def sort_results(spark, sf):
    found = dense.nearest(vectors(spark, sf), centroids(spark, sf))
    return rows.sort_results(found).select("query_id", "doc_id", "similarity_score")


@query("agg_point_stats", f"WITH {Q_POINTS} SELECT count(*) AS total_points, 512::int AS vector_size, 'cosine' AS distance_metric FROM points")
def agg_point_stats(spark, sf):
    return summaries.agg_point_stats(section_points(spark, sf))


@query("search_dense", f"""WITH {Q_WHOLE_POINTS}, {Q_PASSAGES},
    asked AS (SELECT * FROM passages WHERE length({q_strip('text')}) >= 3), {q_dense('points', 'asked', False, 10)}
    SELECT query_id, rank, doc_id, skema, section, similarity_score,
      CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text_preview, text AS matched_text
    FROM near JOIN (SELECT doc_id, text FROM points) USING (doc_id)""")
def search_dense(spark, sf):
    return search.search_dense(whole_points(spark, sf), passages(spark, sf))


Q_BULK_DENSE = f"""{Q_POINTS}, {Q_BATCH_ROWS},
    bq AS (SELECT query_index * 7 + section_order AS query_id, * FROM batch_rows WHERE length({q_strip('text')}) >= 3)"""


def q_bulk_dense(k, cutoff):
    return f"""{Q_BULK_DENSE}, {q_dense('points', 'bq', True, k, cutoff)},
    bulk AS (SELECT (query_id // 7)::bigint AS query_index, doc_id, skema, section, similarity_score, (row_number() OVER (
        PARTITION BY query_id // 7 ORDER BY similarity_score DESC, section_order, doc_id))::int AS rank
      FROM (SELECT * EXCLUDE rank FROM near) QUALIFY rank <= {k})"""


@query("search_bulk_dense", f"""WITH {q_bulk_dense(5, 'score > -2')}
    SELECT bulk.*, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS text_preview, text AS matched_text
    FROM bulk JOIN (SELECT doc_id, section, text FROM points) USING (doc_id, section)""")
def search_bulk_dense(spark, sf):
    return search.search_bulk_dense(section_points(spark, sf), items(spark, sf))


def requests(queries):
    """Queries with their own k of 1, 5 or 10 and their own threshold, some without one."""
    kind = F.col("query_id") % 3
    return queries.withColumns({
        "k": F.when(kind == 0, 1).when(kind == 1, 5).otherwise(10),
        "threshold": F.when(kind == 0, 0.15).when(kind == 1, 0.2).otherwise(F.lit(None).cast("double")),
    })


Q_OWN = "rank <= CASE query_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 10 END AND {score} >= CASE query_id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.2 ELSE {default} END"


@query("search_tfidf_requests", f"WITH {SEARCH}, {q_hits(10)} SELECT query_id, doc_id, skema, similarity_score, rank FROM hits WHERE {Q_OWN.format(score='similarity_score', default='0.1')}")
def search_tfidf_requests(spark, sf):
    """One batch in which every request has its own k and threshold."""
    return tfidf.search_requests(text_index(spark, sf), requests(passages(spark, sf))).drop("section")


@query("search_dense_requests", f"""WITH {Q_WHOLE_POINTS}, {Q_PASSAGES},
    asked AS (SELECT * FROM passages WHERE length({q_strip('text')}) >= 3), {q_dense('points', 'asked', False, 10)}
    SELECT query_id, rank, doc_id, skema, section, similarity_score FROM near WHERE {Q_OWN.format(score='similarity_score', default='-2')}""")
def search_dense_requests(spark, sf):
    found = search.search_dense(whole_points(spark, sf), requests(passages(spark, sf)))
    return found.drop("text_preview", "matched_text")


@query("rerank_bulk", f"WITH {q_bulk_dense(1, 'score > 0.1')} FROM bulk")
def rerank_bulk(spark, sf):
    return search.search_bulk_dense(section_points(spark, sf), items(spark, sf), k=1, cutoff=0.1, texts=False)


@query("results_to_json", f"""WITH {q_bulk_dense(5, 'score > 0.1')}
    SELECT query_index, to_json({{'results': coalesce(list({{'doc_id': doc_id, 'skema': skema, 'section': section,
      'similarity_score': similarity_score}} ORDER BY rank) FILTER (doc_id IS NOT NULL), []), 'total_results': count(doc_id)}})::varchar AS response
    FROM (SELECT query_index FROM items) LEFT JOIN bulk USING (query_index) GROUP BY query_index""")
def results_to_json(spark, sf):
    batch = items(spark, sf)
    return to_response(search.search_bulk_dense(section_points(spark, sf), batch, cutoff=0.1, texts=False), items=batch)


@query("bulk_response", f"""WITH {q_bulk_dense(5, 'score > 0.1').replace(Q_ITEMS, Q_GOOD_ITEMS)},
    found AS (SELECT query_index, list({{'doc_id': doc_id, 'skema': skema, 'section': section, 'similarity_score': similarity_score}} ORDER BY rank) AS results FROM bulk GROUP BY ALL),
    looked AS (SELECT query_index, list(section ORDER BY section_order) AS sections FROM batch_rows GROUP BY ALL)
    SELECT query_index, to_json({{'query_index': query_index, 'results': coalesce(results, []), 'query_info': {{'skema_filter': skema,
      'columns_searched': coalesce(sections, []), 'total_results': coalesce(len(results), 0)}}}})::varchar AS response
    FROM items LEFT JOIN found USING (query_index) LEFT JOIN looked USING (query_index)
    UNION ALL SELECT item_id, to_json({{'query_index': item_id, 'error': CASE item_id % 4 WHEN 2
      THEN 'Invalid list format: ' || to_json([string_split(text, chr(10))[1]])::varchar ELSE 'Expected dict but got str: "item ' || item_id || '"' END}})::varchar
    FROM benchmark WHERE item_id % 4 >= 2""")
def bulk_response(spark, sf):
    """A whole response: results and what was searched for good elements, an error in place for each other one."""
    from bindings.tables import elements

    good, bad = parse_query_batch(elements(spark, sf))
    good, bad = runtime.written(good, "good-items"), runtime.written(bad, "bad-items")
    found = search.search_bulk_dense(section_points(spark, sf), good, cutoff=0.1, texts=False)
    return to_bulk_response(good, bad, found)


@query("agg_columns_searched", f"""WITH {q_bulk_dense(5, 'score > -2')}
    SELECT query_index, coalesce(array_to_string(list(section ORDER BY section_order) FILTER (section IS NOT NULL), ','), '') AS columns_searched,
      coalesce(max(n), 0)::bigint AS total_results
    FROM (SELECT query_index FROM items) LEFT JOIN batch_rows USING (query_index) LEFT JOIN (SELECT query_index, count(*) AS n FROM bulk GROUP BY ALL) USING (query_index) GROUP BY query_index""")
def agg_columns_searched(spark, sf):
    batch = items(spark, sf)
    found = search.search_bulk_dense(section_points(spark, sf), batch, texts=False)
    return summaries.agg_columns_searched(summaries.batch_rows(batch), found, items=batch).withColumn("columns_searched", F.array_join("columns_searched", ","))


@query("union_sections", f"""WITH {Q_SECTION_ROWS} SELECT doc_id, section, length(text) AS n_chars FROM section_rows WHERE text IS NOT NULL""")
def union_sections(spark, sf):
    """All sections from one scan: an unpivot, not a union of six."""
    return section_rows(spark, sf).where(F.col("text").isNotNull()).select(
        "doc_id", "section", F.length("text").cast("bigint").alias("n_chars")
    )


@query("join_skema_fallback", f"""WITH {Q_POINTS}, {Q_ITEMS.replace("item_id % 20", "item_id % 25")},
    bq AS (SELECT query_index, skema, unnest([{quoted(rows.SECTIONS)}]) AS section FROM items),
    known AS (SELECT DISTINCT skema, section FROM points)
    SELECT query_index, q.section, q.skema AS search_skema, k.skema, q.skema IS NOT NULL AND k.skema IS NULL AS fallback_used
    FROM bq q LEFT JOIN known k ON q.skema = k.skema AND q.section = k.section""")
def join_skema_fallback(spark, sf):
    wider = F.when(F.col("query_index") % 3 == 0, F.concat(F.lit("src"), (F.col("query_index") % 25).cast("string")))
    asked = items(spark, sf).select("query_index", wider.alias("skema"), F.explode(F.array(*map(F.lit, rows.SECTIONS))).alias("section"))
    return d.join_skema_fallback(asked, section_points(spark, sf))


@query("ann_candidates")
def ann_candidates(spark, sf):
    forest = once(spark, sf, "vector-forest", lambda: neighbours.build_forest(vectors(spark, sf), 64))
    return neighbours.ann_candidates(forest, centroids(spark, sf), 64)


@query("ann_forest", """SELECT count(*) * 16 AS entries, ceil(count(*) * 16 / 256)::bigint AS pages, least(256, count(*) * 16)::bigint AS longest FROM embeddings""")
def ann_forest(spark, sf):
    """Every vector is in every tree, and no page is longer than the others."""
    forest = once(spark, sf, "vector-forest", lambda: neighbours.build_forest(vectors(spark, sf), 64))
    return forest.pages.agg(
        F.sum(F.size("entries")).alias("entries"), F.count("*").alias("pages"), F.max(F.size("entries")).cast("bigint").alias("longest")
    )
