"""Pair similarity, combined scores, verdicts, thresholds and summaries."""

from pyspark.sql import functions as F

from bindings.base import (
    Q_BATCH_ROWS, Q_CENTROIDS, Q_ITEMS, Q_PAIRS, Q_PASSAGES, Q_POINTS, Q_PROPOSALS, Q_SECTION_ROWS, Q_WHOLE_POINTS, documents,
    items, passages, proposals, q_bags, q_collapse, q_count, q_dedupe, q_dense, q_jaccard, q_ngrams, q_overlap,
    q_phrase_share, q_sentences, q_spacing, q_strip, q_tokens, q_unstopped, q_words, query, read, section_points,
    section_rows, text_pairs, whole_points, whole_rows,
)
from bindings.text import Q_SEGMENTS
from kembar import runtime
from kembar.functions import pairs as p
from kembar.functions import scores as s
from kembar.functions import text as t
from kembar.functions.vectors import encode
from kembar.operators import dense, edits, passages as g, segments as seg, spans, summaries, tfidf, thresholds
from kembar.plans import detect as d

def pair():
    return F.col("a"), F.col("b")


@query("pair_tfidf_cosine", f"""WITH {Q_PAIRS},
    tk AS (SELECT doc_id, 0 AS side, unnest(regexp_extract_all(lower(a), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM pairs
      UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(lower(b), '[\\p{{L}}\\p{{N}}_]{{2,}}')) FROM pairs),
    pt AS (SELECT doc_id, term, count(*) FILTER (side = 0) AS ta, count(*) FILTER (side = 1) AS tb FROM tk GROUP BY ALL),
    pw AS (SELECT *, ln(3.0 / (1 + (ta > 0)::int + (tb > 0)::int)) + 1 AS w FROM pt),
    sm AS (SELECT doc_id, sum(ta * w * tb * w) AS dot, sqrt(sum(ta * w * ta * w)) AS na, sqrt(sum(tb * w * tb * w)) AS nb FROM pw GROUP BY ALL)
    SELECT doc_id, round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) END, 0.0), 6) AS tfidf_cosine
    FROM pairs LEFT JOIN sm USING (doc_id)""")
def pair_tfidf_cosine(spark, sf):
    scored = tfidf.pair_cosine(text_pairs(spark, sf), "a", "b", "doc_id")
    return scored.select("doc_id", F.round("tfidf_cosine", 6).alias("tfidf_cosine"))


Q_GRAMS = f"""dt AS (SELECT doc_id, {q_tokens('text')} AS w FROM documents), qt AS (SELECT item_id AS query_id, {q_tokens('text')} AS w FROM benchmark),
    dg AS MATERIALIZED (SELECT doc_id, unnest(g) AS ngram, len(g) AS doc_size FROM (SELECT doc_id, {q_ngrams('w')} AS g FROM dt)),
    qg AS MATERIALIZED (SELECT query_id, unnest(g) AS ngram, len(g) AS query_size FROM (SELECT query_id, {q_ngrams('w')} AS g FROM qt)),
    sh AS (SELECT query_id, doc_id, query_size, doc_size, count(*) AS shared FROM dg JOIN qg USING (ngram) GROUP BY ALL)"""


def asked(spark, sf):
    return passages(spark, sf).select("query_id", "text")


@query("ngram_jaccard", f"WITH {Q_GRAMS} SELECT query_id, doc_id, round(shared / (query_size + doc_size - shared), 6) AS exact_score FROM sh")
def ngram_jaccard(spark, sf):
    return g.ngram_jaccard_join(asked(spark, sf), documents(spark, sf))


@query("ngram_containment", f"WITH {Q_GRAMS} SELECT query_id, doc_id, round(shared / query_size, 6) AS containment FROM sh")
def ngram_containment(spark, sf):
    return g.ngram_containment(asked(spark, sf), documents(spark, sf))


@query("drop_boilerplate", f"""WITH {Q_GRAMS}, common AS (SELECT ngram FROM dg GROUP BY ngram HAVING count(*) > 20)
    SELECT doc_id, ngram FROM dg WHERE ngram NOT IN (FROM common)""")
def drop_boilerplate(spark, sf):
    grams = runtime.written(g.ngram_rows(documents(spark, sf), ["doc_id"]), "ngrams")
    return g.drop_boilerplate(grams, 20)


def q_sentence_rows(table, key):
    return f"""SELECT {key}, sentence, pos - 1 AS pos, md5(lower(sentence)) AS sentence_md5
      FROM (SELECT {key}, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM (SELECT {key}, {q_sentences('text')} AS s FROM {table}))"""


@query("matched_passages", f"""WITH ds AS ({q_sentence_rows('documents', 'doc_id')}), qs AS ({q_sentence_rows('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')}),
    hit AS (SELECT query_id, doc_id, pos, sentence, pos - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS run
      FROM qs JOIN (SELECT DISTINCT doc_id, sentence_md5 FROM ds WHERE length(sentence) >= 20) USING (sentence_md5) WHERE length(sentence) >= 20)
    SELECT query_id, doc_id, min(pos) AS first_sentence, max(pos) AS last_sentence, sum(length(sentence))::bigint AS matched_chars
    FROM hit GROUP BY query_id, doc_id, run""")
def matched_passages(spark, sf):
    found = g.matched_passages(asked(spark, sf), documents(spark, sf))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("first_sentence", "last_sentence")})


Q_COMPARABLE = q_collapse("lower(coalesce(text, ''))")


@query("matched_spans", f"""WITH qt AS (SELECT item_id AS query_id, {Q_COMPARABLE} AS x FROM benchmark), dt AS (SELECT doc_id, {Q_COMPARABLE} AS x FROM documents),
    qg AS (SELECT query_id, qp, substr(x, qp::int + 1, 40) AS g FROM (SELECT query_id, x, unnest(range(0, length(x) - 39)) AS qp FROM qt)),
    dg AS (SELECT doc_id, dp, substr(x, dp::int + 1, 40) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) - 39)) AS dp FROM dt)),
    hits AS (SELECT query_id, doc_id, qp, dp, qp - row_number() OVER (PARTITION BY query_id, doc_id, qp - dp ORDER BY qp) AS run FROM qg JOIN dg USING (g)),
    runs AS (SELECT query_id, doc_id, min(qp) AS s, max(qp) + 40 AS e, min(dp) AS d FROM hits GROUP BY query_id, doc_id, qp - dp, run),
    once AS (SELECT query_id, doc_id, s, e, min(d) AS d FROM runs GROUP BY ALL)
    SELECT query_id, doc_id, s::int AS query_start, e::int AS query_end, d::int AS doc_start FROM once a
    WHERE NOT EXISTS (SELECT 1 FROM once b WHERE a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s)""")
def matched_spans(spark, sf):
    return spans.matched_spans(asked(spark, sf), documents(spark, sf))


@query("similar_sentences")
def similar_sentences(spark, sf):
    return edits.similar_sentences(asked(spark, sf), documents(spark, sf))


@query("drop_citations", f"""WITH ds AS ({q_sentence_rows('documents', 'doc_id')}), qs AS ({q_sentence_rows('(SELECT item_id AS query_id, text FROM benchmark)', 'query_id')})
    SELECT doc_id, pos, sentence FROM ds WHERE sentence_md5 NOT IN (SELECT sentence_md5 FROM qs)""")
def drop_citations(spark, sf):
    quoted = g.sentence_rows(asked(spark, sf), ["query_id"])
    kept = g.drop_citations(g.sentence_rows(documents(spark, sf), ["doc_id"]), runtime.written(quoted, "quoted"))
    return kept.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


Q_WORDSETS = f"""{Q_PAIRS}, ws AS (SELECT doc_id, list_distinct({q_words('a')}) AS x, list_distinct({q_words('b')}) AS y FROM pairs)"""


@query("word_jaccard", f"WITH {Q_WORDSETS} SELECT doc_id, round({q_jaccard('x', 'y')}, 4) AS jaccard FROM ws")
def word_jaccard(spark, sf):
    return text_pairs(spark, sf).select("doc_id", p.word_jaccard(*pair()).alias("jaccard"))


@query("overlap_coefficient", f"WITH {Q_WORDSETS} SELECT doc_id, round({q_overlap('x', 'y')}, 4) AS word_overlap FROM ws")
def overlap_coefficient(spark, sf):
    return text_pairs(spark, sf).select("doc_id", p.overlap_coefficient(*pair()).alias("word_overlap"))


@query("set_intersect_union", f"""WITH {Q_WORDSETS}
    SELECT doc_id, len(list_intersect(x, y)) AS n_shared, len(list_distinct(list_concat(x, y))) AS n_joint FROM ws""")
def set_intersect_union(spark, sf):
    sets = text_pairs(spark, sf).select("doc_id", p.set_counts(p.word_set(F.col("a")), p.word_set(F.col("b"))).alias("n"))
    return sets.select("doc_id", "n.*")


@query("fuzzy_ratio")
def fuzzy_ratio(spark, sf):
    return text_pairs(spark, sf).select("doc_id", F.round(p.fuzzy_ratio(*pair()), 6).alias("fuzzy_score"))


def q_unstopped_set(x):
    return f"list_distinct({q_unstopped(q_words(q_spacing(x)))})"


@query("lexical_metrics_sets", f"""WITH {Q_PAIRS}, ws AS (SELECT doc_id, a, b, {q_unstopped_set('a')} AS x, {q_unstopped_set('b')} AS y FROM pairs)
    SELECT doc_id, round({q_jaccard('x', 'y')}, 4) AS jaccard, round({q_overlap('x', 'y')}, 4) AS word_overlap,
      round({q_phrase_share('a', 'b')}, 4) AS academic FROM ws""")
def lexical_metrics_sets(spark, sf):
    return p.lexical_metrics(text_pairs(spark, sf), "a", "b").select("doc_id", "lexical.jaccard", "lexical.word_overlap", "lexical.academic")


# ---------------------------------------------------------------- combined scores over every line item's numbers

def numbers(spark, sf):
    rows = read(spark, sf, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("semantic"),
        F.round(F.col("l_discount") * 10, 4).alias("jaccard"), F.round(F.col("l_tax") * 12.5, 4).alias("sequence"),
        F.round((F.col("l_partkey") % 101) / 100, 4).alias("overlap"),
        F.round((F.col("l_suppkey") % 34) / 33, 4).alias("phrases"),
        F.repeat(F.lit("x"), (F.col("l_orderkey") % 200).cast("int")).alias("a"),
        F.repeat(F.lit("x"), (F.col("l_partkey") % 700).cast("int")).alias("b"),
    )


Q_NUMBERS = """nums AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, round(l_discount * 10, 4) AS j, round(l_tax * 12.5, 4) AS q,
    round((l_partkey % 101) / 100, 4) AS o, round((l_suppkey % 34) / 33, 4) AS ph, l_orderkey % 200 AS la, l_partkey % 700 AS lb FROM lineitem)"""
KEY = ("l_orderkey", "l_linenumber")


def over_numbers(name, sql, column):
    @query(name, f"WITH {Q_NUMBERS} SELECT l_orderkey, l_linenumber, {sql} AS result FROM nums")
    def run(spark, sf):
        return numbers(spark, sf).select(*KEY, column().alias("result"))

    return run


def named(name):
    return lambda: F.col(name)


sem, jac, seq, ovl, phr = map(named, ("semantic", "jaccard", "sequence", "overlap", "phrases"))

over_numbers("final_score_fixed", "round(0.4::double * j + 0.3::double * q + 0.3::double * s, 6)",
             lambda: F.round(s.final_score_fixed(jac(), seq(), sem()), 6))
over_numbers(
    "final_score_adaptive",
    """round(least(CASE WHEN la < 100 OR lb < 100 THEN 0.4::double * j + 0.6::double * s ELSE 0.5::double * j + 0.5::double * s END
      + CASE WHEN s > 0.9::double THEN 0.05::double ELSE 0 END, 1), 6)""",
    lambda: F.round(s.final_score_adaptive(jac(), seq(), sem(), *pair()), 6),
)


def q_mix(semantic, w):
    return f"{w[0]}::double * {semantic} + {w[1]}::double * j + {w[2]}::double * o + {w[3]}::double * q"


over_numbers(
    "composite_standard",
    f"""round(greatest(0, least(1, CASE WHEN o > 0.8::double THEN {q_mix('s', (.2, .3, .4, .1))}
      WHEN o > 0.5::double THEN {q_mix('s', (.4, .25, .25, .1))} ELSE {q_mix('s', (.6, .15, .15, .1))} END)), 6)""",
    lambda: F.round(s.composite_standard(sem(), jac(), ovl(), seq()), 6),
)
Q_DAMPED = "(CASE WHEN ph > 0.3::double THEN s * 0.95::double WHEN ph > 0.1::double THEN s * 0.98::double ELSE s END)"
over_numbers(
    "composite_academic",
    f"""round(greatest(0, least(1, CASE WHEN o > 0.9::double THEN {q_mix(Q_DAMPED, (.1, .3, .5, .1))}
      WHEN o > 0.7::double THEN {q_mix(Q_DAMPED, (.2, .3, .4, .1))}
      WHEN {Q_DAMPED} > 0.8::double AND o < 0.4::double THEN {q_mix(Q_DAMPED, (.7, .1, .1, .1))}
      ELSE {q_mix(Q_DAMPED, (.5, .2, .2, .1))} END)), 6)""",
    lambda: F.round(s.composite_academic(sem(), jac(), ovl(), seq(), phr()), 6),
)

RULES = (
    "q > 0.8::double AND s > 0.9::double", "j > 0.7::double AND s > 0.85::double", "j > 0.5::double AND s > 0.8::double",
    "s > 0.8::double AND j < 0.4::double", "s > 0.6::double AND j < 0.3::double", "s < 0.6::double", "true",
)


def q_verdict(part):
    cases = " ".join(
        f"WHEN {rule} THEN " + (f"'{v[part]}'" if isinstance(v[part], str) else f"{v[part]}")
        for rule, v in zip(RULES, s.VERDICTS, strict=True)
    )
    return f"CASE {cases} END"


@query("classify_match", f"""WITH {Q_NUMBERS} SELECT l_orderkey, l_linenumber, {q_verdict(0)} AS classification,
    ({q_verdict(1)})::double AS confidence, {q_verdict(2)} AS risk_level, {q_verdict(3)} AS explanation, {q_verdict(4)} AS is_plagiarism FROM nums""")
def classify_match(spark, sf):
    verdict = numbers(spark, sf).select(*KEY, s.classify_match(sem(), jac(), seq()).alias("v")).select(*KEY, "v.*")
    return verdict.withColumn("explanation", F.array_join("explanation", "; "))


over_numbers("threshold_verdict", "round(l_linenumber * 0.1, 6)::double <= s", lambda: s.threshold_verdict(sem(), F.round(F.col("l_linenumber") * 0.1, 6)))

Q_THRESHOLD = "CASE WHEN words > 300 THEN {base} + 0.02::double WHEN words > 0 AND words < 50 THEN {base} - 0.05::double ELSE {base} END"


@query("dynamic_threshold", f"""SELECT doc_id, words, round({Q_THRESHOLD.format(base='0.8::double')}, 6) AS threshold
    FROM (SELECT doc_id, {q_count('text')} AS words FROM documents)""")
def dynamic_threshold(spark, sf):
    counted = documents(spark, sf).select("doc_id", t.word_count(F.col("text")).cast("bigint").alias("words"))
    return counted.withColumn("threshold", F.round(s.dynamic_threshold(F.col("words")), 6))


def section_thresholds(spark):
    start = spark.createDataFrame([("judul", 0.8), ("ringkasan", 0.8), ("metode", 0.75)], "section string, threshold double")
    return thresholds.update_thresholds(start, spark.createDataFrame([("ringkasan", 0.85)], "section string, threshold double"))


@query("join_thresholds", f"""WITH {Q_SECTION_ROWS}, th(section, base) AS (VALUES ('judul', 0.8::double), ('ringkasan', 0.85::double), ('metode', 0.75::double)),
    counted AS (SELECT doc_id, section, coalesce(base, 0.8::double) AS base, coalesce({q_count('text')}, 0) AS words FROM section_rows LEFT JOIN th USING (section))
    SELECT doc_id, section, words, round({Q_THRESHOLD.format(base='base')}, 6) AS threshold_used FROM counted""")
def join_thresholds(spark, sf):
    counted = section_rows(spark, sf).select("doc_id", "section", t.word_count(F.col("text")).cast("bigint").alias("words"))
    joined = thresholds.join_thresholds(counted, section_thresholds(spark))
    return joined.withColumn("threshold_used", F.round("threshold_used", 6))


@query("match_type_thresholds", f"""WITH {Q_WORDSETS}, sc AS (SELECT doc_id, 'exact' AS score_type, {q_jaccard('x', 'y')} AS score, len(x) AS words FROM ws
      UNION ALL SELECT doc_id, 'overlap', {q_overlap('x', 'y')}, len(x) FROM ws),
    th(score_type, base) AS (VALUES ('exact', 0.1::double), ('overlap', 0.3::double))
    SELECT doc_id, score_type, round(score, 4) AS score, words, round({Q_THRESHOLD.format(base='base')}, 6) AS threshold_used,
      round(score, 4) >= round({Q_THRESHOLD.format(base='base')}, 6) AS is_match FROM sc JOIN th USING (score_type)""")
def match_type_thresholds(spark, sf):
    scored = text_pairs(spark, sf).select(
        "doc_id", F.size(p.word_set(F.col("a"))).cast("bigint").alias("words"),
        F.explode(F.create_map(F.lit("exact"), p.word_jaccard(*pair()), F.lit("overlap"), p.overlap_coefficient(*pair()))).alias("score_type", "score"),
    )
    table = spark.createDataFrame([("exact", 0.1), ("overlap", 0.3)], "score_type string, threshold double")
    return thresholds.match_type_thresholds(scored, table)


# ---------------------------------------------------------------- summaries

@query("agg_corpus_info", f"""WITH {Q_SECTION_ROWS} SELECT count(DISTINCT doc_id) AS total_proposals, count(DISTINCT skema) AS unique_skemas,
    (SELECT array_to_string(list(section ORDER BY o), ',') FROM (SELECT section, min(section_order) AS o FROM section_rows WHERE text IS NOT NULL GROUP BY section)) AS available_sections
    FROM section_rows""")
def agg_corpus_info(spark, sf):
    return summaries.agg_corpus_info(proposals(spark, sf)).withColumn("available_sections", F.array_join("available_sections", ","))


@query("skema_names", "SELECT source AS skema, count(*) AS n_proposals FROM documents GROUP BY source")
def skema_names(spark, sf):
    return summaries.skema_names(proposals(spark, sf))


@query("agg_skema_sections", f"""WITH {Q_POINTS}
    SELECT skema, count(DISTINCT section) AS n_sections, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections FROM points GROUP BY skema""")
def agg_skema_sections(spark, sf):
    return summaries.agg_skema_sections(section_points(spark, sf)).withColumn("sections", F.array_join("sections", ","))


Q_SECTION_NEAR = f"""{Q_POINTS}, {Q_BATCH_ROWS}, bq AS (SELECT query_index * 7 + section_order AS query_id, * FROM batch_rows), {q_dense('points', 'bq', True, 1)}"""


def item_thresholds(frame):
    """Every second item brings a threshold, some of them zero."""
    given = F.when(F.col("query_index") % 2 == 0, (F.col("query_index") % 10) / 10.0)
    return frame.withColumn("threshold", given)


@query("agg_bulk_summary", f"""WITH {Q_SECTION_NEAR}, sums AS (SELECT query_id // 7 AS query_index, avg(similarity_score) AS m, max(similarity_score) AS x, count(*) AS n FROM near GROUP BY ALL),
    th AS (SELECT query_index, coalesce(nullif(CASE WHEN query_index % 2 = 0 THEN (query_index % 10) / 10 END, 0), 0.8::double) AS threshold_used FROM items)
    SELECT query_index, round(coalesce(m, 0), 4) AS average_similarity_score, round(coalesce(x, 0), 4) AS max_similarity_score,
      coalesce(x >= threshold_used, false) AS is_plagiarism, coalesce(n, 0) AS columns_processed, threshold_used FROM th LEFT JOIN sums USING (query_index)""")
def agg_bulk_summary(spark, sf):
    from kembar.plans.search import bulk_queries

    near = dense.nearest(section_points(spark, sf), encode(bulk_queries(items(spark, sf)), "text"), 1)
    near = near.withColumn("query_index", F.floor(F.col("query_id") / 7).cast("bigint"))
    return summaries.agg_bulk_summary(item_thresholds(items(spark, sf)), near)


@query("agg_segments", f"""WITH {Q_SEGMENTS}, sg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_index) - 1 AS i,
      sum(words)::bigint AS w, sum(length(sentence))::bigint AS n FROM raw GROUP BY doc_id, raw_index),
    sr AS (SELECT doc_id, i, w, round((n % 1000) / 1000, 6) AS sim FROM sg)
    SELECT doc_id, count(*) AS total_segments, count(*) FILTER (sim >= 0.8) AS plagiarism_segments, max(sim) AS max_similarity,
      round(avg(sim), 6) AS avg_similarity, round(list_avg(list_reverse_sort(list(sim))[1:3]), 6) AS top3_avg_similarity,
      round(sum(sim * w) / sum(w), 6) AS confidence_score, arg_max(i, sim * 1000000 - i / 1000000) AS best_segment,
      CASE WHEN count(*) FILTER (sim >= 0.8) / count(*) > 0.6 THEN 'High' WHEN count(*) FILTER (sim >= 0.8) > 0 THEN 'Medium' ELSE 'Low' END AS risk_level,
      count(*) FILTER (sim >= 0.8) > 0 AS is_plagiarism
    FROM sr GROUP BY doc_id""")
def agg_segments(spark, sf):
    """Segments of whole documents, with a number made of the segment's letters as their score."""
    cuts = seg.segment_text(documents(spark, sf), ["doc_id"])
    letters = F.length("segment_text") - 2 * (F.size(F.split("segment_text", r"\. ")) - 1)
    scored = cuts.withColumn("similarity_score", F.round((letters % 1000) / 1000, 6))
    scored = scored.withColumn("is_plagiarism", F.col("similarity_score") >= 0.8)
    summed = seg.agg_segments(scored, ["doc_id"], "weighted_average")
    return summed.withColumn("best_segment", F.col("best_segment").cast("bigint"))


# ---------------------------------------------------------------- verdicts

@query("detect")
def detect(spark, sf):
    return flat(d.detect(whole_points(spark, sf), passages(spark, sf), titles=proposals(spark, sf)))


def flat(verdicts):
    return verdicts.withColumn("explanation", F.array_join("verdict.explanation", "; ")).select(
        "*", "lexical.*", "verdict.classification", "verdict.confidence", "verdict.risk_level"
    ).drop("lexical", "verdict")


@query("detect_match", f"""WITH {Q_WHOLE_POINTS}, asked AS (SELECT item_id AS query_id, 'text' AS section, NULL::varchar AS skema, text FROM ({q_dedupe('benchmark', 'item_id')})),
    {q_dense('points', 'asked', True, 1)}, th AS (SELECT query_id, text AS q_text, {q_count('text')} AS words FROM asked),
    pr AS (SELECT n.query_id, n.doc_id, similarity_score, words, q_text AS a, p.text AS b, string_split(p.text, chr(10))[1] AS title FROM near n JOIN th USING (query_id) JOIN (SELECT doc_id, text FROM points) p USING (doc_id)),
    ws AS (SELECT *, {q_unstopped_set('a')} AS x, {q_unstopped_set('b')} AS y FROM pr)
    SELECT query_id, doc_id AS most_similar_article_id, title AS most_similar_article_judul, round(similarity_score, 4) AS semantic_similarity, words AS text_length_words,
      round({Q_THRESHOLD.format(base='0.8::double')}, 6) AS threshold_used, round({q_jaccard('x', 'y')}, 4) AS jaccard,
      round({q_overlap('x', 'y')}, 4) AS word_overlap FROM ws""")
def detect_match(spark, sf):
    """The part of a verdict that plain SQL can follow: match, threshold and word sets."""
    verdicts = d.detect(whole_points(spark, sf), passages(spark, sf), titles=proposals(spark, sf))
    return verdicts.select(
        "query_id", "most_similar_article_id", "most_similar_article_judul", "semantic_similarity", F.col("text_length_words").cast("bigint").alias("text_length_words"),
        "threshold_used", "lexical.jaccard", "lexical.word_overlap",
    )


@query("detect_segmented")
def detect_segmented(spark, sf):
    cut = d.detect_segmented(whole_points(spark, sf), passages(spark, sf), True, 20, titles=proposals(spark, sf))
    return cut.withColumns({"detailed_segments": F.to_json("detailed_segments"), "explanation": F.array_join("explanation", "; ")})


@query("detect_bulk")
def detect_bulk(spark, sf):
    """Summaries over segments of 20 words, so that passages are cut."""
    return d.detect_bulk(section_points(spark, sf), items(spark, sf), 20)[1]


@query("detect_by_skema_strict", f"""WITH {Q_WHOLE_POINTS}, given AS (SELECT * FROM ({q_dedupe('benchmark', 'item_id')})),
    asked AS (SELECT item_id AS query_id, 'text' AS section, 'src' || (item_id % 25) AS skema, text FROM given
      WHERE 'src' || (item_id % 25) IN (SELECT skema FROM points)), {q_dense('points', 'asked', True, 1)}
    SELECT query_id, doc_id AS most_similar_article_id, round(similarity_score, 4) AS semantic_similarity, NULL::varchar AS error FROM near
    UNION ALL SELECT item_id, NULL, NULL, 'No points of category src' || (item_id % 25) || ' in section text' FROM given
      WHERE 'src' || (item_id % 25) NOT IN (SELECT skema FROM points)""")
def detect_by_skema_strict(spark, sf):
    """Without fallback: a match inside the category, or an error."""
    asked = passages(spark, sf).withColumn("skema", F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string")))
    found = d.detect_by_skema(whole_points(spark, sf), asked, fallback=False)
    return found.select("query_id", "most_similar_article_id", "semantic_similarity", "error")


@query("detect_by_skema")
def detect_by_skema(spark, sf):
    asked_skema = F.concat(F.lit("src"), (F.col("query_id") % 25).cast("string"))
    return flat(d.detect_by_skema(whole_points(spark, sf), passages(spark, sf).withColumn("skema", asked_skema)))
