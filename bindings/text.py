"""Cleaning, tokens and n-grams over whole texts."""

from pyspark.sql import functions as F

from bindings.base import (
    Q_PAIRS, Q_SECTION_ROWS, documents, q_academic, q_collapse, q_count, q_dedupe, q_lexical, q_ngrams, q_noise,
    q_phrase_share, q_sentences, q_spacing, q_stem, q_tokens, q_unstopped, q_words, query, section_rows, text_pairs,
)
from kembar.functions import text as t
from kembar.operators import passages as g
from kembar.operators.segments import segment_text as cut

# Frequent word pairs of the given documents, to see the phrase operator at work beside its own list.
FREQUENT = ("of the", "in the", "de la", "que la", "und die", "in", "the", "que")


def over_documents(name, sql, column):
    @query(name, f"SELECT doc_id, {sql} AS result FROM documents")
    def run(spark, sf):
        return documents(spark, sf).select("doc_id", column(F.col("text")).alias("result"))

    return run


over_documents("clean_academic", q_academic("text"), t.clean_academic)
over_documents("clean_keep_spacing", q_spacing("text"), t.clean_keep_spacing)
over_documents("clean_lexical", q_lexical("text"), t.clean_lexical)
over_documents("remove_stopwords", f"array_to_string({q_unstopped(q_words('text'))}, ' ')", t.remove_stopwords)
over_documents("stem_tokens", f"array_to_string(list_transform({q_words('text')}, lambda w: {q_stem('w')}), ' ')", t.stem_text)
over_documents("tokenize_words", f"array_to_string({q_tokens('text')}, ' ')", lambda c: F.array_join(t.tokenize_words(c), " "))
over_documents(
    "tokenize_tfidf", "array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), ' ')",
    lambda c: F.array_join(t.tokenize_tfidf(c), " "),
)
over_documents("word_count", q_count("text"), lambda c: t.word_count(c).cast("bigint"))


@query("dedupe_sentences", q_dedupe("documents", "doc_id"))
def dedupe_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", t.dedupe_sentences(F.col("text")).alias("text"))


@query("text_fingerprint", f"""WITH {Q_SECTION_ROWS}
    SELECT doc_id, section, CASE WHEN coalesce(text, '') = '' THEN '' ELSE md5(text) END AS text_md5 FROM section_rows""")
def text_fingerprint(spark, sf):
    return section_rows(spark, sf).select("doc_id", "section", t.text_fingerprint(F.col("text")).alias("text_md5"))


@query("word_ngrams", f"""WITH tok AS (SELECT doc_id, {q_tokens('text')} AS w FROM documents)
    SELECT doc_id, unnest({q_ngrams('w')}) AS ngram FROM tok""")
def word_ngrams(spark, sf):
    return g.ngram_rows(documents(spark, sf), ["doc_id"])


@query("char_ngrams", f"""WITH flat AS (SELECT doc_id, {q_collapse("lower(text)")} AS s FROM documents),
    grams AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g
      FROM (SELECT doc_id, string_split(s, '') AS c FROM flat))
    SELECT DISTINCT doc_id, g AS gram FROM grams""")
def char_ngrams(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(t.char_ngrams(F.col("text"))).alias("gram"))


@query("phrase_overlap", f"""WITH {Q_PAIRS}
    SELECT doc_id, round({q_phrase_share('a', 'b')}, 6) AS phrase_overlap,
      round({q_phrase_share('a', 'b', FREQUENT)}, 6) AS frequent_overlap FROM pairs""")
def phrase_overlap(spark, sf):
    a, b = F.col("a"), F.col("b")
    return text_pairs(spark, sf).select(
        "doc_id", F.round(t.phrase_overlap(a, b), 6).alias("phrase_overlap"),
        F.round(t.phrase_overlap(a, b, FREQUENT), 6).alias("frequent_overlap"),
    )


Q_SEGMENTS = f"""sent AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos
      FROM (SELECT doc_id, {q_sentences('text')} AS s FROM documents)),
    placed AS (SELECT *, {q_count('sentence')} AS words FROM sent),
    raw AS (SELECT *, floor((sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words) / 100) AS raw_index FROM placed)"""


@query("segment_text", f"""WITH {Q_SEGMENTS}
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY raw_index) - 1 AS segment_index,
      string_agg(sentence, '. ' ORDER BY pos) AS segment_text, sum(words)::bigint AS segment_words
    FROM raw GROUP BY doc_id, raw_index""")
def segment_text(spark, sf):
    cuts = cut(documents(spark, sf), ["doc_id"])
    return cuts.withColumns({"segment_index": F.col("segment_index").cast("bigint"), "segment_words": F.col("segment_words").cast("bigint")})
