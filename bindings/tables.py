"""Sources, sinks, projections and filters."""

from pyspark.sql import functions as F

from bindings.base import (
    Q_BATCH_ROWS, Q_ITEM_SKEMA, Q_POINTS, Q_PROPOSALS, Q_SECTION_ROWS, Q_WHOLE, documents, items, proposals, q_strip,
    q_tfidf, q_tokens, query, read, section_index, section_points, section_rows, q_words,
)
from kembar import runtime
from kembar.functions import text as t
from kembar.operators import cache, rows, tfidf
from kembar.schema import SECTIONS
from kembar.sources import batches
from kembar.sources.append_table import AppendTable
from kembar.sources import proposals as src

NAMES = ", ".join(SECTIONS)


@query("src_proposals", f"WITH {Q_PROPOSALS} SELECT doc_id, skema, {NAMES} FROM proposals")
def src_proposals(spark, sf):
    path = runtime.table_path(spark, "proposals-csv")
    src.write_proposals(proposals(spark, sf), path)
    return src.read_proposals(spark, path)


@query("src_metadata", "SELECT doc_id, source AS skema FROM documents")
def src_metadata(spark, sf):
    path = runtime.table_path(spark, "metadata-csv")
    src.write_metadata(proposals(spark, sf), path)
    return src.read_metadata(spark, path)


@query("sink_tfidf_index", f"""WITH {Q_SECTION_ROWS}, {q_tfidf('section_rows')}
    SELECT section, doc_id, skema, term, tf, round(w / norm, 6) AS w FROM dw JOIN dn USING (section, doc_id)""")
def sink_tfidf_index(spark, sf):
    path = runtime.table_path(spark, "saved-index")
    tfidf.save(section_index(spark, sf), path)
    stored = tfidf.load(spark, path)
    return stored.postings.select("section", "doc_id", "skema", "term", "tf", F.round("w", 6).alias("w"))


def vector_facts(df, *keys):
    """Sum and number of filled positions: what a hashed vector is checked by."""
    return df.select(
        *keys, F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("n_words"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("n_positions"),
    )


def q_vector_facts(keys, source):
    return f"""SELECT {keys}, len(toks)::double AS n_words,
      len(list_distinct(list_transform(toks, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint % 512))) AS n_positions
      FROM (SELECT {keys}, {q_tokens('text')} AS toks FROM {source})"""


@query("sink_vectors", f"""WITH {Q_PROPOSALS}, kept AS (
    SELECT doc_id, skema, ringkasan AS text FROM proposals WHERE {q_strip('ringkasan')} <> '')
    {q_vector_facts('doc_id, skema', 'kept')}""")
def sink_vectors(spark, sf):
    path = runtime.table_path(spark, "ringkasan-vectors")
    src.write_vectors(proposals(spark, sf), "ringkasan", path)
    return vector_facts(spark.read.parquet(path), "doc_id", "skema")


@query("vector_store_by_skema", f"""WITH {Q_POINTS}, facts AS ({q_vector_facts('skema, section', 'points')})
    SELECT skema, section, count(*) AS n_points, sum(n_words) AS n_words FROM facts GROUP BY ALL""")
def vector_store_by_skema(spark, sf):
    path = runtime.table_path(spark, "vector-store")
    src.write_vector_store(section_points(spark, sf).drop("point_id"), path)
    store = vector_facts(src.read_vector_store(spark, path), "skema", "section")
    return store.groupBy("skema", "section").agg(F.count("*").alias("n_points"), F.sum("n_words").alias("n_words"))


@query("upload_points", f"""WITH {Q_POINTS}
    SELECT row_number() OVER (ORDER BY doc_id, section_order) - 1 AS point_id, doc_id, skema, section,
      length(text) AS n_chars FROM points""")
def upload_points(spark, sf):
    return section_points(spark, sf).select(
        "point_id", "doc_id", "skema", "section", F.length("text").cast("bigint").alias("n_chars")
    )


def labelled(spark, sf):
    """Texts of labelled documents stand for those already encoded."""
    labels = read(spark, sf, "labels").select("doc_id")
    return documents(spark, sf).join(labels, "doc_id", "left_semi")


Q_CACHE = """texts AS (SELECT md5(text) AS text_md5, first(text) AS text FROM documents GROUP BY ALL),
    cached AS (SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query("embedding_cache_refresh", f"""WITH {Q_CACHE}, missing AS (SELECT * FROM texts WHERE text_md5 NOT IN (FROM cached))
    {q_vector_facts('text_md5', 'missing')}""")
def embedding_cache_refresh(spark, sf):
    stored = cache.distinct_texts(labelled(spark, sf)).select("text_md5")
    return vector_facts(cache.embedding_cache_refresh(documents(spark, sf), stored), "text_md5")


@query("embedding_cache_append", f"""WITH {Q_CACHE}, kept AS (SELECT * FROM texts WHERE {q_strip('text')} <> '')
    {q_vector_facts('text_md5', 'kept')}""")
def embedding_cache_append(spark, sf):
    """A stored cache, made from some texts, refreshed with all, and refreshed once more without effect."""
    stored = AppendTable(spark, runtime.table_path(spark, "embedding-cache"), cache.CACHE)
    for texts in (labelled(spark, sf), documents(spark, sf), documents(spark, sf)):
        vectors = cache.refresh_cache(texts, stored)
    return vector_facts(vectors, "text_md5")


@query("join_cache_miss", f"WITH {Q_CACHE} SELECT text_md5, text FROM texts WHERE text_md5 NOT IN (FROM cached)")
def join_cache_miss(spark, sf):
    return cache.cache_misses(documents(spark, sf), cache.distinct_texts(labelled(spark, sf)))


@query("join_cache_hit", f"""WITH {Q_CACHE}, found AS (SELECT * FROM texts WHERE text_md5 IN (FROM cached))
    {q_vector_facts('text_md5', 'found')}""")
def join_cache_hit(spark, sf):
    stored = cache.embedding_cache_refresh(
        labelled(spark, sf), spark.createDataFrame([], "text_md5 string, embedding array<float>")
    )
    return vector_facts(cache.cache_hits(documents(spark, sf), stored), "text_md5")


def elements(spark, sf):
    """Every passage as one element of a JSON batch: objects, wrapped objects, lists of texts, bare texts."""
    batch = items(spark, sf)
    as_object = F.to_json(F.struct("skema", *SECTIONS))
    shape = F.col("query_index") % 4
    element = (
        F.when(shape == 1, F.concat(F.lit("["), as_object, F.lit("]")))
        .when(shape == 2, F.to_json(F.array("judul")))
        .when(shape == 3, F.concat(F.lit('"item '), F.col("query_index").cast("string"), F.lit('"')))
        .otherwise(as_object)
    )
    return batch.select("query_index", element.alias("element"))


Q_ELEMENTS = ", ".join(f"CASE WHEN shape < 2 THEN {name} END AS {name}" for name in ("skema", *SECTIONS))


@query("parse_query_batch", f"""WITH {Q_BATCH_ROWS}
    SELECT query_index, {Q_ELEMENTS}, CASE shape WHEN 2 THEN 'Invalid list format: ' || to_json([judul])::varchar
      WHEN 3 THEN 'Expected dict but got str: "item ' || query_index || '"' END AS error
    FROM (SELECT *, query_index % 4 AS shape FROM items)""")
def parse_query_batch(spark, sf):
    good, bad = batches.parse_query_batch(elements(spark, sf))
    return good.unionByName(bad, allowMissingColumns=True)


@query("unpivot_sections", f"WITH {Q_SECTION_ROWS} SELECT doc_id, skema, section, text FROM section_rows")
def unpivot_sections(spark, sf):
    return section_rows(spark, sf)


@query("filter_min_chars", f"WITH {Q_POINTS} SELECT doc_id, section, text FROM points")
def filter_min_chars(spark, sf):
    return rows.filter_min_chars(section_rows(spark, sf)).drop("skema")


@query("filter_nonblank", f"""WITH {Q_SECTION_ROWS}
    SELECT doc_id, section, text FROM section_rows WHERE {q_strip('text')} <> ''""")
def filter_nonblank(spark, sf):
    return rows.filter_nonblank(section_rows(spark, sf)).drop("skema")


@query("filter_query_text", f"""WITH {Q_BATCH_ROWS}
    SELECT query_index, section, text FROM batch_rows WHERE length({q_strip('text')}) >= 3""")
def filter_query_text(spark, sf):
    from kembar.operators.summaries import batch_rows

    return rows.filter_query_text(batch_rows(items(spark, sf))).select("query_index", "section", "text")


@query("filter_section_skema", f"""WITH {Q_SECTION_ROWS}
    SELECT doc_id, text FROM section_rows WHERE section = 'metode' AND skema = 'src7'""")
def filter_section_skema(spark, sf):
    return rows.section_rows(proposals(spark, sf), "metode", "src7").select("doc_id", "text")


@query("fill_missing_text", f"""WITH {Q_SECTION_ROWS} SELECT doc_id, section, coalesce(text, '') AS text FROM section_rows""")
def fill_missing_text(spark, sf):
    return rows.fill_missing_text(section_rows(spark, sf)).drop("skema")


@query("project_match", """SELECT doc_id,
      CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview,
      substr(text, 1, 500) AS cut,
      CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS segment FROM documents""")
def project_match(spark, sf):
    df = documents(spark, sf).select("doc_id", F.col("text").alias("preview"), F.col("text").alias("cut"), F.col("text").alias("segment"))
    df = rows.project_match(df, "preview")
    return rows.project_match(rows.project_match(df, "cut", dots=False), "segment", 100)


COMMON = ", ".join(f"('{p}')" for p in rows.COMMON_QUERIES)


@query("sample_per_section", f"""WITH {Q_SECTION_ROWS}
    SELECT section, {q_strip('text')} AS text FROM (SELECT * FROM section_rows WHERE text IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY section ORDER BY doc_id) <= 10) WHERE {q_strip('text')} <> ''
    UNION ALL SELECT 'query', col0 FROM (VALUES {COMMON})""")
def sample_per_section(spark, sf):
    return rows.sample_per_section(section_rows(spark, sf))
