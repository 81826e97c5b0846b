"""Registry, table bindings, and the SQL pieces the checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions.lists import ACADEMIC_PHRASES, PREFIXES, PUNCTUATION, STOP_WORDS, SUFFIXES
from kembar.functions.text import SPACE, URL_START, WORD
from kembar.operators import tfidf
from kembar.operators.rows import unpivot_sections
from kembar.schema import SECTIONS
from kembar.sources.proposals import sections_from_lines, upload_points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# ---------------------------------------------------------------- tables

def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark, sf) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", F.col("source").alias("skema"), "text")
    return runtime.spread(rows, "doc_id")


def proposals(spark, sf) -> DataFrame:
    return sections_from_lines(documents(spark, sf), "text", ["doc_id", "skema"])


def section_rows(spark, sf) -> DataFrame:
    return unpivot_sections(proposals(spark, sf))


def whole_rows(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", "skema", F.lit("text").alias("section"), "text")


def item_skema():
    """Every third passage asks for one category; the others search all."""
    return F.when(F.col("query_index") % 3 == 0, F.concat(F.lit("src"), (F.col("query_index") % 20).cast("string")))


def items(spark, sf) -> DataFrame:
    rows = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_index"), "text")
    return sections_from_lines(rows.withColumn("skema", item_skema()), "text", ["query_index", "skema"])


def passages(spark, sf) -> DataFrame:
    rows = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rows.select("query_id", F.lit("text").alias("section"), F.lit(None).cast("string").alias("skema"), "text")


def text_pairs(spark, sf) -> DataFrame:
    """Each document's odd lines and its even lines as a pair of texts, so that the whole text is read."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def every_other(first: int):
        return F.array_join(F.filter(lines, lambda x, i: i % 2 == first), "\n")

    return documents(spark, sf).select("doc_id", every_other(0).alias("a"), every_other(1).alias("b"))


def vectors(spark, sf) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("skema"), F.lit("text").alias("section"),
        "embedding",
    )
    return runtime.spread(rows, "doc_id")


def centroids(spark, sf) -> DataFrame:
    """The mean vector of each label, as a query."""
    cells = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = cells.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda c: c["m"])
    return means.groupBy("label").agg(ordered.alias("embedding")).select(
        F.col("label").cast("bigint").alias("query_id"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast("string").alias("skema"), "embedding",
    )


_built: dict[tuple, object] = {}


def once(spark, sf, what: str, build):
    """Indexes and points are tables: built once per session and folder, then read by every search."""
    key = (spark.sparkContext.applicationId, runtime.releases(spark), sf, what)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def text_index(spark, sf) -> tfidf.TfidfIndex:
    return once(spark, sf, "text-index", lambda: tfidf.fit(whole_rows(spark, sf)))


def section_index(spark, sf) -> tfidf.TfidfIndex:
    return once(spark, sf, "section-index", lambda: tfidf.fit(section_rows(spark, sf)))


def section_points(spark, sf) -> DataFrame:
    return once(spark, sf, "section-points", lambda: upload_points(proposals(spark, sf)))


def whole_points(spark, sf) -> DataFrame:
    def build():
        return upload_points(documents(spark, sf), sections=("text",))

    return once(spark, sf, "whole-points", build)


# ---------------------------------------------------------------- SQL

def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def q_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def q_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def q_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACE}]+'), lambda w: w <> '')"


def q_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SPACE}]+'))"


def q_noise(x: str) -> str:
    bare = f"regexp_replace(lower(coalesce({x}, '')), '{URL_START}[^{SPACE}]+', '', 'g')"
    bare = f"regexp_replace({bare}, '\\p{{Nd}}+', '', 'g')"
    return q_strip(f"regexp_replace({bare}, '[^{WORD}{SPACE}]', '', 'g')")


def q_stem(w: str) -> str:
    bare = f"regexp_replace({w}, '^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$', '\\1')"
    return f"regexp_replace({bare}, '^(?:{'|'.join(PREFIXES)})(.{{3,}})$', '\\1')"


def q_unstopped(words: str) -> str:
    return f"list_filter({words}, lambda w: w NOT IN ({quoted(STOP_WORDS)}))"


def q_academic(x: str) -> str:
    return f"array_to_string(list_transform({q_unstopped(q_words(q_noise(x)))}, lambda w: {q_stem('w')}), ' ')"


def q_spacing(x: str) -> str:
    bare = q_collapse(f"lower(coalesce({x}, ''))")
    return q_collapse(f"regexp_replace({bare}, '[^{WORD}{SPACE}]', ' ', 'g')")


def q_lexical(x: str) -> str:
    signs = PUNCTUATION.replace("'", "''")
    return q_collapse(f"translate(lower(coalesce({x}, '')), '{signs}', '')")


def q_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split({q_collapse(x)}, '.'), lambda s: trim(s)), lambda s: s <> '')"


def q_dedupe(table: str, key: str) -> str:
    """Query giving (key, text) with sentences once each, in order of first appearance."""
    sentences = f"SELECT {key}, unnest(s) AS v, generate_subscripts(s, 1) AS i FROM (SELECT {key}, {q_sentences('text')} AS s FROM {table})"
    first = f"SELECT {key}, v, min(i) AS i FROM ({sentences}) GROUP BY ALL"
    joined = f"SELECT {key}, string_agg(v, '. ' ORDER BY i) AS text FROM ({first}) GROUP BY ALL"
    return f"SELECT {key}, coalesce(j.text, '') AS text FROM {table} LEFT JOIN ({joined}) j USING ({key})"


def q_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[{WORD}]+')"


def q_ngrams(tokens: str) -> str:
    """Distinct 3-grams of a token list that is a column."""
    return (
        f"list_distinct(list_transform(range(1, len({tokens}) - 1), "
        f"lambda i: {tokens}[i] || ' ' || {tokens}[i + 1] || ' ' || {tokens}[i + 2]))"
    )


def q_jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared} / (len({a}) + len({b}) - {shared}) ELSE 0.0 END"


def q_overlap(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 "
        f"THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0.0 END"
    )


def q_bucket(term: str, dim: int = 512) -> str:
    return f"('0x' || substr(md5({term}), 1, 8))::bigint % {dim}"


def q_phrase_share(a: str, b: str, phrases=ACADEMIC_PHRASES) -> str:
    both = " + ".join(f"(contains(lower({a}), '{p}') AND contains(lower({b}), '{p}'))::int" for p in phrases)
    return f"({both}) / {float(len(phrases))}"


LINES = "string_split(text, chr(10))"


def _section_columns() -> str:
    named = [f"l[{i + 1}] AS {name}" for i, name in enumerate(SECTIONS[:-1])]
    named.append(f"CASE WHEN len(l) >= {len(SECTIONS)} THEN array_to_string(l[{len(SECTIONS)}:], chr(10)) END AS {SECTIONS[-1]}")
    return ", ".join(named)


Q_PROPOSALS = f"proposals AS (SELECT doc_id, skema, {_section_columns()} FROM (SELECT doc_id, source AS skema, {LINES} AS l FROM documents))"

Q_ITEM_SKEMA = "CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 20) END"

Q_ITEMS = f"items AS (SELECT query_index, skema, {_section_columns()} FROM (SELECT item_id AS query_index, {Q_ITEM_SKEMA} AS skema, {LINES} AS l FROM benchmark))"


def q_unpivot(table: str, ids: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{name}' AS section, {i + 1} AS section_order, {name} AS text FROM {table}"
        for i, name in enumerate(SECTIONS)
    )


Q_SECTION_ROWS = f"{Q_PROPOSALS}, section_rows AS ({q_unpivot('proposals', 'doc_id, skema')})"
Q_BATCH_ROWS = f"{Q_ITEMS}, batch_rows AS (SELECT * FROM ({q_unpivot('items', 'query_index, skema')}) WHERE coalesce(text, '') <> '')"
_OTHER_LINES = "array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: i % 2 = {}), chr(10))"
Q_PAIRS = f"{Q_PROPOSALS}, pairs AS (SELECT doc_id, {_OTHER_LINES.format(1)} AS a, {_OTHER_LINES.format(0)} AS b FROM documents)"
Q_POINTS = f"{Q_SECTION_ROWS}, points AS (SELECT * FROM section_rows WHERE length({q_strip('text')}) > 10)"
Q_WHOLE_POINTS = f"points AS (SELECT doc_id, source AS skema, 'text' AS section, 0 AS section_order, text FROM documents WHERE length({q_strip('text')}) > 10)"


def q_terms(name: str, source: str, keys: str) -> str:
    return f"""{name} AS MATERIALIZED (
      SELECT {keys}, term, count(*) AS tf FROM (
        SELECT {keys}, {q_stem('w')} AS term FROM (
          SELECT {keys}, unnest({q_words(q_noise('text'))}) AS w FROM {source}) WHERE w NOT IN ({quoted(STOP_WORDS)}))
      WHERE length(term) >= 2 GROUP BY ALL)"""


def q_tfidf(corpus: str, queries: str | None = None) -> str:
    """CTEs ct, idf, dw, dn of a corpus (section, doc_id, skema, text), and sc: its cosine with queries."""
    sql = f"""{q_terms('ct', corpus, 'section, doc_id, skema')},
    sizes AS (SELECT section, count(*) AS n FROM {corpus} GROUP BY section),
    idf AS MATERIALIZED (SELECT section, term, df, ln((1 + n) / (1 + df)) + 1 AS idf
      FROM (SELECT section, term, count(*) AS df FROM ct GROUP BY ALL) JOIN sizes USING (section)),
    dw AS MATERIALIZED (SELECT section, doc_id, skema, term, tf, tf * idf AS w FROM ct JOIN idf USING (section, term)),
    dn AS MATERIALIZED (SELECT section, doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY ALL)"""
    if queries is None:
        return sql
    return f"""{sql}, {q_terms('qt', queries, 'query_id, section, skema')},
    qw AS MATERIALIZED (SELECT query_id, section, skema, term, df, tf * idf AS w FROM qt JOIN idf USING (section, term)),
    qn AS (SELECT query_id, section, sqrt(sum(w * w)) AS norm FROM qw GROUP BY ALL),
    sc AS MATERIALIZED (SELECT query_id, section, doc_id, skema, dot / (dn.norm * qn.norm) AS score FROM (
        SELECT qw.query_id, dw.section, dw.doc_id, dw.skema, sum(dw.w * qw.w) AS dot
        FROM dw JOIN qw ON dw.section = qw.section AND dw.term = qw.term AND (qw.skema IS NULL OR qw.skema = dw.skema)
        GROUP BY ALL) JOIN dn USING (section, doc_id) JOIN qn USING (query_id, section))"""


def q_hits(k: int, cutoff: float = 0.1) -> str:
    """CTE hits: the top k of sc per query and section."""
    return f"""hits AS MATERIALIZED (SELECT query_id, section, doc_id, skema, round(score, 6) AS similarity_score,
        (row_number() OVER (PARTITION BY query_id, section ORDER BY round(score, 6) DESC, doc_id))::int AS rank
      FROM sc WHERE score >= {cutoff} QUALIFY rank <= {k})"""


Q_WHOLE = "corpus AS (SELECT doc_id, source AS skema, 'text' AS section, text FROM documents)"
Q_PASSAGES = "passages AS (SELECT item_id AS query_id, 'text' AS section, NULL::varchar AS skema, text FROM benchmark)"


def q_bags(name: str, source: str, keys: str, text: str = "text") -> str:
    """Hashed word counts of texts."""
    return f"""{name} AS MATERIALIZED (SELECT {keys}, {q_bucket('tok')} AS b, count(*)::double AS c
      FROM (SELECT {keys}, unnest({q_tokens(text)}) AS tok FROM {source}) GROUP BY ALL)"""


def q_dense(points: str, queries: str, section_equal: bool, k: int, cutoff: str = "score > -2") -> str:
    """CTE near: hashed-vector top k of `points` per query (query_id, section, skema, text); zero vectors score 0."""
    on_section = "AND p.section = q.section" if section_equal else ""
    return f"""pt AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM {points}),
    {q_bags('pb', 'pt', 'pid')}, {q_bags('qb', queries, 'query_id')},
    pn AS (SELECT pid, sqrt(sum(c * c)) AS norm FROM pb GROUP BY pid),
    qn2 AS (SELECT query_id, sqrt(sum(c * c)) AS norm FROM qb GROUP BY query_id),
    dots AS (SELECT query_id, pid, sum(pb.c * qb.c) AS dot FROM pb JOIN qb USING (b) GROUP BY ALL),
    near AS MATERIALIZED (SELECT q.query_id, p.doc_id, p.skema, p.section, p.section_order,
        coalesce(dot / (pn.norm * qn2.norm), 0.0) AS score, round(score, 6) AS similarity_score,
        (row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(dot / (pn.norm * qn2.norm), 0.0), 6) DESC,
          p.section_order, p.doc_id))::int AS rank
      FROM pt p JOIN {queries} q ON (q.skema IS NULL OR q.skema = p.skema) {on_section}
      LEFT JOIN dots ON dots.query_id = q.query_id AND dots.pid = p.pid
      LEFT JOIN pn ON pn.pid = p.pid LEFT JOIN qn2 ON qn2.query_id = q.query_id
      WHERE {cutoff} QUALIFY rank <= {k})"""


Q_CENTROIDS = """cells AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    centroids AS (SELECT label AS query_id, list(m ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS m FROM cells GROUP BY ALL) GROUP BY label)"""
