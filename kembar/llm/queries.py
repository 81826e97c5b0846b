"""Registers the operators of this package on the given tables; SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kembar import runtime
from kembar.llm import (
    conversations, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality, repeats, secrets, toxicity, url_filter, warc,
    whitening,
)
from kembar.llm.words import UPPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def spans_text(findings, kinds=None):
    """kind:start:end of findings in order, comma-joined."""
    kept = F.filter(findings, lambda x: x["kind"].isin(*kinds)) if kinds else findings
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Names the folder of a ledger that outlives the session; without it, each run starts with an empty one.
LEDGER_SETTING = "kembar.blobLedger"


@query("op1_secrets")
def op1(spark, sf):
    ledger = secrets.BlobLedger(spark, spark.conf.get(LEDGER_SETTING, None) or runtime.table_path(spark, "blob-ledger"))
    found = ledger.scan(documents(spark, sf))
    findings = F.coalesce("findings", F.array().cast(found.schema["findings"].dataType))

    def of(kind):
        return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(of, secrets.BASE_KINDS),
        F.sha2(spans_text(findings, secrets.BASE_KINDS), 256).alias("base_sha256"), spans_text(findings).alias("spans"),
    )


_NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


@query("op5_mix")
def op5(spark, sf):
    return mixing.mix_documents(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_exact_dedup", f"""
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
      text_sha256 FROM (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents)
    WINDOW w AS (PARTITION BY text_sha256)""")
def op6(spark, sf):
    return exact_dedup.exact_groups(documents(spark, sf)).drop("uid")


def _shingles(words: str) -> str:
    """Distinct five-word shingles of a list of words; fewer words are one shingle."""
    return f"list_distinct(list_transform(range(1, greatest(len({words}) - 4, 1) + 1), lambda i: array_to_string({words}[i:i + 4], ' ')))"


_LINES = "string_split(coalesce(text, ''), chr(10))"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


@query("op2_line_dedup", f"""
    WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no FROM (SELECT doc_id, {_LINES} AS l FROM documents)),
    w AS (SELECT doc_id, no, {_WORDS.format(f"translate(line, '{UPPER}', '{UPPER.lower()}')")} AS w FROM lines),
    s AS (SELECT doc_id, no, {_shingles("w")} AS t FROM w WHERE len(w) > 0),
    tok AS (SELECT doc_id, no, len(t) AS n, unnest(t) AS k FROM s),
    pairs AS (SELECT a.doc_id, a.no, a.n AS n, b.n AS m, count(*) AS c FROM tok a
      JOIN tok b ON a.k = b.k AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.no < a.no)) GROUP BY a.doc_id, a.no, a.n, b.doc_id, b.no, b.n),
    gone AS (SELECT doc_id, count(*) AS n_removed, string_agg(no, ',' ORDER BY no) AS removed_lines
      FROM (SELECT DISTINCT doc_id, no FROM pairs WHERE 4 * c >= 3 * (n + m - c)) GROUP BY doc_id)
    SELECT doc_id, len({_LINES})::bigint AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
    FROM documents LEFT JOIN gone USING (doc_id)""")
def op2(spark, sf):
    return line_dedup.line_counts(documents(spark, sf))


@query("op3_pack")
def op3(spark, sf):
    pieces = packing.token_pieces(documents(spark, sf))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


@query("op4_toxicity")
def op4(spark, sf):
    docs = documents(spark, sf)
    model = toxicity.fit_toxicity(docs, labels(spark, sf).select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    score = F.col("toxic_score")
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query("op7_jaccard_join", f"""
    WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) > 0 THEN {_shingles("w")} ELSE [] END AS t
      FROM (SELECT doc_id, {_WORDS.format(_NORMAL)} AS w FROM documents)),
    tok AS MATERIALIZED (SELECT doc_id, len(t) AS n, unnest(t) AS k FROM s),
    links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS c
      FROM tok x JOIN tok y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) WHERE 100 * c >= 75 * (n + m - c)),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT doc_id, len(t)::bigint AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""")
def op7(spark, sf):
    return jaccard_join.jaccard_classes(documents(spark, sf))


@query("op8_url_filter")
def op8(spark, sf):
    return url_filter.url_filter(spark.read.parquet(f"{sf}/pages.parquet"))


@query("op9_quality")
def op9(spark, sf):
    judged = quality.quality_rules(documents(spark, sf), labels(spark, sf).select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query("op10_repeats")
def op10(spark, sf):
    stripped = repeats.repeated_bytes(documents(spark, sf))
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_warc", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM p)
    SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest,
      CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to FROM o""")
def op11(spark, sf):
    pages = runtime.spread(spark.read.parquet(f"{sf}/pages.parquet"))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.with_originals(pages), folder)
    read = warc.read_records(index, folder, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_whitening")
def op12(spark, sf):
    whitened = whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return whitened.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op13_conversations")
def op13(spark, sf):
    rows = runtime.spread(spark.read.parquet(f"{sf}/conversations.parquet"))
    return conversations.repair_conversations(conversations.damage(rows))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
