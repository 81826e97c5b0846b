"""Secret scans: a ledger of blobs by content, so that each text meets each version of a rule once."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kembar import runtime
from kembar.llm.words import per_batch, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; those whose `group` is shorter than `least` drop out.

    `hint` is a cheaper pattern that is found in every text with a match. A kind holds no colon.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

RULES = (
    Rule("assign", 1, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, f"(?:{_NAMES})[\"']?\\x20*[:=]"),
    Rule("access", 1, "AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, "[0-9a-f]+", 24, 0, "[0-9a-f]{24}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, "-----BEGIN "),
    Rule("hub", 1, "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 30),
)
BASE_KINDS = ("assign", "access", "hex")
#: A row of the table: a text's digest, the rules (kind:version) it has met in one scan, and what they found.
LEDGER = "blob binary, scanned array<string>, findings array<struct<rule:string,start:bigint,end:bigint>>"


def find_spans(rule: Rule, text: str) -> list[dict]:
    found = re.compile(rule.pattern).finditer(text)
    return [{"start": m.start(), "end": m.end()} for m in found if len(m[rule.group]) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    """A row of the ledger for each row of batches (blob, text, todo): findings of the rules that it still has to meet."""
    def run(batch: pa.RecordBatch) -> dict:
        texts, todo = batch.column("text"), batch.column("todo").to_pylist()
        hinted = [pc.match_substring_regex(texts, rule.hint or rule.pattern).to_pylist() for rule in rules]
        scanned, findings = [], []
        for i, kinds in enumerate(todo):
            due = [k for k, rule in enumerate(rules) if rule.kind in kinds]
            text = texts[i].as_py() if any(hinted[k][i] for k in due) else ""
            scanned.append([rules[k].name for k in due])
            findings.append([{"rule": rules[k].name} | span for k in due if hinted[k][i] for span in find_spans(rules[k], text)])
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"blob": batch.column("blob"), "scanned": pa.array(scanned, pa.list_(pa.string())), "findings": pa.array(findings, kind)}

    return run


class BlobLedger:
    """A table with a row for each text and scan of it, which keeps what every version of a rule found in that text.

    `scan` adds what is missing and returns the findings of all given versions of all paths. A run appends in one
    write, so one that fails leaves the ledger as it was, and the next one scans those texts again. Two runs at once
    may both append a text; its findings count once all the same.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def stored(self) -> DataFrame:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def rows(self) -> DataFrame:
        """(blob, kind, version, spans array<struct<start,end>>), one per text and version of a rule that have met."""
        each = self.stored().select("blob", "findings", F.explode("scanned").alias("rule"))
        spans = F.transform(F.filter("findings", lambda f: f["rule"] == F.col("rule")), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))
        return each.select(
            F.lower(F.hex("blob")).alias("blob"), F.substring_index("rule", ":", 1).alias("kind"),
            F.substring_index("rule", ":", -1).cast("int").alias("version"), spans.alias("spans"),
        ).dropDuplicates(["blob", "kind", "version"])

    def unseen(self, blobs: DataFrame) -> DataFrame:
        """Adds `todo` to rows with a blob (digest, or its hexadecimal form): the kinds of the rules in force it has not met;
        rows without any are left out."""
        key = F.unhex("blob") if blobs.schema["blob"].dataType == T.StringType() else F.col("blob")
        # Scans differ by the rules of their time, so a blob has few distinct sets of them.
        seen = self.stored().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen")).withColumnRenamed("blob", "seen_blob")
        missing = F.array_except(F.array(*(F.lit(r.name) for r in self.rules)), F.coalesce("seen", F.array().cast("array<string>")))
        todo = F.transform(missing, lambda rule: F.substring_index(rule, ":", 1))
        return blobs.join(seen, key == F.col("seen_blob"), "left").withColumn("todo", todo).drop("seen", "seen_blob").where(F.size("todo") > 0)

    def scan(self, versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(path_col, blob, findings array<struct<start, kind_order, kind, end>>) for every row of `versions`.

        A text's blob is the SHA-256 of its bytes. One row stands for all rows with the same blob and is scanned;
        texts move once, by path, and only rows that are to be scanned get to Python. Findings then join back by blob:
        hot blobs are rows of plain ids there, which adaptive execution splits. Null texts count as empty; a path may
        have several versions, rows may repeat; null paths are paths. No rows: no rows.
        """
        digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
        own = versions.select(F.col(path_col).alias("path"), digest.alias("blob"), text_or_empty(text_col).alias("text"))
        found = runtime.written(own.select("path", "blob"), "blobs")
        chosen = found.groupBy("blob").agg(F.min("path").alias("path"))
        todo = self.unseen(chosen)
        texts = own.join(todo.withColumnRenamed("blob", "todo_blob").withColumnRenamed("path", "todo_path"),
                         F.col("path").eqNullSafe(F.col("todo_path")) & (F.col("blob") == F.col("todo_blob")))
        scanned = per_batch(texts.select("blob", "text", "todo"), _scan(self.rules), LEDGER)
        # Rows that agree in path and text were scanned each; one row per blob goes into the ledger.
        scanned.dropDuplicates(["blob"]).write.mode("append").parquet(self.path)
        names = [r.name for r in self.rules]
        hits = self.stored().where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).where(F.col("f.rule").isin(names))
        order = F.expr("case f.rule " + " ".join(f"when '{name}' then {i}" for i, name in enumerate(names)) + " end")
        finding = F.struct("f.start", order.alias("kind_order"), F.substring_index("f.rule", ":", 1).alias("kind"), "f.end")
        per_blob = hits.groupBy("blob").agg(F.array_sort(F.collect_set(finding)).alias("findings"))
        per_blob = per_blob.withColumnRenamed("blob", "hit_blob")
        return found.join(per_blob, F.col("blob") == F.col("hit_blob"), "left").select(F.col("path").alias(path_col), F.lower(F.hex("blob")).alias("blob"), "findings")
