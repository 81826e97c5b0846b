"""Parts of query texts that a document holds character for character, wherever and in whichever order.

Texts are fingerprinted by winnowing: of every window of neighbouring grams the one with the least hash is kept, so two texts
that share a run of `least` characters share a kept gram inside it. Each shared gram is a seed; on its diagonal it grows in
both directions as far as the texts agree. Queries travel with the tasks in blocks and documents are scanned in place, so a
gram that very many documents hold is no key of any shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions import text as t

#: Characters of queries that travel at once; their fingerprints take some eight bytes each.
BLOCK_CHARS = 8_000_000
#: Grams whose windows are looked at together.
STRETCH = 100_000
_SPANS = "query_id bigint, doc_id bigint, query_start int, query_end int, doc_start int"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def comparable(text: Column) -> Column:
    """Lower case with single blanks: the form whose characters are counted."""
    return t.collapse(F.lower(F.coalesce(text, F.lit(""))))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(signs: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` signs."""
    many = len(signs) - gram + 1
    if many <= 0:
        return np.zeros(0, np.uint64)
    wide = signs.astype(np.uint64)
    total = np.zeros(many, np.uint64)
    for at in range(gram):
        total = total * _FACTOR + wide[at:at + many] + np.uint64(1)
    total ^= total >> np.uint64(29)
    total *= _FACTOR
    return total ^ (total >> np.uint64(32))


def fingerprints(signs: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the least gram of each window of least - gram + 1 grams, each place once."""
    hashes = gram_hashes(signs, gram)
    window = least - gram + 1
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = []
    for start in range(0, len(hashes) - window + 1, STRETCH):
        part = hashes[start:start + STRETCH + window - 1]
        views = np.lib.stride_tricks.sliding_window_view(part, window)
        kept.append(np.unique(views.argmin(axis=1) + np.arange(len(views))) + start)
    places = np.unique(np.concatenate(kept))
    return hashes[places], places


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many signs two arrays agree in from their start."""
    most, done, step = min(len(a), len(b)), 0, 64
    while done < most:
        end = min(most, done + step)
        differs = np.flatnonzero(a[done:end] != b[done:end])
        if len(differs):
            return done + int(differs[0])
        done, step = end, step * 4
    return most


def grown(query: np.ndarray, document: np.ndarray, seeds: np.ndarray, gram: int, least: int) -> list[tuple[int, int, int]]:
    """(query start, query end, document start) of the runs that seeds (query place, document place) lie in.

    Of runs within a longer run of the query only the longer one stays, and of equal ones the first in the document.
    """
    diagonal = seeds[:, 0] - seeds[:, 1]
    order = np.lexsort((seeds[:, 0], diagonal))
    found: dict[tuple[int, int], int] = {}
    last, end = None, -1
    for at in order:
        q, d = int(seeds[at, 0]), int(seeds[at, 1])
        if diagonal[at] == last and q < end:
            continue
        last = diagonal[at]
        ahead = _agreeing(query[q:], document[d:])
        if ahead < gram:  # equal hashes of unequal grams
            end = q
            continue
        back = _agreeing(query[:q][::-1], document[:d][::-1])
        start, end = q - back, q + ahead
        if end - start >= least:
            place = found.get((start, end))
            found[start, end] = d - back if place is None else min(place, d - back)
    spans, reach = [], -1
    for start, stop in sorted(found, key=lambda s: (s[0], -s[1])):
        if stop > reach:
            spans.append((start, stop, found[start, stop]))
            reach = stop
    return spans


class _Asked:
    """Fingerprints of a block of queries, in order of hash."""

    def __init__(self, ids: list[int], texts: list[str], least: int, gram: int):
        self.ids, self.texts = ids, [codes(text) for text in texts]
        made = [fingerprints(signs, least, gram) for signs in self.texts]
        hashes = np.concatenate([h for h, _ in made]) if made else np.zeros(0, np.uint64)
        owners = np.repeat(np.arange(len(made)), [len(h) for h, _ in made])
        places = np.concatenate([p for _, p in made]) if made else np.zeros(0, np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.places = hashes[order], owners[order], places[order]

    def seeds(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners, and (query place, document place), of all pairs of equal hashes."""
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        many = high - low
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return self.owners[rows], np.stack([self.places[rows], np.repeat(places, many)], axis=1)


def _finder(ids: list[int], texts: list[str], least: int, gram: int):
    def run(batches):
        asked = _Asked(ids, texts, least, gram)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                signs = codes(text)
                owners, seeds = asked.seeds(*fingerprints(signs, least, gram))
                for owner in np.unique(owners):
                    spans = grown(asked.texts[owner], signs, seeds[owners == owner], gram, least)
                    out += [(asked.ids[owner], doc, *span) for span in spans]
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _SPANS.split(", ")])

    return run


def matched_spans(
    queries: DataFrame, documents: DataFrame, least: int = 40, gram: int = 16, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Maximal spans of `least` or more characters of each query that a document holds too.

    Returns query_id, doc_id, query_start and query_end (end exclusive) and doc_start, the first place in the document; all
    count characters of the `comparable` texts. A span lies within no longer span of the same query and document. Missing
    and short texts have none. Rows are one per span, at most one per character of the query for each document.
    """
    if not 0 < gram <= least:
        raise ValueError("grams must not be longer than the spans that are looked for")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), comparable(F.col("text")).alias("text"))
    asked = runtime.written(asked.where(F.length("text") >= least), "asked-texts")
    stored = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), comparable(F.col("text")).alias("text"))
    stored = stored.where(F.length("text") >= least)
    parts = (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    found = []
    for part in range(parts):
        block = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(parts)) == part)
        table = block.toArrow()
        if len(table):
            spans = stored.mapInArrow(_finder(table.column(0).to_pylist(), table.column(1).to_pylist(), least, gram), _SPANS)
            found.append(spans if parts == 1 else runtime.written(spans, "matched-spans"))
    if not found:
        return documents.sparkSession.createDataFrame([], _SPANS)
    whole = found[0]
    for spans in found[1:]:
        whole = whole.unionByName(spans)
    return whole


def span_coverage(spans: DataFrame, keys=("query_id", "doc_id")) -> DataFrame:
    """Characters of each query that spans cover, overlaps once, and how many spans there are."""
    from pyspark.sql.window import Window

    # Spans lie in no longer one, so in order of start they are in order of end too.
    in_order = Window.partitionBy(*keys).orderBy("query_start")
    fresh = F.greatest("query_start", F.coalesce(F.lag("query_end").over(in_order), F.lit(0)))
    return spans.withColumn("fresh", F.col("query_end") - fresh).groupBy(*keys).agg(
        F.sum("fresh").alias("matched_chars"), F.count("*").alias("n_spans")
    )
