"""Sentences of documents that are like sentences of queries by edit ratio, without comparing all of them.

If two texts are within so many edits of each other, and one of them is cut into one piece more, then a piece stands
unchanged in the other, not far from its place. Pieces are cut by bands of length, so that both sides know where they lie.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.functions.lcs import indel_ratios
from kembar.operators.passages import sentence_rows

#: Query sentences whose pieces travel with a task, by the number of pieces.
PIECES = 500_000
PAIRS = 20_000
#: Classes of letters that are counted to tell pairs apart before they are measured.
LETTERS = 64
_MATCH = "query_md5 string, sentence_md5 string, ratio double"


class Bands:
    """Bands of length for a least ratio: in each, every text is cut into equally many pieces of equal length."""

    def __init__(self, ratio: float):
        if not 2 / 3 < ratio <= 1:
            raise ValueError("a ratio above 2/3 and up to 1 is needed: below, pieces are empty")
        self.ratio = ratio
        self.growth = 1 + max(0.02, (1 - ratio) / 2)

    def span(self, length: int) -> tuple[int, int]:
        """Least and greatest length of a text that can reach the ratio with one of `length`."""
        return math.ceil(length * self.ratio / (2 - self.ratio) - 1e-9), math.floor(length * (2 - self.ratio) / self.ratio + 1e-9)

    def edits(self, a: int, b: int) -> int:
        """The most edits that two texts of these lengths may be apart."""
        return math.floor((1 - self.ratio) * (a + b) + 1e-9)

    def number(self, length: int) -> int:
        band = int(math.log(length) / math.log(self.growth))
        while self.low(band + 1) <= length:
            band += 1
        while self.low(band) > length:
            band -= 1
        return band

    def low(self, band: int) -> int:
        return math.ceil(self.growth ** band)

    def pieces(self, band: int) -> tuple[int, int]:
        """How many pieces, and how long each."""
        high = max(self.low(band), self.low(band + 1) - 1)
        many = self.edits(high, self.span(high)[1]) + 1
        return many, max(1, self.low(band) // many)

    def of(self, text: str) -> list[tuple[int, int, str]]:
        """(band, number, piece) of an indexed text. Where pieces would be empty, all texts of a band share one mark."""
        band = self.number(len(text))
        many, size = self.pieces(band)
        if many > self.low(band):
            return [(band, -1, "")]
        return [(band, at, text[at * size:at * size + size]) for at in range(many)]

    def sought(self, text: str) -> set[tuple[int, int, str]]:
        """Every (band, number, piece) that a text within the ratio of this one may have unchanged."""
        length = len(text)
        least, most = self.span(length)
        found = set()
        for band in range(self.number(max(1, least)), self.number(most) + 1):
            many, size = self.pieces(band)
            low, high = max(least, self.low(band)), min(most, self.low(band + 1) - 1)
            if low > high:
                continue
            if many > self.low(band):
                found.add((band, -1, ""))
                continue
            # Of d edits, those that add and those that take away differ by the difference of lengths.
            back = max((self.edits(length, n) + n - length) // 2 for n in (low, high))
            ahead = max((self.edits(length, n) + length - n) // 2 for n in (low, high))
            for at in range(many):
                start = at * size
                for place in range(max(0, start - back), min(length - size, start + ahead) + 1):
                    found.add((band, at, text[place:place + size]))
        return found


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has the letters of each of LETTERS classes."""
    lengths = np.array([len(text) for text in texts], np.int64)
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS
    cells = np.repeat(np.arange(len(texts)), lengths) * LETTERS + signs
    return np.bincount(cells, minlength=len(texts) * LETTERS).reshape(len(texts), LETTERS).astype(np.int32)


class Sought:
    """The pieces of a block of query sentences, made once for all batches of a task."""

    def __init__(self, bands: Bands, asked: list[tuple[str, str]]):
        self.bands, self.asked = bands, asked
        self.sizes = [len(text) for _, text in asked]
        self.lengths = np.array(self.sizes, np.int64)
        self.letters = letter_counts([text for _, text in asked])
        self.holders = defaultdict(list)
        for number, (_, text) in enumerate(asked):
            for piece in bands.sought(text):
                self.holders[hash(piece)].append(number)

    def candidates(self, text: str) -> list[int]:
        """Query sentences that share a piece with the text and are not too long or short for it."""
        found: set[int] = set()
        for piece in self.bands.of(text):
            found.update(self.holders.get(hash(piece), ()))
        least, most = self.bands.span(len(text))
        return [q for q in found if least <= self.sizes[q] <= most]


def edit_matches(sought: Sought, sentences: list[str], pairs: int = PAIRS):
    """(query number, sentence number, ratio) of all pairs that reach the ratio.

    Of the candidates by pieces, those that share too few letters in any order are dropped before the subsequences are
    measured: no subsequence is longer than the letters that both have.
    """
    letters, ratio = letter_counts(sentences), sought.bands.ratio - 1e-12
    lengths = np.array([len(text) for text in sentences], np.int64)
    work: list[tuple[int, int]] = []

    def settled():
        if not work:
            return []
        query, stored = np.array(work, np.int64).T
        shared = np.minimum(sought.letters[query], letters[stored]).sum(axis=1)
        likely = np.flatnonzero(2.0 * shared >= ratio * (sought.lengths[query] + lengths[stored]))
        work.clear()
        query, stored = query[likely].tolist(), stored[likely].tolist()
        ratios = indel_ratios([sought.asked[q][1] for q in query], [sentences[s] for s in stored])
        return [(q, s, float(r)) for q, s, r in zip(query, stored, ratios, strict=True) if r >= ratio]

    for number, text in enumerate(sentences):
        work.extend((q, number) for q in sought.candidates(text))
        if len(work) >= pairs:
            yield from settled()
    yield from settled()


def _asked_blocks(asked: DataFrame, bands: Bands, pieces: int):
    """Query sentences in lists whose pieces fit a task, read one after the other."""
    cost = F.col("length") * F.col("length") * F.lit((1 - bands.ratio) * 2 + 0.05)
    total = asked.agg(F.sum(cost)).first()[0] or 0
    parts = int(total // pieces) + 1
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("sentence_md5"), F.lit(parts)) == part)
        table = mine.select("sentence_md5", "sentence").toArrow()
        if len(table):
            yield list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def similar_sentences(
    queries: DataFrame, documents: DataFrame, ratio: float = 0.9, min_chars: int = 20, pieces: int = PIECES
) -> DataFrame:
    """All pairs of a query sentence and a document sentence whose edit ratio is `ratio` or more, each text once.

    Returns query_md5, sentence_md5 (of the lower-cased sentences, see `sentence_rows`), ratio, n_queries and n_documents that
    hold them; equal sentences fold before anything is compared, so copies cost nothing. Letters count as lower case.
    Sentences of fewer than `min_chars` characters are left out. Query sentences travel with the tasks in blocks;
    document sentences are scanned in place, so a piece that very many of them share is no hot key.
    """
    bands = Bands(ratio)

    def distinct(df, key, name):
        rows = sentence_rows(df, [key]).select(key, F.lower("sentence").alias("sentence"), "sentence_md5")
        rows = rows.where(F.length("sentence") >= min_chars)
        once = rows.groupBy("sentence_md5", key).agg(F.first("sentence").alias("sentence"))
        return once.groupBy("sentence_md5").agg(F.first("sentence").alias("sentence"), F.count("*").alias(name))

    asked = runtime.written(distinct(queries, "query_id", "n_queries").withColumn("length", F.length("sentence")), "asked-sentences")
    stored = runtime.written(distinct(documents, "doc_id", "n_documents"), "stored-sentences")
    low, high = asked.agg(F.min("length"), F.max("length")).first()
    parts = []
    if low is not None:
        least, most = bands.span(low)[0], bands.span(high)[1]
        likely = runtime.spread(stored.where(F.length("sentence").between(least, most)).select("sentence_md5", "sentence"))
        for block in _asked_blocks(asked, bands, pieces):
            parts.append(runtime.written(likely.mapInArrow(_matcher(bands, block), _MATCH), "similar-sentences"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"{_MATCH}, n_queries bigint, n_documents bigint")
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.join(asked.select(F.col("sentence_md5").alias("query_md5"), "n_queries"), "query_md5")
    return pairs.join(stored.select("sentence_md5", "n_documents"), "sentence_md5").select(
        "query_md5", "sentence_md5", F.round("ratio", 6).alias("ratio"), "n_queries", "n_documents"
    )


def _matcher(bands: Bands, block: list[tuple[str, str]]):
    def run(batches):
        sought = Sought(bands, block)
        for batch in batches:
            keys, texts = batch.column("sentence_md5").to_pylist(), batch.column("sentence").to_pylist()
            found = list(edit_matches(sought, texts))
            yield pa.RecordBatch.from_pydict({
                "query_md5": pa.array([block[q][0] for q, _, _ in found], pa.string()),
                "sentence_md5": pa.array([keys[s] for _, s, _ in found], pa.string()),
                "ratio": pa.array(np.array([r for *_, r in found], dtype=np.float64)),
            })

    return run
