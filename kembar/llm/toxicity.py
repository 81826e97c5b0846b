"""Toxicity by compression distance: a zstandard dictionary of ordinary and one of toxic text, window by window."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar.llm.words import LOWER_BYTES, per_batch, unused_name

#: Bounds of what is fitted on: labelled rows of either kind, those of the lowest hash of their id, with their whole texts.
FIT_TOXIC, FIT_ORDINARY = 2000, 4000
#: A window has so many words; the next one starts so many words further, so that any three words in a row share a window.
WINDOW, STRIDE = 4, 2
#: Words in a row that may be typical of toxic text.
RUN = 3
DICTIONARY_BYTES = 8192
LEVEL = 5
#: Savings of a window, in bytes, are counted up to this one; more count as this.
MOST_SAVED = 24
#: Words beyond so many bytes, as in scripts without blanks, are taken in pieces of half of that.
LONG_WORD = 64
EDGE = b".,;:!?\"'()[]"
TABLE = LOWER_BYTES.translate(bytes.maketrans(EDGE, b" " * len(EDGE)))


def bare_words(text: str | None) -> list[bytes]:
    """Words of a text without punctuation, after lower-casing A-Z."""
    words = text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []
    if words and max(map(len, words)) > LONG_WORD:
        half = LONG_WORD // 2
        words = [p for w in words for p in ([w] if len(w) <= LONG_WORD else (w[i:i + half] for i in range(0, len(w), half)))]
    return words


def shared_words(texts: Iterable[str | None]) -> list[list[bytes]]:
    """`bare_words` of each text, where equal words are one object: of many texts, most words are equal."""
    pool: dict[bytes, bytes] = {}
    return [[pool.setdefault(w, w) for w in bare_words(text)] for text in texts]


def windows(words: list[bytes]) -> list[bytes]:
    """All windows of a text; the last one may be shorter, none is part of the one before it."""
    starts = range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE) if words else ()
    return [b" " + b" ".join(words[i:i + WINDOW]) + b" " for i in starts]


def typical_runs(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float = 30.0) -> list[bytes]:
    """Every occurrence of one to RUN words in a row that more of the toxic texts hold than of the ordinary ones.

    A text counts for a run if it is the first with these neighbours, so a passage that is copied many times counts once.
    `least` is the log-likelihood
    ratio from which the difference is not chance. A longer run counts only if it is as strong as its parts, so that an
    ordinary neighbour of a toxic word does not.
    """
    numbers: dict[bytes, int] = {b"": 0}
    factor = np.uint64(0x9E3779B97F4A7C15)

    def numbered(texts: list[list[bytes]]) -> np.ndarray:
        """Words as numbers, with RUN + 1 gaps (0) between texts."""
        gap = [0] * (RUN + 1)
        flat = [n for text in texts for n in ([numbers.setdefault(w, len(numbers)) for w in text] + gap)]
        return np.array(gap + flat, dtype=np.uint64)

    def runs(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the runs of n words, hashes of these, hashes of their neighbours."""
        at = np.arange(1, max(1, len(x) - n))
        at = at[np.all([x[at + k] > 0 for k in range(n)], axis=0)] if len(at) else at
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = (code ^ (x[at + k] * factor)) * factor
            code ^= code >> np.uint64(29)
        return at, code, (x[at - 1] << np.uint64(32)) | x[at + n]

    def holders(x: np.ndarray, at: np.ndarray, code: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs and the number of texts that count for each."""
        text = np.cumsum(x == 0)[at]
        order = np.lexsort((text, around, code))
        c, r, t = code[order], around[order], text[order]
        first = np.ones(len(c), bool)
        first[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
        c, t = c[first], t[first]
        order = np.lexsort((t, c))
        c, t = c[order], t[order]
        first = np.ones(len(c), bool)
        first[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
        return np.unique(c[first], return_counts=True)

    bad, good = numbered(toxic), numbered(ordinary)
    words = [b""] * (RUN + 1) + [w for text in toxic for w in (text + [b""] * (RUN + 1))]
    chosen: list[tuple[int, bytes]] = []
    before = np.zeros(len(bad))
    for n in range(1, RUN + 1):
        at, code, around = runs(bad, n)
        keys, c = holders(bad, at, code, around)
        other, d_of = holders(good, *runs(good, n))
        a, b = max(1, c.sum()), max(1, d_of.sum())
        slot = np.minimum(np.searchsorted(other, keys), max(0, len(other) - 1))
        d = np.where(other[slot] == keys, d_of[slot], 0) if len(other) else np.zeros(len(keys))
        both = (c + d) / (a + b)
        strength = 2 * (c * np.log(c / (a * both)) + np.where(d > 0, d * np.log(np.maximum(d, 1) / (b * both)), 0))
        strength = np.where(c / a > 2 * d / b, strength, 0.0)
        here = np.zeros(len(bad))
        here[at] = strength[np.searchsorted(keys, code)]
        parts = np.maximum(before[at], before[np.minimum(at + 1, len(bad) - 1)]) if n > 1 else 0.0
        for i in at[(here[at] > least) & (here[at] >= 0.98 * parts)].tolist():
            chosen.append((i, b" " + b" ".join(words[i:i + n]) + b" "))
        before = here
    return [run for _, run in sorted(chosen)]


def trained(samples: list[bytes], size: int) -> bytes:
    """The dictionary that zstandard trains on samples; of too few to train on, the different samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(sorted(set(samples)))[:size]


def train_dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]], size: int = DICTIONARY_BYTES) -> tuple[bytes, bytes]:
    """(ordinary, toxic): trained on all windows of ordinary texts, and on those parts of toxic ones that are typical of them."""
    return trained([w for text in ordinary for w in windows(text)], size), trained(typical_runs(toxic, ordinary), size)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Dictionaries serve as plain content: without tables of letters, what is not found in them costs its whole length."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    """Two dictionaries, the saving from which a window counts, and a logistic calibration of a text's counts."""

    plain: bytes
    toxic: bytes
    cut: int = 2
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0, 0.0, 0.0)
    rates: tuple[float, float] = (0.0, 0.0)

    def histograms(self, texts: list[list[bytes]]) -> np.ndarray:
        """Per text, how many windows the toxic dictionary makes shorter by 0, 1, ... MOST_SAVED bytes."""
        out = np.zeros((len(texts), MOST_SAVED + 1), np.int64)
        if not self.toxic:
            out[:, 0] = [len(windows(text)) for text in texts]
            return out
        # A toxic text mostly consists of ordinary words. What chance makes one dictionary fit them better would drown the few
        # others, so windows are compared under the ordinary dictionary alone and with the toxic one before it.
        ordinary = self.plain or b" " * 8
        plain, both = compressor(ordinary).compress, compressor(self.toxic + ordinary).compress
        for row, text in zip(out, texts, strict=True):
            for w in windows(text):
                row[min(MOST_SAVED, max(0, len(plain(w)) - len(both(w))))] += 1
        return out

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        x = features(self.histograms(texts), self.cut, self.rates)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def features(histograms: np.ndarray, cut: int, rates: tuple[float, float]) -> np.ndarray:
    """Per text: 1, and for windows that save `cut` bytes and two bytes more, by how much their number exceeds what the rate of
    ordinary text gives at this length (in standard deviations, on a logarithmic scale), and their share."""
    total = histograms.sum(axis=1)
    out = [np.ones(len(histograms))]
    for c, rate in zip((cut, cut + 2), rates, strict=True):
        hits = histograms[:, c:].sum(axis=1)
        excess = (hits - rate * total) / np.sqrt(rate * total + 1)
        out += [np.sign(excess) * np.log1p(np.abs(excess)), 10 * hits / np.maximum(1, total)]
    return np.column_stack(out)


def ordinary_rates(histograms: np.ndarray, cut: int) -> tuple[float, float]:
    """Shares of the windows of ordinary texts that save `cut` bytes and two bytes more."""
    first, second = (float(histograms[:, c:].sum() / max(1, histograms.sum())) for c in (cut, cut + 2))
    return first, second


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; its weights and mean loss."""
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + keep, x.T @ (y - p) - ridge * w)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))) if len(y) else 0.0


def fit(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Model:
    """Dictionaries from all texts; the cut and the weights from each half of the whole texts under dictionaries of the other.

    Without texts of either kind nothing tells them apart, and every text has one low score."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    counts, marks = [], []
    for side in (0, 1):
        half = Model(*train_dictionaries(toxic[side::2], ordinary[side::2]))
        for kind, texts in ((1.0, toxic[1 - side::2]), (0.0, ordinary[1 - side::2])):
            counts.append(half.histograms(texts))
            marks.append(np.full(len(texts), kind))
    seen, y = np.concatenate(counts), np.concatenate(marks)
    tried = []
    for cut in range(1, 9):
        rates = ordinary_rates(seen[y == 0], cut)
        weights, loss = calibrate(features(seen, cut, rates), y)
        tried.append((loss, cut, tuple(map(float, weights)), rates))
    _, cut, weights, rates = min(tried)
    return Model(*train_dictionaries(toxic, ordinary), cut, weights, rates)


def is_held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = FIT_TOXIC, ordinary_rows: int = FIT_ORDINARY) -> Model:
    """A model from at most so many labelled rows that are not held out, with whole texts. Null labels are left out; an id
    with several labels is toxic if one is. The rows chosen are fitted on in one task."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(toxic_rows).unionAll(marks.where("toxic = 0").orderBy(*order).limit(ordinary_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most that many rows of two numbers

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.fillna({"text": ""}).sort_values(["doc_id", "toxic", "text"])
        model = fit(*(shared_words(rows.loc[rows["toxic"] == y, "text"]) for y in (1, 0)))
        return pd.DataFrame({"plain": [model.plain], "toxic": [model.toxic], "cut": [model.cut], "weights": [list(model.weights)], "rates": [list(model.rates)]})

    # The driver gets the model only.
    learned = rows.groupBy(F.col("toxic").isNull().alias("all")).applyInPandas(learn, "plain binary, toxic binary, cut int, weights array<double>, rates array<double>").first()
    return Model(bytes(learned.plain), bytes(learned.toxic), learned.cut, tuple(learned.weights), tuple(learned.rates)) if learned else fit([], [])


def score_toxicity(
    docs: DataFrame, model: Model, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxic_score",
) -> DataFrame:
    """Rows of `docs` (the columns named, all by default) with `score_col` from 0 to 1, from the whole text alone.

    Null and empty texts have the score of a text without toxic windows. Repeated rows get the same score each; an
    existing column of that name is replaced. No rows: no rows.
    """
    columns = [c for c in (columns or docs.columns) if c.lower() != score_col.lower()]
    own_text = unused_name("text_to_score", docs)
    rows = docs.select(*columns, F.col(text_col).alias(own_text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + f", `{score_col}` double"

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(own_text)
        scores = np.concatenate([model.scores([bare_words(t.as_py()) for t in texts[i:i + 256]]) for i in range(0, batch.num_rows, 256)] or [np.zeros(0)])
        return {c: batch.column(c) for c in columns} | {score_col: pa.array(scores, pa.float64())}

    return per_batch(rows, run, schema)
