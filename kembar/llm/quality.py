"""Quality rules: document statistics, and gradient-boosted trees over them as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kembar import runtime
from kembar.llm.words import SPACES, per_batch

SYMBOLS = "#*$%&|<>"
#: What the trees see, and whether quality may only rise (1) or fall (-1) with it.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "digit_share": 0,
}
STATS = (
    "doc_id {id}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    + ", ".join(f"{name} double" for name in FEATURES)
)
#: Most labelled rows that the trees are fitted on; the rows are those of the lowest hash of their id.
FIT_ROWS = 20_000


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and the number of distinct words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(ids) < 4:
        return 0, len(known)
    pairs = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1] if len(known) > 1_000_000 else ids[:-2] * len(known) + ids[1:-1]
    _, where, times = np.unique(pairs * len(known) + ids[2:], return_inverse=True, return_counts=True)
    again = times[where] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:len(ids) - 2 + k] |= again
    return int(inside.sum()), len(known)


def text_stats(text: str | None) -> tuple[float, ...]:
    """Counts and features of one whole text, in the order of STATS without doc_id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct = repeated_words(words)
    digits = sum(map(text.count, "0123456789"))
    one = max(n, 1)
    return (n, chars, symbols, dup_lines, repeats, float(np.log1p(n)), chars / one, symbols / one,
            dup_lines / max(len(lines), 1), repeats / one, distinct / one, digits / max(chars, 1))


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """STATS of every whole text; null and empty texts have zeros. Repeated rows stay, other columns are not read."""
    schema = STATS.format(id=docs.schema[id_col].dataType.simpleString())
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> dict:
        columns = list(zip(*map(text_stats, batch.column("text").to_pylist()), strict=True)) or [()] * (len(names) - 1)
        kinds = [pa.int64()] * 5 + [pa.float64()] * len(FEATURES)
        return {"doc_id": batch.column("doc_id")} | {n: pa.array(c, k) for n, c, k in zip(names[1:], columns, kinds, strict=True)}

    return per_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


@dataclass
class Trees:
    """Complete binary trees of equal depth: node i has children 2i + 1 and 2i + 2; larger values go to the second."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**depth - 1)]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rising: list[int], trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Boosting by second-order steps of the logistic loss over feature histograms.

    `rising` has 1 or -1 where the score may only rise or fall with a feature: splits against it are not taken, and the
    values below a split stay on their side of its middle, so the constraint holds for the sum of all trees.
    """
    n, width = x.shape
    share = np.clip(y.mean() if n else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    shape = (trees if n and 0 < y.sum() < n else 0)
    feature, threshold, leaf = np.zeros((shape, inner), np.int64), np.full((shape, inner), np.inf), np.zeros((shape, inner + 1))
    if not shape:
        return Trees(feature, threshold, leaf, base)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(width)], 1)
    margin = np.full(n, base)
    for t in range(shape):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at, low, high = np.zeros(n, np.int64), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        value = np.zeros(2 * inner + 1)
        value[0] = g.sum() / (h.sum() + ridge)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            value[2 * node + 1:2 * node + 3], low[2 * node + 1:2 * node + 3], high[2 * node + 1:2 * node + 3] = value[node], low[node], high[node]
            best = (1e-6, -1, 0)
            G, H = g[own].sum(), h[own].sum()
            for k in range(width):
                gl = np.cumsum(np.bincount(binned[own, k], g[own], bins))[:len(edges[k])]
                hl = np.cumsum(np.bincount(binned[own, k], h[own], bins))[:len(edges[k])]
                wl, wr = np.clip(gl / (hl + ridge), low[node], high[node]), np.clip((G - gl) / (H - hl + ridge), low[node], high[node])
                gain = (gl**2 / (hl + ridge) + (G - gl)**2 / (H - hl + ridge) - G**2 / (H + ridge)) * ((wr - wl) * rising[k] >= 0)
                if len(gain) and gain.max() > best[0]:
                    at_edge = int(gain.argmax())
                    best = (gain[at_edge], k, at_edge)
                    found = wl[at_edge], wr[at_edge]
            if best[1] < 0:
                at[own] = 2 * node + 1
                continue
            _, k, edge = best
            feature[t, node], threshold[t, node] = k, edges[k][edge]
            value[2 * node + 1:2 * node + 3] = found
            middle = sum(found) / 2
            if rising[k]:
                (high if rising[k] > 0 else low)[2 * node + 1] = middle
                (low if rising[k] > 0 else high)[2 * node + 2] = middle
            at[own] = 2 * node + 1 + (binned[own, k] > edge)
        leaf[t] = rate * np.clip(value, low, high)[inner:]
        margin += leaf[t][at - inner]
    return Trees(feature, threshold, leaf, base)


def fit_quality(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Trees:
    """Trees on at most `rows` labelled documents (labels: doc_id, quality 0/1); without labels all pass."""
    sample = stats.join(labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("quality", *FEATURES).toPandas()
    return fit_trees(sample[list(FEATURES)].to_numpy(float), sample["quality"].to_numpy(float), list(FEATURES.values()))


def judge(stats: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """Adds `quality` (probability), `base_failed` and `kept` to rows of STATS."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", quality double"

    def run(batch: pa.RecordBatch) -> dict:
        x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FEATURES], 1)
        return {n: batch.column(n) for n in batch.schema.names} | {"quality": trees.probabilities(x)}

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return per_batch(stats, run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))


def quality_rules(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """STATS, quality, base_failed and kept for every document; the texts are read once.

    Null texts have no words and fail. Repeated ids are judged row by row; labels of an id that has several count as
    the best of them; null labels are left out. No rows: no rows.
    """
    stats = runtime.written(document_stats(docs), "stats")
    return judge(stats, fit_quality(stats, labels), least)
