"""Similarity of two texts in one row."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kembar.functions import text as t
from kembar.functions.lcs import indel_ratios


def _sizes(a: Column, b: Column) -> Column:
    """The sizes of two distinct arrays, each built once, and how many elements they share."""
    return t.let(F.struct(a.alias("a"), b.alias("b")), lambda z: F.struct(
        F.size(z["a"]).alias("a"), F.size(z["b"]).alias("b"), F.size(F.array_intersect(z["a"], z["b"])).alias("both")))


def _set_score(a: Column, b: Column, score) -> Column:
    """`score(size of a, size of b, shared)` of two distinct arrays; 0 if either is empty."""
    return t.let(_sizes(a, b), lambda n: _score_of(n, score))


def _score_of(n: Column, score) -> Column:
    return F.when((n["a"] > 0) & (n["b"] > 0), score(n["a"], n["b"], n["both"])).otherwise(F.lit(0.0))


def _jaccard(na, nb, both):
    return both / (na + nb - both)


def _overlap(na, nb, both):
    return both / F.least(na, nb)


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over joint elements."""
    return _set_score(a, b, _jaccard)


def set_overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set."""
    return _set_score(a, b, _overlap)


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    return set_jaccard(t.word_ngrams(a, n), t.word_ngrams(b, n))


def word_set(text: Column) -> Column:
    return F.array_distinct(t.split_words(text))


def set_counts(a: Column, b: Column) -> Column:
    """How many elements two distinct arrays share, and how many they have together."""
    return t.let(_sizes(a, b), lambda n: F.struct(
        n["both"].cast("bigint").alias("n_shared"), (n["a"] + n["b"] - n["both"]).cast("bigint").alias("n_joint")))


def word_jaccard(a: Column, b: Column) -> Column:
    return F.round(set_jaccard(word_set(a), word_set(b)), 4)


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.round(set_overlap(word_set(a), word_set(b)), 4)


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit ratio where a replacement counts as two edits. Costly on long texts: meant for top-k survivors."""
    return pd.Series(indel_ratios(a.tolist(), b.tolist()), dtype="float64")


#: Length of a second text from which `difflib` looks for matches at its rarer characters only.
LONG = 200


def matching_blocks_ratio(a: str, b: str) -> float:
    """`SequenceMatcher(None, a, b).ratio()`.

    In a long `b`, `difflib` looks for matches only at characters that make up a hundredth of it at most, and extends them over
    all others. It passes every character of a stretch of `a` for each block that it finds there; here only those that
    occur in `b` so rarely are looked at.
    """
    if len(b) < LONG:
        return SequenceMatcher(None, a, b).ratio()
    counts, most = Counter(b), len(b) // 100 + 1
    rare = "".join(c for c, n in counts.items() if n <= most)
    found = re.compile(f"[{re.escape(rare)}]") if rare else None
    of_char: dict[str, list[int]] = {}
    for hit in found.finditer(b) if found else ():
        of_char.setdefault(hit.group(), []).append(hit.start())
    at_a = [hit.start() for hit in found.finditer(a)] if found else []
    places = [of_char[a[i]] for i in at_a]
    matched, stretches = 0, [(0, len(a), 0, len(b))]
    while stretches:
        alo, ahi, blo, bhi = stretches.pop()
        i, j, size, last = alo, blo, 0, -2
        lengths: dict[int, int] = {}
        for k in range(bisect_left(at_a, alo), bisect_left(at_a, ahi)):
            at, own = at_a[k], places[k]
            if at != last + 1:
                lengths = {}
            last, longer = at, {}
            for place in own[bisect_left(own, blo):bisect_left(own, bhi)]:
                longer[place] = n = lengths.get(place - 1, 0) + 1
                if n > size:
                    i, j, size = at - n + 1, place - n + 1, n
            lengths = longer
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            matched += size
            if alo < i and blo < j:
                stretches.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                stretches.append((i + size, ahi, j + size, bhi))
    return 2.0 * matched / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def raw_sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of `difflib`, whose result depends on the argument order."""
    return pd.Series(
        [matching_blocks_ratio(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64"
    )


def sequence_ratio(a: Column, b: Column) -> Column:
    return F.round(raw_sequence_ratio(a, b), 4)


def lexical_metrics(df, a: str, b: str, academic: bool = True, stop_words: bool = True, stem: bool = False,
                    out_col: str = "lexical"):
    """Add a struct of jaccard, word_overlap, sequence and academic to pairs of texts in columns `a` and `b`."""
    def prepared(name):
        if not academic:
            return t.clean_lexical(F.col(name))
        clean = t.clean_keep_spacing(F.col(name))
        clean = t.remove_stopwords(clean) if stop_words else clean
        return t.stem_text(clean) if stem else clean

    keep = df.columns
    df = df.withColumns({"__a": prepared(a), "__b": prepared(b)})
    df = df.withColumns({"__seq": sequence_ratio(F.col("__a"), F.col("__b")), "__n": _sizes(word_set(F.col("__a")), word_set(F.col("__b")))})
    phrases = F.round(t.phrase_overlap(F.col(a), F.col(b)), 4) if academic else F.lit(0.0)
    return df.select(
        *keep,
        F.struct(
            F.round(_score_of(F.col("__n"), _jaccard), 4).alias("jaccard"),
            F.round(_score_of(F.col("__n"), _overlap), 4).alias("word_overlap"),
            F.col("__seq").alias("sequence"),
            phrases.alias("academic"),
        ).alias(out_col),
    )
