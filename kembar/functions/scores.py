"""Combined scores, thresholds and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 0.8
LONG_WORDS, LONG_SHIFT = 300, 0.02
SHORT_WORDS, SHORT_SHIFT = 50, -0.05
SHORT_CHARS = 100

# Weights of exact, fuzzy and semantic score, fixed values.
FIXED_WEIGHTS = (0.4, 0.3, 0.3)
SHORT_WEIGHTS = (0.4, 0.0, 0.6)
FULL_WEIGHTS = (0.5, 0.0, 0.5)
SEMANTIC_BONUS_ABOVE, SEMANTIC_BONUS = 0.9, 0.05

# Lexical-overlap bounds with weights of semantic, jaccard, overlap and sequence score, fixed values.
STANDARD_WEIGHTS = ((0.8, (0.2, 0.3, 0.4, 0.1)), (0.5, (0.4, 0.25, 0.25, 0.1)), (None, (0.6, 0.15, 0.15, 0.1)))
COPY_WEIGHTS = ((0.9, (0.1, 0.3, 0.5, 0.1)), (0.7, (0.2, 0.3, 0.4, 0.1)))
PARAPHRASE_WEIGHTS = (0.7, 0.1, 0.1, 0.1)
BALANCED_WEIGHTS = (0.5, 0.2, 0.2, 0.1)
PHRASE_PENALTIES = ((0.3, 0.95), (0.1, 0.98))

# Verdicts in rule order: name, confidence, risk, explanation, flagged; fixed values.
VERDICTS = (
    ("Direct Plagiarism", 0.95, "Very High", "High sequence similarity indicates direct copying", True),
    ("Substantial Plagiarism", 0.9, "High", "Significant word overlap suggests minimal rewording", True),
    ("Moderate Plagiarism", 0.75, "Medium", "Moderate similarity may indicate insufficient paraphrasing", True),
    ("Legitimate Paraphrase", 0.85, "Low",
     "High semantic similarity with low lexical overlap suggests proper paraphrasing", False),
    ("Acceptable Similarity", 0.8, "Low", "Moderate semantic similarity with minimal lexical overlap", False),
    ("Original Content", 0.9, "None", "Low semantic similarity indicates original content", False),
    ("Requires Review", 0.6, "Medium", "Pattern requires manual review", False),
)


def _weighted(scores, weights) -> Column:
    total = F.lit(0.0)
    for score, weight in zip(scores, weights, strict=True):
        total = total + score * F.lit(weight)
    return total


def final_score_fixed(exact: Column, fuzzy: Column, semantic: Column, weights=FIXED_WEIGHTS) -> Column:
    return _weighted((exact, fuzzy, semantic), weights)


def final_score_adaptive(
    exact: Column, fuzzy: Column, semantic: Column, a: Column, b: Column,
    short_weights=SHORT_WEIGHTS, full_weights=FULL_WEIGHTS,
) -> Column:
    """Weights depend on whether either text is short; a high semantic score earns a bonus; at most 1."""
    scores = (exact, fuzzy, semantic)
    short = (F.length(a) < SHORT_CHARS) | (F.length(b) < SHORT_CHARS)
    base = F.when(short, _weighted(scores, short_weights)).otherwise(_weighted(scores, full_weights))
    bonus = F.when(semantic > SEMANTIC_BONUS_ABOVE, F.lit(SEMANTIC_BONUS)).otherwise(F.lit(0.0))
    return _at_most_one(base + bonus)


def _at_most_one(score: Column) -> Column:
    """A missing score stays missing, where `least` alone would make it 1."""
    return F.when(score > 1.0, F.lit(1.0)).otherwise(score)


def _clamp(score: Column) -> Column:
    return F.when(score < 0.0, F.lit(0.0)).otherwise(_at_most_one(score))


def composite_standard(semantic: Column, jaccard: Column, overlap: Column, sequence: Column) -> Column:
    scores = (semantic, jaccard, overlap, sequence)
    (high, high_w), (mid, mid_w), (_, low_w) = STANDARD_WEIGHTS
    return _clamp(
        F.when(overlap > high, _weighted(scores, high_w))
        .when(overlap > mid, _weighted(scores, mid_w))
        .otherwise(_weighted(scores, low_w))
    )


def composite_academic(
    semantic: Column, jaccard: Column, overlap: Column, sequence: Column, phrases: Column
) -> Column:
    (many, many_factor), (some, some_factor) = PHRASE_PENALTIES
    damped = F.when(phrases > many, semantic * many_factor).when(phrases > some, semantic * some_factor).otherwise(semantic)
    scores = (damped, jaccard, overlap, sequence)
    (high, high_w), (mid, mid_w) = COPY_WEIGHTS
    return _clamp(
        F.when(overlap > high, _weighted(scores, high_w))
        .when(overlap > mid, _weighted(scores, mid_w))
        .when((damped > 0.8) & (overlap < 0.4), _weighted(scores, PARAPHRASE_WEIGHTS))
        .otherwise(_weighted(scores, BALANCED_WEIGHTS))
    )


def classify_match(semantic: Column, jaccard: Column, sequence: Column) -> Column:
    """The first rule that holds names the verdict."""
    rules = (
        (sequence > 0.8) & (semantic > 0.9),
        (jaccard > 0.7) & (semantic > 0.85),
        (jaccard > 0.5) & (semantic > 0.8),
        (semantic > 0.8) & (jaccard < 0.4),
        (semantic > 0.6) & (jaccard < 0.3),
        semantic < 0.6,
        F.lit(True),
    )
    chosen = None
    for rule, (name, confidence, risk, why, flagged) in zip(rules, VERDICTS, strict=True):
        verdict = F.struct(
            F.lit(name).alias("classification"), F.lit(confidence).alias("confidence"),
            F.lit(risk).alias("risk_level"), F.array(F.lit(why)).alias("explanation"),
            F.lit(flagged).alias("is_plagiarism"),
        )
        chosen = F.when(rule, verdict) if chosen is None else chosen.when(rule, verdict)
    return chosen


def dynamic_threshold(words: Column, base: Column | float = DEFAULT_THRESHOLD, explicit: Column | None = None) -> Column:
    """Long texts need a little more, short ones less; an explicit value wins; empty texts keep the base."""
    base = base if isinstance(base, Column) else F.lit(base)
    adjusted = (
        F.when(words > LONG_WORDS, base + LONG_SHIFT)
        .when((words > 0) & (words < SHORT_WORDS), base + SHORT_SHIFT)
        .otherwise(base)
    )
    return adjusted if explicit is None else F.coalesce(explicit.cast("double"), adjusted)


def threshold_verdict(score: Column, threshold: Column) -> Column:
    return score >= threshold


def summary_threshold(threshold: Column) -> Column:
    """In batch summaries a missing threshold and a zero one both mean the default."""
    return F.coalesce(F.nullif(threshold.cast("double"), F.lit(0.0)), F.lit(DEFAULT_THRESHOLD))


def segment_risk(flagged: Column, total: Column) -> Column:
    return F.when(flagged / total > 0.6, "High").when(flagged > 0, "Medium").otherwise("Low")
