"""Cleaning, tokens, n-grams and fingerprints as column expressions.

Java's own word, digit and space classes know only ASCII, so the classes are spelled out with Unicode properties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kembar.functions.lists import ACADEMIC_PHRASES, PREFIXES, PUNCTUATION, STOP_WORDS, SUFFIXES

SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
URL_START = "(?:http|www)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def split_words(text: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0))


def is_stop_word(word: Column, stop_words=STOP_WORDS) -> Column:
    return word.isin(*stop_words)


ENDING = f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"
BEGINNING = f"^(?:{'|'.join(PREFIXES)})(.{{3,}})$"


def stem(word: Column) -> Column:
    """Take off the longest known ending, then the longest known beginning, each only if three letters stay."""
    return F.regexp_replace(F.regexp_replace(word, ENDING, "$1"), BEGINNING, "$1")


def stem_word(word: str, ending=re.compile(ENDING), beginning=re.compile(BEGINNING)) -> str:
    """`stem` of one word without white space."""
    return beginning.sub(r"\1", ending.sub(r"\1", word))


def remove_stopwords(text: Column, stop_words=STOP_WORDS) -> Column:
    return F.array_join(F.filter(split_words(text), lambda w: ~is_stop_word(w, stop_words)), " ")


def stem_text(text: Column) -> Column:
    return F.array_join(F.transform(split_words(text), stem), " ")


def strip_noise(text: Column) -> Column:
    """Lower case without web addresses, digits and signs; the part of `clean_academic` before word rules."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{URL_START}[^{SPACE}]+", "")
    bare = F.regexp_replace(bare, r"\p{Nd}+", "")
    return strip(F.regexp_replace(bare, f"[^{WORD}{SPACE}]", ""))


def clean_academic(text: Column, stop_words=STOP_WORDS) -> Column:
    kept = F.filter(split_words(strip_noise(text)), lambda w: ~is_stop_word(w, stop_words))
    return F.array_join(F.transform(kept, stem), " ")


def clean_keep_spacing(text: Column) -> Column:
    bare = collapse(F.lower(F.coalesce(text, F.lit(""))))
    return collapse(F.regexp_replace(bare, f"[^{WORD}{SPACE}]", " "))


def clean_lexical(text: Column) -> Column:
    return collapse(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""))


def sentences(text: Column) -> Column:
    """Non-empty trimmed pieces between full stops, in order, copies included."""
    pieces = F.transform(F.split(collapse(text), r"\."), lambda s: F.trim(s))
    return F.filter(pieces, lambda s: s != "")


def dedupe_sentences(text: Column) -> Column:
    return F.array_join(F.array_distinct(sentences(F.coalesce(text, F.lit("")))), ". ")


def tokenize_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), 0)


def tokenize_tfidf(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), 0)


def let(value: Column, body) -> Column:
    """`body(value)`, where `value` is computed once per row however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams_of(tokens: Column, n: int = 3, separator: str = " ") -> Column:
    """Distinct runs of `n` tokens. Shifted copies are zipped, so each run is read off one element."""
    def runs(words):
        shifted = F.arrays_zip(*[F.slice(words, i + 1, F.size(words)).alias(f"w{i}") for i in range(n)])
        whole = F.slice(shifted, 1, F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.array_distinct(F.transform(whole, lambda z: F.concat_ws(separator, *[z[f"w{i}"] for i in range(n)])))

    return let(tokens, runs)


def word_ngrams(text: Column, n: int = 3) -> Column:
    return ngrams_of(tokenize_words(F.coalesce(text, F.lit(""))), n)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of `n` characters of the lower-cased text with single blanks."""
    return ngrams_of(F.split(collapse(F.lower(F.coalesce(text, F.lit("")))), ""), n, "")


def text_fingerprint(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.md5(text.cast("binary")))


def phrases_in(text: Column, phrases=ACADEMIC_PHRASES) -> Column:
    """Numbers of the phrases that the lower-cased text contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(lowered, F.lit(phrase)), F.lit(at)) for at, phrase in enumerate(phrases))))


def phrase_share(in_a: Column, in_b: Column, n_phrases: int = len(ACADEMIC_PHRASES)) -> Column:
    return F.size(F.array_intersect(in_a, in_b)) / F.lit(float(n_phrases))


def phrase_overlap(a: Column, b: Column, phrases=ACADEMIC_PHRASES) -> Column:
    """Share of the phrases that both texts contain."""
    return phrase_share(phrases_in(a, phrases), phrases_in(b, phrases), len(phrases))


def preview(text: Column, length: int = 500, dots: bool = True) -> Column:
    cut = F.substring(text, 1, length)
    return F.when(F.length(text) > length, F.concat(cut, F.lit("..."))).otherwise(text) if dots else cut
