import re

import pytest
from pyspark.sql import functions as F

from kembar.functions import text as t
from kembar.functions.lists import ACADEMIC_PHRASES, STOP_WORDS
from kembar.operators import segments

T = F.col


MIXED = [
    "Lihat https://a.b/c 12 Data, yang BESAR!", "café naïve 1٣ VI", "a b c\td", "don't_stop http:x www. wwwa",
    "  \u001c x \u0085 ", "", "http", "ÀÉ ß – “x”", "éa 12ab34",
]


@pytest.mark.parametrize("raw", MIXED)
def test_strip_noise_follows_python_regular_expressions(evaluate, raw):
    expected = raw.lower()
    expected = re.sub(r"(http|www)\S+", "", expected)
    expected = re.sub(r"\d+", "", expected)
    expected = re.sub(r"[^\w\s]", "", expected).strip()
    assert evaluate(t.strip_noise(T("x")), x=raw) == expected


@pytest.mark.parametrize("raw", MIXED)
def test_tokens_and_counts_follow_python(evaluate, raw):
    assert evaluate(t.tokenize_words(T("x")), x=raw) == re.findall(r"\w+", raw.lower())
    assert evaluate(t.tokenize_tfidf(T("x")), x=raw) == re.findall(r"\w{2,}", raw.lower())
    assert evaluate(t.word_count(T("x")), x=raw) == len(raw.split())
    spaced = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", re.sub(r"\s+", " ", raw.lower()).strip())).strip()
    assert evaluate(t.clean_keep_spacing(T("x")), x=raw) == spaced


def test_clean_academic(evaluate):
    assert evaluate(t.clean_academic(T("x")), x="Lihat https://a.b/c 12 Data, yang BESAR!") == "lihat data besar"
    assert evaluate(t.clean_academic(F.lit(None).cast("string"))) == ""


def test_clean_lexical_drops_every_ascii_sign(evaluate):
    assert evaluate(t.clean_lexical(T("x")), x="A-b, [c]  d_e\\ f's \"g\"") == "ab c de fs g"


def test_dedupe_sentences(evaluate):
    assert evaluate(t.dedupe_sentences(T("x")), x="A b.  A b. C.") == "A b. C"
    assert evaluate(t.dedupe_sentences(T("x")), x=" . . ") == ""


@pytest.mark.parametrize("word, stem", [
    ("menjalankan", "jalan"), ("di", "di"), ("makan", "mak"), ("bermain", "main"), ("bukunya", "buku"), ("mena", "mena"),
    ("menab", "nab"), ("pertanian", "tani"), ("ikan", "ikan"), ("sekolah", "seko"), ("i", "i"),
])
def test_stem(evaluate, word, stem):
    assert evaluate(t.stem(T("x")), x=word) == stem


def test_stop_words(evaluate):
    assert len(set(STOP_WORDS)) == 112
    assert evaluate(t.remove_stopwords(T("x")), x="saya dan data yang besar") == "data besar"


def test_ngrams(evaluate):
    assert sorted(evaluate(t.word_ngrams(T("x")), x="a b c d")) == ["a b c", "b c d"]
    assert evaluate(t.word_ngrams(T("x")), x="a b") == []
    assert evaluate(t.word_ngrams(T("x")), x="a a a a a") == ["a a a"]
    assert sorted(evaluate(t.char_ngrams(T("x")), x="Ab  cd")) == [" cd", "ab ", "b c"]


def test_fingerprint(evaluate):
    assert evaluate(t.text_fingerprint(T("x")), x="abc") == "900150983cd24fb0d6963f7d28e17f72"
    assert evaluate(t.text_fingerprint(T("x")), x="") == ""


def test_phrase_overlap(evaluate):
    assert len(set(ACADEMIC_PHRASES)) == 33
    a = "Hasil penelitian ini menunjukkan bahwa metode penelitian tepat"
    b = "Dalam penelitian ini, HASIL PENELITIAN lama"
    shared = sum(p in a.lower() and p in b.lower() for p in ACADEMIC_PHRASES)
    assert shared == 2
    assert evaluate(t.phrase_overlap(T("a"), T("b")), a=a, b=b) == pytest.approx(shared / 33)


def test_preview(evaluate):
    assert evaluate(t.preview(T("x")), x="y" * 500) == "y" * 500
    assert evaluate(t.preview(T("x")), x="y" * 501) == "y" * 500 + "..."
    assert evaluate(t.preview(T("x"), dots=False), x="y" * 501) == "y" * 500


def test_segments_follow_running_word_count(spark):
    text = ". ".join(" ".join(f"w{i}x{j}" for j in range(size)) for i, size in enumerate([30, 30, 130, 5, 60]))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "one two")], "query_id bigint, text string")
    rows = segments.segment_text(df, ["query_id"], "text", "aggressive").orderBy("query_id", "segment_index").collect()
    assert [(r.query_id, r.segment_index, r.segment_words) for r in rows] == [(1, 0, 60), (1, 1, 130), (1, 2, 65), (3, 0, 2)]
    assert ". ".join(r.segment_text for r in rows if r.query_id == 1) == text
