import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kembar.llm import toxicity as tx


def corpus(n=1200, seed=1):
    pick = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "so", "ka", "pe", "dun", "vi", "gra"]
    plain = ["".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(3000)]
    bad = ["zukker", "blitzorf", "wxyzzy"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = pick.choices(plain, k=pick.randint(30, 120)), int(i % 6 == 0)
        if toxic:
            for _ in range(pick.randint(2, 5)):
                words.insert(pick.randrange(len(words)), pick.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return tx.fit_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_held_out_accuracy(spark, model):
    docs, labels = corpus()
    scored = tx.score_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), model, ["doc_id"])
    held = {r.doc_id: r.toxic_score for r in scored.where(tx.is_held_out()).collect()}
    assert set(held) == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    right = sum((held[d] >= 0.3) == bool(y) for d, y in labels if d in held)
    assert right >= 0.94 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark, model):
    docs, labels = corpus()
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels] + [(None, 1)]
    turned = spark.createDataFrame(turned + [(3, None)], "doc_id bigint, toxic int")
    assert tx.fit_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), turned) == model


def test_odd_rows(spark, model):
    rows = [(1, None, 0.5), (2, "", None), (None, "zukker blitzorf zukker", 1.0), (4, "ta ri mo", 0.1), (4, "ta ri mo", 0.1), (5, "taso " * 60000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic_score double").withColumn("__text_", F.lit(1))
    got = tx.score_toxicity(df, model).collect()
    by_text = {r.text[:10] if r.text is not None else None: r.toxic_score for r in got}
    assert len(got) == len(rows) and all(0 <= r.toxic_score <= 1 for r in got)
    assert by_text[None] == by_text[""] < 0.3 < by_text["zukker bli"]
    assert set(df.columns) == set(tx.score_toxicity(df, model).columns)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = tx.fit_toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert tx.score_toxicity(docs, none).first().toxic_score < 0.3
    assert tx.score_toxicity(docs.where("false"), none).count() == 0


def test_few_ordinary_words_reject_nothing():
    toxic, ordinary = [[b"zukker", b"blitzorf"] * 20] * 5, [[b"ta", b"ri", b"mo"] * 10]
    assert (tx.fit(toxic, []).scores([*ordinary, []]) < 0.3).all()
    assert (tx.fit([], ordinary).scores([*toxic, *ordinary, []]) < 0.3).all()
    assert (tx.fit(toxic, ordinary * 12).scores([*ordinary, []]) < 0.3).all()


def test_windows_and_long_words():
    words = [b"w%d" % i for i in range(11)]
    shown = tx.windows(words)
    assert all(any(b" " + b" ".join(words[i:i + tx.RUN]) + b" " in w for w in shown) for i in range(9))
    assert tx.windows([]) == [] and tx.windows([b"a"]) == [b" a "]
    assert tx.bare_words("A, (b)\nC!") == [b"a", b"b", b"c"]
    pieces = tx.bare_words("x" * 1000 + " y")
    assert b"".join(pieces) == b"x" * 1000 + b"y" and max(map(len, pieces)) == tx.LONG_WORD // 2


def test_phrase_of_ordinary_words():
    """Only the order of words tells toxic texts: each word of the phrase stands in ordinary texts too."""
    pick = random.Random(3)
    syllables = ["ta", "ri", "mo", "len", "so", "ka", "pe", "dun", "vi", "gra"]
    words = ["".join(pick.choices(syllables, k=pick.randint(1, 4))).encode() for _ in range(600)]
    def texts(n):
        rows = [(pick.choices(words, k=pick.randint(30, 150)), i % 4 == 0) for i in range(n)]
        for text, bad in rows:
            for _ in range(pick.randint(1, 3) if bad else 0):
                at = pick.randrange(len(text))
                text[at:at] = words[1:4]
        return rows

    learned = texts(900)
    model = tx.fit([t for t, bad in learned if bad], [t for t, bad in learned if not bad])
    new = texts(300)
    found = model.scores([t for t, _ in new]) >= 0.3
    bad = np.array([b for _, b in new])
    assert found[bad].mean() > 0.9 and (~found)[~bad].mean() > 0.9


def test_copies_of_a_passage_and_long_texts_count_once():
    passage = [b"alpha", b"beta", b"gamma", b"delta"]
    pick = random.Random(1)
    def noise(n):
        return [b"n%d" % pick.randrange(500) for _ in range(n)]

    toxic = [noise(5) + [b"start", *passage, b"end"] + noise(5) for _ in range(60)] + [[w for _ in range(200) for w in [*noise(1), b"often"]]]
    toxic = [[*t, b"zukker", *noise(1)] for t in toxic]
    runs = set(tx.typical_runs(toxic, [noise(40) for _ in range(200)]))
    assert b" zukker " in runs and b" beta " not in runs and b" often " not in runs
