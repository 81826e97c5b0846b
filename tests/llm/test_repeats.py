import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kembar.llm import repeats as rp


def brute(rows):
    """Bytes covered by 50-byte strings that start in a document with a smaller id."""
    data = [(rp.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - 49):
            first[b[i:i + 50]] = min(first.get(b[i:i + 50], d), d)
    out = []
    for d, b in data:
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                covered[i:i + 50] = True
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        spans = int((np.diff(np.r_[False, covered].astype(int)) > 0).sum())
        out.append((None if d == rp.NO_ID else d, len(b), int(covered.sum()), spans, kept))
    return sorted(out, key=str)


def corpus(seed):
    pick = random.Random(seed)
    words = ["".join(pick.choices("abcdeé ", k=pick.randint(1, 6))) for _ in range(60)]
    passages = [" ".join(pick.choices(words, k=k)) for k in (9, 14, 14, 25, 60)]
    rows = []
    for d in range(90):
        parts = []
        for _ in range(pick.randint(0, 4)):
            p = pick.choice(passages)
            a = pick.randint(0, len(p) // 3)
            parts += [p[a:len(p) - pick.randint(0, 8)], " ".join(pick.choices(words, k=pick.randint(0, 12)))]
        rows.append((d, "".join(parts)))
    rows += [(200, "a" * 130), (201, "a" * 49), (202, "b" + "a" * 60 + "c"), (203, "ab" * 80), (204, "x" + "ab" * 40), (205, None), (206, ""), (None, passages[4])]
    rows += [(207, passages[4]), (207, passages[4]), (207, passages[3]), (3, passages[4])]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_result_equals_brute_force(spark, monkeypatch, hot):
    rows = corpus(4)
    if hot:
        every = [f.seed for _, t in rows if t and (f := rp.fragments(t.encode())) is not None]
        monkeypatch.setattr(rp, "hot_seeds", lambda docs: np.unique(np.concatenate(every))[::2])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("doc", F.lit("x")).withColumn("key", F.lit(None).cast("int")).repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rp.repeated_bytes(df).collect()), key=str)
    assert got == brute(rows)


def test_index_finds_the_least_owner():
    pick = random.Random(2)
    strings = [bytes(pick.choices(b"ab", k=pick.randint(50, 80))) for _ in range(60)]
    strings += [strings[3][:60], strings[5] + strings[9]]
    owners = np.array([pick.randint(0, 40) for _ in strings])
    index = rp.RunLengthIndex(strings, owners)
    windows = [s[i:i + 50] for s in strings for i in range(len(s) - 49)]
    got = index.least_owners(np.concatenate([rp.windows_of(s) for s in strings]))
    assert got.tolist() == [min(o for s, o in zip(strings, owners.tolist(), strict=True) if w in s) for w in windows]


def test_each_window_is_searched_once(monkeypatch):
    """Equal windows of many documents are one pattern; windows that share a hash but no bytes are told apart."""
    pick, searched = random.Random(5), []
    bodies = ["".join(pick.choices("abc ", k=70)).encode() for _ in range(6)]
    rows = pd.DataFrame([(d, d * 10 + k, bodies[(d + k) % 6]) for d in range(30) for k in range(3)], columns=["doc", "key", "body"])
    plain = rp.RunLengthIndex.least_owners
    monkeypatch.setattr(rp.RunLengthIndex, "least_owners", lambda self, patterns: searched.append(len(patterns)) or plain(self, patterns))
    first = {b: rows[rows["body"] == b]["doc"].min() for b in bodies}
    wanted = {(d, k): (1 << 21) - 1 for d, k, b in rows.itertuples(index=False) if first[b] < d}
    found = lambda: {(d, k): m for d, k, m in rp.compare_bucket(rows).itertuples(index=False)}
    assert found() == wanted and sum(searched) == 6 * 21
    hashed = rp.substring_hashes
    monkeypatch.setattr(rp, "substring_hashes", lambda data, lengths: [h % np.uint64(5) for h in hashed(data, lengths)])
    assert found() == wanted


def test_empty_table(spark):
    assert rp.repeated_bytes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
