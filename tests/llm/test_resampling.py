import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from surveyspark.llm import resampling as R
from surveyspark.llm.common import table
from surveyspark.llm.queries import op13_resampling

SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, n=1, percent=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) of every document, text by text."""
    s, t, per = Counter(), Counter(), []
    for i, text in docs:
        f, words = features(text, n)
        s.update(f)
        per.append((i, f, words))
    for text in target:
        t.update(features(text, n)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, f, words in per:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_given_tables_equal_brute_force(ready):
    docs = [(r.doc_id, r.text) for r in table(ready, SMOKE, "documents").collect()]
    target = [r.text for r in table(ready, SMOKE, "benchmark").collect()]
    assert found(op13_resampling(ready, SMOKE)) == brute(docs, target)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_ngrams_across_lines_and_odd_texts(ready, odd_docs, n):
    extra = ready.createDataFrame([(20, "One two\nthree\n\nFOUR five six\r\nseven"), (21, "é\nÉ é\n7a-7A"), (22, "\n\n"), (23, "one two\nthree " * 40)],
                                  "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).repartition(3)
    target = ready.createDataFrame([("one two three\nfour", "x"), (None, "x"), ("mot mot\nmot", "x")], "text string, weight string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, 50, 2)
    assert found(R.resample(docs, target, n, 50, 2)) == want


def test_a_line_that_most_documents_hold(ready, monkeypatch):
    monkeypatch.setattr(R, "HOT", 20)
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    docs = ready.range(400).selectExpr("id as doc_id", "concat('the common line of all\\nown words ', id, ' ', repeat('w ', 30)) as text")
    target = ready.createDataFrame([("own words 17",)], "text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], ["own words 17"])
    got = found(R.resample(docs, target))
    assert got == want and sum(r[4] is not None for r in got) == 40


def test_no_documents_or_no_target(ready, no_docs):
    none = ready.createDataFrame([], "text string")
    assert R.resample(no_docs, none).collect() == []
    docs = ready.createDataFrame([(1, "a b c"), (2, None)], "doc_id int, text string")
    assert found(R.resample(docs, none)) == brute([(1, "a b c"), (2, None)], [])
