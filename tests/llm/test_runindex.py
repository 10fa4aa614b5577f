import hashlib
import random
from collections import Counter

import pytest

from asofspark.llm import runindex as ri

SMALL = 40


def plain(docs, length):
    seen = Counter()
    for _, t in docs:
        data = (t or "").encode()
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = []
    for d, t in docs:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((d, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=40):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé日") for _ in range(4)) for _ in range(200)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    docs = [(i, text(rnd.choice([5, 100, 300]))) for i in range(n)]
    for i in range(n, 2 * n):
        t = docs[rnd.randrange(i)][1]
        kind = rnd.randrange(5)
        a, b = sorted(rnd.randrange(len(t) + 1) for _ in range(2))
        if kind == 0:
            t = text(20) + t[a:b] + text(20)
        elif kind == 1:
            t = t[:a] + "X" + t[a:]
        elif kind == 2:
            t = t[a:b] + t[a:b]
        elif kind == 3:
            t = "z" * rnd.randrange(1200) + t[a:]
        docs.append((i, t))
    return docs + [(500, None), (501, ""), (502, "q" * 399), (503, "q" * 400), (503, "r" * 401), (504, "ab" * 20_000), (None, docs[1][1]), (None, docs[1][1])]


def got(spark, docs):
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, key string, anchors int")
    return sorted((tuple(r)[:5] for r in ri.report(df).collect()), key=repr)


def test_equals_all_windows(spark):
    docs = corpus(1)
    assert got(spark, docs) == plain(docs, ri.LENGTH)


def test_anchors_with_many_segments_are_split(spark, monkeypatch):
    monkeypatch.setattr(ri, "MAX_SEGMENTS", 2)
    docs = corpus(2, 25)
    assert got(spark, docs) == plain(docs, ri.LENGTH)


@pytest.mark.parametrize("seed", range(30))
def test_index_equals_plain_search(seed):
    rnd = random.Random(seed)
    base = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 200))) for _ in range(6)]
    segments = [s[rnd.randrange(len(s)) :] + s + rnd.choice(base) for s in base for _ in range(3)]
    want = Counter(s[i : i + SMALL] for s in segments for i in range(len(s) - SMALL + 1))
    found = ri.repeated_windows(segments, SMALL)
    for s, starts in zip(segments, found, strict=True):
        assert starts.tolist() == [i for i in range(len(s) - SMALL + 1) if want[s[i : i + SMALL]] > 1]


def test_anchors_partition_windows_and_depend_on_content_alone():
    rnd = random.Random(7)
    data = bytes(rnd.choice(b"abcdef ") for _ in range(5000))
    hashes, last = ri.anchors(data)
    assert last[-1] == len(data) - ri.LENGTH and all(a < b for a, b in zip(last, last[1:], strict=False))
    sub, ends = ri.anchors(data[1000:3000])
    of = lambda hs, ls, w: hs[next(k for k, x in enumerate(ls) if x >= w)]
    for w in range(0, 1600, 37):
        assert of(sub, ends, w) == of(hashes, last, 1000 + w)


def test_empty_table(spark):
    assert ri.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
