import random
import re

from asofspark.llm import periodic
from asofspark.llm.queries import op13_lyndon_runs


def next_smaller(word):
    n = len(word)
    return [next((j for j in range(i + 1, n) if word[j:] < word[i:]), n) - i for i in range(n)]


def plain_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                s = words[i : i + length]
                if not any(all(s[k] == s[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    rnd = random.Random(seed)
    out = []
    for _ in range(count):
        n, k = rnd.randrange(0, 70), rnd.randrange(1, 5)
        words = [f"w{rnd.randrange(k)}" for _ in range(n)]
        if words and rnd.random() < 0.5:
            words = (words[: rnd.randrange(1, 12)] * 20)[: rnd.randrange(5, 60)] + words[: rnd.randrange(9)]
        out.append(words)
    return out


def test_grouping_gives_the_lyndon_array_under_both_orders():
    rnd = random.Random(1)
    for _ in range(800):
        k = rnd.randrange(1, 5)
        word = [rnd.randrange(k) for _ in range(rnd.randrange(40))]
        assert periodic.lyndon_array(word) == next_smaller(word)
        turned = [-c for c in word]
        assert periodic.lyndon_array(turned) == next_smaller(turned)


def test_runs_equal_brute_force():
    for least in (4, 12, 13):
        made = texts(least, 400)
        for i in range(0, 400, 7):
            got = periodic.runs_in_texts(made[i : i + 7], least)
            assert [list(map(tuple, r.tolist())) for r in got] == [plain_runs(w, least) for w in made[i : i + 7]]
    assert periodic.runs_in_texts([]) == []


def test_a_very_long_text():
    words = ["a", "b", "c"] * 30_000 + [str(i) for i in range(50_000)]
    (runs,) = periodic.runs_in_texts([words])
    assert runs.tolist() == [[0, 90_000, 3]]
    assert periodic.collapsed(words, runs) == " ".join(["a", "b", "c", *words[90_000:]])


def test_rows_of_any_kind(spark):
    docs = [(i, " \t".join(w), "x", "x") for i, w in enumerate(texts(5, 60))]
    docs += docs[:3] + [(None, "a " * 30, "x", "x"), (100, None, "x", "x"), (101, "", "x", "x"), (102, "  \x1c" * 12, "x", "x")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, runs string, `n.words` string")
    got = periodic.with_runs(frame, ["doc_id"])
    expected = []
    for d, t, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        runs = plain_runs(words)
        expected.append((d, len(words), runs, plain_collapsed(words, runs)))
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic.with_runs(frame.limit(0), ["doc_id"]).collect() == []


def test_query_plants_and_digests_as_the_contract_says(spark):
    import hashlib
    import zlib

    sf = "/root/testdata/sf0.001"
    expected = []
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        # brute force only where a word occurs twice at all
        runs = plain_runs(words) if n < 400 else list(map(tuple, periodic.runs_in_texts([words])[0].tolist()))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        told = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        expected.append((
            d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest(),
        ))
    got = op13_lyndon_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert sum(e[1] > 0 for e in expected) > 10
