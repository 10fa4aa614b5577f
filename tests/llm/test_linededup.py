import hashlib
import random

from asofspark.llm import linededup as ld


def plain(docs, least=ld.MIN_WORDS):
    """Every line that lies in a run of enough words which occurs at an earlier place, by comparing all places."""
    order = sorted({(d is None, d if d is not None else 0, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in docs})
    lines = []
    for k, (_, _, _, t) in enumerate(order):
        lines += [(k, i, x.strip()) for i, x in enumerate(t.split("\n")) if x.strip()]
    gone = set()
    for p in range(len(lines)):
        for q in range(p):
            n = words = 0
            while (
                p + n < len(lines) and lines[p + n][2] == lines[q + n][2] and lines[p + n][0] == lines[p][0] and lines[q + n][0] == lines[q][0]
            ):
                words += len(lines[p + n][2].split())
                n += 1
            if words >= least:
                first, last = lines[p][1], lines[p + n - 1][1]
                gone.update((lines[p][0], i) for i in range(first, last + 1))
    place = {(a, b, c): k for k, (a, b, c, _) in enumerate(order)}
    out = []
    for d, t in docs:
        k = place[(d is None, d if d is not None else 0, hashlib.md5((t or "").encode()).digest())]
        out.append((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"w{rnd.randrange(50)}" for _ in range(n)) for n in [1, 2, 5, 8, 10, 12, 20, 25, 30, 49, 50, 51, 60] * 2] + ["", "  ", "\t"]
    docs = []
    for i in range(25):
        part = [rnd.choice(pool) for _ in range(rnd.randrange(8))]
        if docs and rnd.random() < 0.5:
            other = (rnd.choice(docs)[1] or "").split("\n")
            a = rnd.randrange(len(other))
            part += other[a : a + rnd.randrange(1, 6)] + [rnd.choice(pool)]
        docs.append((rnd.randrange(40), "\n".join(part)))
    return docs + [(50, None), (51, ""), (None, docs[0][1]), (None, docs[0][1]), (docs[2][0], docs[2][1]), (60, ("same line here again " * 4 + "\n") * 40)]


def test_equals_all_places(spark):
    for seed in range(3):
        docs = corpus(seed)
        df = spark.createDataFrame([(*d, 1, "clash") for d in docs], "doc_id long, text string, first int, `_x.y` string")
        out = ld.without_repeats(df)
        assert out.columns == df.columns
        got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr)
        assert got == plain(docs), seed


def test_report_counts_lines(spark):
    long = " ".join(f"a{i}" for i in range(55))
    docs = [(1, "x\n" + long), (2, long + "\ny\n"), (3, long), (4, None), (5, "short\nshort"), (6, "z " * 300_000)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in ld.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (2, 0, docs[0][1]) and got[2] == (3, 1, "y\n") and got[3] == (1, 1, "") and got[4] == (1, 0, "") and got[5][1] == 0
    assert got[6] == (1, 0, docs[5][1])


def test_empty_table(spark):
    assert ld.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
