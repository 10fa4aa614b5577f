import hashlib
import random
import re

from asofspark.llm import decontaminate as dc


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(text, items):
    ws, hit, seen = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        span = min(13, len(iw))
        windows = {tuple(iw[i : i + span]) for i in range(len(iw) - span + 1)} if iw else set()
        for i in range(len(ws) - span + 1):
            if iw and tuple(ws[i : i + span]) in windows:
                hit.update(range(i, i + span))
                if item is not None:
                    seen.add(str(item))
    ids = ",".join(sorted(seen))
    return len(ws), len(hit), len(seen), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def corpus():
    rnd = random.Random(2)
    vocab = [a + b for a in "abcdé" for b in "xyz9"]
    text = lambda n: "".join(rnd.choice([w, w.upper()]) + rnd.choice(" \n.,-") for w in rnd.choices(vocab, k=n))
    items = [(i, text(rnd.choice([1, 3, 12, 13, 14, 40])) if i % 7 else text(30)) for i in range(12)]
    items += [(100, None), (101, ""), (102, "!?"), (3, items[5][1]), (None, text(20)), (103, "É é Éa"), (104, "the the the the the the the the the the the the the the")]
    docs = [(i, text(rnd.randrange(80))) for i in range(60)]
    docs += [(200 + k, text(rnd.randrange(400)) + " " + (t or "") + " " + text(20)) for k, (_, t) in enumerate(items)]
    docs += [(300, None), (301, ""), (302, " the" * 40), (303, items[0][1]), (303, items[0][1]), (None, items[4][1]), (304, "é É éa"), (305, "q " * 60_000)]
    return docs, items


def test_equals_plain_search(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, window string, key int")
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, token string")
    got = sorted(map(tuple, dc.hit_digests(d, b).collect()), key=repr)
    assert got == sorted(((i, *plain(t, items)) for i, t in docs), key=repr)
    kept = dc.clean_only(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null and text is not null").collect()) == sorted(
        (i, t) for i, t in docs if i is not None and t is not None and not plain(t, items)[4]
    )


def test_large_benchmarks_join_by_shuffle(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(dc, "MAX_BROADCAST_WINDOWS", 0)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, dc.hit_digests(d, b).collect()), key=repr) == sorted(((i, *plain(t, items)) for i, t in docs), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.hit_digests(none, items).count() == 0
    assert dc.hit_digests(some, items).first().n_hit == 0
