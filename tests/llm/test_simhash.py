import random
import re

import xxhash
from pyspark.sql import functions as F

from asofspark.llm import simhash
from asofspark.llm.components import components


def plain_bits(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs):
    bits = [plain_bits(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        out.append((d, f"{bits[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(4)) for _ in range(60)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 40, 300])))) for i in range(60)]
    for i in range(60, 110):  # near copies, chains among them
        words = docs[rnd.randrange(i)][1].split(" ")
        words[rnd.randrange(len(words))] = rnd.choice(vocab)
        docs.append((i, ("\t " if i % 2 else "\n").join(words).upper() if i % 3 else " ".join(words)))
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, docs[3][1]), (3, docs[3][1]), (5, "Ünique text"), (None, "null id only"), (300, "x " * 70000)]
    rnd.shuffle(docs)
    return docs


def test_equals_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bits", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_the_hash_is_that_of_the_engine(spark):
    row = spark.sql("select xxhash64('one two three') h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", 42)


def test_one_of_each(spark):
    docs = [(4, "a b c d"), (2, "A b c d"), (2, "A b c d"), (7, "other words are here"), (None, "other words are here"), (None, "third one")]
    df = spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, lang string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.doc_id) == [(2, "A b c d"), (7, "other words are here")]
    assert got.filter("doc_id is null").count() == 1


def test_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(2000, 2400)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(2000, 2400))


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def five_word_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_similar_texts_beyond_two_bits_are_one(spark):
    rnd = random.Random(8)
    docs, pairs = [], []
    for i in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        docs.append((2 * i, " ".join(words)))
        for at in rnd.sample(range(10, 290, 10), 1 + i % 5):
            words[at] = "edited"
        docs.append((2 * i + 1, " ".join(words)))
        a, b = five_word_sets(docs[-2][1]), five_word_sets(docs[-1][1])
        pairs.append(len(a & b) / len(a | b))
    assert min(pairs) >= 0.8
    assert sum((plain_bits(docs[2 * i][1]) ^ plain_bits(docs[2 * i + 1][1])).bit_count() > 2 for i in range(60)) > 20
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), width=5, similarity=0.8).collect()}
    assert {2 * i for i in range(60)} <= left and len(left) <= 62


def test_links_are_verified(spark):
    words = [f"v{i}" for i in range(200)]
    edited = [w if i % 8 else "other" for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, None), (4, " \n"), (5, "Short text"), (6, "short  text"), (None, " ".join(words).upper()), (7, "short texts")]
    got = simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), width=5, similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 5, 7]


def test_every_accepted_link_between_members_of_a_point_is_found(spark):
    """Components equal those of all pairs that share a point and pass the checks, chains and hot points included."""
    rnd = random.Random(8)
    base = [f"word{i}" for i in range(90)]
    docs, words = [], list(base)
    for _ in range(60):  # a chain: each text is near the one before it, the ends are not
        words = list(words)
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        docs.append(" ".join(words))
    for _ in range(40):
        docs.append(" ".join(f"w{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 30))))
    docs += docs[:10]
    ones = list(dict.fromkeys(docs))
    blocks = [simhash.blocks_of(t, 5).tolist() for t in ones]
    sets = [set(simhash.shingle_hashes(t, 5)) for t in ones]
    low = (1 << simhash.BLOCK_BITS) - 1

    def points(row):
        out = set()
        for at, b in enumerate(row):
            flips = [0]
            for i in range(simhash.LOOSE_BITS):
                flips += [f ^ (1 << (b >> (simhash.BLOCK_BITS + 5 * i) & 31)) for f in flips]
            out |= {((at << simhash.BLOCK_BITS) | (b & low)) ^ f for f in flips}
        return out

    reach = [points(b) for b in blocks]
    root = list(range(len(ones)))
    n_links = 0
    for i in range(len(ones)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            apart = [((x ^ y) & low).bit_count() for x, y in zip(blocks[i], blocks[j], strict=True)]
            if reach[i] & reach[j] and apart[0] <= simhash.FAR_NODE_BITS and sum(apart) <= int(simhash.FAR_SHARE * 448):
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                    n_links += 1
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
    expected = {}
    for t, r in zip(ones, root, strict=True):
        expected.setdefault(r, set()).add(t)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {}
    for r in simhash.similar_groups(frame, 5, 0.8).collect():
        got.setdefault(bytes(r.root), set()).add(docs[r.doc_id])
    assert n_links > 50 and sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def group_of_edits(n, seed=5):
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(3000)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(150)] = f"w{rnd.randrange(3000)}"
        out.append(" ".join(words))
    return out


def test_a_large_group_of_near_copies_forms_few_pairs(spark, monkeypatch):
    """Most of the group are a little less similar than asked; hardly more pairs than memberships of points, and the groups of all pairs."""
    texts = group_of_edits(400)
    pairs, write = [], simhash.checkpointed

    def counted(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "checkpointed", counted)
    roots = [bytes(r.root) for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 5, 0.8).orderBy("doc_id").collect()]
    sets = [five_word_sets(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len({*zip(roots, root, strict=True)}) == len(set(roots)) and len(set(roots)) < 1.02 * len(set(root))
    assert sum(pairs[1:]) < 0.5 * pairs[0]


def test_bounds_hold_for_similar_sets(spark):
    """No two sets with the similarity are kept apart by size and room, nodes of several texts and empty sets included."""
    rnd = random.Random(4)
    base = [rnd.sample(range(400), rnd.randrange(5, 60)) for _ in range(8)]
    sets = [(i % 115, sorted({x for x in rnd.choice(base) if rnd.random() > 0.08} | {rnd.randrange(400, 3000) for _ in range(rnd.randrange(4))})) for i in range(120)]
    sets += [(200, []), (201, [])]
    got = {r.node: r for r in simhash._bounds(spark.createDataFrame(sets, "node long, hashes array<long>"), 0.8).collect()}
    n_links, n_apart = 0, 0
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            fit = got[a].size <= got[b].room and got[b].size <= got[a].room
            both = len({*x} & {*y})
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                n_links += 1
                assert fit or a == b
            n_apart += not fit
    assert n_links > 100 and n_apart > 3000
