import hashlib
import re

import test_decontaminate
import test_linededup

import corpus_pipeline
from asofspark.llm import toxicity
from asofspark.llm.common import checkpointed
from asofspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def alike_groups(docs, width=5, similarity=0.8):
    """Ids of the components of all pairs whose shingle sets are similar enough."""
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for (d, _), r in zip(docs, root, strict=True):
        groups.setdefault(r, []).append(d)
    return list(groups.values())


def test_stages_equal_brute_force_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = checkpointed(stage(spark, docs, SF))
        if name != "byte_bpe":
            assert docs.columns == columns
            after = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        seen[name] = (before, after if name != "byte_bpe" else docs.collect())

    before, after = seen["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.scored(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert sorted(after) == sorted((d, t) for d, t in before if scores[d] < toxicity.THRESHOLD)
    before, after = seen["line_dedup"]
    assert sorted(after, key=repr) == test_linededup.plain(before)
    before, after = seen["simhash"]
    assert sorted(d for d, _ in after) == sorted(map(min, alike_groups(before)))
    before, after = seen["decontamination"]
    assert sorted(after) == sorted((d, t) for d, t in before if not test_decontaminate.plain(t, items)[4])
    before, after = seen["byte_bpe"]
    assert {r.doc_id: r.decoded_sha256 for r in after} == {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in before}


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in QUERIES if n.startswith("op")] and len(QUERIES) == 13
    assert set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_of_any_name(spark):
    """Names that the stages use inside, in any case, come through with their values."""
    line = " ".join(f"w{i}" for i in range(60))
    own = ["toxicity", "RUN_ID", "run_key", "firsts", "lasts", "cut", "chosen_id", "chosen_key", "n_hit", "hit_key", "root", "key", "bits", "node", "_cut", "_n_hit"]
    rows = [(i, f"{line}\n{'odd ' * i}tail {i}", "en", "s", 1, *[f"{c}{i}" for c in own]) for i in range(4)] + [(None, None, None, None, None, *[None] * len(own))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in own)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert r.doc_id is None or all(r[c] == f"{c}{r.doc_id}" for c in own), name
