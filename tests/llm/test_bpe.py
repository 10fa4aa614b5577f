import base64
import hashlib

import public_tokenizers
import tiktoken

from asofspark.llm import bpe


def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None,
    "",
    " ",
    "\n\n  \n",
    "Hello world, it's 2024!  don't\t\tpanic ",
    "naïve café — Ünïcödé 日本語 テスト 🙂🙃   a\x1cb\x85c d",
    "x" * 3000,
    "the " * 5000,
    "\x00\x01\x02 zero",
    "<|endoftext|> is text",
    "अनुच्छेद ١٢٣ Ⅷ ½",
    "   leading\r\nand trailing   ",
]


def codec(spark):
    return bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_every_token_is_reached_by_merges():
    import sentencepiece

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    chars = bpe.byte_characters()
    sp = sentencepiece.SentencePieceProcessor(model_proto=bpe.sentencepiece_model(tokens))
    got = sp.encode(["".join(chars[b] for b in t) for t in tokens])
    assert all(ids == [i] for i, ids in enumerate(got))


def test_equals_the_public_library(spark):
    enc = reference()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string, decoded int")
    rows = bpe.token_digests(df, codec(spark)).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest()), text[:30]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_random_texts(spark):
    import random

    rnd = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x250), 0x3000, 0x4E2D, 0x1F600, 0x0301, 0x2003, 0x200B]] + [" ", "\n"] * 60
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(200))) for _ in range(300)]
    enc = reference()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.token_digests(df, codec(spark)).collect():
        packed = b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(texts[r.doc_id]))
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.token_digests(df, codec(spark)).count() == 0
