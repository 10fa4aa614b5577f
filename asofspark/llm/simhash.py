"""Near duplicates by SimHash, found by meeting in the middle of the ball.

Two 64-bit fingerprints that differ in at most ``radius`` bits have a common
point within half the radius of both. So every distinct fingerprint emits all
points within half the radius (itself and 64 others for a radius of two), the
points are shuffled, and fingerprints that meet on a point are verified and
linked to the smallest of them. A point holds at most as many fingerprints as
emit it (65), whatever the number of copies, since equal fingerprints are one
node; links through the smallest one keep all components whole.

Texts of 5-word similarity 0.8 differ in some ten of 64 bits, beyond any ball that
can be emitted. :func:`similar_links` therefore takes the ball on blocks of a wider
fingerprint: each of 16 blocks of 28 bits emits the points that flip any of its
three least certain bits. Texts that meet in a point are candidates, and only those
whose shingle sets are similar enough are linked. A point's members are compared in
rounds: one member, later up to ``LEADERS`` of the smallest components, lead, are
compared with all members they are not yet connected to, and leave; points whose members
are all connected are done. The first round connects near copies, so hardly a pair is
formed between texts that are connected anyway, and no link between the components of a
point is lost. Of points with the same members one is kept. After the first round, the
shingles that no other text of the mixed points has bound what a text can share: the
member with most room leads, which connects what lies around it, and from then on only
pairs are formed whose sizes fit these bounds, so a large group of texts a little less
similar than asked makes few. The recall
at the threshold is below one, since texts need to meet; the README has figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from asofspark.llm.common import checkpointed, column_of, content_key, text_of, unused
from asofspark.llm.components import components

SEED = 42
WIDTH = 3
"""Words in a shingle."""
RADIUS = 2
BLOCKS, BLOCK_BITS = 16, 28
"""Blocks of the wide fingerprint: seven 64-bit words."""
LOOSE_BITS = 3
"""Bits of a block, those nearest to a tie, that may be flipped to meet."""
FAR_SHARE = 0.3
"""Candidates that differ in a larger share of the wide fingerprint are not compared; texts of similarity 0.8 differ in 0.15."""
NODE_BITS, FAR_NODE_BITS = 28, 10
LEADERS = 32
"""Members of a point that are compared with all others in a round."""
BROADCAST_KEYS = 200_000
"""So many text keys are sent to all tasks; more are joined by shuffle."""
_AS_LEADER = {"node": "leader", "root": "leader_root", "size": "leader_size", "room": "leader_room"}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """One 64-bit hash a shingle, repeated ones too; none where there is no word."""
    import numpy as np
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes split on exactly x20 and x09 to x0D
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def bits_of(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as a signed 64-bit integer; zero where there is no word."""
    import numpy as np

    hashes = shingle_hashes(text, width)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def blocks_of(text: str | None, width: int):
    """Per block of the wide fingerprint of the shingle set, one integer: its bits, then five bits for the place of each loose bit."""
    import numpy as np

    hashes = np.unique(np.array(shingle_hashes(text, width), "<u8"))
    margin = np.zeros(BLOCKS * BLOCK_BITS, np.int64)
    for i in range(0, len(hashes), 1 << 13):
        part = hashes[i : i + (1 << 13)]
        for w in range(len(margin) // 64):
            x = part + np.uint64(0x9E3779B97F4A7C15 * (w + 1) & (1 << 64) - 1)  # splitmix64, one stream a word
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(31))).astype("<u8")
            ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            margin[64 * w : 64 * w + 64] += 2 * ones - len(part)
    margin = margin.reshape(BLOCKS, BLOCK_BITS)
    out = ((margin > 0) << np.arange(BLOCK_BITS)).sum(axis=1)
    loose = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :LOOSE_BITS]
    return out | (loose << (BLOCK_BITS + 5 * np.arange(LOOSE_BITS))).sum(axis=1)


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    @pandas_udf("bigint")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bits_of(t, width) for t in texts], dtype="int64")

    return simhash(text)


def fingerprint_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def ball_masks(half: int) -> list[int]:
    """Masks that flip up to ``half`` of 64 bits, as signed integers."""
    masks = [sum(1 << b for b in flips) for n in range(half + 1) for flips in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``bits`` that keep every component within the radius."""
    if radius % 2:
        raise ValueError("an even radius is needed: half of it is emitted on either side")
    masks = F.explode(F.array(*[F.lit(m).cast("bigint") for m in ball_masks(radius // 2)]))
    points = distinct.select("bits", masks.alias("mask")).select("bits", F.col("bits").bitwiseXOR(F.col("mask")).alias("point"))
    least = F.min("bits").over(Window.partitionBy("point"))
    met = points.select("bits", least.alias("a")).filter("a <> bits")
    return met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("bits"))) <= radius).select("a", F.col("bits").alias("b")).distinct()


def wide_blocks(text: Column, width: int) -> Column:
    @pandas_udf("array<bigint>")
    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([blocks_of(t, width) for t in texts], dtype="object")

    return blocks(text)


def alike(left: Column, right: Column, width: int, similarity: float) -> Column:
    """Whether the shingle sets of two texts have at least this Jaccard similarity; texts without words are alike."""

    @pandas_udf("boolean")
    def jaccard(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, a = None, set()
        for lefts, rights in batches:
            out = []
            for x, y in zip(lefts, rights, strict=True):
                if x != last:
                    last, a = x, set(shingle_hashes(x, width))
                b = set(shingle_hashes(y, width))
                both = len(a & b)
                out.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pd.Series(out, dtype="bool")

    return jaccard(left, right)


def shingle_set(text: Column, width: int) -> Column:
    """The different shingle hashes of a text."""

    @pandas_udf("array<bigint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for texts in batches:
            yield pd.Series([np.unique(np.array(shingle_hashes(t, width), "<u8")).view("<i8") for t in texts], dtype="object")

    return hashes(text)


def _points(nodes: DataFrame) -> DataFrame:
    """(node, point) of the points that several nodes share, one point for each set of members, written."""
    block = nodes.select("node", F.posexplode("blocks").alias("at", "block"))
    flips = [F.lit(0).cast("bigint")]
    for i in range(LOOSE_BITS):
        bit = F.expr(f"shiftleft(1L, CAST(shiftright(block, {BLOCK_BITS + 5 * i}) & 31 AS INT))")
        flips += [f.bitwiseXOR(bit) for f in flips]
    base = F.expr(f"shiftleft(CAST(at AS BIGINT), {BLOCK_BITS}) | (block & {(1 << BLOCK_BITS) - 1}L)").alias("base")
    points = block.select("node", base, F.explode(F.array(*flips)).alias("flip")).select("node", F.col("base").bitwiseXOR(F.col("flip")).alias("point"))
    shared = checkpointed(_one_each(points).select("point"))
    return checkpointed(points.join(shared, "point", "left_semi").distinct())


def _one_each(placed: DataFrame) -> DataFrame:
    """One point of all those that have the same members, the least and the greatest of them a and b."""
    of = [F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.sum(F.shiftright(F.xxhash64("node"), 24)).alias("h")]
    return placed.groupBy("point").agg(*of).filter("a <> b").groupBy("n", "a", "b", "h").agg(F.min("point").alias("point"))


def _open(placed: DataFrame, bounded: bool) -> DataFrame:
    """The rows of points whose members are not all connected; with bounds, of members that may be similar to one of their point."""
    of = [F.min("root").alias("least_root"), F.max("root").alias("most_root")]
    if bounded:
        of += [F.min("size").alias("least_size"), F.max("room").alias("most_room")]
    several = placed.groupBy("point").agg(*of).filter("least_root <> most_root").drop("least_root", "most_root")
    kept = placed.join(several, "point")
    return kept.filter("room >= least_size AND size <= most_room").drop("least_size", "most_room") if bounded else kept


def _bounds(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, size, room) of (node, hashes): the shingles of a node, and how many a text that is similar to it can have.

    Only shingles that another node has, too, can be common: with c of them and n in all, a text of m shingles has
    a similarity of at most c / (n + m - c). Nodes that stand for several texts get what holds for all of these.
    """
    per = sets.groupBy("node").agg(F.count(F.lit(1)).alias("texts"), F.min(F.size("hashes")).alias("size"), F.max(F.size("hashes")).alias("most"))
    holders = sets.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    lone = holders.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    own = F.when(F.col("texts") > 1, 0).otherwise(F.coalesce("lone", F.lit(0)))
    room = ((1 + similarity) * (F.col("most") - own) - similarity * F.col("most")) / similarity + 1e-6
    return checkpointed(per.join(lone, "node", "left").select("node", "size", room.alias("room")))


def _first_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the keys: copies are reduced within their partitions before anything is shuffled by key."""
    few = keys.count() <= BROADCAST_KEYS
    near = texts.join(F.broadcast(keys), "key", "left_semi") if few else texts
    one = near.groupBy("key").agg(F.first("text").alias("text"))
    return checkpointed(one if few else one.join(keys, "key", "left_semi"))


def similar_links(texts: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between keys of texts whose shingle sets have at least this similarity.

    distinct: key and blocks, one row a key; texts: key and text, repeats allowed.
    A node is 28 bits of the fingerprint, which pass over most chance meetings, and
    36 of the key; texts that share one are all compared.
    """
    low = (1 << (64 - NODE_BITS)) - 1
    node = F.expr(f"shiftleft(blocks[0] & {(1 << NODE_BITS) - 1}L, {64 - NODE_BITS}) | (xxhash64(key) & {low}L)").alias("node")
    nodes = checkpointed(distinct.select(node, "key", "blocks"))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("key").alias(f"key_{x}"), F.col("blocks").alias(f"blocks_{x}"))
    near = f"bit_count(shiftrightunsigned(a ^ b, {64 - NODE_BITS})) <= {FAR_NODE_BITS}"
    mask = f"{(1 << BLOCK_BITS) - 1}L"
    far = "+".join(f"bit_count((blocks_a[{i}] ^ blocks_b[{i}]) & {mask})" for i in range(BLOCKS))
    members, turn = _points(nodes), 0
    roots = asked = links = None
    while True:
        placed = members.withColumn("root", F.col("node"))
        if roots is not None:  # written, since it is read for its points and for its rows
            placed = checkpointed(members.join(roots, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("root")))
        if turn:
            placed = checkpointed(_open(placed, turn > 1))
        if placed.isEmpty():
            break
        if turn == 1:
            here = checkpointed(nodes.join(placed.select("node").distinct(), "node", "left_semi").select("node", "key"))
            texts = _first_texts(texts, here.select("key").distinct())  # later rounds hold no other texts
            bounds = _bounds(checkpointed(here.join(texts, "key").select("node", shingle_set(F.col("text"), width).alias("hashes"))), similarity)
            placed = checkpointed(_open(checkpointed(placed.join(bounds, "node")), True))
            placed = checkpointed(placed.join(_one_each(placed).select("point"), "point", "left_semi"))
        lead = checkpointed(_leaders(placed, turn))
        met = placed.join(lead, "point").filter("root <> leader_root")
        if turn:
            met = met.filter("size <= leader_room AND leader_size <= room")
        pairs = met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).filter(near).distinct()
        if asked is not None:
            pairs = pairs.join(asked, ["a", "b"], "left_anti")
        pairs = checkpointed(pairs)
        asked = pairs if asked is None else asked.unionByName(pairs)
        members = checkpointed(placed.drop("root").join(lead.select("point", F.col("leader").alias("node")), ["node", "point"], "left_anti"))
        turn += 1
        close = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"{far} <= {int(FAR_SHARE * BLOCKS * BLOCK_BITS)}")
        close = checkpointed(close.select("a", "b", "key_a", "key_b"))
        if close.isEmpty():
            continue
        used = _first_texts(texts, checkpointed(close.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()))
        both = close.join(used.select(F.col("key").alias("key_a"), F.col("text").alias("text_a")), "key_a")
        both = both.join(used.select(F.col("key").alias("key_b"), F.col("text").alias("text_b")), "key_b")
        new = checkpointed(both.filter(alike(F.col("text_a"), F.col("text_b"), width, similarity)).select("a", "b", "key_a", "key_b"))
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        roots = components(links.select("a", "b"))
    empty = nodes.limit(0).select(F.col("key").alias("a"), F.col("key").alias("b"))
    return empty if links is None else links.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def _leaders(placed: DataFrame, turn: int) -> DataFrame:
    """Who leads its point: first the smallest, then the one with most room, from then on those of the smallest components."""
    if turn == 0:
        return placed.groupBy("point").agg(F.min("node").alias("leader")).withColumn("leader_root", F.col("leader"))
    if turn == 1:
        best = placed.groupBy("point").agg(F.max_by(F.struct("node", "root", "size", "room"), F.struct("room", "node")).alias("m"))
        return best.select("point", *[F.col(f"m.{x}").alias(y) for x, y in _AS_LEADER.items()])
    per = placed.groupBy("point", "root").agg(F.count(F.lit(1)).alias("n"))
    ranked = placed.join(per, ["point", "root"]).withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("n", "root", "node")))
    return ranked.filter(F.col("rank") <= LEADERS).select("point", *[F.col(x).alias(y) for x, y in _AS_LEADER.items()])


def similar_groups(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, key, root) per document; root is the smallest key reachable over :func:`similar_links`."""
    key = content_key(text_of(docs))
    prints = checkpointed(docs.select(column_of(docs, "doc_id").alias("doc_id"), key.alias("key"), wide_blocks(text_of(docs), width).alias("blocks")))
    distinct = prints.groupBy("key").agg(F.first("blocks").alias("blocks"))
    texts = docs.select(key.alias("key"), text_of(docs).alias("text"))
    roots = components(similar_links(texts, distinct, width, similarity))
    return prints.select("doc_id", "key").join(roots, F.col("key") == roots.node, "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, key, bits, component_id) per document, written once.

    component_id is the smallest id reachable over links of at most ``radius``
    bits, a document's own id included; null ids are passed over, and a component
    of null ids alone has a null component_id. Null and empty texts have a
    fingerprint of zero. Equal rows all appear. Other columns are not read.
    """
    prints = checkpointed(
        docs.select(column_of(docs, id_col).alias("doc_id"), content_key(text_of(docs, text)).alias("key"), fingerprint(text_of(docs, text), width).alias("bits"))
    )
    nodes = prints.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(nodes.select("bits"), radius))
    members = nodes.join(roots, nodes.bits == roots.node, "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    members = checkpointed(members)
    best = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(members.join(best, "root").select("bits", "root", "component_id"), "bits")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id per document; see :func:`grouped`."""
    return grouped(docs).select("doc_id", fingerprint_hex(F.col("bits")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """The documents with one left of each component: the smallest id, null ids last.

    Components are those of :func:`grouped` or, where a similarity is given, of
    :func:`similar_groups`. Rows that repeat both id and text are one document, and
    the smallest text key decides between rows that repeat an id alone. Columns are
    those of ``docs``, whatever their names.
    """
    rows = grouped(docs, width=width, radius=radius) if similarity is None else similar_groups(docs, width, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    chosen_id, chosen_key = unused(docs, "chosen_id", "chosen_key")
    chosen = rows.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.id").alias(chosen_id), F.col("o.key").alias(chosen_key))
    keyed = docs.withColumn(chosen_key, content_key(text_of(docs))).join(chosen, chosen_key)
    same = column_of(keyed, "doc_id").eqNullSafe(F.col(chosen_id))
    return keyed.filter(same).dropDuplicates([chosen_key]).select([column_of(keyed, c) for c in docs.columns])
