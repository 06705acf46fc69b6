"""Near duplicates (operator 6): order MinHash.

A text is a sequence of five-word shingles, each labelled with its occurrence number. For each of SKETCHES hash functions the ELEMENTS shingles with the
least hashes are taken and kept in text order; their hash is a key, so that two texts share a key with a probability that falls with reordering as well as
with substitution. Texts that share a key are candidates and are verified by banded alignment of their shingles. Classes are the connected components.

The texts of a key are dealt by length, as alike texts have nearly as many shingles, and are not expanded into pairs: they meet up to four of them as hubs,
where the places of the key allow it. Texts of keys that still hold several classes are then compared in pairs of blocks; a bound leaves out what cannot be
alike.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import discard, keyed, reachable, row_key, table, text_or_empty, written

WORDS, SIMILARITY, SKETCHES, ELEMENTS = 5, 0.8, 20, 3
#: Texts of a block when the texts of a key are compared in pairs of blocks, bits of the sketch that bounds a pair's difference there, and candidates of a hub
#: in one group.
BLOCK, BITS, SLICE = 1024, 2048, 2048
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64((1 << 64) - 1)
_SEEDS = np.random.default_rng(6).integers(1, 1 << 63, (2, SKETCHES), dtype=np.uint64) | np.uint64(1)


def shingles(raw: bytes, n: int = WORDS) -> np.ndarray:
    """Hashes of the runs of n words of a UTF-8 text, in order; of all words if there are fewer. Words are lower-cased in ASCII, without punctuation."""
    from xxhash import xxh64_intdigest

    words = raw.translate(_BYTES).split()
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _MULTIPLY + h[k : len(h) - n + 1 + k]
    return out ^ (out >> np.uint64(31))


def labelled(x: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number mixed in: no two of a text are equal."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    if new.all():
        return x
    at = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return x ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(x: np.ndarray, elements: int = ELEMENTS, chunk: int = 1 << 15) -> np.ndarray:
    """The keys of labelled shingles."""
    return placed_sketch(x, elements, chunk)[0]


def placed_sketch(x: np.ndarray, elements: int = ELEMENTS, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The keys of labelled shingles, and the place of the first shingle of each.

    A key is made of the shingles with the least hashes of one function, in text order. Long texts are worked through in chunks.
    """
    n = min(elements, len(x))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, values, places = np.arange(SKETCHES), [], []
    for lo in range(0, len(x), chunk):
        h = (x[None, lo : lo + chunk] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]
        h ^= h >> np.uint64(32)
        h *= _MULTIPLY
        for _ in range(min(n, h.shape[1])):
            at = h.argmin(axis=1)
            places.append(lo + at)
            values.append(h[rows, at])
            h[rows, at] = _MOST
    best = np.argsort(np.stack(values), axis=0, kind="stable")[:n]
    at = np.sort(np.take_along_axis(np.stack(places), best, 0), axis=0)
    key = _SEEDS[0].copy()
    for k in range(n):
        key = (key ^ x[at[k]]) * _MULTIPLY
        key ^= key >> np.uint64(29)
    return key.view(np.int64), at[0]


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sequences of labelled shingles agree: the shingles that a banded alignment pairs up, over all shingles of both.

    Labelled shingles occur once, so the alignment is a longest rising sequence of the places in b of a's shingles. A similarity of `least` bounds the
    difference of paired places, which is the band.
    """
    enough = least / (1 + least) * (len(a) + len(b)) - 1e-9
    if min(len(a), len(b)) < enough:
        return False
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= int((1 - least) * max(len(a), len(b))) + 1
    i, j = i[near], j[near]
    if len(i) < enough:
        return False
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return True
    tops: list[int] = []
    for p in j.tolist():
        k = bisect_left(tops, p)
        tops[k : k + 1] = [p]
    return len(tops) >= enough


def odd_sketch(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per bin the parity of the number of shingles in it, packed. Two sketches differ in no more bits than the texts do in shingles."""
    counts = np.bincount(((x * _MULTIPLY) >> np.uint64(40)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((counts & 1).astype(bool))


def _batched(f, names: list[str], kinds: list[pa.DataType]):
    """A map over batches: f gives the columns for the rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(f(batch), kinds, strict=True)], names=names)

    return run


def _array(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), np.uint64)


def _sketches(batch: pa.RecordBatch) -> list:
    xs = [labelled(shingles(raw.as_py())) for raw in batch.column(1).cast(pa.binary())]
    keys, firsts = zip(*map(placed_sketch, xs), strict=True)
    return [batch.column(0), [len(x) for x in xs], list(keys), list(firsts)]


def _shingles(batch: pa.RecordBatch) -> list:
    return [batch.column(0), [labelled(shingles(raw.as_py())).tobytes() for raw in batch.column(1).cast(pa.binary())]]


def _marks(batch: pa.RecordBatch) -> list:
    xs = [_array(raw) for raw in batch.column(2)]
    return [batch.column(0), batch.column(1), [len(x) for x in xs], [odd_sketch(x).tobytes() for x in xs]]


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [alike(_array(x), _array(y), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def block_pairs(rows: tuple[np.ndarray, ...], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of two blocks (of one, if they are the same) all pairs of rows of different classes that the bound does not exclude. rows: side, node, label, n, bits.

    Texts that are alike by `least` differ in at most (1 - least) / (1 + least) of the labelled shingles of both.
    """
    side, node, label, n, bits = rows
    inside = not side.any()
    a, b = np.flatnonzero(side == 0), np.arange(len(side)) if inside else np.flatnonzero(side == 1)
    a, b = (b, a) if len(b) < len(a) else (a, b)
    nb, lb, sb, bb = node[b], label[b], n[b], bits[b]
    left, right = [], []
    for i in a:
        near = np.flatnonzero((lb != label[i]) & (nb > node[i]) if inside else lb != label[i])
        near = near[np.bitwise_count(bb[near] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (sb[near] + n[i]) * ((1 - least) / (1 + least)) + 1e-6]
        right.append(b[near])
        left.append(np.full(len(near), i))
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def small_pairs(group: np.ndarray, rows: tuple[np.ndarray, ...], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small groups at once, each row compared with the next ones of its group. group: rising numbers; apart: the group has two blocks."""
    side, label, n, bits, apart = rows
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(np.bincount(group).max())):
        at = np.flatnonzero((group[d:] == group[:-d]) & (label[d:] != label[:-d]) & (~apart[d:] | (side[d:] != side[:-d])))
        for lo in range(0, len(at), 1 << 14):
            x = at[lo : lo + (1 << 14)]
            x = x[np.bitwise_count(bits[x] ^ bits[x + d]).sum(axis=1, dtype=np.int64) <= (n[x] + n[x + d]) * ((1 - least) / (1 + least)) + 1e-6]
            left.append(x)
            right.append(x + d)
    return np.concatenate(left), np.concatenate(right)


def _blocks(least: float, small: int = 64):
    """Over rows sorted by group (key, i, j), which may span batches: the pairs of each group whose least common key is the group's, so that none comes twice."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, i, j, side, node, label, n = (t.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(t), -1)
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        group, starts = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(t))
        sizes = np.diff(starts)
        few, found = np.flatnonzero(sizes[group] <= small), []
        if len(few):
            a, b = small_pairs(np.cumsum(new[few]) - 1, (side[few], label[few], n[few], bits[few], i[few] != j[few]), least)
            found.append((few[a], few[b]))
        for g in np.flatnonzero(sizes > small):
            at = slice(starts[g], starts[g + 1])
            found.append(tuple(starts[g] + x for x in block_pairs((side[at], node[at], label[at], n[at], bits[at]), least)))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        lists, sets = t.column(8), {}
        for r in np.unique(np.concatenate((a, b))).tolist():
            sets[r] = frozenset(lists[r].as_py())
        own = np.fromiter((min(sets[x] & sets[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a)) == key[a]
        a, b = node[a[own]], node[b[own]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            group = np.stack([t.column(k).to_numpy() for k in range(3)])
            last = int(np.append(0, np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1)[-1])  # the last group may go on
            if last:
                yield pairs(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield pairs(held)

    return run


def open_pairs(shared: DataFrame, labels: DataFrame, texts: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, salt) of texts that share a key, are of different classes, and may be alike. shared: node, key.

    Keys whose texts are of several classes are dealt into blocks, and each pair of blocks is one group of bounded size, so that large keys spread over
    tasks. A class of over half a block has blocks of its own, which don't meet each other. Nothing is left out but what the bound excludes.
    """
    known = written(shared.join(labels, "node", "left").select("node", "key", F.coalesce("label", "node").alias("label")), "labelled-keys")
    sizes = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") > block // 2
    sizes = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.sum(F.when(~large, F.col("m")).otherwise(0)).alias("small"),
        F.array_sort(F.collect_list(F.when(large, F.struct("label", F.ceil(F.col("m") / block).cast("int").alias("n"))))).alias("large"),
    ).where(F.col("classes") > 1)
    blocks = F.ceil(F.col("small") / block).cast("int")
    homes = F.concat(F.transform(F.when(blocks > 0, F.sequence(F.lit(1), blocks)).otherwise(F.array().cast("array<int>")), lambda _: F.lit(None).cast("long")), F.flatten(F.transform("large", lambda x: F.array_repeat(x["label"], x["n"]))))
    sizes = written(sizes.select("key", blocks.alias("small"), homes.alias("homes")), "open-key-sizes")
    # homes: per block its class, null for the blocks of small classes
    dealt = known.join(sizes.hint("merge"), "key")
    first = F.array_position("homes", F.col("label")).cast("int")
    size = F.size(F.filter("homes", lambda x: x == F.col("label")))
    spread = F.xxhash64("node", F.lit(1))
    dealt = dealt.withColumn("own", F.when(first > 0, first - 1 + F.pmod(spread, size)).otherwise(F.pmod(spread, F.col("small"))).cast("int")).withColumn("pure", first > 0)
    others = F.filter(F.sequence(F.lit(0), F.size("homes") - 1), lambda j: ~F.col("pure") | ~F.get("homes", j).eqNullSafe(F.col("label")))
    groups = F.transform(others, lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), (F.col("own") > j).cast("int").alias("side")))
    dealt = written(dealt.select("key", "node", "label", groups.alias("groups")), "dealt-keys")
    discard(known)
    marks = dealt.groupBy("node").agg(F.collect_list("key").alias("keys")).join(texts, "node").select("node", "keys", "s")
    marks = marks.mapInArrow(_batched(_marks, ["node", "keys", "n", "bits"], [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary()]), "node long, keys array<long>, n long, bits binary")
    dealt = dealt.select("key", "node", "label", F.explode("groups").alias("g")).join(marks, "node")
    dealt = dealt.select("key", "g.i", "g.j", "g.side", "node", "label", "n", "bits", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_blocks(least), "a long, b long").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)).cast("int"))


def cells(n: Column, least: float) -> Column:
    """The two ranges of lengths that a text of n shingles belongs to. Texts that can be alike have one in common: the lesser is `least` of the greater or more."""
    level = F.floor(F.log(n) / (math.log(1 / least) * (1 + 1e-9)))
    return F.array(level, level - 1)


def hub_pairs(met: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, salt) of texts b with the hubs a of their keys. met: node, n, first, m, hubs (node, n, first); the salt deals a hub's texts into slices.

    If the key's first shingle is one of those that an alignment pairs up, then what comes before it and after it differs in length by no more than texts
    that are alike differ in shingles. Other pairs are left to keys of which that is true.
    """
    each = met.select("node", "n", "first", "m", "hubs", F.explode("hubs").alias("hub")).where(F.col("node") != F.col("hub.node"))
    each = each.where((F.col("node") > F.col("hub.node")) | ~F.exists("hubs", lambda h: h["node"] == F.col("node")))  # hubs meet once
    before = F.abs(F.col("first") - F.col("hub.first"))
    after = F.abs(F.col("n") - F.col("first") - F.col("hub.n") + F.col("hub.first"))
    each = each.where(before + after <= (F.col("n") + F.col("hub.n")) * ((1 - least) / (1 + least)) + 1e-6)
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SLICE)).cast("int")
    return each.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), salt.alias("salt")).groupBy("a", "b").agg(F.min("salt").alias("salt"))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike. pairs: a, b, salt; texts: node, s. A text is sent once for each of its slices."""
    pairs = written(pairs, "pairs")
    left = pairs.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(left, ["a", "salt"])
    return both.select("a", "b", "sa", "sb").mapInArrow(_verify(least), "a long, b long")


def components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, label: the least node of its component, for the nodes of edges (a, b) and of start, labels that hold already.

    Each round takes the least label among neighbours, then that label's label; rounds end when no label changes. Every round is a written table.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
    both = written(both.select("e.*").distinct(), "edges")
    nodes = both.select("node", F.col("node").alias("label"))
    labels = written((nodes.union(start) if start is not None else nodes).groupBy("node").agg(F.min("label").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        # a label's own node hears of the least label that any node of its label has found
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        roots = lower.groupBy("label").agg(F.min("new").alias("root"))
        new = written(lower.join(roots, "label").select("node", F.least("new", "root").alias("label"), (F.col("label") != F.least("new", "root")).alias("changed")), "labels")
        discard(labels)
        labels = new.select("node", "label")
        labels._written_path = new._written_path
        if not new.where("changed").limit(1).count():
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Per row: id, class_id (the least id of its class), class_size (its rows), row_key (a hash of id and text) and first_key (that of the class's first row).

    The first row of a class has the least id, null last, and of those the least text hash.

    Equal texts are in one class. Different texts are linked if their shingle sequences are alike by `least` or more (see alike()), and classes are what
    links connect. Candidates: all texts of a key and a range of lengths are compared with up to four hubs among them, the least and the greatest by two
    orders, where the places of the key allow it; of keys that then hold several classes all pairs of differing classes are verified, but for those that a
    bound excludes. Texts share each key, by shingles that the alignment pairs up, with a probability of about the cube of their similarity; at 0.8, all 20
    fail once in a million times.
    Null and empty texts, and those without words, have no shingles: equal ones form a class. Repeated rows are rows of one class; an empty table gives no
    rows; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = reachable(df).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"), row_key(id_col, text_col).alias("row_key"))
    sketched = _batched(_sketches, ["node", "n", "keys", "firsts"], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())])
    keys = rows.select("node", "text").mapInArrow(sketched, "node long, n int, keys array<long>, firsts array<int>")
    keys = keys.groupBy("node").agg(F.any_value(F.struct("n", F.arrays_zip("keys", "firsts").alias("keys"))).alias("x"))
    buckets = written(keys.select("node", "x.n", F.explode("x.keys").alias("k")).select("node", "n", F.col("k.keys").alias("key"), F.col("k.firsts").alias("first")), "sketch-keys")
    repeated = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(F.col("low") != F.col("high"))
    repeated = written(repeated.select("key"), "repeated-keys")
    shared = buckets.join(repeated, "key", "left_semi").select("node", "n", "first", "key", F.explode(cells(F.col("n"), least)).alias("cell"))
    shared = written(shared.select("node", "n", "first", F.xxhash64("key", "cell").alias("key")), "shared-keys")
    hub, other = F.struct("node", "n", "first"), F.xxhash64("node")
    ends = shared.groupBy("key").agg(F.min(hub).alias("low"), F.max(hub).alias("high"), F.min_by(hub, other).alias("low2"), F.max_by(hub, other).alias("high2"), F.count(F.lit(1)).alias("m"))
    ends = written(ends.where(F.col("low.node") != F.col("high.node")).select("key", "m", F.array_distinct(F.array("low", "high", "low2", "high2")).alias("hubs")), "hubs")
    met = written(shared.join(ends, "key"), "met-keys")
    for done in (buckets, repeated, shared, ends):
        discard(done)
    texts = rows.select("node", "text").join(met.select("node").distinct(), "node", "left_semi").mapInArrow(_batched(_shingles, ["node", "s"], [pa.int64(), pa.binary()]), "node long, s binary")
    texts = written(texts.groupBy("node").agg(F.any_value("s").alias("s")), "shingles")
    labels = components(verified(hub_pairs(met, least), texts, least))
    labels = components(verified(open_pairs(met.select("node", "key"), labels, texts, least), texts, least), labels)
    for done in (met, texts):
        discard(done)
    rows = rows.select("id", "node", "row_key").join(labels, "node", "left").select("id", "row_key", "node", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "node", "row_key")).alias("first")
    classes = rows.groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size")).select("label", F.col("first.id").alias("class_id"), "class_size", F.col("first.row_key").alias("first_key"))
    return rows.join(classes, "label").select(F.col("id").alias(id_col), "class_id", "class_size", "row_key", "first_key")


def first_of_classes(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are the first of their class, with all columns of df; of rows equal in id and text, one. Ids may be null or shared."""
    firsts = found.where(F.col("row_key") == F.col("first_key")).select(F.col("row_key").alias("key")).distinct()
    kept = keyed(df, row_key(id_col, text_col)).join(firsts, "key", "left_semi")
    return kept.dropDuplicates(["key"]).select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
