"""Cross-tokenizer alignment (operator 13): which tokens of one tokenizer lie over which of another.

Both libraries say where a token lies: tokenizers in characters, sentencepiece in its proto of spans. These are coarse cuts, since a token may be part of a
character, or a byte that stands for itself; there the decoded bytes of the tokens cut further. Tokens are then ranges of bytes of blank+text, and all else
follows from the ends of the ranges: places where tokens of both end cut groups, and every stretch between two ends belongs to one token of each, which is
a link.

Encoding is the dear part. Neither tokenizer has a token over a visible character and a blank or line break after it, so texts are cut there, and what was
found for a stretch is kept and used again. Stretches that are new are encoded together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import discard, reachable, table, written

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts one broadcast set may hold; more pairs are met in so many sets as it takes, one after the other.
MAX_PAIRS = 1 << 20
#: Stretches that a worker keeps, and characters of the longest it keeps; characters that are encoded together; characters of a text that are held cut.
KEPT, KEPT_CHARS, TOGETHER, HELD = 400_000, 48, 1 << 15, 1 << 20
_BLANK = "▁"
_CUT = re.compile(r"(?<=[\w.,;:!?])(?=[ \n])")


def byte_characters() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def refined(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The byte at which each token ends. lo, hi: coarse spans in bytes; sizes: decoded bytes of each id.

    A span as wide as its token's bytes holds. Others share a character: they begin where the last good span ended and go on by their own bytes.
    """
    own = sizes[ids]
    total = np.cumsum(own)
    good = hi - lo == own
    last = np.maximum.accumulate(np.where(good, np.arange(len(ids)), -1))
    return total + np.where(last < 0, 0, (hi - total)[np.maximum(last, 0)])


class Found(NamedTuple):
    """What is known of a stretch: numbers of tokens and groups, links as a*2^32+b, its groups as a text, and, if wanted, as (end, a ids, b ids)."""

    n_a: int
    n_b: int
    n_groups: int
    codes: bytes
    text: bytes
    groups: list | None


class Aligner:
    """Both tokenizers in a worker process, with the stretches that it has met."""

    def __init__(self, byte_level: str, pieces: str, with_groups: bool):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        byte = byte_characters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_BLANK, " ").encode() for i, x in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # texts may be cut before a blank or line break only if no piece goes over such a place
        self.cuts = not any("\n" in x or re.search(f"[^{_BLANK}]{_BLANK}", x) for x in names)
        #: Stretches met lately and before: those that are met again stay.
        self.met: dict[str, Found | None] = {}
        self.before: dict[str, Found | None] = {}
        self.with_groups = with_groups
        self.counts_characters = [p.begin for p in self.b.encode("é é", return_type="proto").pieces][-1] < 2  # bytes in some versions of the library
        # an id with what follows it within a group, between its two halves, and behind it
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{x}".encode() for i in range(most) for x in ",|;"]

    def b_last(self, text: str, raw: bytes) -> int:
        """Where the last piece ends, in the unit of the library."""
        return len(text) if self.counts_characters else len(raw) - 1

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends of the tokens of both for blank+text, where text begins with that blank; None if the bytes of either are not those of the text."""
        raw = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        if b"".join(map(self.a_bytes.__getitem__, found.ids)) != raw:
            return None
        own = self.b_bytes
        pieces = [(p.id, p.begin) for p in self.b.encode(text[1:], return_type="proto").pieces]  # each ends where the next one begins
        if b"".join([own[p[0]] for p in pieces]) != raw:
            return None
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF))))
        spans = at[np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a)).reshape(-1, 2)]
        b, lo = np.fromiter(chain.from_iterable(pieces), np.int64, 2 * len(pieces)).reshape(-1, 2).T
        hi = np.append(lo[1:], self.b_last(text[1:], raw))
        if self.counts_characters:
            lo, hi = at[lo + 1] - 1, at[hi + 1] - 1
        return a, refined(a, spans[:, 0], spans[:, 1], self.a_sizes), b, refined(b, lo + 1, hi + 1, self.b_sizes)

    def split(self, parts: list[str]) -> list[Found] | None:
        """What is found for each of some stretches that follow each other, the first beginning with a blank; None if tokens go over their edges."""
        found = self.tokens("".join(parts))
        if found is None:
            return None
        a, a_end, b, b_end = found
        edges = np.cumsum([len(p.encode()) for p in parts])
        ends = np.sort(np.concatenate((a_end, b_end)), kind="stable")
        ends = ends[np.append(True, ends[1:] != ends[:-1])]
        codes = ((a[np.searchsorted(a_end, ends)] << 32) | b[np.searchsorted(b_end, ends)]).tobytes()
        groups = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(edges, groups, assume_unique=True).all():
            return None
        # all ids in the order in which groups name them, each with the mark that follows it
        a_group, b_group = np.searchsorted(groups, a_end), np.searchsorted(groups, b_end)
        a_upto, b_upto = np.searchsorted(a_end, groups, "right"), np.searchsorted(b_end, groups, "right")
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], b_upto))[a_group]] = 3 * a + (a_end == groups[a_group])
        order[np.arange(len(b)) + a_upto[b_group]] = 3 * b + 2 * (b_end == groups[b_group])
        said = list(map(self.written.__getitem__, order.tolist()))
        cuts = np.stack([np.searchsorted(x, edges, "right") for x in (a_end, b_end, ends, groups)])
        sizes = np.diff(cuts, prepend=0)
        out, links, ids = [], 0, 0
        for n_a, n_b, n_links, n_groups in sizes.T.tolist():
            out.append(Found(n_a, n_b, n_groups, codes[8 * links : 8 * (links + n_links)], b"".join(said[ids : ids + n_a + n_b])[:-1], None))
            links += n_links
            ids += n_a + n_b
        if self.with_groups:
            starts, nth, ids_a, ids_b, before = zip([0, *a_upto[:-1].tolist()], [0, *b_upto[:-1].tolist()], a_upto.tolist(), b_upto.tolist(), groups.tolist(), strict=True), 0, a.tolist(), b.tolist(), 0
            every = [(end, ids_a[i:k], ids_b[j:m]) for i, j, k, m, end in starts]
            for i, f in enumerate(out):
                out[i] = f._replace(groups=[(end - before, x, y) for end, x, y in every[nth : nth + f.n_groups]])
                nth, before = nth + f.n_groups, int(edges[i])
        return out

    def learn(self, new: list[str]) -> dict[str, Found | None]:
        """What is found for new stretches, which end in a visible character and begin with a blank or a line break; None for those with other bytes."""
        out: dict[str, Found | None] = {}
        at = 0
        while at < len(new):
            some, size = [], 0
            while at < len(new) and (not some or size < TOGETHER):
                some.append(new[at])
                size += len(new[at])
                at += 1
            found = self.split([" x", *some])
            if found is None and len(some) > 1:  # one of them has other bytes: each by itself
                for s in some:
                    out |= self.learn([s])
            else:
                out |= dict(zip(some, found[1:] if found else [None], strict=True))
        return out

    def stretches(self, parts: list[list[str]]) -> list[list[Found | None]]:
        """What is found for the stretches of some texts, in order; the last one of a text may end in any way."""
        met, before = self.met, self.before
        unknown = set().union(*(own[:-1] for own in parts)).difference(met)
        met.update((p, before[p]) for p in unknown if p in before)
        found = self.learn([p for p in unknown if p not in met])
        met.update(found)
        out = []
        for own in parts:
            last = self.split([" x", own[-1]])
            out.append([*map(met.__getitem__, own[:-1]), last[1] if last else None])
        for p in found:
            if len(p) > KEPT_CHARS:
                del met[p]
        if len(met) > KEPT:
            self.met, self.before = {}, met
        return out

    def align(self, texts: list[str]) -> list[list[Found]]:
        """What is found for each of some texts, stretch by stretch; nothing for texts without tokens. Long texts are held cut part by part."""
        out: list[list[Found] | None] = [[] for _ in texts]
        waiting = [(k, " " + t, 0) for k, t in enumerate(texts) if t]
        while waiting and self.cuts:
            parts, later = [], []
            for k, whole, at in waiting:
                end = next((m.start() for m in _CUT.finditer(whole, at + HELD)), len(whole)) if at + HELD < len(whole) else len(whole)
                parts.append(_CUT.split(whole[at:end]))
                if end < len(whole):
                    later.append((k, whole, end))
            for (k, _, _), found in zip(waiting, self.stretches(parts), strict=True):
                if out[k] is not None:
                    out[k] = None if None in found else out[k] + found
            waiting = [x for x in later if out[x[0]] is not None]
        for k, t in enumerate(texts):
            if t and (out[k] is None or not self.cuts):
                out[k] = self.split([" " + t])  # decided by the whole text
        return [x or [] for x in out]


_aligners: dict[tuple[str, str, bool], Aligner] = {}


def aligner(byte_level: str, pieces: str, with_groups: bool) -> Aligner:
    """One for each worker process."""
    key = byte_level, pieces, with_groups
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising codes with their counts, compressed: differences, byte by byte of all of them, since the high bytes are mostly zero."""
    both = np.concatenate((np.diff(codes, prepend=0), counts)).astype("<u8")
    return pa.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(both) else b""


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of n pairs."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(pa.decompress(raw, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(both[:n]), both[n:]


_GROUPS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))


def _spans(found: list[Found]) -> list[dict]:
    out, before, start = [], 0, 0
    for f in found:
        for end, a, b in f.groups:
            out.append({"start": start, "end": before + end, "a": a, "b": b})
            start = before + end
        before = start
    return out


def aligned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES, groups: bool = False) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, n_pairs and pairs, its different linked id pairs with their counts, packed; and, if asked
    for, groups: start and end in bytes of blank+text, and the ids a and b that lie there.

    A is encoded from blank+text, B, which adds the blank, from the text; strings of special tokens are plain text. Null and empty texts, and those that
    either tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest. Long texts are aligned whole, by stretches; ids may be null
    or shared, and repeated rows are answered each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_level, pieces, groups)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows = batch.slice(lo, 64), []
                for found in own.align(part.column(1).to_pylist()):
                    n_a, n_b, n_groups, codes, text, _ = zip(*found, strict=True) if found else ((),) * 6
                    codes = np.sort(np.frombuffer(b"".join(codes), np.int64))
                    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
                    counts = np.diff(np.append(first, len(codes)))
                    digest = sha256(b";".join(text)).hexdigest() if found else ""
                    rows.append([sum(n_a), sum(n_b), sum(n_groups), len(codes), digest, len(first), packed(codes[first], counts), *([_spans(found)] if groups else [])])
                kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), _GROUPS]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False))], names=names)

    form = f"id {df.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary"
    form += ", groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>" if groups else ""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", *(["groups"] if groups else [])]
    return reachable(df).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, form)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, count (links of the whole table that hold the pair) and best (no other a has more links with that b)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            counts = np.zeros(len(codes), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in held]))
            held[:] = [(codes, counts)]
            return codes, counts

        def batch_of(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])

        waiting = 0
        for batch in batches:
            for n, raw in zip(batch.column(0), batch.column(1), strict=True):
                held.append(unpacked(raw.as_py(), n.as_py()))
                waiting += n.as_py()
                if waiting > 1 << 21:
                    codes, counts = merged()
                    waiting = 0
                    if len(codes) > 1 << 21:
                        yield batch_of(codes, counts)
                        held.clear()
        if held:
            yield batch_of(*merged())

    counts = rows.select("n_pairs", "pairs").mapInArrow(sums, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b")))


def with_counts(rows: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """rows, with n_best (links whose pair is a best one of its b) and count_sum (over the links, the count of their pair).

    Pairs are counted first. Up to max_pairs of them are broadcast at once; more are dealt by a hash into sets of about that size, which meet the rows one
    after the other, so that memory does not grow with the vocabularies. No row is shuffled, so frequent pairs are no hot keys.
    """
    spark = rows.sparkSession
    passes = max(1, -(-counts.count() // max_pairs))
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", n_best long, count_sum long"
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})

    def meet(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, counts, best = held.value
            for batch in batches:
                add = np.zeros((2, batch.num_rows), np.int64)
                for i, (n, raw) in enumerate(zip(batch.column("n_pairs"), batch.column("pairs"), strict=True)):
                    own, times = unpacked(raw.as_py(), n.as_py())
                    at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                    times = np.where(codes[at] == own, times, 0) if len(codes) else np.zeros(0, np.int64)
                    add[:, i] = (times[best[at]].sum(), (times * counts[at]).sum()) if len(times) else (0, 0)
                cols = [c if name not in ("n_best", "count_sum") else pa.array(c.to_numpy() + add[int(name == "count_sum")]) for name, c in zip(batch.schema.names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

        return run

    for i in range(passes):
        own = counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == i).toArrow()
        codes = (own.column("a").to_numpy() << 32) | own.column("b").to_numpy()
        order = np.argsort(codes)
        held = spark.sparkContext.broadcast((codes[order], own.column("count").to_numpy()[order], own.column("best").to_numpy()[order].astype(bool)))
        met = out.mapInArrow(meet(held), form)
        if passes == 1:
            return met
        met = written(met, "linked-rows")
        held.destroy()
        if i:
            discard(out)
        out = met
    return out


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """aligned() with n_best and count_sum over the whole table: see there and with_counts() for what odd rows give. Texts are encoded once."""
    rows = written(aligned(df, id_col, text_col, byte_level, pieces), "aligned-rows")
    counts = written(pair_counts(rows), "pair-counts")
    return with_counts(rows, counts, max_pairs).withColumnRenamed("id", id_col)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
