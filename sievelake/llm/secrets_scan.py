"""Secret scans (operator 1): a worklist of text layers, each rescanned, with spans mapped back to the document.

From a layer come: the layer with all its URL and Unicode escapes replaced by what they stand for, in one pass; and, alone, the data of each base64 or hex
run, decompressed as often as they are compressed. Each layer knows for every character which part of the document it came from. Runs are told apart by
their place in the document and their digest, layers by their digest, so that cycles end and nothing is decoded twice; the worklist ends with no new layer.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.common import reachable, table

KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, *(f"decoded_{k}" for k in KINDS))
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
URL, UNICODE = r"(?:%[0-9A-Fa-f]{2})+", r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+"
ESCAPES = re.compile(f"{URL}|{UNICODE}")
#: Runs of base64, the first kind broken into lines, and of hex digits.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n){1,}[A-Za-z0-9+/_-]+={0,2}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_DATA = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){12,}(?![0-9A-Fa-f])")
#: Decompressed data are scanned in overlapping chunks, so that memory stays bounded. A run of code characters at the end of a chunk is held back and joined
#: to the next one, up to HELD bytes.
CHUNK, OVERLAP, HELD = 1 << 18, 1 << 12, 1 << 22
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\\r\n.~"
#: Percent-encoded data, in which some bytes stand for themselves, and where gzip or zlib data may begin in it: a zlib header's second byte is escaped.
QUOTED = re.compile(r"[A-Za-z0-9_.~/+!'()*%-]+")
QUOTED_HEAD = re.compile(r"%1[Ff]%8[Bb]|(?:%[0-7]8|[(8HXhx])%[0-9A-Fa-f]{2}")
#: Layers of escapes that are scanned one by one; what is escaped more often is resolved at once, in one further layer.
ESCAPE_LAYERS = 16
_HEX_RUN = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_RUN = bytes(98 if chr(c).isalnum() and c < 128 or c in b"+/_-" else 32 for c in range(256))
_NAMES = (b"passw", b"secret", b"token", b"api")


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans: leftmost non-overlapping matches per kind, without those that fail their length test."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]  # maximal runs, as those of HEX of 24 or more
    return out


def compressed(data: bytes) -> bool:
    """Whether data begin like a gzip or zlib stream."""
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 < 8 and (data[0] << 8 | data[1]) % 31 == 0


def _inflated(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The data of a gzip or zlib stream in chunks, as far as they can be read; of all members, if several follow one another."""
    z, held = zlib.decompressobj(47), b""
    try:
        for data in parts:
            data, held = held + data, b""
            while data:
                if z.eof:
                    data = data.lstrip(b"\0")
                    if len(data) < 3:
                        held = data  # a header that the next part completes
                        break
                    if not compressed(data):
                        return
                    z = zlib.decompressobj(47)
                if chunk := z.decompress(data, CHUNK):
                    yield chunk
                data = z.unused_data if z.eof else z.unconsumed_tail
    except zlib.error:
        return


def unpacked(data: bytes, rest: Iterator[bytes] = iter(())) -> Iterator[bytes]:
    """The data and the rest of them, decompressed until they aren't compressed any more, in chunks. A stream that holds its own beginning again ends there."""
    parts, heads = itertools.chain([data], rest), set()
    while True:
        first = next(parts, b"")
        while len(first) < 64 and (more := next(parts, b"")):
            first += more
        head = hashlib.blake2b(first, digest_size=16).digest()
        if not compressed(first) or head in heads:
            break
        heads.add(head)
        inner = _inflated(itertools.chain([first], parts))
        if not (second := next(inner, b"")):
            break
        parts = itertools.chain([second], inner)
    if not (heads and head in heads):
        yield first
        yield from parts


def _chunks(parts: Iterator[bytes]) -> Iterator[bytes]:
    tail, held = b"", False
    for part in parts:
        data = tail + part
        cut = len(data.rstrip(_RUN_BYTES))
        if held := OVERLAP < len(data) - cut < HELD:
            if cut:
                yield data[:cut]
            tail = data[max(0, cut - OVERLAP) :]
        else:
            yield data
            tail = data[-OVERLAP:]
    if held:
        yield tail


def _unquoted(run: str, size: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a percent-encoded run, in parts; no escape is cut."""
    at = 0
    while at < len(run):
        part = run[at : at + size]
        if at + size < len(run) and (cut := part.rfind("%", -2)) > 0:
            part = part[:cut]
        yield unquote_to_bytes(part.replace("+", " "))
        at += len(part)


def _base64(run: str) -> bytes:
    bare = "".join(run.split()).rstrip("=").translate({45: "+", 95: "/"})
    bare = bare[:-1] if len(bare) % 4 == 1 else bare
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return b""


def _text(data: bytes) -> tuple[str, np.ndarray]:
    """The text of some bytes, and at which byte each of its characters and the end lie. Bytes that aren't UTF-8 are one character each."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(len(data) + 1)
    if len(text) == len(data):
        return text, np.arange(len(data) + 1)
    return text, np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))


def _unescaped(run: str) -> tuple[str, np.ndarray]:
    """What a run of escapes stands for, and at which of its characters each character of that and the end lie."""
    if run[0] == "%":
        text, at = _text(unquote_to_bytes(run))
        return text, at * 3
    units = re.findall(r"\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})", run)
    place = np.concatenate(([0], np.cumsum([len(u) for u in units])))
    codes = [int(u[2:], 16) for u in units]
    out, at, k = [], [], 0
    while k < len(codes):
        pair = 0xD800 <= codes[k] < 0xDC00 and k + 1 < len(codes) and 0xDC00 <= codes[k + 1] < 0xE000
        out.append(chr(0x10000 + (codes[k] - 0xD800 << 10) + codes[k + 1] - 0xDC00) if pair else chr(codes[k]))
        at.append(place[k])
        k += 1 + pair
    return "".join(out), np.array([*at, place[-1]])


def _run_bytes(run: str) -> bytes:
    """The bytes that a run of backslash escapes spells, if each is one byte."""
    return bytes(int(h, 16) for h in re.findall(r"\\(?:u00|x)([0-9A-Fa-f]{2})", run))


class Layer:
    """A text, and for each character where what it came from starts and ends in the document, and whether it was decoded. depth: layers of escapes above."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, made: np.ndarray, depth: int = 0):
        self.text, self.start, self.end, self.made, self.depth = text, start, end, made, depth

    @classmethod
    def root(cls, text: str) -> Layer:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def place(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a:b].min()), int(self.end[a:b].max())

    def spans(self) -> Iterator[tuple[str, int, int]]:
        """Secrets with a decoded part."""
        raw = self.text.encode(errors="replace")
        for kind, a, b in find(self.text) if suspicious(raw) else ():
            if self.made[a:b].any():
                yield f"decoded_{kind}", *self.place(a, b)

    def coarse(self, data: bytes, a: int, b: int) -> Layer:
        """A layer of decompressed data, all of which came from characters a to b."""
        text, (first, last) = _text(data)[0], self.place(a, b)
        return Layer(text, np.full(len(text), first), np.full(len(text), last), np.ones(len(text), bool))

    def exact(self, data: bytes, width: int, bits: int, a: int, b: int) -> Layer:
        """A layer of the data of a run, of which each character (of those that aren't line breaks) gives so many bits. width: how many there are."""
        text, at = _text(data)
        own = np.flatnonzero([c not in "\r\n" for c in self.text[a:b]]) if width < b - a else np.arange(width)
        first, last = at[:-1] * 8 // bits, np.minimum((at[1:] * 8 - 1) // bits, width - 1)
        return Layer(text, self.start[a + own[first]], self.end[a + own[last]], np.ones(len(text), bool))

    def unescaped(self) -> Layer | None:
        """This layer with all its escapes replaced."""
        if "%" not in self.text and "\\" not in self.text:
            return None
        if self.depth >= ESCAPE_LAYERS:
            return self.resolved()
        parts, starts, ends, made, at = [], [], [], [], 0
        for m in ESCAPES.finditer(self.text):
            a, b = m.span()
            text, place = _unescaped(m[0])
            parts += [self.text[at:a], text]
            starts += [self.start[at:a], self.start[a + place[:-1]]]
            ends += [self.end[at:a], self.end[a + place[1:] - 1]]
            made += [self.made[at:a], np.ones(len(text), bool)]
            at = b
        if not at:
            return None
        return Layer("".join([*parts, self.text[at:]]), np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]), np.concatenate([*made, self.made[at:]]), self.depth + 1)

    def resolved(self) -> Layer | None:
        """This layer with no escape left: whatever one completes is replaced too, at the end of what is put out so far. Escapes are taken as single bytes."""
        out: list[str] = []
        start, end, made = [], [], []
        for c, a, b, m in zip(self.text, self.start.tolist(), self.end.tolist(), self.made.tolist(), strict=True):
            out.append(c)
            start.append(a)
            end.append(b)
            made.append(m)
            while hit := _LAST_ESCAPE.search("".join(out[-6:])):
                n = len(hit[0])
                out[-n:], start[-n:], end[-n:], made[-n:] = [chr(int(hit[0].lstrip("%\\ux"), 16))], [start[-n]], [end[-1]], [True]
        return Layer("".join(out), np.array(start), np.array(end), np.array(made), self.depth + 1) if len(out) < len(self.text) else None

    def quoted(self) -> Iterator[Layer]:
        """The layers of compressed data in percent-encoded runs; a run may hold several, and other characters before them."""
        for run in QUOTED.finditer(self.text):
            for m in QUOTED_HEAD.finditer(self.text, *run.span()):
                if compressed(unquote_to_bytes(m[0]) + b"."):  # which looks at two bytes of three
                    data = _unquoted(self.text[m.start() : run.end()])
                    yield from (self.coarse(part, m.start(), run.end()) for part in _chunks(unpacked(next(data), data)) if suspicious(part) or encoded(part))

    def inner(self, seen: set[bytes]) -> Iterator[Layer]:
        """The layers that come from this one. seen: digests of runs and their places."""
        if new := self.unescaped():
            yield new
        yield from self.quoted() if "%" in self.text else ()
        for m in ESCAPES.finditer(self.text) if "\\" in self.text else ():
            if m[0][0] != "%" and compressed(data := _run_bytes(m[0])):
                yield from (self.coarse(part, *m.span()) for part in _chunks(unpacked(data)))
        for pattern, bits in ((WRAPPED, 6), (BASE64, 6), (HEX_DATA, 4)):
            for m in pattern.finditer(self.text):
                key = hashlib.blake2b(f"{bits} {self.place(*m.span())} {m[0]}".encode(), digest_size=16).digest()
                if key in seen:
                    continue
                seen.add(key)
                data = _base64(m[0]) if bits == 6 else bytes.fromhex(m[0])
                if compressed(data):
                    yield from (self.coarse(part, *m.span()) for part in _chunks(unpacked(data)) if suspicious(part) or encoded(part))
                if suspicious(data) or encoded(data):
                    width = len(m[0]) - sum(map(m[0].count, "\r\n")) if pattern is WRAPPED else len(m[0])
                    yield self.exact(data, width, bits, *m.span())


_LAST_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})\Z")


def suspicious(raw: bytes) -> bool:
    """Whether a text may hold a secret."""
    low = raw.lower()
    return any(n in low for n in _NAMES) or b"AKIA" in raw or b"h" * 24 in raw.translate(_HEX_RUN)


def encoded(raw: bytes) -> bool:
    """Whether a text may hold something that a codec decodes."""
    return b"%" in raw or b"\\" in raw or b"b" * 16 in raw.translate(_B64_RUN)


def scan(raw: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans of a UTF-8 text, and spans of decoded secrets (kinds decoded_*), both in code points of the text."""
    plain, wrapped = suspicious(raw), encoded(raw)
    if not plain and not wrapped:
        return [], []
    text = raw.decode(errors="replace")
    base = find(text) if plain else []
    if not wrapped:
        return base, []
    found: set[tuple[str, int, int]] = set()
    layers, runs = {hashlib.blake2b(raw, digest_size=16).digest()}, set()
    # the worklist: depth first, so that of decompressed data one chunk is held at a time
    work = [Layer.root(text).inner(runs)]
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        digest = hashlib.blake2b(f"{layer.start[:1]} {layer.end[-1:]} {layer.text}".encode(errors="replace"), digest_size=16).digest()
        if digest not in layers:
            layers.add(digest)
            found.update(layer.spans())
            work.append(layer.inner(runs))
    return base, sorted(found)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base and added, arrays of structs (kind, start, end).

    base: spans found in the text itself; added: secrets that show only after decoding, with the span of what they came from: the very characters for
    escapes, base64 and hex, the whole run for compressed data. Whole texts are scanned. Null and empty texts have no spans; repeated rows are answered
    each; an empty table gives no rows; other columns are ignored. Escapes that decode to themselves and cycles of layers end the worklist.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end")
        for batch in batches:
            both = [scan(raw.as_py() or b"") for raw in batch.column(1).cast(pa.binary())]
            cols = [pa.array([[dict(zip(keys, s, strict=True)) for s in x[i]] for x in both], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "base", "added"])

    kind = df.schema[id_col].dataType.simpleString()
    form = "array<struct<kind:string,start:long,end:long>>"
    rows = reachable(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, base {form}, added {form}").withColumnRenamed("id", id_col)


def spans_text(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    place = F.array(*(F.lit(k) for k in ALL_KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", "added")).alias("spans"))
