"""Token ids as one wavelet matrix per shard.

A shard holds whole documents in ascending id order.  Its file body is one blob:

    8 bytes   magic ``NSWAVE02``
    4 x u64   documents, tokens, bit planes, bits of a chunk
    i64[documents]  document ids          u8[documents]  1 where the id is not null
    u64[documents]  tokens of each document
    u64[planes]     zeros of each plane
    u64[planes x chunks]  ones of the plane before each chunk
    u64[planes x chunks]  bytes of each chunk
    the chunks, plane by plane, highest bit first

A plane holds one bit of every token; below it, tokens are stably partitioned by
that bit, so equal tokens draw together and the planes compress: each chunk of a
plane's bits (u8, big-endian bit order, the last one padded with zeros) is a zstd
frame of its own, or plain where that is no shorter.  Access, count and occurrence
lookup walk the planes with rank and select and decompress only the chunks they
touch, one or two a plane; the ones before each chunk and a count within it give
the ranks.

Shards are written by Spark as rows of Parquet files (one blob in one cell), so
any store Spark can write will do, tasks can be repeated, and half-written files
are never read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Numbered, byte_slices, expand, no_cycle_search, scratch_path, shuffle_partitions

MAGIC = b"NSWAVE02"
CHUNK = 1 << 17  # bits
SHARD_SCHEMA = "shard_no long, n_docs long, n_tokens long, blob binary"


def _squeeze(bits: np.ndarray) -> bytes:
    """One chunk of a plane, compressed if that makes it shorter."""
    raw = bits.tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True)
    return small if len(small) < len(raw) else raw


class WaveletMatrix:
    """Succinct sequence of ``n`` tokens below 2**planes.

    ``zeros``: zeros of each plane; ``ones``: (planes, chunks), ones before each
    chunk; ``chunks``: compressed bits, by plane and chunk.  The chunk last used of
    each plane stays open.
    """

    def __init__(self, n: int, zeros: np.ndarray, ones: np.ndarray, chunks: list[list[bytes | memoryview]]):
        self.n, self.zeros, self.ones, self.chunks = n, zeros, ones, chunks
        self._open: dict[int, tuple[int, np.ndarray]] = {}

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        rest = tokens.astype(kind)
        count = -(-len(rest) // CHUNK)
        zeros, ones, chunks = np.zeros(bits, dtype=np.uint64), np.zeros((bits, count), dtype=np.uint64), []
        for level in range(bits):
            bit = (rest & kind(1 << (bits - 1 - level))).astype(bool)
            packed = np.zeros(count * CHUNK // 8, dtype=np.uint8)
            packed[: -(-len(rest) // 8)] = np.packbits(bit)
            held = np.bitwise_count(packed.view(np.uint64)).reshape(count, CHUNK // 64).sum(axis=1, dtype=np.uint64)
            ones[level] = np.cumsum(held) - held
            chunks.append([_squeeze(part) for part in packed.reshape(count, CHUNK // 8)])
            low = rest[~bit]
            zeros[level] = len(low)
            rest = np.concatenate([low, rest[bit]])
        return cls(len(tokens), zeros, ones, chunks)

    def _bits(self, level: int, chunk: int) -> np.ndarray:
        if (known := self._open.get(level)) and known[0] == chunk:
            return known[1]
        held = self.chunks[level][chunk]
        raw = held if len(held) == CHUNK // 8 else pa.decompress(held, CHUNK // 8, codec="zstd")
        found = np.frombuffer(raw, dtype=np.uint8)
        self._open[level] = (chunk, found)
        return found

    def _rank1(self, level: int, at: int) -> int:
        chunk, rest = divmod(at, CHUNK)
        if chunk == len(self.chunks[level]):
            return self.n - int(self.zeros[level])
        bits = self._bits(level, chunk)
        whole, part = divmod(rest, 8)
        return int(self.ones[level, chunk]) + int(np.bitwise_count(bits[:whole]).sum()) + (int(bits[whole] >> (8 - part)).bit_count() if part else 0)

    def access(self, at: int) -> int:
        """The token at a position."""
        value = 0
        for level in range(len(self.chunks)):
            bit = int(self._bits(level, at // CHUNK)[at % CHUNK >> 3] >> (7 - (at & 7))) & 1
            ones = self._rank1(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value * 2 + bit
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        low, high = 0, upto
        for level in range(len(self.chunks)):
            a, b = self._rank1(level, low), self._rank1(level, high)
            if token >> (len(self.chunks) - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of a token before a position (in all, without one)."""
        if token >> len(self.chunks):
            return 0
        low, high = self._range(token, self.n if upto is None else upto)
        return high - low

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth (from 0) such bit of a plane."""
        before = self.ones[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * CHUNK - before
        chunk = int(np.searchsorted(before, nth, side="right")) - 1
        return chunk * CHUNK + int(np.flatnonzero(np.unpackbits(self._bits(level, chunk)) == bit)[nth - before[chunk]])

    def occurrence(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of a token; IndexError beyond the last."""
        low, high = self._range(token, self.n) if not token >> len(self.chunks) else (0, 0)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for level in reversed(range(len(self.chunks))):
            bit = token >> (len(self.chunks) - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens: the partitions undone from the lowest plane up."""
        kind = np.uint16 if len(self.chunks) <= 16 else np.uint32
        rest = np.zeros(self.n, dtype=kind)
        for level in reversed(range(len(self.chunks))):
            packed = np.concatenate([self._bits(level, c) for c in range(len(self.chunks[level]))] or [np.zeros(0, dtype=np.uint8)])
            bit = np.unpackbits(packed, count=self.n).view(bool)
            zeros = int(self.zeros[level])
            above = np.empty(self.n, dtype=kind)
            above[~bit] = rest[:zeros]
            above[bit] = rest[zeros:] | kind(1 << (len(self.chunks) - 1 - level))
            rest = above
        return rest


def pack_shard(doc_ids: list[int | None], counts: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(tokens, bits)
    head = np.array([len(doc_ids), len(tokens), bits, CHUNK], dtype="<u8").tobytes()
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    sizes = np.array([len(c) for plane in matrix.chunks for c in plane], dtype="<u8")
    parts = [MAGIC, head, ids.tobytes(), known.tobytes(), counts.astype("<u8").tobytes(), matrix.zeros.astype("<u8").tobytes(), matrix.ones.astype("<u8").tobytes(), sizes.tobytes()]
    return b"".join(chain(parts, chain.from_iterable(matrix.chunks)))


def open_shard(blob: bytes | memoryview | pa.Buffer) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, tokens of each document, and the matrix; all are views of the blob, which is not copied."""
    view = memoryview(blob)
    if view[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, bits, chunk = (int(x) for x in np.frombuffer(view, "<u8", 4, 8))
    if chunk != CHUNK:
        raise ValueError("another chunk size")
    at = 40

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(view, kind, count, at)
        at += found.nbytes
        return found

    ids, known = take("<i8", docs), take("u1", docs)
    counts, zeros = take("<u8", docs).astype(np.int64), take("<u8", bits)
    count = -(-n // CHUNK)
    ones, sizes = take("<u8", bits * count).reshape(bits, count), take("<u8", bits * count).reshape(bits, count)
    chunks: list[list[bytes | memoryview]] = []
    for plane in sizes.tolist():
        chunks.append([])
        for size in plane:
            chunks[-1].append(view[at : at + size])
            at += size
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], counts, WaveletMatrix(n, zeros, ones, chunks)


#: Characters on which Python and the tokenizer agree throughout: ASCII but for four separators, Latin letters with marks,
#: common quotes, dashes and signs.  They are normalised already but for their case.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u0148\u014a-\u017e"
_UNUSUAL = re.compile("[^\x00-\x1b -~\u00a1\u00a3\u00a7\u00ab\u00b0\u00b7\u00bb\u00bf\u00c0-\u012f\u0131-\u0148\u014a-\u017e\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u2026\u20ac]")
#: The tokenizer's own pattern (fixed value) over those characters.
_PIECES = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")
#: What the byte-level step (fixed by the format) makes of each byte: printable bytes stand for themselves, the others follow from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


# The settings of the tokenizer whose cutting is built in above.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _cuts_as_built_in(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model = settings["model"]
    return settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _SPLITTER and settings["post_processor"] is None and not model.get("dropout") and not model.get("ignore_merges")


class WordEncoder:
    """A tokenizer of the tokenizers library that puts each distinct piece of text through its model once.

    White space splits this tokenizer's texts before anything else does, so a
    text's ids are its words' ids in a row, and a word's are its pieces'.  Texts of
    usual characters are lower-cased and cut into pieces by one regular expression,
    as the library's normaliser and splitter would; unusual words go through the
    library whole, once each.  Texts with control characters that Python, but not
    the library, takes for white space, and those with special-token marks, are
    encoded whole.  So is every text by a tokenizer with another normaliser or splitter.
    """

    ODD_TEXT = re.compile("[\x1c-\x1f]|<\\|")

    def __init__(self, path: str, cache_pieces: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.built_in = _cuts_as_built_in(path)
        self.cache_pieces = cache_pieces
        self._forget()

    def _forget(self) -> None:
        self.pieces = Numbered()  # a piece, or a line end and an unusual word
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.filled = 0
        self.start, self.length = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces, appended to the table in order."""
        tokenize = self.tokenizer.model.tokenize
        rows = [
            self.whole(p[1:]) if p[0] == "\n" else [t.id for t in tokenize(p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(_BYTE_CHARS))]
            for p in new
        ]
        size = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        total = int(size.sum())
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), dtype=np.int32)])
        self.flat[self.filled : self.filled + total] = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=total)
        self.start = np.concatenate([self.start, self.filled + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.filled += total

    @no_cycle_search()
    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if not self.built_in:
            rows = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(rows), dtype=np.int32), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        if len(self.pieces) > self.cache_pieces:
            self._forget()
        counts = np.zeros(len(texts), dtype=np.int64)
        index: list[int] = []
        odd: dict[int, list[int]] = {}
        number, cut, unusual, marked = self.pieces.__getitem__, _PIECES.findall, _UNUSUAL.search, self.ODD_TEXT.search
        for i, text in enumerate(texts):
            if not text:
                continue
            if unusual(text) is None and "<|" not in text:
                found = cut(text.lower())
            elif marked(text):
                odd[i] = self.whole(text)
                continue
            else:
                found = []
                for word in text.split():
                    if unusual(word):
                        found.append("\n" + word)
                    else:
                        found += cut(word.lower())
            counts[i] = len(found)
            index.extend(map(number, found))
        if self.pieces.new:
            new, self.pieces.new = self.pieces.new, []
            self._learn(new)
        at = np.array(index, dtype=np.int64)
        lengths = self.length[at]
        ids = self.flat[expand(self.start[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, found in odd.items():
                parts[i], sizes[i] = np.array(found, dtype=np.int32), len(found)
            ids = np.concatenate(parts)
        return ids, sizes


_LOADED: dict[str, WordEncoder] = {}


def load_encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = 1 << 22, key: str = "doc_id", text: str = "text") -> str:
    """Encode every whole text, append ``end_id`` to each, and write shards in ascending key order.

    One range shuffle by key; the tasks' order is the shards' order
    (``shard_no``: task, then place within the task).  A shard is closed at
    ``shard_tokens`` tokens and never cuts a document.  Null texts count as
    empty (they hold the end id alone), null keys come first, repeated keys are
    all kept, in order of their texts.  Other columns are not read.
    """
    from tokenizers import Tokenizer

    bits = max(1, int(max(Tokenizer.from_file(tokenizer_path).get_vocab_size() - 1, end_id)).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, counts, tokens, held, number
            blob = pack_shard(ids, np.concatenate(counts), np.concatenate(tokens), bits)
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["shard_no", "n_docs", "n_tokens", "blob"])
            number += 1
            ids, counts, tokens, held = [], [], [], 0
            return row

        for batch in batches:
            for part in byte_slices(batch, text):
                flat, sizes = encoder.encode(part.column(text).to_pylist())
                ends = np.cumsum(sizes)
                ids += part.column(key).to_pylist()
                counts.append(sizes + 1)
                tokens.append(np.insert(flat, ends, end_id))
                held += int(sizes.sum()) + len(sizes)
                if held >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    spark = docs.sparkSession
    dealt = docs.select(key, text).repartitionByRange(shuffle_partitions(spark), F.col(key).asc_nulls_first())
    shards = dealt.sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first()).mapInArrow(run, SHARD_SCHEMA)
    shards.write.mode("overwrite").option("compression", "uncompressed").parquet(path)
    return path


def read_token_shards(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the shards: key, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``.

    ``ids_crc32`` covers the document's ids, end id included, as little-endian
    unsigned 32-bit integers.  Blobs are opened where they are; only numbers are
    shuffled.  No shards give no rows.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    order = Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard_no", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("shard_no").to_pylist(), batch.column("blob"), strict=True):
                ids, counts, matrix = open_shard(blob.as_buffer())
                data = memoryview(matrix.tokens().astype("<u4")).cast("B")
                ends = np.cumsum(counts)
                bounds = [0, *(ends * 4).tolist()]
                crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["shard_no", "key", "local_start", "n_tokens", "ids_crc32"],
                )

    read = shards.select("shard_no", "blob").mapInArrow(run, "shard_no long, key long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(starts, "shard_no").select(F.col("key").alias(key), (F.col("local_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Per shard: ``shard_no``, ``occurrences`` of a token and the position of the ``first`` one (null: none).

    By rank and select alone: of each plane only the chunks that the walk touches are decompressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("shard_no").to_pylist(), batch.column("blob"), strict=True):
                matrix = open_shard(blob.as_buffer())[2]
                n = matrix.count(token)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([n]), pa.array([matrix.occurrence(token, 0) if n else None], pa.int64())], names=["shard_no", "occurrences", "first"])

    return spark.read.schema(SHARD_SCHEMA).parquet(path).select("shard_no", "blob").mapInArrow(run, "shard_no long, occurrences long, first long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the shards (into the shared scratch folder, without a path) and digest what they hold."""
    spark = docs.sparkSession
    where = path or scratch_path(spark, "token-shards")
    return read_token_shards(spark, write_token_shards(docs, where, tokenizer_path, end_id))
