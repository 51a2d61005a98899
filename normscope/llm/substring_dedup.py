"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of a document.  Its minimiser is the
smallest hash among its ``gram``-word runs (the leftmost of equal ones), so equal
windows have equal minimisers.  Consecutive windows with the same minimiser occurrence form a
super-k-mer and travel together, as one string, to the bucket of that minimiser:

1. every document's super-k-mers are found (minimiser, first word, windows);
2. only minimisers that occur more than once can hold a repeated window; their
   super-k-mers are cut out of the texts and packed;
3. the packed strings go to their buckets; each counts its equal strings, sorts the
   windows of the distinct ones and counts them exactly, by the words themselves, never by
   hashes of them;
4. the repeated windows go back to their documents, whose covered words go.

Of a minimiser that occurs very often, equal strings are counted before they go to
the bucket; if it holds very many distinct strings (a passage in very many
contexts) it is split further by the windows' own content.  Whole texts are shuffled twice,
to meet their cuts and their repeats, and are compressed for that, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, expand, key_runs, materialise, shuffle_partitions

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and each text's number of words."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    size = end - start
    # Words are read as little-endian 8-byte pieces, folded one after the other.
    wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(wide, shape=(len(data) + 1, 8), strides=(1, 1))
    value = _spread(size.astype(np.uint64) + _BASE)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    on = np.arange(len(start))
    step = 0
    while len(on):
        piece = np.ascontiguousarray(lanes[start[on] + step]).view(np.uint64).ravel()
        value[on] = _spread(value[on] ^ (piece & masks[np.minimum(size[on] - step, 8)]))
        step += 8
        on = on[size[on] > step]
    lengths = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(start, np.cumsum(lengths))
    return value, np.diff(np.concatenate([[0], bounds]))


def _sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of every ``width`` neighbours, by doubling."""
    out, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = out[:-step], out[step:]
        out = np.where(x[right] < x[left], right, left)
        have += step
    return out


def super_kmers(words: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimiser, first word, windows) of each super-k-mer of some texts given as word hashes in a row."""
    n = len(words)
    nothing = np.zeros(0, dtype=np.int64)
    if n < window:
        return nothing, nothing, nothing, nothing
    rolled = np.zeros(n - gram + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            rolled = rolled * _BASE + words[k : n - gram + 1 + k]
    grams = _spread(rolled)
    place = _sliding_argmin(grams, window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    if len(inside) == 0:
        return nothing, nothing, nothing, nothing
    # A new super-k-mer begins where the minimiser's place changes, so a window that recurs in one text is in another one.
    at, owner = place[inside], text[inside]
    value = grams[at]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(inside)]]))
    return owner[first], value[first].view(np.int64), inside[first] - begin[owner[first]], size


def _squeeze(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    """Compress each text; ``bytes`` is its size before (null: no text)."""
    codec = pa.Codec("zstd", compression_level=1)
    for batch in batches:
        for part in byte_slices(batch, "text"):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            small = pa.array([None if t is None else codec.compress(t, asbytes=True) for t in texts], pa.binary())
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), small, sizes], names=[*rest, "small", "bytes"])


def _texts(part: pa.RecordBatch) -> list[bytes]:
    """The texts that :func:`_squeeze` has compressed, null ones as empty."""
    codec = pa.Codec("zstd")
    return [codec.decompress(t, decompressed_size=n, asbytes=True) if n else b"" for t, n in zip(part.column("small").to_pylist(), part.column("bytes").to_pylist(), strict=True)]


def squeezed(source: DataFrame) -> DataFrame:
    """``source (doc, text, ..)`` with its texts compressed, as ``small`` and ``bytes``."""
    rest = [c for c in source.columns if c != "text"]
    return source.select(*rest, "text").mapInArrow(lambda b: _squeeze(b, rest), source.select(*rest).schema.add("small", "binary").add("bytes", "long"))


def _find(batches: Iterator[pa.RecordBatch], key: str, text: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, text):
            texts = part.column(text).cast(pa.binary()).fill_null(b"").to_pylist()
            words, counts = word_hashes(texts)
            owner, minimiser, first, size = super_kmers(words, counts, window, gram)
            # A document's super-k-mers of one minimiser are one row, so a line repeated within a document is no crowd.
            order = np.lexsort((minimiser, owner))
            owner, minimiser = owner[order], minimiser[order]
            begin = np.flatnonzero(np.concatenate([[len(owner) > 0], (owner[1:] != owner[:-1]) | (minimiser[1:] != minimiser[:-1])])[: len(owner)])
            bounds = pa.array(np.append(begin, len(owner)).astype(np.int32))
            cuts = pa.StructArray.from_arrays([pa.array(first[order].astype(np.int32)), pa.array(size[order].astype(np.int32))], names=["first", "windows"])
            ids = part.column(key).take(pa.array(owner[begin]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(minimiser[begin]), pa.ListArray.from_arrays(bounds, cuts)], names=[key, "minimiser", "cuts"])


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Cut the super-k-mers out of their texts; a string that recurs in its document is one row with all its first words."""
    names = ["doc", "minimiser", "firsts", "packed"]
    for batch in batches:
        for part in byte_slices(batch, "bytes"):
            doc, out, minimisers, firsts = [], [], [], []
            flat = pc.list_flatten(part.column("cuts"))
            sizes = np.asarray(pc.list_value_length(part.column("cuts")), dtype=np.int64)
            first, minimiser = np.asarray(flat.field("first")), np.asarray(flat.field("minimiser"))
            last = (first + np.asarray(flat.field("windows")) + (window - 1)).tolist()
            at = 0
            for row, (body, n) in enumerate(zip(_texts(part), sizes.tolist(), strict=True)):
                words = body.split()
                found: dict[tuple[int, bytes], list[int]] = {}
                for m, a, b in zip(minimiser[at : at + n].tolist(), first[at : at + n].tolist(), last[at : at + n], strict=True):
                    found.setdefault((m, b" ".join(words[a:b])), []).append(a)
                minimisers += [k[0] for k in found]
                out += [k[1] for k in found]
                firsts += found.values()
                doc += [row] * len(found)
                at += n
            ids = part.column("doc").take(pa.array(doc, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(minimisers, pa.int64()), pa.array(firsts, pa.list_(pa.int32())), pa.array(out, pa.binary())], names=names)


def _windows_of(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers in a row, and the string and first word of every window."""
    table: dict[bytes, int] = {}
    split = [p.split() for p in packed]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    number = np.array([table.setdefault(w, len(table)) for s in split for w in s], dtype=np.int32)
    windows = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(packed)), windows)
    first = expand(np.cumsum(sizes) - sizes, windows)
    return number, owner, first


def _split_hot(batches: Iterator[pa.RecordBatch], window: int, least: int) -> Iterator[pa.RecordBatch]:
    """Cut a crowded minimiser's strings into runs of windows that go to the same sub-bucket by their own words."""
    for batch in batches:
        for part in byte_slices(batch, "packed", 1_000_000):
            packed = part.column("packed").to_pylist()
            ways = np.asarray(part.column("crowd")) // least + 1
            minimiser, ids = np.asarray(part.column("minimiser")), np.asarray(part.column("string_id"))
            rows: list[tuple[int, int, int, int, bytes]] = []
            for k, p in enumerate(packed):
                words = p.split()
                n = len(words) - window + 1
                goes = [int.from_bytes(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=6).digest(), "big") % int(ways[k]) for i in range(n)]
                i = 0
                while i < n:
                    j = i
                    while j < n and goes[j] == goes[i]:
                        j += 1
                    rows.append((k, goes[i] + 1, i, j - i, b" ".join(words[i : j + window - 1])))
                    i = j
            at = np.array([r[0] for r in rows], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(minimiser[at]),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array(ids[at]),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array(np.asarray(part.column("copies"))[at]),
                    pa.array([r[4] for r in rows], pa.binary()),
                ],
                names=["minimiser", "sub", "string_id", "offset", "copies", "packed"],
            )


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Sort each bucket's windows and name the repeated ones: (minimiser, string_id, offset, windows)."""
    strings = ["minimiser", "sub", "string_id", "offset", "packed"]
    for run in key_runs(batches, ["minimiser", "sub"], 8_000):
        part = pa.Table.from_batches([run]).group_by(strings, use_threads=False).aggregate([("copies", "sum")])
        number, owner, first = _windows_of(part.column("packed").to_pylist(), window)
        if len(owner) == 0:
            continue
        copies = np.asarray(part.column("copies_sum"))[owner]
        rows = np.lib.stride_tricks.sliding_window_view(number, window)[first]
        mixed = _row_hash(rows)
        order = np.argsort(mixed, kind="stable")
        same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        # Rows of one hash that differ would part a run of equal rows; put such runs in full order.
        mixed = mixed[order]
        clash = np.flatnonzero((mixed[1:] == mixed[:-1]) & ~same)
        if len(clash):
            order = np.lexsort(rows.T[::-1])
            same = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
        group = np.concatenate([[0], np.cumsum(~same)])
        total = np.bincount(group, weights=np.minimum(copies[order], 2))
        again = np.zeros(len(owner), dtype=bool)
        again[order] = total[group] >= 2
        at = np.flatnonzero(again)
        if len(at) == 0:
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(at)]]))
        which = owner[at[begin]]
        base = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])[:-1]
        offset = at[begin] - base[which] + np.asarray(part.column("offset"))[which]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(part.column("minimiser"))[which]), pa.array(np.asarray(part.column("string_id"))[which]), pa.array(offset.astype(np.int32)), pa.array(size.astype(np.int32))],
            names=["minimiser", "string_id", "offset", "windows"],
        )


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            out = out * _BASE + rows[:, k].astype(np.uint64)
    return _spread(out)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8, crowd: int = 20_000) -> DataFrame:
    """``doc``, ``first`` (word), ``windows``: runs of windows whose words also start somewhere else.

    ``crowd`` strings under one minimiser are one bucket's work; of more, equal ones are counted
    first, and more than ``crowd`` distinct ones are split by content.  Texts shorter than a window, null ones and rows without a
    key have no spans (:func:`remove_repeats` handles null keys).
    """
    if not 1 <= gram <= window:
        raise ValueError("a minimiser lies within a window")
    n = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    found = materialise(source.mapInArrow(lambda b: _find(b, "doc", "text", window, gram), "doc long, minimiser long, cuts array<struct<first:int,windows:int>>"), "superkmers")
    repeated = found.groupBy("minimiser").agg(F.sum(F.size("cuts")).alias("all")).where("all > 1").select("minimiser")
    wanted = found.join(repeated, "minimiser").select("doc", F.transform("cuts", lambda c: F.struct(F.col("minimiser"), c["first"].alias("first"), c["windows"].alias("windows"))).alias("cuts"))
    wanted = wanted.groupBy("doc").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    cut = squeezed(source).join(wanted, "doc").select("doc", "small", "bytes", "cuts").mapInArrow(lambda b: _pack(b, window), "doc long, minimiser long, firsts array<int>, packed binary")
    packed = materialise(cut.withColumn("string_id", F.xxhash64("packed")), "packed")
    # Strings of a minimiser that occurs up to ``crowd`` times go to its bucket as they are.
    string = ["minimiser", F.lit(0).alias("sub"), "string_id", F.lit(0).alias("offset"), F.size("firsts").cast("long").alias("copies"), "packed"]
    busy = F.broadcast(materialise(packed.groupBy("minimiser").agg(F.sum(F.size("firsts")).alias("all")).where(F.col("all") > crowd).select("minimiser"), "busy"))
    calm = packed.join(busy, "minimiser", "left_anti").select(*string)
    # Of the others equal strings first: one row for each string, with how often it occurs.
    counted = packed.join(busy, "minimiser", "left_semi").select(*string).groupBy("minimiser", "sub", "string_id", "offset", "packed").agg(F.sum("copies").alias("copies"))
    counted = materialise(counted.select(*calm.columns), "strings")
    crowds = F.broadcast(materialise(counted.groupBy("minimiser").agg(F.count("*").alias("crowd")).where(F.col("crowd") > crowd), "crowds"))
    hot = counted.join(crowds, "minimiser").mapInArrow(lambda b: _split_hot(b, window, crowd), calm.schema)
    strings = calm.unionByName(counted.join(crowds, "minimiser", "left_anti").select(*calm.columns)).unionByName(hot)
    buckets = strings.repartition(n, "minimiser", "sub").sortWithinPartitions("minimiser", "sub")
    marks = buckets.mapInArrow(lambda b: _count(b, window), "minimiser long, string_id long, offset int, windows int")
    places = packed.select("doc", "minimiser", "firsts", "string_id")
    return places.join(marks, ["minimiser", "string_id"]).select("doc", F.explode("firsts").alias("first"), "offset", "windows").select("doc", (F.col("first") + F.col("offset")).alias("first"), "windows")


def _strip(batches: Iterator[pa.RecordBatch], window: int, rest: list[str], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, "bytes"):
            n_words, n_removed, digest, kept = [], [], [], []
            cuts = part.column("spans").to_pylist()
            for body, spans in zip(_texts(part), cuts, strict=True):
                words = body.split()
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["first"] + s["windows"] + window - 1 for s in spans], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_removed.append(n_words[-1] - len(words))
                line = b" ".join(words)
                digest.append(hashlib.sha256(line).hexdigest())
                if whole:
                    kept.append(line.decode("utf-8", "replace"))
            columns = [*(part.column(c) for c in rest), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.string())] if whole else []), names=[*rest, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if whole else [])])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = 8, with_text: bool = True) -> DataFrame:
    """Per document: key, ``n_words``, ``n_removed``, ``kept_sha256`` and, if asked, ``kept_text``.

    Each word covered by a window that also starts elsewhere (the same document
    included) is removed; windows are judged on the input.  Kept words are joined
    by one space.  Null texts have no words.  Each row must have its own key:
    rows with null or repeated keys are numbered apart, so all of them count.
    """
    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    odd = source.groupBy("doc").count().where("doc is null or count > 1").limit(1).count() > 0
    if odd:  # stable numbers of its own for every row
        source = materialise(source.withColumn("_key", F.col("doc")).withColumn("doc", F.monotonically_increasing_id()), "numbered")
    spans = repeated_spans(source, "doc", "text", window, gram).groupBy("doc").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    joined = squeezed(source).join(spans, "doc", "left").select(F.col("_key" if odd else "doc").alias(key), "small", "bytes", "spans")
    schema = joined.select(key).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    return joined.mapInArrow(lambda b: _strip(b, window, [key], with_text), schema)
