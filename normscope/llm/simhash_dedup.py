"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  The perfect
Golay code of length 23 puts every segment within three bits of exactly one code
word; the code words within four bits of a segment are its *near* words (one, or
six where the nearest is three bits away).  Two facts make them keys:

* segments one bit apart: the nearest word of either is a near word of the other;
* segments up to two bits apart share a near word (the nearest word of a segment
  halfway between them).

Four differing bits over three segments leave the two best segments with at most
two between them, so every pair within four bits meets under one of these keys:

* "home": the nearest words of two segments, against "probe": near words of both
  (covers 0+0, 0+1 and 1+1 errors);
* "exact": one whole segment and a near word of the next one (covers 0+2+2).

Fingerprints that meet are compared exactly; equal fingerprints are one node
throughout, and each bucket hands on only a spanning forest of its links.

:func:`near_duplicates` is for texts that share most of their shingles, which may
differ in a sixth of their bits, more than those keys are complete for.  It takes
192 bits in nine segments; the near words of two segments together are a key, for
six pairs of segments, and two texts meet if in one of these pairs they share a near
word of both.  Pairs that meet and have near fingerprints make groups; of these only
spanning forests are needed.  Within a group every pair is verified by the Jaccard
similarity of its shingles, exactly: a group's texts are dealt into blocks, a task holds two
blocks' shingle sets, and a spanning forest of its links goes on, so no list of pairs is made.

Crowded buckets, as a small sample tells them, are dealt into blocks, and each pair
of blocks is a part of its own; results do not depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_counted
from .common import HELD_EDGES, Forest, byte_slices, connected_components, contract, key_runs, materialise, shuffle_partitions

#: Generator polynomial of the binary Golay code (fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_POLYNOMIAL = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
HOME, PROBE = 0, 1
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY_POLYNOMIAL << (bit - 11)), rest)
    return rest


def _error_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight three or less, and the five of weight four (zero: none)."""
    single = 1 << np.arange(23)
    pick = [np.array([0])]
    for weight in range(1, 5):
        grown = (pick[-1][:, None] | single[None, :]).ravel()
        pick.append(np.unique(grown[np.bitwise_count(grown) == weight]))
    nearest = np.zeros(2048, dtype=np.int64)
    for errors in pick[:4]:
        nearest[_syndromes(errors)] = errors
    four = np.zeros((2048, 5), dtype=np.int64)
    syndrome = _syndromes(pick[4])
    order = np.argsort(syndrome, kind="stable")
    values, first, count = np.unique(syndrome[order], return_index=True, return_counts=True)
    for s, a, n in zip(values, first, count, strict=True):
        four[s, :n] = pick[4][order[a : a + n]]
    return nearest, four


_NEAREST, _FOUR = _error_tables()


def near_codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code word of each 23-bit segment, and an (n, 6) array of those within four bits (-1: none)."""
    syndrome = _syndromes(segments)
    nearest = segments ^ _NEAREST[syndrome]
    four = _FOUR[syndrome]
    others = np.where(four > 0, segments[:, None] ^ four, -1)
    return nearest, np.concatenate([nearest[:, None], others], axis=1)


def _shingles(text: str | None, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text in a line, and where each shingle begins and ends there; texts with fewer words have one, those without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return b"", [], []
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - shingle + 1)
    return b" ".join(words), begin[:n].tolist(), (begin + size)[-n:].tolist()


def _majority(hashes: np.ndarray) -> np.ndarray:
    """(bytes,): the bits set in more than half of (n, bytes) hashes."""
    ones = np.zeros(hashes.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes))


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of a text's word shingles; no words: zero."""
    import xxhash

    line, first, last = _shingles(text, shingle)
    if not first:
        return 0
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[i:j], 42) for i, j in zip(first, last, strict=True)]), dtype=np.uint8)
    return int.from_bytes(_majority(hashes.reshape(-1, 8)).tobytes(), "big")


def wide_fingerprint(text: str | None, shingle: int) -> tuple[np.ndarray, int, int]:
    """Three words of 64 majority bits of a text's different shingles, a digest of their set, and how many there are; no words: zeros.

    Shingles count once, so a line that repeats decides nothing.  The bits come from 128-bit hashes and a mix of their halves.
    """
    import xxhash

    line, first, last = _shingles(text, shingle)
    if not first:
        return np.zeros(3, dtype=np.uint64), 0, 0
    digest = xxhash.xxh3_128_digest
    hashes = np.unique(np.frombuffer(b"".join([digest(line[i:j]) for i, j in zip(first, last, strict=True)]), dtype="V16"))
    halves = hashes.view(np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        third = (halves[:, 0] ^ (halves[:, 1] >> np.uint64(29))) * _PRIME + halves[:, 1]
        third ^= third >> np.uint64(32)
        third *= _PRIME
    return _majority(np.column_stack([halves, third]).view(np.uint8)).view(np.uint64), xxhash.xxh3_64_intdigest(hashes.tobytes()), len(hashes)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles."""
    import xxhash

    line, first, last = _shingles(text, shingle)
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(line[i:j]) for i, j in zip(first, last, strict=True)]), dtype=np.int64))


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``key``, ``fp``: the fingerprint of each whole text as a signed long.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text):
                values = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} long, fp long")


def _mix(*parts: np.ndarray) -> np.ndarray:
    """One key of several small numbers, packed injectively."""
    out = parts[0].astype(np.uint64)
    with np.errstate(over="ignore"):
        for p in parts[1:]:
            out = out << np.uint64(23) | p.astype(np.uint64)
    return out.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            fp = np.asarray(batch.column("fp"))
            bits = fp.view(np.uint64)
            n = len(fp)
            rows = np.arange(n)
            key, owner, role = [], [], []
            cut = [((bits >> np.uint64(a)) & np.uint64((1 << size) - 1)).astype(np.int64) for a, size in SEGMENTS]
            near = [near_codewords(s) for s in cut]
            # Code words are systematic in their 12 upper bits; those name them.
            for p in range(3):
                q = (p + 1) % 3
                kind = np.full(n, p)
                key.append(_mix(kind, near[p][0] >> 11, near[q][0] >> 11))
                owner.append(rows)
                role.append(np.full(n, HOME, dtype=np.int8))
                for x in range(6):
                    for y in range(6):
                        a, b = near[p][1][:, x], near[q][1][:, y]
                        on = np.flatnonzero((a >= 0) & (b >= 0) & ((x > 0) | (y > 0)))
                        key.append(_mix(kind[on], a[on] >> 11, b[on] >> 11))
                        owner.append(on)
                        role.append(np.full(len(on), PROBE, dtype=np.int8))
                    b = near[q][1][:, x]
                    on = np.flatnonzero(b >= 0)
                    key.append(_mix(kind[on] + 3, cut[p][on], b[on] >> 11))
                    owner.append(on)
                    role.append(np.full(len(on), HOME, dtype=np.int8))
            at_row = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key)), pa.array(fp[at_row]), pa.array(np.concatenate(role))],
                names=["bucket", "fp", "role"],
            )


def _dealt(prints: DataFrame, keyed: DataFrame, keys_of, schema: str, crowd: int, every: int = 64, name: str = "fp") -> DataFrame:
    """The rows of ``keyed`` with ``side`` and ``part``: one part for a bucket, but a part for each pair of blocks of a crowded one.

    Buckets are crowded if the keys of one fingerprint in ``every`` say that they hold more
    than ``crowd`` rows and more than a quarter of a partition's share; so they are few.
    """
    n = shuffle_partitions(prints.sparkSession)
    rows = prints.count()
    sample = prints.where(F.pmod(F.xxhash64(name, F.lit("sample")), F.lit(every)) == 0).mapInArrow(keys_of, schema)
    share = max(crowd, rows // (4 * n)) // every
    hot = sample.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > max(share, 8)).select("bucket", F.ceil(F.col("rows") * every / crowd).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    sided = keyed.join(F.broadcast(hot), "bucket", "left").withColumn("side", F.pmod(F.xxhash64(name), blocks).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: (F.least("side", o) * blocks + F.greatest("side", o)).cast("int"))
    return sided.withColumn("part", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(parts))).drop("blocks")


def _distance(words: list[np.ndarray], i, j) -> np.ndarray:
    """Differing bits of the fingerprints at i and j, over all their words."""
    return sum(np.bitwise_count(w[i] ^ w[j]) for w in words)


def _alike(size: np.ndarray, i, j, least: float) -> np.ndarray:
    """Whether the sets at i and j are near enough in size to have a Jaccard similarity of ``least``."""
    return np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j])


def _links(batches: Iterator[pa.RecordBatch], most: int, words: tuple[str, ...] = ("fp",), name: str = "fp", least: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of fingerprints within ``most`` bits in each part: all of them in small parts, else a spanning forest of nearest pairs.

    ``words``: the columns that make a fingerprint; ``name``: the column that names its owner.
    Without a column ``role`` all rows are home ones.  With ``least``, pairs whose
    column ``size`` rules that similarity out are left out; no pair of that similarity is.
    """
    for part in key_runs(batches, ["bucket", "part"], 200_000):
        bucket, piece, side = (np.asarray(part.column(c)) for c in ("bucket", "part", "side"))
        prints = [np.asarray(part.column(c)).view(np.uint64) for c in words]
        fp = np.asarray(part.column(name)).view(np.uint64)
        sizes = np.asarray(part.column("size")) if least else np.ones(len(fp), dtype=np.int32)
        role = np.asarray(part.column("role")) if "role" in part.schema.names else np.full(len(fp), HOME, dtype=np.int8)
        edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(piece) != 0)) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(bucket)]])
        size = last - first
        run = np.repeat(np.arange(len(size)), size)
        left, right = [], []
        small = size <= 32
        rows = np.flatnonzero(small[run])
        for step in range(1, int(size[small].max()) if small.any() else 1):
            i = rows[rows + step < last[run[rows]]]  # rows are sorted by role, so the first of a pair is the home one if either is
            rows = i
            i = i[role[i] == HOME]
            i = i[_alike(sizes, i, i + step, least)]
            i = i[_distance(prints, i, i + step) <= most]
            left.append(i)
            right.append(i + step)
        for k in np.flatnonzero(~small):
            own = slice(first[k], last[k])
            a, b = _forest_of([w[own] for w in prints], side[own], most, fp[own], sizes[own], least)
            left.append(a + first[k])
            right.append(b + first[k])
        if left:
            u, v = fp[np.concatenate(left)].view(np.int64), fp[np.concatenate(right)].view(np.int64)
            on = u != v
            pairs = np.unique(np.stack([np.maximum(u[on], v[on]), np.minimum(u[on], v[on])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _forest_of(words: list[np.ndarray], side: np.ndarray, most: int, names: np.ndarray | None = None, sizes: np.ndarray | None = None, least: float = 0.0, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning pairs of a large part, nearest ones first, found block by block; of two sides, only pairs across are compared.

    Blocks already joined throughout are not compared again.
    """
    names, sizes = words[0] if names is None else names, np.ones(len(side), dtype=np.int32) if sizes is None else sizes
    order = np.lexsort((names, *words, side))
    keep = np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (names, *words, side)], axis=0)])
    where = order[keep]
    words, side, sizes, count = [w[where] for w in words], side[where], sizes[where], int(keep.sum())
    cut = int(np.searchsorted(side, side[-1])) if side[0] != side[-1] else 0
    forest = Forest(count)
    out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(0, cut or count, block):
        a_end = min(a + block, cut or count)
        for b in range(cut or a, count, block):
            roots = forest.roots()
            ra, rb = roots[a:a_end], roots[b : b + block]
            if ra.min() == ra.max() == rb.min() == rb.max():
                continue
            far = _distance(words, (slice(a, a_end), None), (None, slice(b, b + block))).astype(np.int64)
            if least:
                far[~_alike(sizes, (slice(a, a_end), None), (None, slice(b, b + block)), least)] = most + 1
            for bits in range(most + 1):
                i, j = np.nonzero((far == bits) & (ra[:, None] != rb[None, :]))
                if len(i):
                    used = forest.join(i + a, j + b)
                    out_a.append(i[used] + a)
                    out_b.append(j[used] + b)
                    roots = forest.roots()
                    ra, rb = roots[a:a_end], roots[b : b + block]
    return where[np.concatenate(out_a)], where[np.concatenate(out_b)]


def _named_components(nodes: DataFrame, edges: DataFrame, name: str, contracted: bool = False) -> DataFrame:
    """``fp``, ``component_id``: the smallest ``node`` of each fingerprint's component; large components are counted first and not shuffled."""
    placed = materialise(nodes.join(connected_components(edges, name, contracted=contracted).toDF("fp", "component"), "fp"), "placed")
    names = placed.groupBy("component").agg(F.min("node").alias("smallest"), F.count("*").alias("rows"))
    found = join_counted(placed, materialise(names, "names"), "component", "rows", placed.count()).select("fp", "smallest")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("smallest", "node").alias("component_id"))


def _with_classes(prints: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """``prints`` with their ``component_id`` (null where there is none); fingerprints that very many rows have are not shuffled."""
    counted = materialise(prints.groupBy(name).agg(F.count("*").alias("rows")).join(classes, name, "left"), "classes")
    total = counted.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_counted(prints, counted, name, "rows", total)


def fingerprint_components(prints: DataFrame, key: str = "doc_id", most: int = 4, crowd: int = 20_000) -> DataFrame:
    """``fp``, ``component_id`` (smallest key reachable by links of at most ``most`` differing bits), for each distinct fingerprint.

    ``most`` is 4 or less; the keys above are complete up to that.
    """
    if not 0 <= most <= 4:
        raise ValueError("the keys find pairs of up to four differing bits")
    n = shuffle_partitions(prints.sparkSession)
    schema = "bucket long, fp long, role byte"
    nodes = materialise(prints.groupBy("fp").agg(F.min(key).alias("node")), "fingerprints")
    named = nodes.where("node is not null").select("fp")
    keyed = _dealt(named, named.repartition(n, "fp").mapInArrow(_keys, schema), _keys, schema, crowd)
    met = keyed.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "role")
    edges = met.mapInArrow(lambda batches: _links(batches, most), "u long, v long")
    return _named_components(nodes, edges, "simhash")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row per document: key, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    A-Z are lower-cased, words are runs of anything but ASCII white space,
    shingles are counted with repeats; texts with fewer words have one shingle,
    null and empty texts the fingerprint zero, which links like any other.
    Rows with a repeated key are all kept.  A null key is no node: such a row
    gets its fingerprint's component (null if no other row has the fingerprint).
    """
    prints = materialise(fingerprints(docs, key, text, shingle), "simhash")
    classes = fingerprint_components(prints, key, most)
    return _with_classes(prints, classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Segments of a wide fingerprint, as (word, first bit, bits), and the pairs of them that make keys.
WIDE_SEGMENTS = tuple((w, *s) for w in range(3) for s in SEGMENTS)
WIDE_PAIRS = ((0, 1), (2, 3), (4, 5), (6, 7), (8, 0), (1, 2))
#: Pairs whose first 128 bits differ in more than this are not verified: at a Jaccard similarity of 0.8 some twenty differ, give or take four.
WIDE_MOST = 32


WIDE_COLUMNS = ("fp", "second", "name", "size")


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of wide fingerprints: near words meet near words, so there are no roles."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            words = [np.asarray(batch.column(c)).view(np.uint64) for c in ("fp", "second", "third")]
            near = [near_codewords(((words[w] >> np.uint64(a)) & np.uint64((1 << size) - 1)).astype(np.int64))[1] for w, a, size in WIDE_SEGMENTS]
            key, owner = [], []
            for k, (p, q) in enumerate(WIDE_PAIRS):
                for x in range(6):
                    for y in range(6):
                        a, b = near[p][:, x], near[q][:, y]
                        on = np.flatnonzero((a >= 0) & (b >= 0))
                        key.append(_mix(np.full(len(on), k), a[on] >> 11, b[on] >> 11))
                        owner.append(on)
            rows = np.concatenate(owner)
            kept = [np.asarray(batch.column(c))[rows] for c in WIDE_COLUMNS]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), *map(pa.array, kept)], names=["bucket", *WIDE_COLUMNS])


#: Texts of a block of a group, at least and at most (between them a sixteenth of the group), and shingles of a block.
BLOCK_TEXTS, MOST_TEXTS, BLOCK_GRAMS = 128, 1_024, 1_000_000


def _common(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right): how many values the sets of two rows have in common, counted by matrix products over slices of the values that several rows have."""
    order = np.argsort(values, kind="stable")
    place = np.cumsum(np.concatenate([[False], np.diff(values[order]) != 0])) if len(values) else np.zeros(0, dtype=np.int64)
    several = np.bincount(place) > 1 if len(values) else np.zeros(0, dtype=bool)
    on = several[place]
    column, row = (np.cumsum(several) - 1)[place[on]], owner[order[on]]
    n = len(left) if left is right else len(left) + len(right)
    width = max(256, 4_000_000 // max(1, n))
    common = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        marks = np.zeros((int(max(left.max(), right.max())) + 1, min(width, int(several.sum()) - at)), dtype=np.float32)
        marks[row[lo:hi], column[lo:hi] - at] = 1.0
        common += (marks[left] @ marks[right].T).astype(np.int64)
    return common


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per part of a group, a spanning forest (u, v) of its links; every pair is compared: of two blocks those across, else all."""
    for run in key_runs(batches, ["component", "part"], 500):
        component, part, side, name = (np.asarray(run.column(c)) for c in ("component", "part", "side", "name"))
        size = np.asarray(pc.list_value_length(run.column("grams")), dtype=np.int64)
        ends, grams = np.cumsum(size), np.asarray(pc.list_flatten(run.column("grams")))
        edges = np.flatnonzero((np.diff(component) != 0) | (np.diff(part) != 0)) + 1
        u, v = [], []
        for a, b in zip([0, *edges], [*edges, len(name)], strict=True):
            if b - a < 2:
                continue
            own = np.arange(b - a)
            first = side[a:b] == side[a]
            left, right = (own, own) if first.all() else (own[first], own[~first])
            both = _common(grams[ends[a] - size[a] : ends[b - 1]], np.repeat(own, size[a:b]), left, right)
            link = both >= least * (size[a:b][left][:, None] + size[a:b][right][None, :] - both)
            i, j = np.nonzero(np.triu(link, 1) if left is right else link)
            i, j = left[i], right[j]
            used = Forest(b - a).join(i, j)
            u.append(name[a:b][i[used]])
            v.append(name[a:b][j[used]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, crowd: int = 20_000, texts: int = BLOCK_TEXTS) -> DataFrame:
    """Per row of ``docs``: key and ``component_id``, the smallest key reachable by links.

    Texts link if the sets of their word shingles (A-Z lower-cased) have a Jaccard
    similarity of ``least`` or more; that is exact for all pairs of a group, and groups hold what is
    reachable by pairs that meet.  Of near copies, pairs meet in about 95 of 100 cases at 0.8 and
    nearly always above 0.9.  Texts of the same shingle set, told by its digest, are one node, whatever repeats
    in them; every other link is verified.  Texts without words are copies of each other and link with
    nothing else.  Null keys are no nodes: such rows get the component of their text
    (null if no other row has it).
    """
    n = shuffle_partitions(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    names = [key, "fp", "second", "third", "name", "size"]

    def print_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text):
                found = [wide_fingerprint(t, shingle) for t in batch.column(text).to_pylist()]
                words = np.array([f[0] for f in found]).reshape(-1, 3).view(np.int64)
                digest, size = np.array([f[1] for f in found], dtype=np.uint64).view(np.int64), np.array([f[2] for f in found], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(np.ascontiguousarray(words[:, c])) for c in range(3)), pa.array(digest), pa.array(size)], names=names)

    prints = materialise(docs.select(key, text).mapInArrow(print_all, f"{key} {kind}, fp long, second long, third long, name long, size int"), "wide")
    each = materialise(prints.where(F.col(key).isNotNull()).groupBy("name").agg(F.min(key).alias("node"), *(F.min(c).alias(c) for c in ("fp", "second", "third", "size"))), "fingerprints")
    nodes = each.select(F.col("name").alias("fp"), "node")
    own, schema = each.where("size > 0").select("fp", "second", "third", "name", "size"), "bucket long, fp long, second long, name long, size int"
    keyed = _dealt(own, own.repartition(n, "name").mapInArrow(_wide_keys, schema), _wide_keys, schema, crowd, name="name")
    met = keyed.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part")
    # Only what is reachable matters here, so each bucket hands on a spanning forest; verifying is done within the groups.
    meets = met.mapInArrow(lambda batches: contract(_links(batches, WIDE_MOST, ("fp", "second"), "name", least), HELD_EDGES), "u long, v long")
    placed = materialise(connected_components(meets, "meets", contracted=True).withColumnRenamed("node", "name").join(each.select("name", "node", "size"), "name"), "groups")
    block = F.greatest(F.lit(texts), F.least(F.lit(MOST_TEXTS), F.ceil(F.col("rows") / 16)))
    blocks = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    counted = materialise(placed.groupBy("component").agg(F.count("*").alias("rows"), F.sum("size").alias("grams")).select("component", "rows", blocks.alias("_blocks")), "counted")
    # Shingle sets of the texts in groups: found by key, told from others of that key by their digest.
    many = placed.count()
    wanted = join_counted(placed, counted, "component", "rows", many).select(F.col("node").alias(key), F.col("name").alias("_name"), F.col("component").alias("_component"), "_blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text):
                texts = batch.column(text).to_pylist()
                digests = np.array([wide_fingerprint(t, shingle)[1] for t in texts], dtype=np.uint64).view(np.int64)
                at = np.flatnonzero(digests == np.asarray(batch.column("_name")))
                grams = pa.array([shingle_set(texts[k], shingle) for k in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in ("_component", "_blocks", "_name")), grams], names=["component", "blocks", "name", "grams"])

    chosen = wanted if many > MOST_BROADCAST else F.broadcast(wanted)
    found = docs.select(F.col(key), F.col(text)).join(chosen, key).select(text, "_component", "_blocks", "_name").mapInArrow(sets, "component long, blocks int, name long, grams array<long>")
    side = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.least("side", o).cast("long") * F.col("blocks") + F.greatest("side", o)).cast("long"))
    dealt = found.withColumn("side", side).withColumn("part", F.explode(parts)).select("component", "part", "side", "name", "grams")
    units = dealt.repartition(n, "component", "part").sortWithinPartitions("component", "part", "side")
    links = units.mapInArrow(lambda batches: contract(_verified(batches, least), HELD_EDGES), "u long, v long")
    classes = _named_components(nodes, links, "simhash", contracted=True).withColumnRenamed("fp", "name")
    return _with_classes(prints, classes, "name").select(key, "component_id")


#: Keys are broadcast up to this number (8 bytes each, some 40 in the join's table); beyond it they are joined by a shuffle.
MOST_BROADCAST = 500_000


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The documents whose key is the smallest of their near-duplicates' (:func:`near_duplicates`); all columns stay.

    Of rows that repeat a key all stay if one of them does; rows with a null key all
    stay.  The keys that go are counted and sent to the texts if they are few enough.
    """
    parts = near_duplicates(docs, key, text, shingle, least)
    gone = materialise(parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col("component_id") == F.col(key)).alias("stays")).where("not stays").select(key), "gone")
    return docs.join(gone if gone.count() > MOST_BROADCAST else F.broadcast(gone), key, "left_anti").select(*docs.columns)
