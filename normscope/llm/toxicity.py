"""Toxicity scores from subword-bag embeddings.

A word is the bag of itself and its character n-grams, each hashed to a row of an
embedding table; a document is the mean of its words; a linear softmax over that
mean gives the class.  Table and softmax are trained jointly, by gradient descent
in numpy, on a bounded sample of labelled rows.  A misspelt or inflected word
shares most of its n-grams with the word it comes from.

Training takes at most ``per_class`` documents of each class (those with the
smallest hashes of their ids); everything else covers all rows.  They are chosen by
ids and labels alone and fetched by a broadcast of the chosen ids, so no text is
shuffled but theirs; tasks turn them into subword bags, which are what the driver
gets (a bag has at most one entry for each row of the table, whatever the text's
length).  The class prior is put right afterwards from the counts over all labelled
documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, expand, no_cycle_search

#: A-Z become a-z; ASCII punctuation parts words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 32 < c < 127 and not chr(c).isalnum() else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dims: int = 6
    shortest: int = 3
    longest: int = 5
    epochs: int = 10
    padding: float = 60.0  # neutral words added to every text, so that few words decide little
    rate: float = 3.0
    out_rate: float = 0.2
    calm: float = 1e-8
    batch: int = 64
    per_class: int = 2_500  # documents of each class that training takes, at most
    threshold: float = 0.3
    seed: int = 7


def row_kind(s: Settings) -> str:
    return "<u2" if s.buckets <= 1 << 16 else "<i4"


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def subword_rows(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of every word, in a row, and how many each has.

    A word's rows are those of its character n-grams between boundary marks, and
    one of its own.  Hashes of all n-grams of all words are taken together.
    """
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    size = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    word_of, row_of = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, s.longest + 1):
            rolled = rolled[: len(codes) - n + 1] * _BASE + codes[n - 1 :] if len(codes) >= n else rolled[:0]
            if n >= s.shortest and len(rolled):
                on = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :])
                word_of.append(owner[on])
                row_of.append((rolled[on] + np.uint64(n)) * _BASE)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(int(size.max(initial=0)), _BASE)]))
        weighted = codes * power[np.arange(len(codes)) - first[owner]]
        whole = np.add.reduceat(weighted, first) if len(first) else weighted
        word_of.append(np.arange(len(words)))
        row_of.append((whole + np.uint64(1 << 40)) * _BASE)
    word, mixed = np.concatenate(word_of), np.concatenate(row_of)
    order = np.argsort(word, kind="stable")
    rows = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(s.buckets)).astype(np.int64)
    return rows[order], np.bincount(word, minlength=len(words))


def damped(counts: np.ndarray) -> np.ndarray:
    """What a word counts in its document's mean, by how often it occurs there: repeats add less and less."""
    return 1.0 + np.log(counts)


@no_cycle_search()
def document_bags(texts: list[str | None], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean subword bag of each text: table rows and their weights.  Words are hashed a part at a time, to bound memory."""
    numbers: dict[bytes, int] = {}
    docs = []
    for t in texts:
        ids, n = np.unique([numbers.setdefault(w, len(numbers)) for w in plain_words(t)], return_counts=True)
        worth = damped(n)
        docs.append((ids.astype(np.int32), (worth / (worth.sum() + s.padding)).astype(np.float32)))
    words = list(numbers)
    parts = [subword_rows(words[a : a + 20_000], s) for a in range(0, len(words), 20_000)]
    kind = row_kind(s)
    rows = np.concatenate([p[0].astype(kind) for p in parts]) if parts else np.zeros(0, dtype=kind)
    sizes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    at = np.cumsum(sizes) - sizes
    out = []
    for ids, share in docs:
        n = sizes[ids]
        found, inverse = np.unique(rows[expand(at[ids], n)], return_inverse=True)
        out.append((found, np.bincount(inverse, weights=np.repeat(share / np.maximum(n, 1), n), minlength=len(found)).astype(np.float32)))
    return out


@dataclass
class Model:
    settings: Settings
    weight: np.ndarray  # by table row: what it adds to the difference of the two classes' logits
    bias: float

    def word_weights(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        rows, sizes = subword_rows(words, self.settings)
        return np.add.reduceat(self.weight[rows], np.cumsum(sizes) - sizes) / sizes


def train(texts: list[str | None], labels: np.ndarray, prior: float, settings: Settings = Settings()) -> Model:
    """Fit table and softmax jointly; ``prior`` is the share of class 1 among all labelled documents."""
    return train_on_bags(document_bags(texts, settings), labels, prior, settings)


def train_on_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, settings: Settings = Settings()) -> Model:
    """:func:`train` on texts that are bags already."""
    s = settings
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1.0 / s.dims, 1.0 / s.dims, (s.buckets, s.dims)).astype(np.float32)
    out = rng.uniform(-1.0, 1.0, (s.dims, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen = np.zeros(s.buckets)
    counts = np.array([len(b[0]) for b in bags], dtype=np.int64)
    order = np.flatnonzero(counts)
    target = np.eye(2, dtype=np.float32)[labels.astype(int)]
    for epoch in range(s.epochs):
        rng.shuffle(order)
        fade = 1.0 - epoch / s.epochs
        for a in range(0, len(order), s.batch):
            part = order[a : a + s.batch]
            row = np.concatenate([bags[i][0] for i in part]).astype(np.int64)
            value = np.concatenate([bags[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), counts[part])
            cut = np.cumsum(counts[part]) - counts[part]
            mean = np.add.reduceat(table[row] * value[:, None], cut, axis=0)
            logits = mean @ out + bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = (chance - target[part]) / len(part)
            pull = error @ out.T
            grad_out = mean.T @ error
            grad = np.stack([np.bincount(row, weights=pull[owner, d] * value, minlength=s.buckets) for d in range(s.dims)], axis=1)
            # Rows move by their gradient over the size of those before it, so rare rows learn too; ``calm`` holds back the rarest.
            seen += (grad**2).mean(axis=1)
            table -= (s.rate * fade / np.sqrt(seen + s.calm))[:, None] * grad
            out -= s.out_rate * fade * grad_out
            bias -= s.out_rate * fade * error.sum(axis=0)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(s, (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0] + shift))


def chosen_keys(docs: DataFrame, labels: DataFrame, held_out, label: str, key: str, settings: Settings) -> tuple[DataFrame, float]:
    """``key``, ``label`` (0 or 1): at most ``per_class`` documents of each class, smallest hash of the key first; and the share of class 1 among all.

    Only keys and labels are read.  A key counts once, however many rows repeat it in either table; its label is
    the largest that it has.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label")).toDF("key", "label")
    known = docs.where(F.col(key).isNotNull() if held_out is None else F.col(key).isNotNull() & ~held_out).select(F.col(key).alias("key"))
    marked = marks.join(known, "key", "left_semi")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows: the classes are 0 and 1
    mixed = F.xxhash64(F.col("key").cast("string"))
    picks = [marked.where(F.col("label") == c).orderBy(mixed, "key").limit(settings.per_class) for c in (0, 1)]
    total = counts.get(0, 0) + counts.get(1, 0)
    return picks[0].unionByName(picks[1]), counts.get(1, 0) / total if total else 0.0


def _packed(values: np.ndarray) -> bytes:
    """Values as a zstd frame after their number of bytes."""
    return len(values.tobytes()).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.BinaryScalar, kind: str) -> np.ndarray:
    view = memoryview(data.as_buffer())
    return np.frombuffer(pa.decompress(view[8:], int.from_bytes(view[:8], "little"), codec="zstd", asbytes=True), dtype=kind)


def sampled_bags(docs: DataFrame, chosen: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """``key``, ``label``, ``rows`` (steps from one to the next) and ``shares`` (float32), both zstd: one subword bag for each chosen document.

    Rows that repeat a key count once, with the text that comes first.
    """
    kind = row_kind(settings)
    near = F.broadcast(chosen)  # at most 2 x ``per_class`` rows
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(near, "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1_000_000):
                bags = document_bags(part.column("text").to_pylist(), settings)
                rows = pa.array([_packed(np.diff(b[0].astype(kind), prepend=np.zeros(1, dtype=kind))) for b in bags], pa.binary())
                shares = pa.array([_packed(b[1].astype("<f4")) for b in bags], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), rows, shares], names=["key", "label", "rows", "shares"])

    return own.mapInArrow(run, f"key {dict(own.dtypes)['key']}, label int, rows binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, held_out=None, label: str = "toxic", key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Train on the documents that ``labels`` marks 0 or 1, without those where the column ``held_out`` is true."""
    chosen, prior = chosen_keys(docs, labels, held_out, label, key, settings)
    found = sampled_bags(docs, chosen, key, text, settings).toArrow()
    kind = row_kind(settings)
    order = np.argsort(np.asarray(found["key"]), kind="stable")
    target = np.asarray(found["label"], dtype=np.int64)[order]
    rows, shares = found["rows"], found["shares"]
    bags = [(np.cumsum(_unpacked(rows[i], kind), dtype=kind), _unpacked(shares[i], "<f4")) for i in order.tolist()]
    del found, rows, shares
    pa.default_memory_pool().release_unused()
    return train_on_bags(bags, target, prior, settings)


class Scorer:
    """Scores lists of texts; keeps the weights of words it has seen, up to a bound."""

    def __init__(self, model: Model, cache_words: int = 150_000):
        self.model, self.cache_words = model, cache_words
        self.known: dict[bytes, float] = {}

    @no_cycle_search()
    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > self.cache_words:
            self.known = {}
        known = self.known
        split = [Counter(plain_words(t)) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        known.update(zip(new, self.model.word_weights(new).tolist(), strict=True))
        sizes = np.array([len(words) for words in split])
        owner = np.repeat(np.arange(len(split)), sizes)
        worth = damped(np.fromiter((n for words in split for n in words.values()), dtype=np.float64, count=len(owner)))
        weight = np.fromiter((known[w] for words in split for w in words), dtype=np.float64, count=len(owner))
        total = np.bincount(owner, weights=worth * weight, minlength=len(split))
        logit = self.model.bias + total / (np.bincount(owner, weights=worth, minlength=len(split)) + self.model.settings.padding)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every whole text.  Null and empty texts get the model's bias.  No shuffle."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # buckets x 8 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(handle.value)
        for batch in batches:
            for part in byte_slices(batch, text, 1_000_000):
                values = scorer(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(values, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, score double")


def is_held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    """True where crc32(key as text) mod ``folds`` is ``fold``; false for null keys."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per document: key, ``held_out``, ``score``, ``predicted``; trained without the held-out fold.

    Without any label nothing is known to be toxic, and all scores are near zero.
    Every row is scored, rows with null or repeated keys too.
    """
    model = fit(docs, labels, is_held_out(key), key=key, text=text, settings=settings)
    scored = score(docs, model, key, text)
    return scored.select(key, is_held_out(key).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents that score below the threshold, with all their columns.  No shuffle of texts for scoring."""
    model = fit(docs, labels, is_held_out(key), key=key, text=text, settings=settings)
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(handle.value)
        for batch in batches:
            for part in byte_slices(batch, text, 1_000_000):
                clean = scorer(part.column(text).to_pylist()) < settings.threshold
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
