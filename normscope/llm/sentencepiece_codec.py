"""SentencePiece encoding and decoding in batched numpy.

Distinct words of a part are grouped by length; all words of one length advance
together.  Hashes of all their substrings probe the sorted hashes of the pieces,
and for every end position a vectorised maximum over the pieces that end there
stores a back-pointer.

The recursion covers both kinds of model:

* unigram: the maximum of (best score of the prefix + score of the piece);
* BPE: a sum of scores does not give a BPE model's pieces, so a candidate counts
  only if it can follow the last piece of its prefix's own encoding.  A row of
  pieces is the BPE encoding of a text exactly if each neighbouring pair is the
  encoding of its two pieces' text, so exactly one candidate remains at each
  position, and the maximum finds it.  Whether a pair holds is found by undoing
  both pieces' merges, latest first, and looking for an earlier merge across the
  boundary; this too runs on whole arrays.

A long run without spaces is one word.  Under BPE its overlapping windows advance
together, as words do; two windows are joined where both have a boundary and the
pieces beside it follow each other, which by the rule above gives the encoding of the
whole.  Under unigram it is cut between characters that no piece holds side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Numbered, byte_slices, expand, no_cycle_search

SPACE = "▁"
#: Types of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)  # odd, so no two hashes meet; spreads them over the leading bits
_SLOT_SHIFT = np.uint64(64 - 19)
_FAR = np.int64(1 << 60)
_UNKNOWN_CHARACTER = -2
#: Words of more characters than this are cut into windows, which overlap by the second number.
LONG, WINDOW, OVERLAP = 2_000, 512, 128


def _fields(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(number, wire type, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, kind, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield tag >> 3, kind, data[at : at + n]
            at += n


class PieceModel:
    """Pieces, scores and settings of a ``.model`` file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, types = [], []
        self.kind, self.dummy_prefix, charsmap, trims = 1, True, b"", True
        self.suffix_space = False
        for number, _, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                types.append(kind)
            elif number == 2:
                for n, _, v in _fields(value):
                    if n == 3:
                        self.kind = v
                    elif n == 24:
                        self.suffix_space = bool(v)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        trims = bool(v)
        self.scores, self.types = np.array(scores), np.array(types)
        if charsmap or trims or self.suffix_space or USER_DEFINED in types:
            raise NotImplementedError("only models without text rewriting and user-defined pieces are supported")
        if self.kind not in (1, 2):
            raise NotImplementedError("only unigram and BPE models are supported")
        if any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, types, strict=True) if t == NORMAL):
            raise NotImplementedError("pieces that go on after a space are not supported")
        self.byte_id = np.full(256, -1, dtype=np.int64)
        for i in np.flatnonzero(self.types == BYTE):
            self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.unknown_id = int(np.flatnonzero(self.types == UNKNOWN)[0])


class Codec:
    """Encodes lists of texts to flat piece ids, and back.

    ``cache_words`` bounds the words kept between parts; beyond it the cache is
    emptied (results never depend on it).
    """

    def __init__(self, model: PieceModel, cache_words: int = 200_000):
        self.model, self.cache_words = model, cache_words
        normal = np.flatnonzero(model.types == NORMAL)
        text = [model.pieces[i] for i in normal]
        self.longest = max(map(len, text))
        self.power = np.ones(self.longest * 2 + 2, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, len(self.power)):
                self.power[i] = self.power[i - 1] * _BASE
        hashes = self._hash_all(text)
        with np.errstate(over="ignore"):
            mixed = hashes * _MIX
        order = np.argsort(mixed)
        keys = mixed[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # Where in the sorted keys those of each leading bit pattern begin, and how many there are.
        slots = 1 << (64 - int(_SLOT_SHIFT))
        self.slot_size = np.bincount((keys >> _SLOT_SHIFT).astype(np.int64), minlength=slots).astype(np.int8)
        self.slot_at = (np.cumsum(self.slot_size, dtype=np.int64) - self.slot_size).astype(np.int32)
        self.keys = np.concatenate([keys, np.zeros(int(self.slot_size.max()), dtype=np.uint64)])
        self.key_piece = normal[order].astype(np.int32)
        n = len(model.pieces)
        self.piece_hash, self.piece_len = np.zeros(n, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
        self.piece_hash[normal], self.piece_len[normal] = hashes, [len(t) for t in text]
        if model.kind == 2:
            self._learn_merges(normal)
        else:
            self.bigrams = np.unique(np.array([ord(a) << 32 | ord(b) for p in text for a, b in zip(p, p[1:], strict=False)], dtype=np.uint64))
        singles = {p for p in text if len(p) == 1}
        #: Characters that no piece holds are pieces of their own whatever surrounds them, so words may be cut there.
        cuts = "".join(re.escape(c) for c in "\n\t\r" if c not in singles)
        self.words = re.compile(f"{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+" + (f"|[{cuts}]" if cuts else ""))
        pool = [b"" if t in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(model.pieces, model.types.tolist(), strict=True)]
        self.pool = np.frombuffer(b"".join(pool), dtype=np.uint8)
        self.pool_len = np.array([len(p) for p in pool], dtype=np.int64)
        self.pool_at = np.cumsum(self.pool_len) - self.pool_len
        self._forget()

    def _hash_all(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, t in enumerate(texts):
                h = np.uint64(0)
                for c in t:
                    h = h * _BASE + np.uint64(ord(c) + 1)
                out[k] = h
        return out

    def _probe(self, hashes: np.ndarray, lengths) -> np.ndarray:
        """Piece ids of the substrings with these hashes and lengths, -1 for none."""
        with np.errstate(over="ignore"):
            hashes = hashes * _MIX
        slot = (hashes >> _SLOT_SHIFT).astype(np.int32)
        out = np.full(len(hashes), -1, dtype=np.int32)
        live = np.flatnonzero(self.slot_size[slot])  # most substrings end here
        wanted, at = hashes[live], self.slot_at[slot[live]]
        hit = np.full(len(live), -1, dtype=np.int64)
        for step in range(int(self.slot_size.max())):
            hit = np.where(self.keys[at + step] == wanted, at + step, hit)
        piece = np.where(hit >= 0, self.key_piece[hit], -1)
        size = lengths if np.isscalar(lengths) else lengths[live]
        out[live] = np.where(self.piece_len[piece] == size, piece, -1)
        return out

    # -- BPE ---------------------------------------------------------------

    def _learn_merges(self, normal: np.ndarray) -> None:
        """Rank of every piece and the two pieces that its last merge joins."""
        m = self.model
        score = {m.pieces[i]: m.scores[i] for i in normal}
        ids = {m.pieces[i]: i for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        n = len(m.pieces)
        self.rank, self.left, self.right = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.combined_rank = np.full(n + 1, _FAR)
        self.usable = np.zeros(n, dtype=bool)
        for p, i in ids.items():
            self.combined_rank[i] = ranks[score[p]]
            parts, last = list(p), None
            while len(parts) > 1:
                best = None
                for k in range(len(parts) - 1):
                    s = score.get(parts[k] + parts[k + 1])
                    if s is not None and (best is None or s > best[0]):
                        best = (s, k)
                if best is None:
                    break
                k = best[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                self.usable[i] = True
                if last:
                    self.rank[i], self.left[i], self.right[i] = ranks[score[p]], ids.get(last[0], -1), ids.get(last[1], -1)
        # Characters that are no pieces themselves can still be merged; such a model needs the plain algorithm.
        if (self.left[self.rank >= 0] < 0).any() or (self.right[self.rank >= 0] < 0).any():
            raise NotImplementedError("a piece is made of characters that are no pieces")

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether [a, b] is the encoding of the text of a and b; a < 0: a start or an unknown character."""
        ok = np.ones(len(a), dtype=bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[at], b[at]
        bound = np.full(len(at), _FAR)
        while len(at):
            with np.errstate(over="ignore"):
                joined = self.piece_hash[a] * self.power[self.piece_len[b]] + self.piece_hash[b]
            across = self.combined_rank[self._probe(joined, self.piece_len[a] + self.piece_len[b])]
            ra, rb = self.rank[a], self.rank[b]
            bad = across < bound
            ok[at[bad]] = False
            on = np.flatnonzero(~bad & ((ra >= 0) | (rb >= 0)))
            at, a, b, ra, rb = at[on], a[on], b[on], ra[on], rb[on]
            first = ra > rb  # the latest merge is undone first; of equal ones the right-hand one was later
            bound = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    # -- the lattice -------------------------------------------------------

    def _lattice(self, codes: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each of n words, given as an (n, length) array of code points."""
        n, length = codes.shape
        hashes = np.zeros((length + 1, n), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(length):
                hashes[i + 1] = hashes[i] * _BASE + (codes[:, i].astype(np.uint64) + np.uint64(1))
        reach = min(self.longest, length)
        pieces = np.full((reach + 1, length + 1, n), -1, dtype=np.int32)  # by length and end
        for size in range(1, reach + 1):
            with np.errstate(over="ignore"):
                sub = hashes[size:] - hashes[:-size] * self.power[size]
            pieces[size, size:] = self._probe(sub.ravel(), size).reshape(sub.shape)
        bpe = self.model.kind == 2
        if bpe:
            pieces[(pieces >= 0) & ~self.usable[pieces]] = -1
        unknown = pieces[1] < 0
        unknown[0] = False
        pieces[1][unknown] = _UNKNOWN_CHARACTER
        last = np.full((length + 1, n), -1, dtype=np.int64)
        back = np.zeros((length + 1, n), dtype=np.int64)
        best = np.zeros((length + 1, n), dtype=np.float32)  # as the library adds
        floor = np.float32(self.model.scores[self.model.types == NORMAL].min() - 10.0)  # an unknown character's score
        for end in range(1, length + 1):
            sizes = np.arange(1, min(reach, end) + 1)
            here = pieces[sizes, end]  # (sizes, n)
            k, word = np.nonzero(here != -1)
            piece = here[k, word].astype(np.int64)
            score = np.full(here.shape, -np.inf, dtype=np.float32)
            if bpe:
                good = self._follows(last[end - sizes[k], word], piece)
                score[k[good], word[good]] = 0.0
            else:
                score[k, word] = best[end - sizes[k], word] + np.where(piece >= 0, self.model.scores[np.maximum(piece, 0)].astype(np.float32), floor)
            choice = len(sizes) - 1 - np.argmax(score[::-1], axis=0)  # of equal ones the longest piece
            every = np.arange(n)
            best[end], last[end], back[end] = score[choice, every], here[choice, every], sizes[choice]
        ends = np.full(n, length)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        open_words = np.arange(n)
        while len(open_words):
            steps.append((open_words, ends[open_words]))
            ends[open_words] -= back[ends[open_words], open_words]
            open_words = open_words[ends[open_words] > 0]
        word = np.concatenate([s[0] for s in steps])
        end = np.concatenate([s[1] for s in steps])
        order = np.lexsort((end, word))
        return word[order], last[end, word][order], end[order]

    def _long_word(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one long word (code points) and where each ends."""
        if self.model.kind == 2:
            return self._from_windows(codes)
        pair = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        joined = np.isin(pair, self.bigrams)
        parts = np.split(codes, np.flatnonzero(~joined) + 1)
        found, ends, at = [], [], 0
        sizes = np.array([len(p) for p in parts])
        by_size: dict[int, tuple[np.ndarray, ...]] = {}
        place = np.zeros(len(parts), dtype=np.int64)
        for size in np.unique(sizes):  # parts of one length advance together
            own = np.flatnonzero(sizes == size)
            place[own] = np.arange(len(own))
            word, piece, end = self._lattice(np.stack([parts[i] for i in own]))
            by_size[int(size)] = (np.searchsorted(word, np.arange(len(own) + 1)), piece, end)
        for i, size in enumerate(sizes.tolist()):
            cut, piece, end = by_size[size]
            a, b = cut[place[i]], cut[place[i] + 1]
            found.append(piece[a:b])
            ends.append(end[a:b] + at)
            at += size
        return np.concatenate(found), np.concatenate(ends)

    def _from_windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A BPE word from windows; where two cannot be joined, each starts where the one before ended."""
        size = WINDOW + OVERLAP
        count = max(1, -(-(len(codes) - OVERLAP) // WINDOW))
        full = count - 1  # the last one has a length of its own
        word, piece, end = self._lattice(np.lib.stride_tricks.sliding_window_view(codes, size)[: full * WINDOW : WINDOW]) if full else (np.zeros(0, dtype=np.int64),) * 3
        cut = np.searchsorted(word, np.arange(full + 1))
        _, tail, tail_end = self._lattice(codes[None, full * WINDOW :])
        pieces = [piece[a:b] for a, b in zip(cut, cut[1:], strict=False)] + [tail]
        ends = [end[a:b] + k * WINDOW for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))] + [tail_end + full * WINDOW]
        out, out_ends, first = [], [], 0
        for k in range(full):
            _, i, j = np.intersect1d(ends[k], ends[k + 1], assume_unique=True, return_indices=True)
            on = (i >= first) & (j + 1 < len(pieces[k + 1]))
            i, j = i[on], j[on]
            good = np.flatnonzero(self._follows(pieces[k][i].astype(np.int64), pieces[k + 1][j + 1].astype(np.int64)))
            if not len(good):
                return self._from_anchors(codes)
            g = good[len(good) // 2]
            out.append(pieces[k][first : i[g] + 1])
            out_ends.append(ends[k][first : i[g] + 1])
            first = int(j[g]) + 1
        return np.concatenate([*out, pieces[full][first:]]), np.concatenate([*out_ends, ends[full][first:]])

    def _from_anchors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A BPE word from windows that each start at a cut of the one before.

        Runs and periodic words have the same windows again and again; each is advanced once.
        A cut serves if the next window's first piece follows the piece before it, which
        makes the pieces on both sides one encoding; where none of the last few does, the whole advances by itself.
        """
        size, known = WINDOW + OVERLAP, {}

        def window(at: int) -> tuple[np.ndarray, np.ndarray]:
            part = codes[at : at + size]
            key = part.tobytes()
            if key not in known:
                if len(known) > 1_024:
                    known.clear()
                known[key] = self._lattice(part[None, :])[1:]
            return known[key]

        out, out_ends, at = [], [], 0
        piece, end = window(0)
        while at + size < len(codes):
            last = int(np.searchsorted(end, WINDOW, "right")) - 1
            for cut in range(last, max(last - 8, -1), -1):
                following = window(at + int(end[cut]))
                if self._follows(piece[cut : cut + 1].astype(np.int64), following[0][:1].astype(np.int64))[0]:
                    break
            else:
                _, piece, end = self._lattice(codes[None, :])
                return piece, end
            out.append(piece[: cut + 1])
            out_ends.append(end[: cut + 1] + at)
            at += int(end[cut])
            piece, end = following
        return np.concatenate([*out, piece]), np.concatenate([*out_ends, end + at])

    def _encode_new(self, words: list[str]) -> None:
        """Append the ids of these words to the table, in order."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(size, kind="stable")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        limits = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, limits):
            length = int(size[group[0]])
            step = max(1, 3_000_000 // (length * min(length, self.longest))) if length <= LONG else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), length)
                if length > LONG:
                    piece, end = self._long_word(codes[0])
                    word = np.zeros(len(piece), dtype=np.int64)
                else:
                    word, piece, end = self._lattice(codes)
                odd = np.flatnonzero(piece < 0)
                if len(odd):
                    word, piece = self._spell_unknown(codes, word, piece, end, odd)
                found.append((part[word], piece))
        word = np.concatenate([f[0] for f in found])
        piece = np.concatenate([f[1] for f in found])
        by_word = np.argsort(word, kind="stable")
        lengths = np.bincount(word, minlength=len(words))
        first = self.filled
        self._room(first + len(piece), len(self.vocab))
        self.flat[first : first + len(piece)] = piece[by_word]
        base = len(self.vocab) - len(words)
        self.length[base : base + len(words)] = lengths
        self.start[base : base + len(words)] = first + np.cumsum(lengths) - lengths
        self.filled = first + len(piece)

    def _spell_unknown(self, codes, word, piece, end, odd):
        """Unknown characters become their UTF-8 bytes' pieces, or one unknown piece for a run of them."""
        m = self.model
        if (m.byte_id < 0).any():
            run = np.zeros(len(piece), dtype=bool)
            run[1:] = (piece[1:] < 0) & (piece[:-1] < 0) & (word[1:] == word[:-1])
            piece = np.where(piece < 0, m.unknown_id, piece)
            return word[~run], piece[~run]
        spelled = [m.byte_id[np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), dtype=np.uint8)] for c in codes[word[odd], end[odd] - 1]]
        lengths = np.ones(len(piece), dtype=np.int64)
        lengths[odd] = [len(s) for s in spelled]
        out_word, out = np.repeat(word, lengths), np.repeat(piece, lengths)
        out[expand((np.cumsum(lengths) - lengths)[odd], lengths[odd])] = np.concatenate(spelled)
        return out_word, out

    # -- texts -------------------------------------------------------------

    def _forget(self) -> None:
        self.vocab = Numbered()
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)
        self.filled = 0

    def _room(self, ids: int, words: int) -> None:
        if ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(ids - len(self.flat), len(self.flat)), dtype=self.flat.dtype)])
        if words > len(self.start):
            more = max(words - len(self.start), len(self.start))
            self.start = np.concatenate([self.start, np.zeros(more, dtype=self.start.dtype)])
            self.length = np.concatenate([self.length, np.zeros(more, dtype=self.length.dtype)])

    @no_cycle_search()
    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids; null and empty texts have none."""
        if len(self.vocab) > self.cache_words:
            self._forget()
        prefix = SPACE if self.model.dummy_prefix else ""
        index: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        number, words = self.vocab.__getitem__, self.words.findall
        for i, text in enumerate(texts):
            if text:
                found = words(prefix + text.replace(" ", SPACE))
                counts[i] = len(found)
                index.extend(map(number, found))
        if self.vocab.new:
            self._encode_new(self.vocab.new)
            self.vocab.new = []
        at = np.array(index, dtype=np.int64)
        lengths = self.length[at].astype(np.int64)
        ids = self.flat[expand(self.start[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 text of each run of ids (bytes that are no UTF-8 are replaced)."""
        lengths = self.pool_len[ids]
        data = self.pool[expand(self.pool_at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            text = data[a:b]
            if self.model.dummy_prefix and text[:1] == b" ":
                text = text[1:]
            out.append(text)
        return out


_LOADED: dict[str, Codec] = {}


def load_codec(path: str) -> Codec:
    """The codec of a model file, one for each Python process.  The file must be at ``path`` on every executor."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Codec(PieceModel(f.read()))
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids array<int>``: the pieces of the whole text.

    Null and empty texts get an empty array.  All columns stay; a column named
    like ``ids`` is replaced.  No shuffle.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_path)
        for batch in batches:
            for part in byte_slices(batch, text, 2_000_000):
                flat, counts = codec.encode(part.column(text).to_pylist())
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                column = pa.ListArray.from_arrays(bounds, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), column], names=[*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add ``text``: the ids decoded.  Null and empty arrays give the empty text; a column named like ``text`` is replaced."""
    kept = [c for c in encoded.columns if c != text]
    schema = encoded.select(*kept).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_path)
        for batch in batches:
            column = batch.column(ids)
            counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
            flat = np.asarray(pc.list_flatten(column), dtype=np.int64)
            texts = [t.decode("utf-8", "replace") for t in codec.decode(flat, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    return encoded.select(*kept).mapInArrow(run, schema)


def codec_report(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and digest both.

    Per row: the key, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian
    unsigned 32-bit integers), ``n_chars`` and ``text_crc32`` of the decoded
    UTF-8 text, and ``same``: whether it equals the text (null and empty texts:
    no ids, the empty text, true).  A text that holds U+2581 comes back with spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model_path)
        for batch in batches:
            for part in byte_slices(batch, text, 2_000_000):
                texts = part.column(text).to_pylist()
                flat, counts = codec.encode(texts)
                decoded = codec.decode(flat, counts)
                data = memoryview(flat.astype("<u4").tobytes())
                ends = (np.cumsum(counts) * 4).tolist()
                crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                text_out = [t.decode("utf-8", "replace") for t in decoded]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                        pa.array([len(t) for t in text_out], pa.int64()),
                        pa.array([zlib.crc32(t) for t in decoded], pa.int64()),
                        pa.array([t == (s or "") for t, s in zip(text_out, texts, strict=True)]),
                    ],
                    names=[key, "n_tokens", "ids_crc32", "n_chars", "text_crc32", "same"],
                )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long, same boolean")
