"""The first stages of a residual network, in numpy: local descriptors from stored weights.

Weights come from an archive (:func:`read_archive`), batch norms are folded into the
convolutions once (:class:`Prefix`), and a convolution is a matrix product over blocks
of output rows, so memory holds one block's patches.  The folded weights are broadcast:
their size is the network's, and each Python worker reads them once.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections import OrderedDict
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession

from ..functions.raster import align
from ..schema import CHANNEL_MEAN, CHANNEL_STD

#: Numbers of the patch matrix of one block of rows.
BLOCK_NUMBERS = 4_000_000
#: Added to a batch norm's variance before its root is taken.
EPSILON = 1e-5
#: An archive larger than this is no weight archive of such a network.
MOST_ARCHIVE_BYTES = 1 << 30

Weights = dict[str, np.ndarray]

# Storage types that archives of tensors name, as numpy's types.
STORAGES = {
    "DoubleStorage": "<f8",
    "FloatStorage": "<f4",
    "HalfStorage": "<f2",
    "LongStorage": "<i8",
    "IntStorage": "<i4",
    "ShortStorage": "<i2",
    "CharStorage": "<i1",
    "ByteStorage": "<u1",
    "BoolStorage": "?",
}


class _Tensors(pickle.Unpickler):
    """Reads a mapping of tensors and nothing else: no name but those below is looked up, so no code of an archive runs."""

    def __init__(self, data: bytes, storage):
        super().__init__(io.BytesIO(data))
        self.storage = storage

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module == "torch" and name in STORAGES:
            return name
        if module == "torch._utils" and name == "_rebuild_tensor_v2":
            return self.tensor
        if module == "torch._utils" and name == "_rebuild_parameter":
            return lambda value, *_: value
        raise pickle.UnpicklingError(f"an archive of weights holds no {module}.{name}")

    def persistent_load(self, pid) -> np.ndarray:
        kind, storage, key, _, count = pid
        if kind != "storage" or storage not in STORAGES:
            raise pickle.UnpicklingError("unknown storage")
        return np.frombuffer(self.storage(str(key)), dtype=STORAGES[storage], count=count)

    @staticmethod
    def tensor(flat: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
        last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True))
        if min((offset, *size, *stride), default=0) < 0 or (np.prod(size, dtype=int) and last >= len(flat)):
            raise pickle.UnpicklingError("a tensor lies outside its storage")
        steps = tuple(s * flat.itemsize for s in stride)
        return np.lib.stride_tricks.as_strided(flat[offset:], size, steps, writeable=False).copy()


def read_archive(data: bytes) -> Weights:
    """Named arrays of a numpy archive (``.npz``) or of a zipped state dictionary of tensors; ``ValueError`` for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            index = [n for n in archive.namelist() if n.endswith("/data.pkl") or n == "data.pkl"]
            if not index:
                with np.load(io.BytesIO(data), allow_pickle=False) as arrays:
                    return {name: arrays[name] for name in arrays.files}
            root = index[0].removesuffix("data.pkl")
            found = _Tensors(archive.read(index[0]), lambda key: archive.read(f"{root}data/{key}")).load()
    except (zipfile.BadZipFile, pickle.UnpicklingError, KeyError, EOFError, TypeError) as e:
        raise ValueError(f"not an archive of weights: {e}") from e
    if not isinstance(found, dict) or not all(isinstance(v, np.ndarray) for v in found.values()):
        raise ValueError("not an archive of weights: no mapping of names to tensors")
    return dict(found)


@dataclass(frozen=True)
class Conv:
    """A convolution with its batch norm: ``matrix`` is (size * size * channels in, channels out), rows in the order of y, x, channel."""

    matrix: np.ndarray
    bias: np.ndarray
    size: int
    stride: int

    @classmethod
    def folded(cls, weights: Weights, conv: str, norm: str, stride: int, kind: type = np.float32) -> Conv:
        try:
            w = weights[f"{conv}.weight"]
            gain, shift, mean, var = (weights[f"{norm}.{part}"].astype(np.float64) for part in ("weight", "bias", "running_mean", "running_var"))
        except KeyError as e:
            raise ValueError(f"the archive lacks {e.args[0]}") from e
        if w.ndim != 4 or w.shape[2] != w.shape[3] or not w.shape[2] % 2 or any(v.shape != w.shape[:1] for v in (gain, shift, mean, var)):
            raise ValueError(f"{conv} has weights of shape {w.shape}, {norm} of {gain.shape}")
        factor = gain / np.sqrt(var + EPSILON)
        matrix = (w * factor[:, None, None, None]).transpose(2, 3, 1, 0).reshape(-1, len(w))
        return cls(np.ascontiguousarray(matrix, dtype=kind), (shift - mean * factor).astype(kind), w.shape[2], stride)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(h, w, channels) to (h', w', channels out), zeros beyond the border."""
        k, s, pad = self.size, self.stride, self.size // 2
        if x.shape[2] * k * k != len(self.matrix):
            raise ValueError(f"{x.shape[2]} channels for weights of {len(self.matrix) // (k * k)}")
        rows, cols = (x.shape[0] + 2 * pad - k) // s + 1, (x.shape[1] + 2 * pad - k) // s + 1
        if k == 1:
            return x[::s, ::s] @ self.matrix + self.bias
        wide = np.pad(x, ((pad, pad), (pad, pad), (0, 0)))
        patches = np.lib.stride_tricks.sliding_window_view(wide, (k, k), axis=(0, 1))[::s, ::s].transpose(0, 1, 3, 4, 2)
        out = np.empty((rows, cols, self.matrix.shape[1]), dtype=self.matrix.dtype)
        step = max(1, BLOCK_NUMBERS // (cols * len(self.matrix)))
        for a in range(0, rows, step):
            block = patches[a : a + step].reshape(-1, len(self.matrix))
            out[a : a + step] = (block @ self.matrix + self.bias).reshape(-1, cols, out.shape[2])
        return out


def max_pool(x: np.ndarray, size: int = 3, stride: int = 2) -> np.ndarray:
    """The largest of each ``size`` x ``size`` window, windows ``stride`` apart, nothing beyond the border."""
    pad = size // 2
    wide = np.pad(x, ((pad, pad), (pad, pad), (0, 0)), constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(wide, (size, size), axis=(0, 1))[::stride, ::stride].max(axis=(3, 4))


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0, out=x)


@dataclass(frozen=True)
class Block:
    """Two convolutions around which the input, or its projection, is added."""

    first: Conv
    second: Conv
    project: Conv | None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = self.second(relu(self.first(x)))
        out += x if self.project is None else self.project(x)
        return relu(out)


class Prefix:
    """Stem and stages of a residual network of basic blocks, up to the last of ``taps``.

    Stages after the first halve the grid.  A stage has as many blocks as the archive
    names; channels and kernel sizes are the archive's too.
    """

    def __init__(self, weights: Weights, taps: tuple[str, ...] = ("layer2", "layer3")):
        self.taps = taps
        self.stem = Conv.folded(weights, "conv1", "bn1", 2)
        self.stages: dict[str, list[Block]] = {}
        for k in range(1, 1 + max(int(t.removeprefix("layer")) for t in taps)):
            name = f"layer{k}"
            blocks = sorted({int(n.split(".")[1]) for n in weights if n.startswith(f"{name}.")})
            if not blocks or blocks != list(range(len(blocks))):
                raise ValueError(f"the archive lacks blocks of {name}")
            self.stages[name] = []
            for b in blocks:
                conv = partial(Conv.folded, weights)
                at, stride = f"{name}.{b}", 2 if k > 1 and b == 0 else 1
                project = conv(f"{at}.downsample.0", f"{at}.downsample.1", stride) if f"{at}.downsample.0.weight" in weights else None
                self.stages[name].append(Block(conv(f"{at}.conv1", f"{at}.bn1", stride), conv(f"{at}.conv2", f"{at}.bn2", 1), project))

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """What each tapped stage gives for a normalised (h, w, 3) image."""
        found = {}
        x = max_pool(relu(self.stem(x.astype(np.float32))))
        for name, blocks in self.stages.items():
            for block in blocks:
                x = block(x)
            found[name] = x
        return [found[t] for t in self.taps]

    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        """(h, w, 3) uint8 pixels to (cells, dims): the first tap's grid, each further tap brought to it and appended."""
        x = (pixels.astype(np.float32) / 255.0 - np.array(CHANNEL_MEAN, np.float32)) / np.array(CHANNEL_STD, np.float32)
        first, *others = self.maps(x)
        rows, cols, _ = first.shape
        parts = [first, *(align(m.astype(np.float64), rows, cols) for m in others)]
        return np.concatenate(parts, axis=2).reshape(rows * cols, -1).astype(np.float32)


class NetworkFeatures:
    """A descriptor source that runs a broadcast prefix."""

    def __init__(self, handle: Broadcast):
        self.handle = handle

    def __call__(self, pixels: np.ndarray) -> np.ndarray:
        return self.handle.value(pixels)


def network_features(spark: SparkSession, path: str, taps: tuple[str, ...] = ("layer2", "layer3")) -> NetworkFeatures:
    """The descriptor source of an archive on any file system that Spark reads.

    ``ValueError`` where there is no archive, or one of more than ``MOST_ARCHIVE_BYTES``, or one that lacks weights.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "length").head(2)
    if len(found) != 1 or found[0]["length"] > MOST_ARCHIVE_BYTES:
        raise ValueError(f"no single archive of weights at {path}")
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return NetworkFeatures(spark.sparkContext.broadcast(Prefix(read_archive(data), taps)))
