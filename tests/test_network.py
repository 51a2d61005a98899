"""The network prefix against loops, and its archives."""

import io
import pickle
import zipfile

import numpy as np
import pytest

from normscope.schema import CHANNEL_MEAN, CHANNEL_STD
from normscope.sources import network
from normscope.sources.descriptors import describe


def random_weights(channels, blocks, seed=0, stem=7):
    """Names and shapes of a residual network of basic blocks, with random values."""
    rng, w = np.random.default_rng(seed), {}

    def conv(name, norm, out, into, k):
        w[f"{name}.weight"] = rng.normal(scale=1 / np.sqrt(into * k * k), size=(out, into, k, k)).astype(np.float32)
        for part, low, high in (("weight", 0.5, 1.5), ("bias", -0.3, 0.3), ("running_mean", -0.2, 0.2), ("running_var", 0.5, 2.0)):
            w[f"{norm}.{part}"] = rng.uniform(low, high, out).astype(np.float32)

    conv("conv1", "bn1", channels[0], 3, stem)
    into = channels[0]
    for s, out in enumerate(channels):
        for b in range(blocks):
            at = f"layer{s + 1}.{b}"
            conv(f"{at}.conv1", f"{at}.bn1", out, into, 3)
            conv(f"{at}.conv2", f"{at}.bn2", out, out, 3)
            if b == 0 and s > 0:
                conv(f"{at}.downsample.0", f"{at}.downsample.1", out, into, 1)
            into = out
    return w


def slow_conv(x, w, stride):
    """Channels first, one output at a time."""
    out, _, k, _ = w.shape
    p = k // 2
    wide = np.zeros((x.shape[0], x.shape[1] + 2 * p, x.shape[2] + 2 * p))
    wide[:, p : p + x.shape[1], p : p + x.shape[2]] = x
    h, v = (x.shape[1] + 2 * p - k) // stride + 1, (x.shape[2] + 2 * p - k) // stride + 1
    y = np.zeros((out, h, v))
    for o in range(out):
        for i in range(h):
            for j in range(v):
                y[o, i, j] = (wide[:, i * stride : i * stride + k, j * stride : j * stride + k] * w[o]).sum()
    return y


def slow_norm(x, w, name):
    gain, shift, mean, var = (w[f"{name}.{p}"].astype(float)[:, None, None] for p in ("weight", "bias", "running_mean", "running_var"))
    return (x - mean) / np.sqrt(var + 1e-5) * gain + shift


def slow_features(w, pixels, stages, blocks):
    x = ((pixels / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)).transpose(2, 0, 1)
    x = np.maximum(slow_norm(slow_conv(x, w["conv1.weight"], 2), w, "bn1"), 0)
    h, v = (x.shape[1] + 1) // 2, (x.shape[2] + 1) // 2
    x = np.array([[[c[max(0, 2 * i - 1) : 2 * i + 2, max(0, 2 * j - 1) : 2 * j + 2].max() for j in range(v)] for i in range(h)] for c in x])
    maps = []
    for s in range(stages):
        for b in range(blocks):
            at, stride = f"layer{s + 1}.{b}", 2 if s and not b else 1
            y = np.maximum(slow_norm(slow_conv(x, w[f"{at}.conv1.weight"], stride), w, f"{at}.bn1"), 0)
            y = slow_norm(slow_conv(y, w[f"{at}.conv2.weight"], 1), w, f"{at}.bn2")
            same = slow_norm(slow_conv(x, w[f"{at}.downsample.0.weight"], stride), w, f"{at}.downsample.1") if f"{at}.downsample.0.weight" in w else x
            x = np.maximum(y + same, 0)
        maps.append(x.transpose(1, 2, 0))
    return maps


@pytest.mark.parametrize("size, stride", [(1, 1), (1, 2), (3, 1), (3, 2), (7, 2)])
def test_a_convolution_equals_loops_also_in_small_blocks(monkeypatch, size, stride):
    rng = np.random.default_rng(size)
    w = {"c.weight": rng.normal(size=(5, 4, size, size)), **{f"n.{p}": rng.uniform(0.5, 2, 5) for p in ("weight", "bias", "running_mean", "running_var")}}
    x = rng.normal(size=(13, 10, 4)).astype(np.float32)
    want = slow_norm(slow_conv(x.transpose(2, 0, 1), w["c.weight"], stride), w, "n").transpose(1, 2, 0)
    for most in (4_000_000, 700):
        monkeypatch.setattr(network, "BLOCK_NUMBERS", most)
        assert np.allclose(network.Conv.folded(w, "c", "n", stride)(x), want, atol=1e-4)


@pytest.mark.parametrize("shape", [(32, 32), (33, 27)])
def test_the_prefix_equals_loops(shape):
    w = random_weights((4, 6, 8), 2, seed=sum(shape))
    pixels = np.random.default_rng(1).integers(0, 256, (*shape, 3)).astype(np.uint8)
    maps = network.Prefix(w, ("layer1", "layer2", "layer3")).maps((pixels / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD))
    for got, want in zip(maps, slow_features(w, pixels, 3, 2), strict=True):
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-3)


def test_full_size_gives_784_vectors_of_384(spark, tmp_path):
    w = random_weights((64, 128, 256), 2)
    np.savez(tmp_path / "weights.npz", **w, **{"fc.weight": np.zeros((2, 2)), "layer4.0.conv1.weight": np.zeros((1, 1, 3, 3))})
    source = network.network_features(spark, str(tmp_path / "weights.npz"))
    pixels = [np.random.default_rng(k).integers(0, 256, (224, 224, 3)).astype(np.uint8) for k in range(2)]
    uploads = spark.createDataFrame([(f"i{k}", "reference", k, p.tobytes()) for k, p in enumerate(pixels)], "sample_id string, group string, seq long, pixels binary")
    got = describe(uploads, source).orderBy("seq", "cell").collect()
    assert [r["cell"] for r in got] == list(range(784)) * 2 and {len(r["descriptor"]) for r in got} == {384}
    vectors = np.array([r["descriptor"] for r in got if r["sample_id"] == "i1"])
    assert np.isfinite(vectors).all()
    second, third = network.Prefix(w).maps((pixels[1].astype(np.float32) / 255 - np.array(CHANNEL_MEAN, np.float32)) / np.array(CHANNEL_STD, np.float32))
    assert second.shape == (28, 28, 128) and third.shape == (14, 14, 256)
    assert np.allclose(vectors[:, :128], second.reshape(784, 128), atol=1e-4)
    # Between cells (0, 0) and (0, 1) of the coarse grid lie the fine cells (1, 1) and (1, 2), a quarter of a step off either.
    at = (0.75 * third[0, 0] + 0.25 * third[0, 1]) * 0.75 + (0.75 * third[1, 0] + 0.25 * third[1, 1]) * 0.25
    assert np.allclose(vectors[28 + 1, 128:], at, atol=1e-4)


class _Stored:
    """Stands for a tensor while a state dictionary is pickled as such archives are."""

    def __init__(self, key, array):
        self.key, self.array = key, array


class _Global:
    def __init__(self, module, name):
        self.module, self.name = module, name


class _Archive(pickle._Pickler):
    def persistent_id(self, obj):
        if isinstance(obj, _Stored):
            return ("storage", _Global("torch", {"f": "FloatStorage", "i": "LongStorage"}[obj.array.dtype.kind]), obj.key, "cpu", obj.array.size)
        return None

    def save(self, obj, save_persistent_id=True):
        if isinstance(obj, _Global):
            self.write(pickle.GLOBAL + f"{obj.module}\n{obj.name}\n".encode())
        elif isinstance(obj, tuple) and len(obj) == 2 and isinstance(obj[0], _Global):
            self.save(obj[0])
            self.save(obj[1])
            self.write(pickle.REDUCE)
        else:
            super().save(obj, save_persistent_id)


def zipped_state(arrays, root="archive/", extra=None):
    state, stored = {}, {}
    for k, (name, a) in enumerate(arrays.items()):
        stored[str(k)] = a
        strides = tuple(s // a.itemsize for s in a.strides)
        state[name] = (_Global("torch._utils", "_rebuild_tensor_v2"), (_Stored(str(k), a), 0, a.shape, strides, False, {}))
    if extra:
        state["extra"] = extra
    pickled, out = io.BytesIO(), io.BytesIO()
    _Archive(pickled, 2).dump(state)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{root}data.pkl", pickled.getvalue())
        for key, a in stored.items():
            z.writestr(f"{root}data/{key}", a.tobytes())
    return out.getvalue()


def test_both_kinds_of_archive_give_the_same_weights():
    w = random_weights((4, 6, 8), 1) | {"bn1.num_batches_tracked": np.array([7], dtype=np.int64)}
    plain = io.BytesIO()
    np.savez(plain, **w)
    for data in (plain.getvalue(), zipped_state(w), zipped_state(w, root="")):
        found = network.read_archive(data)
        assert sorted(found) == sorted(w) and all(np.array_equal(found[k], w[k]) for k in w)


def test_damaged_and_hostile_archives_are_refused(spark, tmp_path):
    w = {"conv1.weight": np.zeros((2, 3, 3, 3), np.float32)}
    hostile = zipped_state(w, extra=(_Global("os", "system"), ("true",)))
    for data in (b"", b"no archive", zipped_state(w)[:60], hostile):
        with pytest.raises(ValueError, match="not an archive"):
            network.read_archive(data)
    with pytest.raises(ValueError, match="lacks bn1.weight"):
        network.Prefix(network.read_archive(zipped_state(w)))
    lacking = {k: v for k, v in random_weights((4, 6, 8), 1).items() if not k.startswith("layer2.0.bn2")}
    with pytest.raises(ValueError, match="lacks layer2.0.bn2"):
        network.Prefix(lacking)
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / name).write_bytes(zipped_state(w))
    with pytest.raises(ValueError, match="no single archive"):
        network.network_features(spark, str(tmp_path / "two"))
