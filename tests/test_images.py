"""Resampling, decoding and embedding of images."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.errors import RetrievalError
from orrery.functions import resample, vectors
from orrery.operators import embed
from orrery.plans.retrieval import run_retrieval
from orrery.plans.startup import validate_startup
from orrery.sources import images
from orrery.sources.config import load_config


def kernel(name, x):
    """The kernels by their formulas."""
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    a = abs(x)
    match name:
        case "box":
            return float(-0.5 < x <= 0.5)
        case "bilinear":
            return max(0.0, 1 - a)
        case "hamming":
            return sinc(x) * (0.54 + 0.46 * math.cos(math.pi * x)) if a < 1 else 0.0
        case "bicubic":
            return 1.5 * a**3 - 2.5 * a**2 + 1 if a < 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2 if a < 2 else 0.0
    return sinc(x) * sinc(x / 3) if a < 3 else 0.0


def direct(image, height, width, name):
    """Each output value as a double sum over all input values."""
    reach = {"box": 0.5, "bilinear": 1, "hamming": 1, "bicubic": 2, "lanczos": 3}[name]

    def share(size, to, k, x):
        scale = size / to
        wide = max(1.0, scale)
        middle = (k + 0.5) * scale
        inside = int(middle - reach * wide + 0.5) <= x < int(middle + reach * wide + 0.5)
        return kernel(name, (x + 0.5 - middle) / wide) if inside else 0.0

    rows, columns = image.shape
    out = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            w = [[share(rows, height, y, j) * share(columns, width, x, i) for i in range(columns)] for j in range(rows)]
            out[y, x] = sum(w[j][i] * image[j, i] for j in range(rows) for i in range(columns)) / sum(map(sum, w))
    return out


@pytest.mark.parametrize("name", resample.KERNELS)
@pytest.mark.parametrize(("size", "to"), [((9, 7), (4, 3)), ((4, 6), (9, 11)), ((5, 8), (5, 8)), ((3, 10), (8, 4)), ((1, 1), (3, 2)), ((12, 5), (1, 1))])
def test_against_a_double_sum(name, size, to):
    image = np.random.default_rng(sum(size)).integers(0, 256, size).astype(float)
    assert np.allclose(resample.resized(image, *to, name), direct(image, *to, name), atol=1e-9)
    assert np.allclose(resample.weights(size[0], to[0], name).sum(axis=1), 1)
    if size == to and name != "hamming":
        assert np.allclose(resample.resized(image, *to, name), image)


@pytest.mark.parametrize("name", resample.NEAREST)
def test_nearest(name):
    assert resample.resized(np.arange(12.0).reshape(3, 4), 2, 8, name).tolist() == [[0, 0, 1, 1, 2, 2, 3, 3], [8, 8, 9, 9, 10, 10, 11, 11]]
    assert resample.to_bytes(np.array([-3, 0.5, 1.49, 254.5, 300])).tolist() == [0, 1, 1, 255, 255]


def test_columns_of_bytes(spark):
    """Images made from the bytes of texts, resized in a query."""
    data = np.arange(60) * 7 % 256
    df = spark.createDataFrame([(data.tolist(),), (None,)], "x array<int>")
    for name in resample.KERNELS:
        got = df.select(vectors.resized(F.col("x"), (6, 10), (4, 13), name).alias("v")).collect()
        assert np.allclose(got[0]["v"], direct(data.reshape(6, 10).astype(float), 4, 13, name).ravel()) and got[1]["v"] is None


def ppm(image: np.ndarray, kind: int = 6, most: int = 255, comment: bytes = b"") -> bytes:
    height, width = image.shape[:2]
    return b"P%d\n%s%d %d\n%d\n" % (kind, comment, width, height, most) + image.astype(">u2" if most > 255 else np.uint8).tobytes()


def test_netpbm():
    rng = np.random.default_rng(0)
    colour, gray = rng.integers(0, 256, (5, 3, 3)), rng.integers(0, 256, (4, 6))
    assert (images.decoded(ppm(colour, comment=b"# made here\n")) == colour).all()
    assert (images.decoded(ppm(gray, 5)) == gray[:, :, None]).all()
    assert (images.decoded(ppm(gray * 257, 5, 65_535)) == gray[:, :, None]).all()
    assert (images.decoded(ppm(gray // 17, 5, 15)) == (gray // 17 * 17)[:, :, None]).all()
    for bad in (ppm(colour)[:-1], b"P6\n0 0\n255\n"):
        with pytest.raises(ValueError):
            images.decoded(bad)
    assert images.netpbm(b"\x89PNG") is None


def test_convolution_against_a_direct_sum():
    rng = np.random.default_rng(1)
    image, kernels, bias = rng.normal(size=(2, 5, 6)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    padded = np.pad(image, ((0, 0), (1, 1), (1, 1)))
    want = [[[max(0, (padded[:, y : y + 3, x : x + 3] * kernels[k]).sum() + bias[k]) for x in (0, 2, 4)] for y in (0, 2, 4)] for k in range(3)]
    assert np.allclose(embed.convolved(image, kernels, bias), want)


def make_images(make_run, folder, n=9, **how):
    rng = np.random.default_rng(4)
    config = make_run([f"i/{k}.ppm" for k in range(n)], models__net__model_name="small-net", models__net__checkpoint="net.npz", **how)
    for k in range(n):
        image = rng.integers(0, 256, (20 + k, 30 - k, 3))
        (folder / f"data/i/{k}.ppm").write_bytes(ppm(image if k != 5 else np.full((4, 4, 3), 200)))
    embed.save_small_net(folder / "net.npz", (4, 6))
    return config


def test_pixels_to_features(spark, make_run, tmp_path):
    """A run from image files to results, against the same steps by hand."""
    config = load_config(make_images(make_run, tmp_path))
    run = run_retrieval(validate_startup(spark, config))
    assert run["feature_shape"] == [9, 6]
    with np.load(tmp_path / "net.npz") as file:
        layers = [(file[f"kernels{k}"].astype(float), file[f"bias{k}"].astype(float)) for k in (0, 1)]
    want = []
    for k in (0, 3, 5):
        x = images.decoded((tmp_path / f"data/i/{k}.ppm").read_bytes()).astype(float)
        x = np.stack([np.clip(np.floor(direct(x[:, :, c], 32, 48, "bilinear") + 0.5 + 1e-7), 0, 255) for c in range(3)]) / 255
        x = (x - np.array([0, 0.25, 0.5])[:, None, None]) / np.array([1, 0.5, 2])[:, None, None]
        for kernels, bias in layers:
            x = embed.convolved(x, kernels, bias)
        x = x.mean(axis=(1, 2))
        want.append(x / np.linalg.norm(x))
    records = validate_startup(spark, config).records
    got = [r["features"] for r in embed.embedded(records, config.model).orderBy("pos").collect() if r["pos"] in (0, 3, 5)]
    assert np.allclose(got, want, atol=1e-5)


def test_features_do_not_depend_on_batches_and_partitions(spark, make_run, tmp_path):
    found = set()
    for size in (1, 2, 7, 100):
        config = load_config(make_images(make_run, tmp_path, models__net__batch_size=size))
        records = validate_startup(spark, config).records
        for parts in (1, 5):
            rows = embed.embedded(records.repartition(parts), config.model).orderBy("pos").collect()
            found.add(tuple((r["pos"], r["image_id"], *r["features"]) for r in rows))
    assert len(found) == 1


def test_a_broken_image_is_named(spark, make_run, tmp_path):
    config = load_config(make_images(make_run, tmp_path))
    (tmp_path / "data/i/3.ppm").write_bytes(b"P6\n9 9\n255\nxx")
    with pytest.raises(Exception, match=r"Image can't be read: .*i/3\.ppm"):
        run_retrieval(validate_startup(spark, config))
    assert issubclass(RetrievalError, RuntimeError)
