from __future__ import annotations

import hashlib
import json
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orrery.cli import main
from orrery.errors import RetrievalError, StartupError
from orrery.functions import arrays, signatures, vectors
from orrery.operators import embed, order, results, search, select
from orrery.plans.retrieval import run_retrieval
from orrery.plans.startup import summary, validate_startup
from orrery.sources import cache, files
from orrery.sources.config import load_config

ROWS = "pos long, image_id long, file_name string, features array<float>"


def rows_of(spark, features, ids=None):
    return spark.createDataFrame([(k, ids[k] if ids else 10 * k, f"f{k}", list(map(float, v))) for k, v in enumerate(features)], ROWS)


def found(df):
    return [(r["query_ord"], r["rank"], r["pos"]) for r in df.orderBy("query_ord", "rank").collect()]


@pytest.mark.parametrize(("shard", "resident"), [(3, 4), (8192, None), (8192, 1), (1, 100)])
def test_top_k_against_brute_force(spark, shard, resident):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (40, 4)).astype(float)  # many ties
    x[7] = x[8] = x[9]
    rows = rows_of(spark, x)
    queries = select.by_stride(rows, 3)
    got = found(search.top_k(rows, queries, 5, shard=shard, resident=resident))
    want = []
    for q in range(0, 40, 3):
        order = sorted((p for p in range(40) if p != q), key=lambda p: (-float(x[p] @ x[q]), p))
        want += [(q // 3, k + 1, p) for k, p in enumerate(order[:5])]
    assert got == want
    pairs = search.scored_pairs(rows, queries).collect()
    assert len(pairs) == 14 * 39 and all(r["score"] == x[r["pos"]] @ x[r["query_pos"]] for r in pairs)


def test_nan_first_then_infinity(spark):
    x = [[1, 1], [2, 2], [float("nan"), 0], [float("inf"), 1], [0, 0], [-1, 0]]
    assert [p for _, _, p in found(search.top_k(rows_of(spark, x), spark.createDataFrame([(0, 0)], "query_ord long, query_pos long"), 9))] == [2, 3, 1, 4, 5]


def test_equal_vectors_have_equal_scores(spark):
    """Copies of vectors, whose scores a matrix product may round each in its own way, rank by position."""
    x = np.random.default_rng(6).normal(size=(7, 33)).astype(np.float32)
    rows = rows_of(spark, [x[k % 7] for k in range(500)])
    got: dict[int, list[int]] = {}
    for q, _, p in found(search.top_k(rows, select.by_stride(rows, 50), 60, shard=90)):
        got.setdefault(q, []).append(p)
    for q, pos in got.items():
        assert pos == [p for p in range((50 * q) % 7, 500, 7) if p != 50 * q][:60]


def test_best_in_steps(monkeypatch):
    monkeypatch.setattr(search, "STEP", 7)
    rng = np.random.default_rng(2)
    rows, asked = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(-2, 3, (20, 3)).astype(float)
    rows[5], rows[6, 0], asked[3, 1] = np.nan, np.inf, np.nan
    best = search.Best(20, 9)
    for start in range(0, 300, 50):
        search.compare(best, asked, np.arange(20), rows[start : start + 50], np.arange(start, min(300, start + 50)))
        best.ranked()
    query, pos, score = best.ranked()
    with np.errstate(invalid="ignore"):
        s = (rows[None] * asked[:, None]).sum(axis=2)
    key = lambda q, p: (not np.isnan(s[q, p]), 0 if np.isnan(s[q, p]) else -s[q, p], p)
    want = [(q, p) for q in range(20) for p in sorted((p for p in range(300) if p != q), key=lambda p, q=q: key(q, p))[:9]]
    assert list(zip(query.tolist(), pos.tolist(), strict=True)) == want and np.array_equal(score, s[query, pos], equal_nan=True)


@pytest.mark.parametrize(("n", "size"), [(64, 128), (16, 1024), (2048, 4)])
def test_memory_of_a_comparison(n, size):
    """Neither more queries nor longer vectors make what a comparison holds besides its input larger."""
    rng = np.random.default_rng(3)
    rows, asked = rng.normal(size=(2048, size)), rng.normal(size=(n, size))
    best = search.Best(n, 9)
    tracemalloc.start()
    search.compare(best, asked, np.arange(n), rows, np.arange(2048))
    query, pos, score = best.ranked()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for q in range(0, n, 61):
        want = np.argsort(np.where(np.arange(2048) == q, np.inf, -(asked[q] * rows).sum(axis=1)), kind="stable")[:9]
        assert pos[query == q].tolist() == want.tolist() and np.array_equal(score[query == q], (asked[q] * rows[want]).sum(axis=1))


def test_k_is_less_than_rows(spark):
    rows = rows_of(spark, [[1, 0], [2, 0]])
    assert found(search.top_k(rows, select.by_stride(rows, 1), 10)) == [(0, 1, 1), (1, 1, 0)]
    with pytest.raises(RetrievalError, match="at least two"):
        select.require_two(select.head(rows, 1))


def test_queries_by_id_repeat_and_keep_order(spark):
    rows = rows_of(spark, np.eye(4), ids=[9, 7, 5, 2])
    asked = [(r["query_ord"], r["query_pos"]) for r in select.queries_of(rows, [5, 2, 5], 1).orderBy("query_ord").collect()]
    assert asked == [(0, 2), (1, 3), (2, 2)]
    with pytest.raises(RetrievalError, match="8, 3, 8"):
        select.queries_of(rows, [8, 5, 3, 8], 1)
    assert [r["query_pos"] for r in select.queries_of(rows, [], 3).orderBy("query_ord").collect()] == [0, 3]


def test_positions(spark):
    ids = [5, 3, 99, -1, 7, 0, 12, 40]
    got = select.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", parts=3).orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in got] == list(enumerate(sorted(ids)))
    assert select.numbered(spark.createDataFrame([], "id long"), "id").count() == 0


def test_missing_files_preview(spark):
    records = spark.createDataFrame([(k, k, f"/r/{k}") for k in range(9)], "pos long, image_id long, path string")
    files = spark.createDataFrame([("/r/3",), ("/r/8",)], "path string")
    with pytest.raises(RetrievalError, match=r"(?s)/r/0.*/r/5\n  - \.\.\. and 2 more"):
        select.require_files(records, files)
    with pytest.raises(RetrievalError) as few:
        select.require_files(records.filter("pos < 4"), files)
    assert "more" not in str(few.value)


def test_one_listing_for_each_folder(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"d{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 3}" / (f"_{k}" if k % 2 else f".{k}")).touch()
    (tmp_path / "d0/folder").mkdir()
    for root in (str(tmp_path), f"file://{tmp_path}"):
        names = [*(f"d{k % 3}/{'_' if k % 2 else '.'}{k}" for k in range(300)), "d0/folder", "d0/none", "gone/1", "d0/.0/inner"]
        records = spark.createDataFrame([(k, f"{root}/{n}") for k, n in enumerate(names)], "pos long, path string")
        assert select.folders_of(records).count() == 5
        assert [r["pos"] for r in select.missing(records, select.files_of(records)).orderBy("pos").collect()] == [300, 301, 302, 303]
    with pytest.raises(RetrievalError, match="64 queries"):
        search.scored_pairs(rows_of(spark, np.eye(70)), select.by_stride(rows_of(spark, np.eye(70)), 1))


def test_vectors(spark):
    df = rows_of(spark, [[3, 4, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]])
    unit = [r[0] for r in df.orderBy("pos").select(vectors.l2_normalized(F.col("features"))).collect()]
    assert unit == [[0.6, 0.8, 0, 0], [0, 0, 0, 0], [0.5] * 4]
    grid = np.arange(24, dtype=float).reshape(2, 3, 2, 2)
    assert np.allclose(arrays.pooled(grid), grid.mean(axis=(2, 3)))
    tokens = np.arange(40, dtype=float).reshape(2, 4, 5)
    assert np.allclose(arrays.pooled(tokens), tokens.mean(axis=2))
    with pytest.raises(RetrievalError, match="two axes"):
        arrays.pooled(np.zeros(3))
    flat = spark.createDataFrame([(tokens[1].ravel().tolist(),), (None,)], "t array<double>")
    assert [r[0] for r in flat.select(vectors.mean_pooled(F.col("t"), (4, 5))).collect()] == [tokens[1].mean(axis=1).tolist(), None]
    channels = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "x array<double>").select(vectors.channel_normalized(F.col("x"), (1, 2, 3), (1, 2, 4))).first()[0]
    assert channels == [0, 1, 0.5, 1, 0.5, 0.75]
    with pytest.raises(RetrievalError, match="bicubic"):
        embed.interpolation("cubic")


def test_signature(spark, monkeypatch):
    monkeypatch.setattr(signatures, "RUN", 2)
    records = spark.createDataFrame([(2, 5, "b"), (0, 7, "é/1.jpg"), (1, 6, "a")], "pos long, image_id long, file_name string")
    assert signatures.image_signature(records) == hashlib.sha256("7\0é/1.jpg\n6\0a\n5\0b\n".encode()).hexdigest()


def test_cache_checks(spark, tmp_path):
    rows = rows_of(spark, [[1, 2], [3, 4], [5, 6]])
    about = {"model_name": "m", "feature_config_signature": "f"}
    folder = tmp_path / "cache"
    assert cache.load_cache(spark, folder, rows, about) is None
    cache.save_cache(rows, folder, about)
    assert cache.load_cache(spark, folder, rows, about).count() == 3
    for key, message in (("model_name", "another model"), ("feature_config_signature", "other settings")):
        with pytest.raises(RetrievalError, match=message):
            cache.load_cache(spark, folder, rows, about | {key: "x"})
    with pytest.raises(RetrievalError, match="image names.*position 1"):
        cache.load_cache(spark, folder, rows.withColumn("file_name", F.when(F.col("pos") == 1, "x").otherwise(F.col("file_name"))), about)
    for other, where in ((rows.filter("pos < 2"), "position 2"), (rows.withColumn("pos", 2 - F.col("pos")), "position 0")):
        with pytest.raises(RetrievalError, match=f"does not match.*{where}"):
            cache.load_cache(spark, folder, other, about)
    cache.save_cache(rows.withColumn("features", F.when(F.col("pos") == 1, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("features"))), folder, about)
    with pytest.raises(RetrievalError, match="different lengths"):
        cache.load_cache(spark, folder, rows, about)
    (folder / "about-000000000002.json").write_text("{")
    with pytest.raises(RetrievalError, match="can't be read"):
        cache.load_cache(spark, folder, rows, about)


def test_two_writers_of_a_cache(spark, tmp_path, monkeypatch):
    """The second comes while the first is about to take its number; a reader that began before keeps its rows."""
    about = {"model_name": "m", "feature_config_signature": "f"}
    old, one, two = (rows_of(spark, [[k, 2], [3, 4]]) for k in (1, 7, 9))
    folder = tmp_path / "cache"
    cache.save_cache(old, folder, about)
    before = cache.load_cache(spark, folder, old, about)
    put, other = files.put_new, []

    def later(*given):
        if not other:
            other.append(1)
            cache.save_cache(two, folder, about)
        return put(*given)

    monkeypatch.setattr(files, "put_new", later)
    made = cache.save_cache(one, folder, about)
    assert cache.numbers(spark, folder) == [2, 3]  # both got one; the last counts
    assert sorted(r["features"][0] for r in cache.load_cache(spark, folder, one, about).collect()) == [3, 7] == sorted(r["features"][0] for r in made.collect())
    assert len([n for n in files.names(spark, folder) if n.startswith("vectors-")]) == 2
    monkeypatch.setattr(files, "put_new", put)
    assert before is not None and not (folder / "about-000000000001.json").exists()


def test_a_reader_keeps_its_generation_while_another_is_written(spark, tmp_path):
    about = {"model_name": "m", "feature_config_signature": "f"}
    rows = rows_of(spark, [[1, 2], [3, 4]])
    cache.save_cache(rows, tmp_path / "c", about)
    before = cache.load_cache(spark, tmp_path / "c", rows, about)
    cache.save_cache(rows_of(spark, [[5, 2], [6, 4]]), tmp_path / "c", about)
    assert sorted(r["features"][0] for r in before.collect()) == [1, 3]
    assert sorted(r["features"][0] for r in cache.load_cache(spark, tmp_path / "c", rows, about).collect()) == [5, 6]


def test_fingerprints_tell_changes_apart(spark):
    rows = rows_of(spark, np.zeros((3000, 1))).drop("features")
    signs, pos = order.fingerprint(rows), F.col("pos")
    assert order.fingerprint(rows.repartition(7)) == signs and order.first_difference(rows, rows.repartition(3)) is None
    changed = {
        ("moved", 17): rows.withColumn("pos", F.when(pos == 17, 2900).when(pos == 2900, 17).otherwise(pos)), ("renamed", 2999): rows.withColumn("file_name", F.when(pos == 2999, "y").otherwise(F.col("file_name"))),
        ("missing", 0): rows.filter("pos > 0"), ("repeated", 1024): rows.union(rows.filter("pos = 1024")), ("added", 3000): rows.union(rows.filter("pos = 1").withColumn("pos", F.lit(3000).cast("long"))),
        ("other", 5): rows.withColumn("image_id", F.when(pos == 5, -1).otherwise(F.col("image_id"))),
    }
    for (kind, where), other in changed.items():
        found = order.first_difference(rows, other, fan=16)
        assert order.fingerprint(other) != signs and (found.kind, found.pos) == (kind, where), kind
    assert order.fingerprint(changed["renamed", 2999])["ids"] == signs["ids"]
    assert order.first_difference(rows.limit(0), rows.limit(0)) is None and order.first_difference(rows.limit(0), rows.filter("pos = 0")).kind == "added"


def test_startup(spark, make_run, tmp_path):
    started = validate_startup(spark, load_config(make_run()))
    assert (tmp_path / "out").is_dir() and started.sample.endswith("1.jpg") and "1 indexed, 1 selected" in summary(started)
    (tmp_path / "data/one/two/1.jpg").unlink()
    with pytest.raises(StartupError, match="none of the files"):
        validate_startup(spark, load_config(tmp_path / "config.yaml"))
    with pytest.raises(StartupError, match=r"(?s)2 of 6 .*models\.net\.checkpoint.*absent\.pth.*cuda"):
        validate_startup(spark, load_config(make_run(models__net__checkpoint="absent.pth", experiment__device="cuda:999999")))
    with pytest.raises(StartupError, match="experiment.device must be"):
        validate_startup(spark, load_config(make_run(experiment__device="tpu")))


def test_names_that_file_listings_hide(spark, make_run):
    names = ["_a/1.jpg", ".2.jpg", "_3.jpg"]
    started = validate_startup(spark, load_config(make_run(names)))
    assert started.sample.endswith("_a/1.jpg") and run_retrieval(started)["feature_shape"] == [3, 64]


def test_run_then_reuse(spark, make_run, tmp_path):
    names = [f"d/{k}.jpg" for k in range(6)]
    config = make_run(names, h1__top_k=9, h1__query_image_ids=[3, 1, 3], dataset__max_images=5)
    first = run_retrieval(validate_startup(spark, load_config(config)))
    assert not first["cache_reused"] and first["feature_shape"] == [5, 64] and first["status"] == "completed"
    out = json.loads((tmp_path / "out/made/query_results").read_text())
    assert (out["num_images"], out["top_k"]) == (5, 4) and [q["image_id"] for q in out["queries"]] == [3, 1, 3]
    assert out["queries"][0] == out["queries"][2] and [m["rank"] for m in out["queries"][0]["matches"]] == [1, 2, 3, 4]
    assert (tmp_path / "out/made/query_results").read_text() == json.dumps(out, indent=2, sort_keys=True) + "\n"
    again = run_retrieval(validate_startup(spark, load_config(config)))
    assert again["cache_reused"] and json.loads((tmp_path / "out/made/query_results").read_text()) == out
    assert json.loads((tmp_path / "out/made/metadata").read_text())["cache_reused"]
    with pytest.raises(RetrievalError, match="other settings"):
        run_retrieval(validate_startup(spark, load_config(make_run(names, dataset__max_images=5, models__net__std=[1, 1, 1]))))
    assert not run_retrieval(validate_startup(spark, load_config(make_run(names, dataset__max_images=5, h1__reuse_feature_cache=False))))["cache_reused"]
    (tmp_path / "data/d/4.jpg").unlink()
    with pytest.raises(RetrievalError, match=r"d/4\.jpg"):
        run_retrieval(validate_startup(spark, load_config(config)))


def test_command_line(spark, make_run, tmp_path, capsys):
    assert main(["--config", str(make_run()), "--validate-only"]) == 0
    assert "1 indexed" in capsys.readouterr().out
    assert main(["--config", str(tmp_path / "none.yaml")]) == 2
    assert main(["--config", str(make_run())]) == 2  # one image is too few
    assert "at least two" in capsys.readouterr().err
    assert main(["--config", str(make_run(["a.jpg", "b.jpg"]))]) == 0


def test_empty_results_file(spark, tmp_path):
    flat = spark.createDataFrame([], "query_ord long, query_id long, query_file_name string, rank int, image_id long, file_name string, cosine_similarity double")
    results.write_results(tmp_path / "r.json", {"top_k": 1}, results.nested(flat))
    assert json.loads((tmp_path / "r.json").read_text()) == {"queries": [], "top_k": 1}


RETRIED = """
import sys
import tracemalloc
from pathlib import Path
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from orrery.operators import results

folder = Path(sys.argv[1])
spark = SparkSession.builder.master("local[2,3]").config(map={"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}/shared"}).getOrCreate()


def once(batches):
    for batch in batches:
        yield batch
        if not (mark := folder / f"failed-{TaskContext.get().partitionId()}").exists():
            mark.touch()
            raise RuntimeError("the first attempt fails after it gave its rows")


rows = spark.range(0, 500, 1, 3).select("id", F.concat(F.lit("n"), "id").alias("name")).mapInArrow(once, "id long, name string")
results.write_listed(folder / "out.json", {"a": 1, "z": [2]}, "rows", rows.withColumn("ord", F.col("id")), "ord")
spark.stop()
"""


def test_a_task_that_fails_once_leaves_one_right_file(tmp_path):
    subprocess.run([sys.executable, "-c", RETRIED, str(tmp_path)], check=True, cwd=Path(__file__).parent.parent, capture_output=True, timeout=300)
    assert list(tmp_path.glob("failed-*"))
    want = {"a": 1, "rows": [{"id": k, "name": f"n{k}"} for k in range(500)], "z": [2]}
    assert (tmp_path / "out.json").read_text() == json.dumps(want, indent=2, sort_keys=True) + "\n"
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("out")) == ["out.json"]


def test_a_run_that_fails_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "r.json").write_text("before")
    bad = spark.range(3).select(F.col("id").alias("ord"), F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise("x").alias("v"))
    with pytest.raises(PySparkException):
        results.write_listed(tmp_path / "r.json", {}, "rows", bad, "ord")
    assert (tmp_path / "r.json").read_text() == "before" and [p.name for p in tmp_path.iterdir()] == ["r.json"]


def test_files_of_a_store_that_only_spark_reads(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kept.link./in", f"file://{tmp_path}")
    top = "viewfs://kept/in"
    files.write_json(spark, f"{top}/a/b.json", {"k": 1})
    files.write_json(spark, f"{top}/a/b.json", {"k": 2})
    assert json.loads(files.read_text(spark, f"{top}/a/b.json")) == {"k": 2} and files.names(spark, f"{top}/a") == ["b.json"]
    assert files.put_new(spark, f"{top}/a/c", "x") and not files.put_new(spark, f"{top}/a/c", "y") and files.read_text(spark, f"{top}/a/c") == "x"
    results.write_listed(f"{top}/l.json", {"n": 1}, "rows", spark.range(20).withColumn("o", 20 - F.col("id")), "o")
    assert [r["id"] for r in json.loads((tmp_path / "l.json").read_text())["rows"]] == list(range(19, -1, -1))
    rows, about = rows_of(spark, [[1, 2], [3, 4]]), {"model_name": "m", "feature_config_signature": "f"}
    cache.save_cache(rows, f"{top}/cache", about)
    assert cache.load_cache(spark, f"{top}/cache", rows, about).count() == 2
