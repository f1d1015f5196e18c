"""Queries over the driver's tables, one for each part of the library, and SQL that gives the same rows.

embeddings stand in for features (id vec_id), pages for a manifest (id page_id, name url); positions go by id.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.errors import ManifestError, RetrievalError
from orrery.functions import paths, signatures, vectors
from orrery.operators import embed, order, results, search, select
from orrery.plans.startup import Started, summary
from orrery.shared import shared_folder, written
from orrery.sources import cache
from orrery.sources.cache import same_order, well_shaped
from orrery.sources.config import DatasetConfig, ModelConfig, OutputConfig, QueryConfig, RunConfig
from orrery.sources.manifest import checked, judged, parsed, raw_records

STRIDE, K, DIGITS = 100, 10, 6
ASKED, UNKNOWN = (5, 2, 5, 77), (3, -1, 999999999, 5, -1)
#: Bytes of a manifest's blocks here, kernels, and the size that 8 by 8 gets.
MANIFEST_BLOCK, KERNELS, SIZED = 4096, ("box", "bilinear", "bicubic", "lanczos"), (5, 11)
#: Elements of a manifest, for numbers of pages: three that break no rule, except that the last repeats an id.
MADE = (
    '{"id": %d, "file_name": "a/b.jpg"}', '{"id": %d, "file_name": "c.jpg", "height": 4}', '{"id": %d.5, "file_name": "a"}', '{"id": "%d", "file_name": "a"}',
    '{"id": %d, "file_name": " "}', '{"id": %d, "file_name": 5}', '{"id": %d, "file_name": "../a"}', '{"id": -1, "file_name": "p%d"}',
)
NAMES = ("a/b.jpg", "/tmp/a.jpg", "C:\\a.jpg", "\\\\host\\a.jpg", "a/../b", "a\\..\\b", "..", "..\n", "C:x", "\\x", "a..b/c", "../a")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, image_id, file_name and features."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("v"), "vec_id").alias("file_name"), F.col("embedding").alias("features"))
    return select.numbered(rows, "image_id", "file_name")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("image_id"), F.col("url").alias("file_name"))
    return select.numbered(rows, "image_id", "file_name")


def ranked(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    flat = results.named(search.top_k(rows, queries, k), rows)
    return flat.select("query_ord", "query_id", F.col("rank").cast("long").alias("rank"), "image_id", F.round("cosine_similarity", DIGITS).alias("score"))


def topk_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return ranked(rows, select.by_stride(rows, STRIDE), K)


def topk_explicit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return ranked(rows, select.queries_of(rows, ASKED, STRIDE), K)


def topk_head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select.head(features(spark, sf_dir), 40)
    return ranked(rows, select.by_stride(rows, 10), 50)


def score_all_one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return search.scored_pairs(rows, select.by_ids(rows, [7])).select("query_pos", "pos", F.round("score", DIGITS).alias("score"))


def query_positions_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.by_stride(features(spark, sf_dir), 7)


def unknown_query_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.unknown_ids(features(spark, sf_dir), UNKNOWN)


def select_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.head(manifest(spark, sf_dir), 100).select("pos", "image_id", "file_name")


def missing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = select.numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    return select.missing_preview(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first repeat of each id, as the manifest's rules find it."""
    rows = select.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn"), "conv_id", "turn")
    item = F.to_json(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("t/"), "turn").alias("file_name")))
    repeats = judged(parsed(rows.select("pos", item.alias("item")))).filter(F.col("violation").startswith("Duplicate"))
    first = repeats.groupBy("image_id").agg(F.min("pos").alias("pos"))
    return rows.join(first, "pos").select("conv_id", "turn")


def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of all kinds, made from pages, and the rule that each breaks."""
    rows = select.numbered(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"), "page_id")
    made = F.when(F.col("pos") % 9 == 0, "5")
    for k, text in enumerate(MADE, 1):
        made = made.when(F.col("pos") % 9 == k, F.format_string(text, "page_id"))
    found = judged(parsed(rows.select("pos", made.alias("item"))))
    return found.select("pos", F.when(F.col("violation").isNull(), "fine").otherwise(F.regexp_replace("violation", r"images\[\d+\]", "images[]")).alias("verdict"))


def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("name"))
    names = spark.createDataFrame([(n,) for n in NAMES], "name string").union(urls)
    return names.select("name", paths.is_unsafe(F.col("name")).alias("unsafe"), paths.is_blank(F.col("name")).alias("blank"))


def path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("image_id", paths.joined(F.lit("/data"), F.col("file_name")).alias("path"))


def image_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(signatures.image_signature(manifest(spark, sf_dir)),)], "signature string")


def exploded(rows: DataFrame, value: str, digits: int = DIGITS) -> DataFrame:
    return rows.select("image_id", F.posexplode(value).alias("i", "x")).select("image_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), digits).alias("value"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(features(spark, sf_dir).withColumn("v", vectors.l2_normalized(F.transform(vectors.doubles(F.col("features")), lambda x: x * F.lit(3.0)))), "v")


def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(features(spark, sf_dir).withColumn("v", vectors.mean_pooled(F.col("features"), (16, 4))), "v")


def token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(features(spark, sf_dir).withColumn("v", vectors.mean_pooled(F.col("features"), (4, 16))), "v")


def channel_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(features(spark, sf_dir).withColumn("v", vectors.channel_normalized(F.slice("features", 1, 63), (0.1, 0.2, 0.3), (0.5, 0.25, 2.0))), "v")


def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.batches(features(spark, sf_dir), 64).select("pos", "image_id", "batch")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    selected = select.head(rows, 300).agg(F.count("*")).scalar()
    return rows.agg(F.count("*").alias("indexed"), F.max(F.size("features")).cast("long").alias("dimensions")).select("indexed", selected.alias("selected"), "dimensions")


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    found = results.nested(results.named(search.top_k(rows, select.by_stride(rows, STRIDE), K), rows))
    flat = found.select("query_ord", F.col("image_id").alias("query_id"), F.posexplode("matches").alias("i", "m"))
    return flat.select("query_ord", "query_id", (F.col("i") + 1).cast("long").alias("rank"), "m.image_id", F.round("m.cosine_similarity", DIGITS).alias("score"))


def cache_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    swapped = rows.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    less = rows.filter("pos > 0")
    checks = [("same", same_order(rows, rows)), ("swapped", same_order(swapped, rows)), ("one less", same_order(less, rows)), ("shape", well_shaped(rows, rows.count())), ("shape of one less", well_shaped(less, rows.count()))]
    return spark.createDataFrame(checks, "check string, fits boolean")


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a manifest, one JSON file, and read from it again by blocks; some of them break a rule."""
    pages = manifest(spark, sf_dir).withColumn("file_name", F.when(F.col("pos") % 11 == 3, "a/../b").otherwise(F.col("file_name")))
    listed = pages.select("pos", F.col("image_id").alias("id"), "file_name", F.array(F.struct(F.lit('"]},{[').alias("x"), F.col("pos").alias("y"))).alias("more"))
    place = f"{shared_folder(spark)}.json"
    results.write_listed(place, {"annotations": [{"id": k, "segmentation": [[1.5, k]]} for k in range(50)], "info": {"images": [0]}}, "images", listed, "pos")
    return judged(raw_records(spark, place, MANIFEST_BLOCK)).select("pos", "image_id", "file_name", F.col("violation").isNull().alias("fine"))


def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What start-up observes of a manifest while its records are written: their number, and an error of the first that breaks a rule."""
    pages = manifest(spark, sf_dir)
    rows = []
    for case, key, broken in (("fine", "images", F.lit(False)), ("broken", "images", F.col("pos") >= 17), ("none", "images", F.lit(None).cast("boolean")), ("no list", "pictures", F.lit(False))):
        named = pages.filter(broken.isNotNull()).select("pos", F.col("image_id").alias("id"), F.when(broken, F.concat(F.lit("/"), F.col("pos").cast("string"))).otherwise(F.col("file_name")).alias("file_name"))
        place = f"{shared_folder(spark)}.json"
        results.write_listed(place, {}, key, named, "pos")
        try:
            rows.append((case, checked(spark, place)[1], "none"))
        except ManifestError as error:
            rows.append((case, -1, str(error).split(":")[0]))
    return spark.createDataFrame(rows, "case string, records long, problem string")


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a run prints of what it found, for pages as a manifest."""
    place = f"{shared_folder(spark)}.json"
    results.write_listed(place, {}, "images", manifest(spark, sf_dir).select("pos", F.col("image_id").alias("id"), "file_name"), "pos")
    records, indexed = checked(spark, place, "/data")
    model = ModelConfig(Path("/model.bin"), "net", (8, 8), (0, 0, 0), (1, 1, 1), "box", "avg", 1, 0, False, "bfloat16", True)
    output = OutputConfig(*(Path("/out") / k for k in ("", "cache", "results", "figures", "cases", "metadata")))
    config = RunConfig(Path("/run.yaml"), "trial", 0, "cpu", DatasetConfig(Path("/data"), Path("/data/list.json"), 100), model, "m", QueryConfig((), 1, 1, False), output)
    sample = records.agg(F.min_by("path", "pos").alias("path")).first()["path"]
    lines = summary(Started(config, records, indexed, sample)).splitlines()[1:]
    return spark.createDataFrame([tuple(line.strip().split(": ", 1)) for line in lines], "line string, value string")


def selection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first so many records are enough for a search."""
    rows, found = features(spark, sf_dir), []
    for n in (0, 1, 2, None):
        try:
            select.require_two(select.head(rows, n))
            found.append((str(n), True))
        except RetrievalError:
            found.append((str(n), False))
    return spark.createDataFrame(found, "records string, enough boolean")


def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topk_stride, written as a run writes its results and read from that file."""
    rows = features(spark, sf_dir)
    place = f"{shared_folder(spark)}.json"
    results.write_results(place, {"top_k": K}, results.nested(results.named(search.top_k(rows, select.by_stride(rows, STRIDE), K), rows)))
    match = "struct<rank: long, image_id: long, file_name: string, cosine_similarity: double>"
    read = spark.read.schema(f"queries array<struct<image_id: long, file_name: string, matches: array<{match}>>>, top_k long").option("multiLine", True).json(place)
    flat = read.select(F.posexplode("queries").alias("query_ord", "q")).select(F.col("query_ord").cast("long"), F.col("q.image_id").alias("query_id"), F.explode("q.matches").alias("m"))
    return flat.select("query_ord", "query_id", "m.rank", "m.image_id", F.round("m.cosine_similarity", DIGITS).alias("score"))


def resize_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of 8 by 8, made larger and smaller by each kernel."""
    rows = features(spark, sf_dir)
    sized = [F.struct(F.lit(k).alias("kernel"), vectors.resized(F.col("features"), (8, 8), SIZED, k).alias("v")) for k in KERNELS]
    flat = rows.select("image_id", F.explode(F.array(*sized)).alias("s")).select("image_id", "s.kernel", F.posexplode("s.v").alias("i", "x"))
    return flat.select("image_id", "kernel", F.col("i").cast("long").alias("i"), F.round("x", DIGITS).alias("value"))


def order_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one change each, and the first position at which they differ from those without it."""
    rows = written(features(spark, sf_dir).select("pos", "image_id", "file_name"))
    pos = F.col("pos")
    cases = {
        "same": rows,
        "swapped": rows.withColumn("pos", F.when(pos == 40, 203).when(pos == 203, 40).otherwise(pos)),
        "renamed": rows.withColumn("file_name", F.when(pos == 57, "other").otherwise(F.col("file_name"))),
        "last missing": rows.filter(pos < rows.agg(F.max("pos")).scalar()),
        "repeated": rows.union(rows.filter(pos == 300)),
        "other id": rows.withColumn("image_id", F.when(pos == 5, -7).otherwise(F.col("image_id"))),
    }
    signs, found = order.fingerprint(rows), []
    for case, other in cases.items():
        first = order.first_difference(rows, other)
        found.append((case, order.fingerprint(other) == signs, first.pos if first else -1, first.kind if first else "none"))
    return spark.createDataFrame(found, "case string, equal boolean, pos long, kind string")


def cache_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of features says to records and settings that fit, and to others; the second of two generations counts."""
    rows, folder = written(features(spark, sf_dir)), shared_folder(spark)
    about = {"model_name": "m", "feature_config_signature": "s"}
    found = [("none yet", cache.load_cache(spark, folder, rows, about) is None)]
    cache.save_cache(rows.filter("pos < 10"), folder, about)
    cache.save_cache(rows, folder, about)
    cases = {
        "same": (rows, about), "fewer records": (rows.filter("pos < 10"), about), "renamed": (rows.withColumn("file_name", F.upper("file_name")), about),
        "other model": (rows, about | {"model_name": "n"}), "other settings": (rows, about | {"feature_config_signature": "t"}),
    }
    for case, (records, now) in cases.items():
        try:
            found.append((case, cache.load_cache(spark, folder, records, now) is not None))
        except RetrievalError:
            found.append((case, False))
    return spark.createDataFrame(found, "case string, fits boolean")


def batch_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as images of three channels, 4 by 5, through a layer of kernels in batches, and pooled."""
    kernels = np.array([(i * 5) % 7 - 3 for i in range(4 * 27)], float).reshape(4, 3, 3, 3) / 8
    bias = np.arange(4) / 10
    layer = embed.Embedder((3, 4, 5), lambda content: np.zeros(60), lambda: lambda batch: np.stack([embed.convolved(x, kernels, bias) for x in batch.astype(float)]))
    rows = features(spark, sf_dir).select("image_id", F.slice("features", 1, 60).alias("pixels"))
    return exploded(rows.select("image_id", embed.predicted("pixels", layer, batch_size=7).alias("v")), "v", digits=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        topk_stride, topk_explicit_ids, topk_head_limit, score_all_one_query, query_positions_stride, unknown_query_ids, select_head, missing_preview, duplicate_ids, manifest_rules, unsafe_paths,
        path_join, image_signature, l2_normalize, mean_pool, token_pool, channel_normalize, batch_assignment, run_summary, nested_results, cache_check,
        manifest_scan, manifest_summary, summary_text, selection_checks, result_file, resize_kernels, order_differences, cache_generations, batch_inference,
    )
}

_F = "f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_P = "p AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS pos, page_id, url FROM pages)"
_RANKED = f"""s AS (SELECT q.ord, a.vec_id AS query_id, b.vec_id, b.pos, list_dot_product(a.v, b.v) AS score FROM q JOIN f a ON a.pos = q.pos JOIN f b ON b.pos <> a.pos),
    r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, pos) AS rank FROM s)
    SELECT CAST(ord AS BIGINT) AS query_ord, query_id, rank, vec_id AS image_id, round(score, {DIGITS}) AS score FROM r WHERE rank <= """
_PATTERN = r"(?s)\A/|\A[\\/]{2}|\A.:[\\/]|(?:\A|[\\/]|\A[^\\/]:)\.\.(?:[\\/]|\z)"
_TOPK = f"WITH {_F}, q AS (SELECT pos // {STRIDE} AS ord, pos FROM f WHERE pos % {STRIDE} = 0), {_RANKED} {K}"


def _values(rows: tuple) -> str:
    return ", ".join(f"({k}, {x})" for k, x in enumerate(rows))


def _text(name: str) -> str:
    parts = "||".join(f"'{x}'" if len(x) > 1 or x not in "\n" else f"chr({ord(x)})" for x in ([name[:-1], "\n"] if name.endswith("\n") else [name]))
    return f"({parts})"


SQL: dict[str, str] = {
    "topk_stride": _TOPK,
    "nested_results": _TOPK,
    "topk_explicit_ids": f"WITH {_F}, w(ord, id) AS (VALUES {_values(ASKED)}), q AS (SELECT ord, pos FROM w JOIN f ON vec_id = id), {_RANKED} {K}",
    "topk_head_limit": f"WITH g AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE pos < 40), f AS (SELECT * FROM g), q AS (SELECT pos // 10 AS ord, pos FROM f WHERE pos % 10 = 0), {_RANKED} 39",
    "score_all_one_query": f"WITH {_F} SELECT a.pos AS query_pos, b.pos, round(list_dot_product(a.v, b.v), {DIGITS}) AS score FROM f a JOIN f b ON b.pos <> a.pos WHERE a.vec_id = 7",
    "query_positions_stride": f"WITH {_F} SELECT pos // 7 AS query_ord, pos AS query_pos FROM f WHERE pos % 7 = 0",
    "unknown_query_ids": f"WITH w(query_ord, image_id) AS (VALUES {_values(UNKNOWN)}) SELECT CAST(query_ord AS BIGINT) AS query_ord, CAST(image_id AS BIGINT) AS image_id FROM w WHERE image_id NOT IN (SELECT vec_id FROM embeddings)",
    "select_head": f"WITH {_P} SELECT pos, page_id AS image_id, url AS file_name FROM p WHERE pos < 100",
    "missing_preview": "WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id FROM documents), m AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT pos, doc_id, greatest((SELECT count(*) FROM m) - 5, 0) AS more FROM m ORDER BY pos LIMIT 5",
    "duplicate_ids": "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 2",
    "manifest_rules": f"""WITH {_P} SELECT pos, CASE WHEN pos % 9 = 0 THEN 'images[] must be an object.' WHEN pos % 9 IN (3, 4) THEN 'images[].id must be an integer of at most 64 bits.'
        WHEN pos % 9 IN (5, 6) THEN 'images[].file_name must be a non-empty string.' WHEN pos % 9 = 7 THEN 'images[].file_name must be relative to dataset.root: ../a'
        WHEN pos % 9 = 8 AND pos > 8 THEN 'Duplicate image id in manifest: -1' ELSE 'fine' END AS verdict FROM p""",
    "unsafe_paths": f"WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT * FROM (VALUES {', '.join(map(_text, NAMES))})) SELECT name, regexp_matches(name, '{_PATTERN}') AS unsafe, trim(name) = '' AS blank FROM n",
    "path_join": f"WITH {_P}, j AS (SELECT page_id, regexp_replace('/data/' || url, '/(\\.?/)+', '/', 'g') AS path FROM p) SELECT page_id AS image_id, regexp_replace(path, '(/\\.?)+$', '') AS path FROM j",
    "image_signature": "SELECT sha256(string_agg(CAST(page_id AS VARCHAR) || chr(0) || url || chr(10), '' ORDER BY page_id)) AS signature FROM pages",
    "l2_normalize": f"WITH {_F}, m AS (SELECT vec_id, list_transform(v, lambda x: x * 3.0::DOUBLE) AS v FROM f), e AS (SELECT vec_id, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM m) SELECT vec_id AS image_id, i, round(x / n, {DIGITS}) AS value FROM e",
    "mean_pool": f"WITH {_F}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM f) SELECT vec_id AS image_id, j // 4 AS i, round(avg(x), {DIGITS}) AS value FROM e GROUP BY ALL",
    "token_pool": f"WITH {_F}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM f) SELECT vec_id AS image_id, j // 16 AS i, round(avg(x), {DIGITS}) AS value FROM e GROUP BY ALL",
    "channel_normalize": f"WITH {_F}, e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM f) SELECT vec_id AS image_id, i, round(CASE i // 21 WHEN 0 THEN (x - 0.1::DOUBLE) / 0.5::DOUBLE WHEN 1 THEN (x - 0.2::DOUBLE) / 0.25::DOUBLE ELSE (x - 0.3::DOUBLE) / 2.0::DOUBLE END, {DIGITS}) AS value FROM e WHERE i < 63",
    "batch_assignment": f"WITH {_F} SELECT pos, vec_id AS image_id, pos // 64 AS batch FROM f",
    "run_summary": "SELECT count(*) AS indexed, least(count(*), 300) AS selected, max(len(embedding)) AS dimensions FROM embeddings",
    "manifest_scan": f"WITH {_P} SELECT pos, page_id AS image_id, CASE WHEN pos % 11 = 3 THEN 'a/../b' ELSE url END AS file_name, pos % 11 <> 3 AS fine FROM p",
    "manifest_summary": "SELECT 'fine' AS \"case\", count(*) AS records, 'none' AS problem FROM pages UNION ALL SELECT 'broken', CASE WHEN count(*) > 17 THEN -1 ELSE count(*) END, CASE WHEN count(*) > 17 THEN 'images[17].file_name must be relative to dataset.root' ELSE 'none' END FROM pages UNION ALL SELECT 'none', -1, 'Manifest contains no image records' UNION ALL SELECT 'no list', -1, 'Manifest must be an object with a list ''images'''",
    "summary_text": f"""WITH {_P}, n AS (SELECT count(*) AS n FROM p)
        SELECT * FROM (VALUES ('name', 'trial'), ('dataset', '/data'), ('annotation', '/data/list.json'), ('model', 'net'), ('checkpoint', '/model.bin'), ('device', 'cpu'), ('output', '/out')) AS t(line, value)
        UNION ALL SELECT 'images', n || ' indexed, ' || least(n, 100) || ' selected' FROM n
        UNION ALL SELECT 'sample', regexp_replace(regexp_replace('/data/' || url, '/(\\.?/)+', '/', 'g'), '(/\\.?)+$', '') FROM p WHERE pos = 0""",
    "selection_checks": "SELECT records, least(k, n) >= 2 AS enough FROM (VALUES ('0', 0), ('1', 1), ('2', 2), ('None', 1000000000)) AS t(records, k), (SELECT count(*) AS n FROM embeddings)",
    "result_file": _TOPK,
    "resize_kernels": f"""WITH {_F}, k(kernel, reach) AS (VALUES {", ".join(f"('{k}', {r})" for k, r in (("box", 0.5), ("bilinear", 1.0), ("bicubic", 2.0), ("lanczos", 3.0)))}),
        a AS (SELECT kernel, CAST(reach AS DOUBLE) AS reach, n, CAST(o AS INTEGER) AS o, (o + 0.5) * 8.0 / n AS middle, greatest(8.0 / n, 1.0)::DOUBLE AS wide FROM k, (SELECT {SIZED[0]} AS n UNION ALL SELECT {SIZED[1]}), generate_series(0, 10) AS t(o) WHERE o < n),
        b AS (SELECT kernel, n, o, CAST(x AS INTEGER) AS x, (x + 0.5 - middle)::DOUBLE / wide AS d FROM a, generate_series(0, 7) AS t(x) WHERE x >= floor(middle - reach * wide + 0.5) AND x < floor(middle + reach * wide + 0.5)),
        c AS (SELECT *, CASE kernel WHEN 'box' THEN CASE WHEN d > -0.5 AND d <= 0.5 THEN 1.0 ELSE 0.0 END WHEN 'bilinear' THEN greatest(0.0, 1.0 - abs(d))
            WHEN 'bicubic' THEN CASE WHEN abs(d) < 1 THEN 1.5 * pow(abs(d), 3) - 2.5 * d * d + 1 WHEN abs(d) < 2 THEN -0.5 * pow(abs(d), 3) + 2.5 * d * d - 4 * abs(d) + 2 ELSE 0.0 END
            ELSE CASE WHEN d = 0 THEN 1.0 WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0.0 END END::DOUBLE AS h FROM b),
        w AS (SELECT kernel, n, o, x, h / sum(h) OVER (PARTITION BY kernel, n, o) AS w FROM c),
        e AS (SELECT vec_id, unnest(v) AS p, generate_subscripts(v, 1) - 1 AS j FROM f),
        r AS (SELECT vec_id, w.kernel, j // 8 AS y, w.o AS ox, sum(p * w.w) AS p FROM e JOIN w ON w.n = {SIZED[1]} AND w.x = j % 8 GROUP BY ALL)
        SELECT vec_id AS image_id, r.kernel, CAST(w.o * {SIZED[1]} + r.ox AS BIGINT) AS i, round(sum(r.p * w.w), {DIGITS}) AS value FROM r JOIN w ON w.kernel = r.kernel AND w.n = {SIZED[0]} AND w.x = r.y GROUP BY vec_id, r.kernel, w.o, r.ox""",
    "order_differences": """WITH n AS (SELECT count(*) AS n FROM embeddings)
        SELECT * FROM (VALUES ('same', true, -1::BIGINT, 'none'), ('swapped', false, 40, 'moved'), ('renamed', false, 57, 'renamed'), ('repeated', false, 300, 'repeated'), ('other id', false, 5, 'other')) AS t("case", equal, pos, kind)
        UNION ALL SELECT 'last missing', false, n - 1, 'missing' FROM n""",
    "cache_generations": "SELECT * FROM (VALUES ('none yet', true), ('same', true), ('fewer records', false), ('renamed', false), ('other model', false), ('other settings', false)) AS t(\"case\", fits)",
    "batch_inference": f"""WITH {_F}, e AS (SELECT vec_id, unnest(v) AS p, generate_subscripts(v, 1) - 1 AS j FROM f),
        k AS (SELECT CAST(t.i AS INTEGER) AS i, ((t.i * 5) % 7 - 3) / 8.0::DOUBLE AS w, t.i // 27 AS n, t.i // 9 % 3 AS c, t.i // 3 % 3 AS r, t.i % 3 AS s FROM generate_series(0, 107) AS t(i)),
        o AS (SELECT a.y, b.x FROM generate_series(0, 1) AS a(y), generate_series(0, 2) AS b(x)),
        g AS (SELECT vec_id, n, y, x, greatest(sum(p * w) + n / 10.0::DOUBLE, 0) AS z FROM o, k, e WHERE e.j < 60 AND 2 * y + r - 1 BETWEEN 0 AND 3 AND 2 * x + s - 1 BETWEEN 0 AND 4 AND e.j = c * 20 + (2 * y + r - 1) * 5 + 2 * x + s - 1 GROUP BY vec_id, n, y, x)
        SELECT vec_id AS image_id, CAST(n AS BIGINT) AS i, round(CAST(avg(z) AS FLOAT)::DOUBLE, 4) AS value FROM g GROUP BY vec_id, n""",
    "cache_check": "SELECT * FROM (VALUES ('same', true), ('swapped', false), ('one less', false), ('shape', true), ('shape of one less', false)) AS t(\"check\", fits)",
}
