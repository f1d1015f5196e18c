from __future__ import annotations

import json
from pathlib import Path, PurePosixPath, PureWindowsPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.errors import ManifestError
from orrery.functions import paths
from orrery.sources import blocks
from orrery.sources.manifest import judged, read_manifest, read_records


def read(spark, folder: Path, text: str | bytes) -> list[tuple]:
    file = folder / "m.json"
    file.write_bytes(text if isinstance(text, bytes) else text.encode())
    return [tuple(r) for r in read_manifest(spark, f"file://{file}").orderBy("pos").collect()]


def record(id_: object = 1, name: object = "a.jpg") -> dict:
    return {"id": id_, "file_name": name}


def test_order_and_further_keys(spark, tmp_path):
    text = json.dumps({"x": 1, "images": [record(9, "é/1.jpg") | {"height": 3}, record(2, "b//c.jpg")]})
    assert read(spark, tmp_path, text) == [(0, 9, "é/1.jpg"), (1, 2, "b//c.jpg")]


def test_last_of_equal_keys_counts(spark, tmp_path):
    assert read(spark, tmp_path, '{"images": [{"id": 1, "id": 2, "file_name": "a"}]}') == [(0, 2, "a")]


@pytest.mark.parametrize(
    ("images", "message"),
    [
        ([record(), 5], r"images\[1\] must be an object"),
        ([record(), None], r"images\[1\] must be an object"),
        ([[1]], r"images\[0\] must be an object"),
        *(([record(x)], r"images\[0\]\.id must be an integer") for x in (1.0, True, "1", None, 2**63)),
        ([{"file_name": "a"}], r"images\[0\]\.id must be an integer"),
        *(([record(1, x)], r"images\[0\]\.file_name must be a non-empty") for x in (5, " ", "\u3000\x1c", "", None)),
        *(([record(1, x)], "relative to dataset.root") for x in ("/tmp/a.jpg", "C:\\a\\b.jpg", "a/../b", "a\\..\\b", "..\\n", "..")),
        ([record(1), record(2), record(1)], "Duplicate image id in manifest: 1"),
        ([record(1), record(1), 5], "Duplicate"),
        ([record(1, "/a"), 5], r"images\[0\]\.file_name must be relative"),
        ([], "no image records"),
    ],
)
def test_violations(spark, tmp_path, images, message):
    with pytest.raises(ManifestError, match=message):
        read(spark, tmp_path, json.dumps({"images": images}))


GOOD = [
    '{"a": [1, {"b": "}]"}], "images": [{"id": 12, "file_name": "x}y"}, 5, null, [1], {"id": 1.5e3}], "z": {"q": [{}], "r": "[,"}}', '{"images":[]}\n', ' { "images" : [ {} ] } ', '{"images": 3, "images": [1]}',
    '{"k": "\\\\", "l\\"}": ["\\\\\\"", "{"], "images": [{"id": 1, "file_name": "\\\\\\"}é,"}, {"file_name": "\\u007d", "x": [[{"y": "]"}]]}], "m": {}, "n": [[], {}]}',
]
BAD = [
    '{"images": [1,]}', '{"images": [1 2]}', '{"images": [1]', '{"images": [NaN]}', '{"images": [1]} x', '{"images" [1]}', '{"images": [1]}}', '{1: 2}', "", '{"images": [{"id": 1]}}', '{"images": [1}]', '{"images": [,1]}',
    '{"images": [1], "a": {"b"}}', '{"images": [1], "a": {"b": 1,}}', '{"images": [1], "a": {"b": 1 "c": 2}}', '{"images": [1], "a": {1, 2}}', '{"images": ["a]}', '{"images": [1], "a": [{]}]}', '{"images": [\\]}', '{"images": [1],}', '{"images": ["\t"]}', ']}{[',
    '{"images": [{"id": 1, "file_name": "\\ud800"}]}',
]


def items_of(parts: list[bytes]) -> list[str] | str:
    """What the parts of a text give when each is scanned by itself, and the sums before them are added up."""
    switches = depth = openings = commas = 0
    known, skeleton = [], b""
    for part in parts:
        inside = switches % 2 == 1
        block = blocks.Block.at(part, inside, depth)
        known.append((block, depth, openings, commas))
        skeleton += block.skeleton()
        quotes, if_outside, if_inside = blocks.speculated(part)
        switches, depth = switches + quotes, depth + (if_inside if inside else if_outside)
        openings, commas = openings + int(block.opening.sum()), commas + int(block.comma.sum())
    pieces: dict[tuple[int, int], bytes] = {}
    for block, *before in known:
        for container, number, _, text in block.pieces(*before):
            pieces[container, number] = pieces.get((container, number), b"") + text
    try:
        kinds, images = blocks.containers_of(skeleton)
        found = [(c, blocks.content_of(text, kinds[c - 1])) for (c, _), text in sorted(pieces.items())]
        return [blocks.record_of(v[0]) for c, v in found if c == images and v]
    except (ManifestError, ValueError) as error:
        return str(error)


def wanted(text: str) -> list[dict | int]:
    short = lambda x: {k: 0.5 if isinstance(x[k], float) else x[k] for k in ("id", "file_name") if k in x} if isinstance(x, dict) else 0
    return [short(x) for x in json.loads(text)["images"]]


def cuts(text: bytes) -> list[list[bytes]]:
    """The text in two parts, cut at every byte after which no escape is pending, and in as many parts as there are such bytes."""
    fine = [k for k in range(1, len(text)) if (len(text[:k]) - len(text[:k].rstrip(b"\\"))) % 2 == 0]
    return [[text], *([text[:k], text[k:]] for k in fine), [text[a:b] for a, b in zip([0, *fine], [*fine, len(text)], strict=True)]]


def test_blocks_cut_at_every_byte():
    for text in GOOD:
        for parts in cuts(text.encode()):
            assert [json.loads(x) for x in items_of(parts)] == wanted(text), parts
    for text in BAD:
        for parts in cuts(text.encode()):
            assert isinstance(items_of(parts), str), parts
    for text, message in (('{"images": 3}', "a list 'images'"), ('{"images": [], "images": 3}', "a list 'images'"), ('{"images": [], "images": [1]}', "more than one"), ('[{"images": []}]', "a list 'images'")):
        assert all(message in items_of(parts) for parts in cuts(text.encode()))


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text('{}[],:"\\\\ab', max_size=4), x, max_size=4), max_leaves=20), st.data())
@settings(max_examples=150, deadline=None)
def test_any_json(value, data):
    text = json.dumps({"before": value, "images": [value, {"id": 7, "file_name": "{,", "other": value}], "after": value}, ensure_ascii=False, indent=data.draw(st.sampled_from([None, 1])))
    every = cuts(text.encode())
    for parts in (every[0], every[-1], data.draw(st.sampled_from(every))):
        assert [json.loads(x) for x in items_of(parts)] == wanted(text)


@pytest.mark.parametrize("block", [1, 20, 1 << 20])
def test_blocks_in_tasks(spark, tmp_path, block):
    file = tmp_path / "m.json"
    file.write_text(GOOD[0])
    assert [json.loads(r["item"]) for r in blocks.elements(spark, f"file://{file}", file.stat().st_size, block).orderBy("pos").collect()] == wanted(GOOD[0])
    for text in (BAD[1], BAD[8], BAD[12], BAD[-1]):
        file.write_text(text)
        with pytest.raises(ManifestError, match="not valid JSON"):
            blocks.elements(spark, f"file://{file}", file.stat().st_size, block)


def test_a_byte_order_mark_and_lines_after_the_end(spark, tmp_path):
    for text in ("\ufeff" + '{"images": [{"id": 1, "file_name": "a"}]}', "\ufeff" + '{"images": [{"id": 1, "file_name": "a"}]}\n\n', '{"images": [{"id": 1, "file_name": "a"}]}\n \n'):
        assert read(spark, tmp_path, text) == [(0, 1, "a")]


def test_a_manifest_of_150_megabytes(spark, tmp_path):
    file, n = tmp_path / "large.json", 400_000
    with file.open("w") as out:  # one line, as such files mostly are
        out.write('{"annotations": [' + ",".join(f'{{"id": {k}, "segmentation": [[{k}.5, {"1.25, " * 50} 3]]}}' for k in range(n)) + '], "images": [')
        out.write(",".join(f'{{"height": 4, "id": {k}, "file_name": "d/{k}.jpg"}}' for k in range(n)) + "]}")
    assert file.stat().st_size > 150e6
    assert blocks.blocks_of(spark, f"file://{file}", file.stat().st_size, blocks.BLOCK)[0].select("start").distinct().count() >= 4  # so many tasks read it
    got = read_manifest(spark, f"file://{file}")
    assert got.filter("pos = image_id AND file_name = concat('d/', pos, '.jpg')").count() == n


def test_lines_of_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 3, "file_name": "x"}\n\n{"id": "3"}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3, "file_name": "y"}\n{')
    got = judged(read_records(spark, f"file://{tmp_path}/*.jsonl")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == [0, 1, 2, 3] and [r["violation"] is None for r in got] == [True, False, False, False] and "Duplicate" in got[2]["violation"]


@pytest.mark.parametrize("text", ["{", "[]", '{"images": 3}', "{}", b'{"images": "\xff'])
def test_other_shapes(spark, tmp_path, text):
    with pytest.raises(ManifestError):
        read(spark, tmp_path, text)
    with pytest.raises(ManifestError, match="can't be read"):
        read_manifest(spark, f"file://{tmp_path}/none.json")


def test_a_name_tells_lines_from_one_object(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": 3, "file_name": "x"}\n{"id": 4, "file_name": "y"}\n')
    assert [tuple(r) for r in read_manifest(spark, f"file://{tmp_path}/m.jsonl").orderBy("pos").collect()] == [(0, 3, "x"), (1, 4, "y")]


def test_paths_as_pathlib_has_them(spark):
    from itertools import product

    names = ["".join(p) for n in (1, 2, 3) for p in product(("/", "\\", "..", ".", "C:", "x", "\n"), repeat=n)]
    unsafe = lambda n: PurePosixPath(n).is_absolute() or PureWindowsPath(n).is_absolute() or ".." in PurePosixPath(n).parts or ".." in PureWindowsPath(n).parts
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", paths.is_unsafe(F.col("name")).alias("u"), paths.joined(F.lit("/r"), F.col("name")).alias("p")).collect()
    assert [r["name"] for r in rows if r["u"] != unsafe(r["name"])] == []
    assert [r["name"] for r in rows if not r["u"] and r["p"] != str(Path("/r") / r["name"])] == []
