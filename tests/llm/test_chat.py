from __future__ import annotations

import os
from itertools import product

import numpy as np
import pytest

from orrery.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int"


def run(spark, rows, **how):
    return sorted((tuple(r) for r in chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()), key=str)


ROWS = [
    (1, 0, "System", "Be brief."), (1, 1, "human", "What is it?\nTell me"), (1, 2, "ASSISTANT", "It is.\n- a\n- b"), (1, 3, None, "Really?"), (1, 4, "bot", None),
    (2, 0, None, "User: hi\n**Assistant:** hello there\nmore of it\nUser: bye"), (None, None, "user", ""), (None, 3, "x", "<|turn|>user"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "z " * 20_000),
]


def test_cases(spark):
    got = run(spark, ROWS)
    assert [(t[3], t[4]) for t in got if t[0] == 2] == [("user", "hi"), ("assistant", "hello there\nmore of it"), ("user", "bye")]
    assert [t[3] for t in sorted((t for t in got if t[0] == 1), key=lambda t: t[1])] == ["system", "user", "assistant", "user", "assistant"]
    assert sum(t[0] == 3 for t in got) == 2 and sum(t[0] is None for t in got) == 2
    assert all(t[5].count("<|turn|>") == 1 and t[5].startswith(f"<|turn|>{t[3]}\n") and t[5].endswith("<|end|>\n") for t in got)
    assert run(spark, []) == []


@pytest.mark.parametrize("chunk", [1, 3, 10])
def test_chunks_make_no_difference(spark, monkeypatch, chunk):
    rng = np.random.default_rng(0)
    rows = [(int(k > 60), k, rng.choice(["user", "assistant", "system"]) if rng.random() < 0.4 else None, "x " * int(rng.integers(1, 90)) + "?" * int(rng.integers(0, 2))) for k in range(80)]
    whole = run(spark, rows + ROWS)
    monkeypatch.setattr(chat, "CHUNK", chunk)
    assert run(spark, rows + ROWS) == whole


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    model = chat.logs(rng.integers(1, 9, chat.R), rng.integers(1, 9, (chat.R, chat.R)), rng.integers(1, 9, (chat.R, chat.FEATURES)))
    lines = [("", int(rng.integers(-1, chat.R)), int(rng.integers(0, chat.FEATURES)), bool(rng.integers(0, 2))) for _ in range(5)]

    def score(path, before):
        total = 0.0
        for k, line in enumerate(lines):
            move, seen = chat.step(line, model)
            last = path[k - 1] if k else before
            total += (model[0][path[k]] if last is None else move[last, path[k]]) + seen[path[k]]
        return total

    for before, end in product((None, 0, 2), (None, 1, 3)):
        paths = [p for p in product(range(chat.R), repeat=5) if end is None or p[-1] == end]
        assert score(chat.best_path(lines, model, before, end), before) == pytest.approx(max(score(p, before) for p in paths))
    matrix = chat.span_matrix(lines, model, False)
    assert matrix[2, 1] == pytest.approx(max(score(p, 2) for p in product(range(chat.R), repeat=5) if p[-1] == 1))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_roles_that_are_hidden(spark):
    """Of every third row the role is hidden: half of these name it at the beginning of their text, half nowhere."""
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").toPandas()
    rows = rows[rows.role.isin(["system", "user", "assistant"])].drop_duplicates(["conv_id", "turn"]).reset_index(drop=True)
    where = (rows.conv_id * 7 + rows.turn) % 6
    shown = rows.assign(role=rows.role.where(where > 1, None), text=[f"{r.title()}: {t}" if w == 1 else t for r, t, w in zip(rows.role, rows.text, where, strict=True)])
    got = chat.formatted(spark.createDataFrame(shown.astype(object).where(shown.notna(), None))).filter("part = 0").toPandas()
    both = rows.assign(where=where).merge(got, left_on=["conv_id", "turn"], right_on=["conv", "nth_row"])
    right = (both.role_x == both.role_y).groupby(both["where"].clip(upper=2)).mean()
    print(f"roles recovered: named in the text {right[1]:.3f}, nowhere {right[0]:.3f}, in their column {right[2]:.3f}; rows {len(both)}")
    assert right[2] > 0.97 and right[1] > 0.97 and right[0] > 0.8
