"""Transcript parsing and canonical chat turns, by a hidden Markov model over lines.

A conversation is its rows in order, each row some lines. Hidden are the roles of lines; seen are the speaker marker
(a row's own, or one at the beginning of a line) and features of the line: its length, a question mark at its end, a
list or code. A marker speaks for its role with weight, but a missing, unknown or misplaced one does not decide alone:
Viterbi finds the likeliest roles of a whole conversation. Runs of lines of one role in a row become turns.

What follows what, and which lines a role writes, is counted over all rows with a known marker.

Rows are dealt by ranges of (conversation, order) to chunks of bounded size, so a conversation of any length spans as
many chunks as it needs. Viterbi runs across them exactly: where a conversation crosses from chunk to chunk, each
gives the best score from any role before it to any role at its end (a small matrix for each chunk); the driver links
those of one conversation, and each chunk then finds its lines between the roles it is given.

Cases: null and empty texts are a row with one empty line. Null conversation ids are one conversation, first in order;
null orders come first in theirs. Equal orders: by marker, then text, then any order. A repeated row is a row again.
No rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant", "tool")
#: Markers that stand for each role.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "customer", "prompter", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "model", "gpt", "agent", "answer", "a"),
    "tool": ("tool", "function", "observation"),
}
ROLE_OF = {m: k for k, r in enumerate(ROLES) for m in MARKERS[r]}
#: A marker at the beginning of a line: a word between signs and a colon or closing sign.
LINE_MARKER = re.compile(r"\A\s{0,3}(?:#{1,4}\s*|\*\*|\[|<\|)?\s*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")\s*(?:\*\*\s*:|:\s*\*\*|:|\]\s*:?|\|>)\s*", re.IGNORECASE)
#: Probabilities: that a marker names its line's role; that a line without a marker goes on with its row's role.
MARKER, STAY = 0.97, 0.98
#: Rows and bytes of texts of a chunk, about.
CHUNK, CHUNK_BYTES = 20_000, 16 << 20
#: Features of a line: length (4 steps), question, list or code.
FEATURES = 16
R = len(ROLES)


def role_of(marker: str | None) -> int:
    """The role that a row's marker names, or -1."""
    return ROLE_OF.get((marker or "").strip().lower(), -1)


def line_features(line: str) -> int:
    n = len(line)
    bare = line.strip()
    return (0 if n < 20 else 1 if n < 120 else 2 if n < 600 else 3) * 4 + 2 * bare.endswith("?") + bool(re.match(r"[-*]\s|\d+[.)]\s|```|    ", line))


def lines_of(marker: str | None, text: str | None) -> list[tuple[str, int, int, bool]]:
    """Lines of a row as (text without its marker, role its marker names or -1, features, whether it may begin a turn)."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        named = role_of(marker) if k == 0 else -1
        if m := LINE_MARKER.match(line):
            named, line = ROLE_OF[m[1].lower()] if k or named < 0 else named, line[m.end() :]
        out.append((line, named, line_features(line), k == 0 or bool(m)))
    return out


def logs(first: np.ndarray, follow: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of: first role, role after role, role of a line that goes on, features of a role, markers of a role."""
    share = lambda x: np.log((x + 1) / (x + 1).sum(axis=-1, keepdims=True))
    stay = np.log(np.where(np.eye(R, dtype=bool), STAY, (1 - STAY) / (R - 1)))
    marks = np.log(np.where(np.eye(R, dtype=bool), MARKER, (1 - MARKER) / (R - 1)))
    return share(first), share(follow), stay, share(emit), marks


def step(line: tuple[str, int, int, bool], model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each role's transition to each role at a line, and of the line under each role."""
    _, follow, stay, emit, marks = model
    _, named, features, begins = line
    return (follow if begins else stay), emit[:, features] + (marks[:, named] if named >= 0 else 0)


def best_path(lines: list, model: tuple, before: int | None, end: int | None) -> list[int]:
    """The likeliest roles of lines, given the role before them (None: they begin a conversation) and their last role (None: any)."""
    score, back = None, []
    for line in lines:
        move, seen = step(line, model)
        if score is None:
            score = (model[0] if before is None else move[before]) + seen
            continue
        both = score[:, None] + move
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + seen
    path = [int(np.argmax(score)) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def span_matrix(lines: list, model: tuple, begins: bool) -> np.ndarray:
    """Best scores of lines from each role before them (all rows equal if they begin a conversation) to each last role."""
    total = None
    for line in lines:
        move, seen = step(line, model)
        if total is None:
            total = (np.tile(model[0], (R, 1)) if begins else move) + seen
        else:
            total = (total[:, :, None] + move[None]).max(axis=1) + seen
    return total


def conversations(group: pa.Table) -> list[tuple[object, list[int]]]:
    """(id, rows) of the conversations in a chunk, which is in order."""
    out: list[tuple[object, list[int]]] = []
    for k, c in enumerate(group["conv"].to_pylist()):
        if out and out[-1][0] == c:
            out[-1][1].append(k)
        else:
            out.append((c, [k]))
    return out


def counted(group: pa.Table) -> pa.Table:
    """A chunk's counts of first roles, roles after roles and features of roles over rows with known markers."""
    group = group.sort_by("seq")
    first, follow, emit = np.zeros(R), np.zeros((R, R)), np.zeros((R, FEATURES))
    marks, texts, heads = group["marker"].to_pylist(), group["text"].to_pylist(), group["head"].to_pylist()
    for _, rows in conversations(group):
        last = -1
        for k in rows:
            role = role_of(marks[k])
            if role >= 0:
                if heads[k]:
                    first[role] += 1
                elif last >= 0:
                    follow[last, role] += 1
                for line in lines_of(None, texts[k]):
                    emit[role, line[2]] += 1
            last = role
    return pa.table({"counts": pa.array([np.concatenate([first, follow.ravel(), emit.ravel()]).astype(np.int64)], pa.list_(pa.int64()))})


def formatted(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", marker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, nth_row (order_col's value), part, role, content and rendered of every turn found, a row for each."""
    base = turns.select(F.col(id_col).alias("conv"), F.col(order_col).alias("nth_row"), F.col(marker_col).cast("string").alias("marker"), F.col(text_col).cast("string").alias("text"))
    size = base.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-size["rows"] // CHUNK), -(-(size["bytes"] or 0) // CHUNK_BYTES))
    keys = ["conv", "nth_row", "marker", "text", "salt"]
    dealt = base.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = written(dealt.select("conv", "nth_row", "marker", "text", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("seq")))
    # one row for each chunk: the conversations at its two ends
    ends = dealt.groupBy("chunk").agg(F.min_by(F.struct("conv", "marker"), "seq").alias("first"), F.max_by(F.struct("conv", "marker"), "seq").alias("last")).orderBy("chunk").collect()
    meets = [(a, b) for a, b in zip(ends, ends[1:], strict=False) if a["last"]["conv"] == b["first"]["conv"]]
    crosses = {b["chunk"] for _, b in meets}  # their first conversation began before

    def with_heads(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        heads = np.zeros(group.num_rows, bool)
        for k, (_, rows) in enumerate(conversations(group)):
            heads[rows[0]] = k > 0 or group["chunk"][0].as_py() not in crosses
        return group.append_column("head", pa.array(heads))

    totals = dealt.groupBy("chunk").applyInArrow(lambda g: counted(with_heads(g)), "counts array<long>").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(R + R * R + R * FEATURES)
    for r in totals.collect():
        counts[r["k"]] = r["n"]
    for a, b in meets:
        pair = [role_of(x["marker"]) for x in (a["last"], b["first"])]
        if min(pair) >= 0:
            counts[R + R * pair[0] + pair[1]] += 1
    model = logs(counts[:R], counts[R : R + R * R].reshape(R, R), counts[R + R * R :].reshape(R, FEATURES))

    given: dict[int, dict] = {e["chunk"]: {"before": None, "first": None, "last": None} for e in ends}
    if crosses:
        following = {ends[k - 1]["chunk"]: ends[k]["chunk"] for k in range(1, len(ends))}

        def spans(group: pa.Table) -> pa.Table:
            """Matrices of a chunk's conversations that go on at one of its ends."""
            group = group.sort_by("seq")
            chunk, found = group["chunk"][0].as_py(), conversations(group)
            marks, texts, out = group["marker"].to_pylist(), group["text"].to_pylist(), []
            for which, k in {"first": 0, "last": len(found) - 1}.items():
                if (chunk in crosses if which == "first" else following.get(chunk) in crosses) and not (which == "last" and k == 0 and chunk in crosses):
                    lines = [x for r in found[k][1] for x in lines_of(marks[r], texts[r])]
                    begins = not (k == 0 and chunk in crosses)
                    whole = k == len(found) - 1 and following.get(chunk) in crosses
                    out.append({"chunk": chunk, "which": which, "begins": begins, "goes_on": whole, "matrix": span_matrix(lines, model, begins).ravel().tolist()})
            return pa.table({c: pa.array([o[c] for o in out], t) for c, t in (("chunk", pa.int32()), ("which", pa.string()), ("begins", pa.bool_()), ("goes_on", pa.bool_()), ("matrix", pa.list_(pa.float64())))})

        rows = dealt.groupBy("chunk").applyInArrow(spans, "chunk int, which string, begins boolean, goes_on boolean, matrix array<double>").collect()
        chain: list = []
        for r in sorted(rows, key=lambda r: (r["chunk"], r["which"])):
            chain.append((r["chunk"], r["which"], np.array(r["matrix"]).reshape(R, R)))
            if r["goes_on"]:
                continue
            score, back = chain[0][2][0], []
            for _, _, m in chain[1:]:
                both = score[:, None] + m
                back.append(both.argmax(axis=0))
                score = both.max(axis=0)
            path = [int(np.argmax(score))]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
            for k, (chunk, which, _) in enumerate(chain):
                given[chunk][which] = path[k]
                if k:
                    given[chunk]["before"] = path[k - 1]
            chain = []

    def decode(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        chunk, found = group["chunk"][0].as_py(), conversations(group)
        marks, texts = group["marker"].to_pylist(), group["text"].to_pylist()
        at, part, role, content = [], [], [], []
        for k, (_, rows) in enumerate(found):
            known, first = given[chunk], k == 0 and chunk in crosses
            lines = [lines_of(marks[r], texts[r]) for r in rows]
            end = known["first"] if first else known["last"] if k == len(found) - 1 else None
            path = iter(best_path([x for row in lines for x in row], model, known["before"] if first else None, end))
            for r, row in zip(rows, lines, strict=True):
                runs: list[tuple[int, list[str]]] = []
                for line, p in zip(row, path, strict=False):
                    if runs and runs[-1][0] == p:
                        runs[-1][1].append(line[0])
                    else:
                        runs.append((p, [line[0]]))
                for i, (p, body) in enumerate(runs):
                    at.append(r)
                    part.append(i)
                    role.append(ROLES[p])
                    content.append("\n".join(body).strip())
        picked = group.select(["conv", "nth_row"]).take(pa.array(at, pa.int64()))
        return pa.table({"conv": picked["conv"], "nth_row": picked["nth_row"], "part": pa.array(part, pa.int32()), "role": pa.array(role, pa.string()), "content": pa.array(content, pa.string())})

    kinds = dict(dealt.dtypes)
    out = dealt.groupBy("chunk").applyInArrow(decode, f"conv {kinds['conv']}, nth_row {kinds['nth_row']}, part int, role string, content string")
    # what stands for a turn's borders must not occur inside it
    safe = F.regexp_replace("content", r"<\|(turn|end)", r"<\\|$1")
    return out.withColumn("rendered", F.concat(F.lit("<|turn|>"), "role", F.lit("\n"), safe, F.lit("<|end|>\n")))
