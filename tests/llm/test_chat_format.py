import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa

from tidewater.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, formatted string, n_turns int"
NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "[TURN]x[/TURN]", "", " ", "<", "[", "\\", "<s>", "é</s>ß", "a\n[/INST]\n", "[/INST", "s>", "🙂[INST]", " [/INST]"]


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[TURN]", "[", "<s>"]), st.one_of(st.sampled_from(NASTY), st.lists(st.sampled_from(NASTY + ["x"])).map("".join), st.text(st.characters(codec="utf-8"))))))
def test_round_trip(turns):
    roles, texts = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    out, ends, starts, stops = C.assemble(roles, texts)
    assert C.parsed(out.tobytes().decode()) == turns
    assert [C.unescape(out[i:j].tobytes().decode()) for i, j in zip(starts, stops)] == [t for _, t in turns]
    for (_, t), i, j in zip(turns, starts, stops):
        assert not any(c in out[i:j].tobytes().decode() for c in ("[INST]", "[/INST]", "[TURN]", "[/TURN]", "<s>", "</s>"))


@pytest.mark.parametrize("part_turns", [256, 3])
def test_digests(spark, monkeypatch, part_turns):
    monkeypatch.setattr(C, "PART_TURNS", part_turns)
    rows = [(c, t, ["user", "assistant", "system", None, "tool"][(c + t) % 5], NASTY[(c * 7 + t) % len(NASTY)] if t % 4 else None) for c in range(12) for t in range(c * 2 + 1)]
    rows += [(50, i % 700, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 50)) for i in range(1500)] + [(51, 0, "assistant", "é" * 200_000), (52, None, "user", "a"), (52, 1, "user", "b"), (52, 1, "user", "b"), (None, 1, "user", "q"), (None, 0, "assistant", "r")]
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in reversed(rows)], SCHEMA)
    parts = C.formatted(df)
    got = {r.conv_id: tuple(r)[1:5] for r in C.digests(parts).collect()}
    want = defaultdict(list)
    low = lambda x: (x is not None, x)
    for c, t, r, x in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), low(r[2]), low(r[3] if r[3] is None else r[3].encode()))):
        want[c].append((r or "", x or ""))
    assert got == {c: digest(t) for c, t in want.items()}
    assert sum(r.formatted_chars for r in C.digests(parts).collect()) == sum(len(r.formatted) for r in parts.collect())
    assert C.digests(C.formatted(df.where(F.lit(False)))).count() == 0
