import random

import pytest

from retort.llm import chat_format


def brute(rows):
    out = []
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "unknown", r[3] or ""))
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        for p in sorted({t[1] for t in turns} - {"system"}):
            at = 0
            for turn, role, text in turns:
                head = "<|assistant|>\n" if role == p else "<|system|>\n" if role == "system" else f"<|user|>{role}:\n"
                body = head + text + "<|end|>\n"
                end = at + len(body)
                own = role == p
                out.append((conv, p, turn, role, body, at, end, at + len(head) if own else None, end if own else None))
                at = end
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK", block)
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "Zoë", None]
    rows = [(c, t, rng.choice(roles), rng.choice(["", None, "hi", "grüß\n dich", "x" * 50])) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (99, 0, "system", "alone"), (None, 0, "user", "no number"), (None, 1, "assistant", "yes"), (5, None, "user", "first"), (5, -300, "user", "before the start"), (5, -1, "assistant", "so"), (6, None, None, None), (6, 600, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rendered int").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r) for r in chat_format.rotate(df).collect()], key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert chat_format.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
