from __future__ import annotations

import hashlib
import random

from deckframe.llm import chat


def brute(rows):
    by = {}
    for c, t, r, x in set(rows):
        if c is not None:
            by.setdefault(c, set()).add((t, r or "unknown", x or ""))
    order = lambda z: (z[0] is not None, z[0] or 0, z[1], hashlib.md5(z[2].encode()).hexdigest())
    seqs = {c: [(r, x) for _, r, x in sorted(v, key=order)] for c, v in by.items()}
    out = []
    for c, s in seqs.items():
        beaten = any(o != c and t[: len(s)] == s and (len(t) > len(s) or o < c) for o, t in seqs.items())
        if not beaten:
            out.append((c, len(s), "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in s)))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(8)
    rows, logs = [], []
    for i in range(120):
        if logs and rnd.random() < 0.6:
            turns = list(rnd.choice(logs))[: rnd.randrange(1, 7)]
            if rnd.random() < 0.5:
                turns.append((rnd.choice(["user", "assistant"]), f"t{rnd.randrange(4)}"))
        else:
            turns = [(rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "", None, f"t{rnd.randrange(9)}"])) for _ in range(rnd.randrange(1, 6))]
        logs.append(turns)
        rows += [(i, k, r, x) for k, (r, x) in enumerate(turns)]
    rows += rows[:30] + [(None, 0, "user", "lost"), (500, None, "user", "no turn"), (501, 1, "user", "b"), (501, 1, "user", "a"), (501, 1, "assistant", "a"), (502, 1, "user", "long " * 50000)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id long, turn long, role string, text string, k int, digest string")
    got = sorted((r.conv_id, r.n_turns, r.rendered) for r in chat.render(df).collect())
    want = brute(rows)
    assert got == want
    assert len(want) < 90


def test_empty_table(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
