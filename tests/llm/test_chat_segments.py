"""Windows of long conversations are those of the plain greedy rule, however the work is divided."""

import random

import pytest

from skein.llm.chat import format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, budget, history):
    """(repeated turns, new turns) of each window of one conversation."""
    rows, out = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])), []
    size = [len(r[3].split()) + 4 for r in rows]
    head = int(rows[0][2] == "system")
    for i, n in enumerate(size):
        if i == 0:
            out.append([[], [0]])
            used = n
        elif used + n <= budget:
            out[-1][1].append(i)
            used += n
        else:
            room, h, left = min(history, budget - head * size[0] - n), i, 0
            while h > head and left + size[h - 1] <= room:
                h -= 1
                left += size[h]
            out.append([[0] * head + list(range(h, i)), [i]])
            used = head * size[0] + left + n
    text = lambda ids: "".join(f"<|im_start|>{rows[i][2]}\n{rows[i][3]}<|im_end|>\n" for i in ids)
    return [(len(a), text(a + b)) for a, b in out]


def got(spark, rows, **sizes):
    w = format_chats(spark.createDataFrame(rows, SCHEMA), **sizes).collect()
    return [(r["n_context"], r["formatted"]) for r in sorted(w, key=lambda r: (r["seg"], r["window"]))], w


@pytest.mark.parametrize("system", [True, False])
@pytest.mark.parametrize("step", [1, 1000])
def test_history_across_segments(spark, step, system):
    rows = [(1, i * step, "system" if system and i == 0 else "assistant" if i % 2 else "user", f"w{i} " * (1 + i * 7 % 40)) for i in range(700)]
    rows += [(2, i * step, "user", f"short {i}") for i in range(5)]
    for conv in (1, 2):
        mine = [r for r in rows if r[0] == conv]
        assert got(spark, mine, budget=512, history=128, segment=256)[0] == brute(mine, 512, 128)
    w = format_chats(spark.createDataFrame(rows, SCHEMA))
    for r in read_back(w).filter("seg > 0").collect():
        assert r["formatted"].count("<|im_start|>") > len(r["turns"])


def test_thousands_of_turns(spark):
    """Several levels of composed maps; the windows don't depend on the segment."""
    rng = random.Random(2)
    rows = [(None if c == 3 else c, i, "system" if c == 1 and i == 0 else rng.choice(("user", "assistant")), f"w{i} " * rng.choice((1, 3, 9, 30, 200 if i % 97 == 0 else 2))) for c, n in ((1, 5000), (2, 300), (3, 1200)) for i in range(n)]
    w = None
    for segment in (32, 256, 1000):
        found = sorted(((str(r["conv_id"]), r["n_context"], r["formatted"]) for r in format_chats(spark.createDataFrame(rows, SCHEMA), budget=100, history=40, segment=segment).collect()))
        assert w is None or found == w
        w = found
    want = [(str(c), *x) for c in (1, 2, None) for x in brute([r for r in rows if r[0] == c], 100, 40)]
    assert w == sorted(want)


def test_equal_and_null_turns(spark):
    rows = [(None, None if i < 40 else 7, "user", f"t{i // 2} " * (i % 5)) for i in range(130)]
    assert got(spark, rows, budget=60, history=30, segment=32)[0] == brute(rows, 60, 30)


def test_history_gives_way_to_the_budget(spark):
    rows = [(1, 0, "system", "s " * 10)] + [(1, i, "user", "h " * 28) for i in range(1, 16)] + [(1, 16, "assistant", "a " * 446)]
    windows, _ = got(spark, rows)
    assert windows == brute(rows, 512, 128)
    assert len(windows[-1][1].replace("<|im_start|>", " ").split()) <= 512
