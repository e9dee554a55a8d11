import random

from pyspark.sql import functions as F

from sparkrank.llm.chat_format import CLOSE, NEXT, RUN, format_chat, masked_text, read_chat


def test_round_trip_and_mask(spark):
    r = random.Random(3)
    bits = ["\\", "<", "</turn>\n", "<next>", "### ", ":\n", "\\b", "\\l", "é😀", " ok", "\n", "", "\\\\l"]
    say = lambda: "".join(r.choice(bits) for _ in range(r.randint(0, 6)))
    rows = [(c, t, r.choice(["user", "assistant", "sys:\n<x>"]), r.choice([say(), None])) for c in range(40) for t in range(r.randint(1, 9))]
    rows += [(None, 0, None, "x"), (50, 1, "user", "b"), (50, 0, "user", "a"), (50, 1, "user", "b")]
    rows += [(60, t, "assistant" if t % 3 else "user", f"<{t}>") for t in range(1000)]
    rows += [(61, t, "assistant", f"t{t}é") for t in range(RUN * RUN + 3 * RUN + 5)]  # more spans than two levels of runs hold
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, turns int").repartition(3)
    chats = format_chat(frame).select("conv_id", "formatted", read_chat(F.col("formatted")).alias("back"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {x.conv_id: x for x in chats.collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [(b.role, b.text) for b in got[c].back] == turns
        assert got[c].loss == "".join(t for role, t in turns if role == "assistant")
        blocks = sum(1 for i, (role, _) in enumerate(turns) if not i or turns[i - 1][0] != role)
        assert got[c].formatted.count(CLOSE) == blocks and got[c].formatted.count(NEXT) == len(turns) - blocks


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
