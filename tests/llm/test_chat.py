import time

from pyspark.sql import functions as F

from siftlog.llm import chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, loss string"
ROWS = [
    (1, 1, "assistant", "b<|im_sep|>\n"), (1, 0, "user", "a"), (1, 2, "assistant", ""), (1, 3, "assistant", "c<\\|x<\\\\|"), (1, 4, "user", "<|im_end|>"),
    (2, 0, "user", None), (2, 0, None, "t"), (2, None, "assistant", "last"), (2, 1, "tool<|im_sep|>\nx", "é\U0001f600"),
    (3, 0, "assistant", "x" * 50_000), (3, 0, "assistant", "x" * 50_000),
    (None, 0, "user", "<|im_start|>"), (4, 0, "system", "$1 \\ <<||"), (5, 1, "assistant", "<|im_next|>"),
]


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda row: (row[1] is None, row[1] or 0, row[2] or "", row[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip(spark):
    turns = spark.createDataFrame([(*row, "own", "own") for row in ROWS], TURNS)
    done = chat.format_conversations(turns)
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()
    plain = expected(ROWS)
    assert {row.conv_id: [tuple(turn) for turn in row.turns] for row in read} == plain
    for row in read:
        assert row.learnt == "".join(text for role, text in plain[row.conv_id] if role == "assistant")


def test_adjacent_turns_share_a_block(spark):
    turns = spark.createDataFrame([(*row, None, None) for row in ROWS if row[0] == 1], TURNS)
    text = chat.format_conversations(turns).first().formatted
    assert text == "<|im_start|>user<|im_sep|>a<|im_end|><|im_start|>assistant<|im_sep|>b<\\|im_sep|>\n<|im_next|><|im_next|>c<\\\\|x<\\\\\\|<|im_end|><|im_start|>user<|im_sep|><\\|im_end|><|im_end|>"


def test_loss_spans_mark_the_texts(spark):
    turns = spark.createDataFrame([(*row, None, None) for row in ROWS], TURNS)
    for row in chat.format_conversations(turns).collect():
        for start, end in row.loss:
            assert row.formatted[:start].endswith((chat.SEP, chat.NEXT))
            assert row.formatted[end:].startswith((chat.END, chat.NEXT))


def test_many_turns_take_time_in_proportion(spark):
    """What one conversation takes grows with its turns, not with their square."""

    def seconds(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é <| "), F.col("id").cast("string")).alias("text")).cache()
        rows.count()
        start = time.perf_counter()
        done = chat.format_conversations(rows)
        row = done.select(F.size(chat.read_turns(F.col("formatted"))).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).first()
        assert row.turns == n
        assert row.learnt == "".join(f"é <| {i}" for i in range(n) if i % 3)
        return time.perf_counter() - start

    seconds(100)
    small = seconds(4_000)
    assert seconds(32_000) < 24 * small + 2


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0
