"""Conversations as one text each, by Spark expressions only.

    <|im_start|>role<|im_sep|>text<|im_next|>text<|im_end|>

Adjacent turns of one role share a block; <|im_next|> stands between their texts.
Inside roles and texts every "<", backslashes, "|" gets one backslash more, so no text
holds a control string, and taking one away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bound, ready, running_sums

# The control strings of the template.
START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
# What stands before a text.
HEADER = r"^<\|im_(?:sep|next)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def merged_turns(turns: Column) -> Column:
    """What each of the sorted turns adds to the text: the control strings `before` it, its `text`, and whether it is `learnt`.

    A turn of the role of the one before it goes on in that one's block.
    """
    roles = F.transform(turns, lambda turn: turn["role"])
    previous = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, F.lit(1), F.greatest(F.size(roles) - 1, F.lit(0))))

    def piece(turn: Column, role: Column) -> Column:
        opening = F.concat(F.lit(START), escape(turn["role"]), F.lit(SEP))
        before = F.when(role.isNull(), opening).when(role == turn["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opening))
        return F.struct(before.alias("before"), escape(turn["text"]).alias("text"), (turn["role"] == LEARNT_ROLE).alias("learnt"))

    return F.zip_with(turns, previous, piece)


def render(pieces: Column) -> Column:
    return F.concat(F.array_join(F.transform(pieces, lambda piece: F.concat(piece["before"], piece["text"])), ""), F.lit(END))


def loss_spans(pieces: Column) -> Column:
    """`start` and `end` (code points, end exclusive) of each learnt text in the rendered pieces."""
    ends = running_sums(F.transform(pieces, lambda piece: F.length(piece["before"]) + F.length(piece["text"])))
    spans = F.zip_with(pieces, ends, lambda piece, end: F.struct((end - F.length(piece["text"])).alias("start"), end.alias("end"), piece["learnt"].alias("learnt")))
    return F.transform(F.filter(spans, lambda span: span["learnt"]), lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as they were: an array of `role` and `text`."""
    blocks = F.split(formatted, r"<\|im_start\|>", -1)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, SEP, 1)
        body = F.substring(block, F.length(role) + len(SEP) + 1, F.length(block) - F.length(role) - len(SEP) - len(END))
        return F.transform(F.split(body, r"<\|im_next\|>", -1), lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))


def format_conversations(turns: DataFrame) -> DataFrame:
    """`conv_id`, the `formatted` text and the `loss` spans of each conversation.

    Turns go by `turn` (null last), then role, then text; repeated rows are turns of
    their own. A null text or role is empty. Rows with a null conv_id make one
    conversation. Other columns are not read. An empty table gives none.
    """
    ready(turns.sparkSession)
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    both = bound(F.col("turns"), lambda sorted_: bound(merged_turns(sorted_), lambda pieces: F.struct(render(pieces).alias("formatted"), loss_spans(pieces).alias("loss"))))
    return gathered.select("conv_id", both.alias("both")).select("conv_id", "both.formatted", "both.loss")


def loss_text(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were.

    The conversation is parted at its control strings; parts and spans are sorted
    together by where they start, so that a span stands before the text it marks.
    """

    def entry(at: Column, kind: int, text: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), text.alias("text"))

    def read(row: Column) -> Column:
        ends = running_sums(F.transform(row["parts"], F.length))
        bodies = F.zip_with(row["parts"], ends, lambda part, end: entry(end - F.length(part) + F.length(F.regexp_extract(part, HEADER, 0)), 1, F.when(part.rlike(HEADER), F.regexp_replace(part, HEADER, ""))))
        texts = F.filter(bodies, lambda body: body["text"].isNotNull())
        marks = F.transform(row["loss"], lambda span: entry(span["start"], 0, F.lit(None).cast("string")))
        return bound(F.array_sort(F.concat(marks, texts)), marked)

    def marked(entries: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0))), lambda own: F.when(own["kind"] == 0, own["at"]).otherwise(-1)))
        return F.array_join(F.zip_with(entries, before, lambda own, at: F.when((own["kind"] == 1) & (own["at"] == at), unescape(own["text"])).otherwise("")), "")

    return bound(F.struct(F.split(formatted, r"(?=<\|im_)", -1).alias("parts"), loss.alias("loss")), read)
