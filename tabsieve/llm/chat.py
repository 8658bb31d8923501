"""Preference data from conversations, with DataFrame expressions only.

Chosen and rejected conversations are compared turn by turn. What they share
from the start is rendered once as the prompt; what follows becomes two
completions, with masks that tell which characters an assistant wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.tables import join_with_nulls, running_totals
from tabsieve.plans.held import hold

#: What a turn is rendered as: START role, line feed, text, END, line feed. The
#: beginning of a marker inside a text is broken up.
START, END, MARK, BROKEN = "<|im_start|>", "<|im_end|>", "<|im_", "< |im_"
ASSISTANT = "assistant"
KEY = ("conv_id", "lone")


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, lone, turns)`` with the turns in order, each ``(role, text)``.

    Rows repeated in all four columns count once. Turns of the same number are in
    order of role and text, those without a number come first. Missing
    roles and texts are empty. Beginnings of markers are broken up in both, so that neither can
    open or close a turn. Each different row without a conversation is one of its own, named
    by its hash in ``lone``, so that any number of them never meets.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = lambda c: F.replace(text(c), F.lit(MARK), F.lit(BROKEN)).alias(c)
    row = F.struct(F.col("turn"), plain("role"), plain("text"))
    number = F.coalesce(F.col("turn").cast("string"), F.lit("-"))
    name = F.sha2(F.concat(number, F.lit(":"), plain("role"), F.lit(":"), plain("text")), 256)
    lone = F.when(F.col("conv_id").isNull(), name).alias("lone")
    found = turns.groupBy("conv_id", lone).agg(F.sort_array(F.collect_set(row)).alias("turns"))
    return found.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both begin with."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def loss_spans(turns: Column) -> Column:
    """``(start, end)`` in code points of what assistants wrote, with its END, in the
    rendered turns; ends are exclusive."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def add(state, t):
        begin = state["at"] + len(START) + F.length(t["role"]) + 1
        end = begin + F.length(t["text"]) + len(END)
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda state: state["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Replaces ``chosen`` and ``rejected``, arrays of ``(role, text)``, by
    ``n_prompt_turns``, ``prompt``, two rendered completions of the same names,
    and ``chosen_mask`` and ``rejected_mask``, arrays of ``(start, end)``.

    The prompt is the longest common prefix of whole turns; it may be empty. A
    conversation that is all prefix has an empty completion and mask.
    """
    shared = pairs.withColumn("n_prompt_turns", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(c, F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0))) for c in ("chosen", "rejected")}
    return shared.withColumns(
        {
            "prompt": rendered(F.slice("chosen", 1, F.col("n_prompt_turns"))),
            "chosen_mask": loss_spans(rest["chosen"]),
            "rejected_mask": loss_spans(rest["rejected"]),
            "chosen": rendered(rest["chosen"]),
            "rejected": rendered(rest["rejected"]),
        }
    )


def mismatched_replies(turns: DataFrame) -> DataFrame:
    """``(conv_id, other_id, chosen, rejected)``: each conversation that has a reply,
    against itself with its last reply taken from the next such conversation.

    Conversations are in order of their ids, the first one follows the last. A
    lone conversation meets itself, and has nothing to prefer. Those without a reply of an assistant have no pair.
    """
    found = conversations(turns)
    replies = F.transform("turns", lambda t: t["role"] == ASSISTANT)
    back = F.array_position(F.reverse(replies), True)
    found = found.withColumn("at", (F.size("turns") - back + 1).cast("int")).where(back > 0)
    found = hold(found.withColumn("reply", F.element_at("turns", F.col("at"))), "conversations")
    placed = hold(running_totals(found.select(*KEY), list(KEY), {"place": F.lit(1).cast("long")}, "ids"), "places")
    total = placed.count()
    others = placed.select(F.col("conv_id").alias("other_id"), F.col("lone").alias("other_lone"), (F.pmod(F.col("place") - 2, F.lit(max(total, 1))) + 1).alias("place"))
    others = join_with_nulls(others, found.select(F.col("conv_id").alias("other_id"), F.col("lone").alias("other_lone"), F.col("reply").alias("other_reply")), ["other_id", "other_lone"])
    pairs = join_with_nulls(found, placed.join(others, "place"), list(KEY))
    rejected = F.concat(F.slice("turns", 1, F.col("at") - 1), F.array("other_reply"))
    return pairs.select("conv_id", "other_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def mask_text(mask: str) -> Column:
    return F.array_join(F.transform(F.col(mask), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
