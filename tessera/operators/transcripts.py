"""Conversation transcripts ``(conv_id, turn, role, text)``.

Rounds: a user turn opens a round (the question opens round 1, every
follow-up prompt the next one); assistant texts and tool results belong to
the round opened before them. ``round = number of user turns up to and
including this turn`` (at least 1), computed with a skew-safe blocked
running sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import strip_ws
from tessera.functions.windows import blocked_running_sum

MAX_ROUNDS = 8  # fixed value: agent rounds of the reference
TOOL_RESULT = r"(?s)^\[([^\]]+) result\]:\n(.*)$"
# Our own wording; only the tool's name and the question have to be in it.
FOLLOWUP = "Output of {tool} is given above. Still open is the request: {query}"


def with_rounds(conv: DataFrame) -> DataFrame:
    r = blocked_running_sum(conv, ["conv_id"], "turn", (F.col("role") == "user").cast("int"), "round")
    return r.withColumn("round", F.greatest(F.col("round"), F.lit(1)).cast("bigint"))


def is_tool_result(text="text"):
    return (F.col("role") == "assistant") & F.col(text).rlike(TOOL_RESULT)


def cap_rounds(conv: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Keep the turns of the first ``max_rounds`` rounds."""
    return with_rounds(conv).filter(F.col("round") <= max_rounds)


def tool_results(conv: DataFrame) -> DataFrame:
    """``(conv_id, turn, tool, output)`` from ``[tool result]:\\n...``."""
    return conv.filter(is_tool_result()).select(
        "conv_id", "turn", F.regexp_extract("text", TOOL_RESULT, 1).alias("tool"),
        F.regexp_extract("text", TOOL_RESULT, 2).alias("output"))


def stop_round(conv: DataFrame) -> DataFrame:
    """C4: the loop stops after the first round without a tool result; later
    rounds are dropped. Rounds are aggregated first (one row per round), so
    the per-conversation step only sees rounds, not turns."""
    r = with_rounds(conv)
    per_round = r.groupBy("conv_id", "round").agg(F.max(is_tool_result().cast("int")).alias("__tool"))
    stop = per_round.filter(F.col("__tool") == 0).groupBy("conv_id").agg(F.min("round").alias("stop_round"))
    return (r.join(stop, "conv_id", "left")
            .filter(F.col("stop_round").isNull() | (F.col("round") <= F.col("stop_round"))))


def assemble_response(conv: DataFrame) -> DataFrame:
    """Newline-joined assistant texts (tool results excluded) in turn
    order, stripped; one row holds one conversation's answer. Apply ``cap_rounds``
    before it to limit the rounds."""
    a = conv.filter((F.col("role") == "assistant") & ~is_tool_result())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                      lambda x: x["text"]), "\n")
    return a.groupBy("conv_id").agg(strip_ws(joined).alias("response"))


def followup_prompts(conv: DataFrame) -> DataFrame:
    """The follow-up user prompt for every tool result, quoting the
    conversation's first user message (the question)."""
    first_user = (conv.filter(F.col("role") == "user").groupBy("conv_id")
                  .agg(F.min_by("text", "turn").alias("__q")))
    tr = tool_results(conv).join(first_user, "conv_id", "left")
    pre, rest = FOLLOWUP.split("{tool}")
    mid, post = rest.split("{query}")
    return tr.select("conv_id", "turn", "tool", F.concat(
        F.lit(pre), F.col("tool"), F.lit(mid), F.coalesce(F.col("__q"), F.lit("")), F.lit(post)).alias("prompt"))


def round_summary(conv: DataFrame) -> DataFrame:
    """Turns and tool results per (conversation, round)."""
    r = with_rounds(conv)
    return r.groupBy("conv_id", "round").agg(F.count(F.lit(1)).alias("turns"),
                                             F.sum(is_tool_result().cast("int")).alias("tool_results"))

