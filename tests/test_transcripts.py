from pyspark.sql import functions as F

from tessera.functions.windows import blocked_running_sum
from tessera.operators import transcripts as C

CONV = "conv_id bigint, turn bigint, role string, text string"


def transcripts(spark):
    rows = [
        (1, 0, "user", "What sold best?"),
        (1, 1, "assistant", "Let me check."),
        (1, 2, "assistant", "[lookup result]:\nline one\nline two"),
        (1, 3, "user", "Go on."),
        (1, 4, "assistant", "  Laptops sold best.  "),
        (2, 0, "user", "hi"),
        (2, 1, "assistant", "hello"),
    ]
    # conversation 3: nine rounds, each a user turn and an assistant tool result
    for r in range(9):
        rows.append((3, 2 * r, "user", f"q{r}"))
        rows.append((3, 2 * r + 1, "assistant", f"[t{r} result]:\nout{r}"))
    return spark.createDataFrame(rows, CONV)


def test_tool_results_and_followups(spark):
    c = transcripts(spark)
    tr = {(r.conv_id, r.turn): (r.tool, r.output) for r in C.tool_results(c).collect()}
    assert tr[(1, 2)] == ("lookup", "line one\nline two") and len(tr) == 10
    fu = {(r.conv_id, r.turn): r.prompt for r in C.followup_prompts(c).collect()}
    assert fu[(1, 2)] == "Output of lookup is given above. Still open is the request: What sold best?"


def test_rounds_cap_stop_and_response(spark):
    c = transcripts(spark)
    capped = C.cap_rounds(c)
    assert capped.filter("conv_id = 3").agg(F.max("round")).collect()[0][0] == 8
    stop = {r.conv_id: r.stop_round for r in C.stop_round(c).select("conv_id", "stop_round").distinct().collect()}
    assert stop == {1: 2, 2: 1, 3: None}  # conversation 3 never stops by itself
    resp = {r.conv_id: r.response for r in C.assemble_response(c).collect()}
    assert resp[1] == "Let me check.\n  Laptops sold best." and resp[2] == "hello"
    assert 3 not in resp


def test_blocked_running_sum_matches_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                     (F.col("id") % 7).alias("v"))
    got = blocked_running_sum(df, ["g"], "o", F.col("v"), "rs", block_size=16)
    want = df.withColumn("rs", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(got.collect()) == sorted(want.collect())
