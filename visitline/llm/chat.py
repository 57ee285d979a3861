r"""Chat formatting in windows of a token budget, in DataFrame operations only.

Prefix sums of turn tokens place every turn of a conversation on a line. The line is cut into cells of one
stride; a cell's turns are those that start in it, so that windows begin and end at turns and no window needs
to know its predecessor. Only the turn that crosses the end of its cell can make a window too large: it then
gets a window of its own. Every window repeats the conversation's system turn and the last turns before it,
up to a number of tokens; the loss mask covers the texts of assistant turns where they aren't repeated.

The template writes a turn as ``<turn ROLE\nTEXT</turn>\n``. In texts one backslash is put after the ``<`` of every
``<turn`` or ``</turn``, with any backslashes already between, so that neither stands in an escaped text and
taking one backslash away gives the text back. In roles ``%``, ``<`` and the line break become ``%25 %3C %0A``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visitline.llm.mixing import token_count

END = "</turn>\n"
_OPEN = "<turn "


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("<", "%3C"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def turn_tokens(text: Column, overhead: int = 4) -> Column:
    """Tokens of a formatted turn, about: words or a quarter of the characters, and the marks around it."""
    return F.greatest(token_count(text), F.ceil(F.length(text) / 4).cast("bigint")) + F.lit(overhead)


def _placed(turns: DataFrame, budget: int, history: int, bucket_turns: int) -> DataFrame:
    """Turns with the first and last token of each on its conversation's line, and the stride of its cells.

    Sums run over buckets of turn numbers first, so that a conversation with very many turns is ordered and
    summed in many tasks; only one row per bucket is ordered by conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": turn_tokens(F.col("text")), "bucket": F.coalesce(F.floor(F.col("turn") / bucket_turns), F.lit(-(1 << 62)))})
    order = ("turn", "role", "text")
    sums = rows.groupBy("conv_id", "bucket").agg(
        F.sum("tokens").alias("own"), F.min_by(F.struct("role", "text", "tokens"), F.struct(*order)).alias("first")
    )
    line = W.partitionBy("conv_id").orderBy("bucket")
    opening = F.first("first").over(line)
    sums = sums.select(
        F.col("conv_id").alias("_conv"), F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("own").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.row_number().over(line) == 1).alias("opens"), F.when(opening["role"] == "system", opening).alias("system"),
    )
    inside = W.partitionBy("conv_id", "bucket").orderBy(*order)
    placed = rows.withColumns({
        "_inside": F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)), "_at": F.row_number().over(inside),
    }).join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("bucket") == F.col("_bucket")))
    own_system = F.col("opens") & (F.col("_at") == 1) & F.col("system").isNotNull()
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)), F.lit(budget // 4)).cast("bigint")
    return placed.withColumns({"is_system": own_system, "room": room}).withColumns({
        "stride": F.expr("room - room div 4"),
        "stop": F.col("before") + F.col("_inside") - F.coalesce(F.col("system.tokens"), F.lit(0)),
    }).withColumn("start", F.when(F.col("is_system"), F.lit(-1)).otherwise(F.col("stop") - F.col("tokens")))


def chat_windows(turns: DataFrame, *, budget: int = 1024, history: int = 128, bucket_turns: int = 1024) -> DataFrame:
    """Formatted windows of all conversations in ``turns`` (``conv_id, turn, role, text``; others aren't read).

    Returns ``conv_id, window, formatted, n_turns, n_repeated, loss``: ``window`` grows with the turns of its
    conversation (not without gaps); the first ``n_repeated`` of its ``n_turns`` turns stand in an earlier window
    as well; ``loss`` lists the code point ranges (end exclusive) of ``formatted`` to learn from. A window has at
    most ``budget`` tokens, unless its only new turn or the system turn is larger than that. The first
    turn is a system turn if its role is ``system``. ``history`` is at most 3/16 of the budget.

    Turns are ordered by turn number (null first), then role, then text; rows that repeat are turns each for itself.
    Null text or role is empty; null ids are one conversation. No rows: no windows. Rows that share one
    turn number of one conversation are ordered in one task.
    """
    if not 0 <= history <= budget * 3 // 16:
        raise ValueError("history must be at most 3/16 of the budget")
    placed = _placed(turns, budget, history, bucket_turns)
    placed = placed.withColumn("cell", F.when(F.col("is_system"), F.lit(0)).otherwise(F.expr("start div stride")).cast("bigint"))
    step = W.partitionBy("conv_id", "bucket").orderBy("turn", "role", "text")
    heads = F.coalesce(F.lag("cell").over(step) != F.col("cell"), F.lit(True))  # the system text travels once per cell and bucket
    late = ~F.col("is_system") & (F.col("start") >= (F.col("cell") + 1) * F.col("stride") - history)
    entries = placed.withColumns({"_system": F.when(heads, F.col("system")), "_late": late}).select(
        "conv_id", "room", "_system", F.col("cell").alias("_own"),
        F.struct(
            "start", "stop", "role", "text", F.col("is_system"), (F.col("stop") > (F.col("cell") + 1) * F.col("stride")).alias("crosses")
        ).alias("turn"),
        F.explode(F.when(F.col("_late"), F.array("cell", F.col("cell") + 1)).otherwise(F.array("cell"))).alias("cell"),
    )
    cells = entries.groupBy("conv_id", "cell").agg(
        F.array_sort(F.collect_list(F.when(F.col("_own") == F.col("cell"), F.col("turn")))).alias("own"),
        F.collect_list(F.when(F.col("_own") < F.col("cell"), F.col("turn"))).alias("earlier"),
        F.max("_system").alias("system"), F.max("room").alias("room"),
    ).where(F.size("own") > 0)
    fresh = F.filter("own", lambda t: ~t["is_system"])
    tail = F.element_at("own", -1)
    alone = (F.size(fresh) > 1) & tail["crosses"] & (tail["stop"] - F.element_at(fresh, 1)["start"] > F.col("room"))
    parts = F.when(alone, F.array(
        F.struct(F.lit(0).alias("part"), F.slice("own", F.lit(1), F.size("own") - 1).alias("new")),
        F.struct(F.lit(1).alias("part"), F.array(tail).alias("new")),
    )).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col("own").alias("new"))))
    windows = cells.withColumn("_p", F.explode(parts)).withColumns({"new": F.col("_p.new"), "window": F.col("cell") * 2 + F.col("_p.part")})
    begins = F.array_min(F.transform(F.filter("new", lambda t: ~t["is_system"]), lambda t: t["start"]))
    windows = windows.withColumn("_from", begins)
    before = F.array_sort(F.filter(
        F.concat("earlier", "own"),
        lambda t: ~t["is_system"] & (t["start"] < F.col("_from")) & (t["start"] >= F.col("_from") - history),
    ))
    piece = lambda role, text, new: F.struct(
        F.concat(F.lit(_OPEN), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"), (new & (role == "assistant")).alias("learn")
    )
    system = F.when(
        F.col("system").isNotNull() & ~F.exists("new", lambda t: t["is_system"]), F.array(piece(F.col("system.role"), F.col("system.text"), F.lit(False)))
    ).otherwise(F.array().cast("array<struct<head:string,body:string,learn:boolean>>"))
    again = F.concat(system, F.coalesce(F.transform(before, lambda t: piece(t["role"], t["text"], F.lit(False))), F.array().cast("array<struct<head:string,body:string,learn:boolean>>")))
    windows = windows.withColumns({"again": again, "fresh": F.transform("new", lambda t: piece(t["role"], t["text"], F.lit(True)))})
    every = F.concat("again", "fresh")
    step_on = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("bigint").alias("at"),
        F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + F.length(t["head"])).cast("bigint").alias("start"), (acc["at"] + F.length(t["head"]) + F.length(t["body"])).cast("bigint").alias("end")
        )))).otherwise(acc["spans"]).alias("spans"),
    )
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return windows.select(
        "conv_id", "window", F.array_join(F.transform(every, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.size(every).alias("n_turns"), F.size("again").alias("n_repeated"), F.aggregate(every, empty, step_on)["spans"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What windows hold: ``conv_id, window, turns, learned``, both unescaped.

    ``turns`` are the ``(role, text)`` of those that aren't repeated, ``learned`` the texts under the loss mask.
    """
    marked = F.split("formatted", END, -1)
    kept = F.slice(marked, F.col("n_repeated") + 1, F.greatest(F.size(marked) - 1 - F.col("n_repeated"), F.lit(0)))
    cut = lambda t: F.locate("\n", t)
    turn = lambda t: F.struct(
        unescape_role(F.substring(t, F.lit(len(_OPEN) + 1), cut(t) - len(_OPEN) - 1)).alias("role"),
        unescape(F.substring(t, cut(t) + 1, F.length(t))).alias("text"),
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", F.transform(kept, turn).alias("turns"), learned.alias("learned"))
