"""Chat formatting in budgeted windows, in DataFrame functions alone.

A conversation becomes windows of whole turns. Prefix sums of turn tokens choose the spans: turns
whose tokens begin in the same half of a window's room stay together, and a turn longer
than that half stands alone, so that every window of ordinary turns fits its budget. Each
window opens with the system turn, repeats up to `history` earlier turns as far
as the budget allows, and then brings its new turns. Only the new turns of the assistant
are under the loss mask, so each is learnt once.

Template: <|im_start|>role NEWLINE text<|im_end|>NEWLINE, with <|im_new|>NEWLINE ahead of the new turns.
Control strings inside texts and roles get a backslash behind their first character, and
backslashes are doubled, which `unescaped` takes back. A role with a line break is written in hex.

A token is counted for every ideograph, kana, hangul or Thai letter, for every four other letters or digits in a row, and for every
other mark, so that the budget bounds windows in every script.

Turns are dealt and sorted once, by conversation; spans, history and positions are window functions over that one order, and
all grouping stays within it, so a text travels once.

Defined results: null texts and roles count as empty; a null conversation id is a conversation
of its own; a null turn comes first; turns that tie are ordered by role and text, repeated rows
are turns of their own; a single turn over the budget, of any length, makes a window over the budget; an empty
table gives no rows; other columns are ignored. The turns of one conversation are sorted together, as its
digests need the conversation as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's marks, and what is escaped inside texts.
OPEN, CLOSE, NEW = "<|im_start|>", "<|im_end|>\n", "<|im_new|>\n"
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"
TOKEN = r"[\x{0E00}-\x{0EFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]|[\p{L}\p{N}]{1,4}|[^ \t\n\x0B\f\r\p{L}\p{N}]"
# End of fixed values.


def escaped(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("\\")), F.regexp_replace(x, r"(?s)\\(.)", "$1")).otherwise(x)


def _header(role: Column) -> Column:
    return F.when(F.contains(role, F.lit("\n")), F.concat(F.lit("\\x"), F.hex(F.encode(role, "UTF-8")))).otherwise(escaped(role))


def _role(header: Column) -> Column:
    return F.when(F.startswith(header, F.lit("\\x")), F.decode(F.unhex(F.substr(header, F.lit(3))), "UTF-8")).otherwise(unescaped(header))


def _turns(rows: DataFrame, budget: int, history: int, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Every turn: c, i (place), line (rendered), head (tokens of the system turn), body (its own tokens but for the system turn), before and ahead (prefix sums of body and
    of characters), room, w (window), and where a window begins its system turn and the turns that may be its history."""
    t = rows.select(F.col(conv_id).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("c").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"opening": F.concat(F.lit(OPEN), _header(F.col("role")), F.lit("\n")), "said": escaped(F.col("text")), "i": F.row_number().over(order) - 1})
    t = t.withColumn("line", F.concat("opening", "said", F.lit(CLOSE))).withColumns({"tokens": F.regexp_count("line", F.lit(TOKEN)).cast("long"), "leads": (F.col("i") == 0) & (F.col("role") == "system")})
    t = t.select("c", "turn", "role", "text", "i", "leads", "tokens", "line", F.char_length("opening").alias("at"), F.char_length("said").alias("long"))
    t = t.withColumns({"head": F.first(F.when(F.col("leads"), F.col("tokens")).otherwise(0)).over(upto), "body": F.when(F.col("leads"), 0).otherwise(F.col("tokens"))})
    size = F.char_length("line").cast("long")
    t = t.withColumns({"room": F.greatest(F.lit(budget) - F.col("head"), F.lit(2)), "before": F.sum("body").over(upto) - F.col("body"), "ahead": F.sum(size).over(upto) - size})
    t = t.withColumn("half", F.expr("room div 2")).withColumns({"step": F.expr("before div half"), "large": F.col("body") > F.col("half")})
    lag = lambda c, *default: F.lag(c, 1, *default).over(order)
    turned = (F.col("i") > 0) & ~lag("leads", False) & ((F.col("step") != lag("step")) | F.col("large") | lag("large"))
    t = t.withColumn("turned", turned.cast("int")).withColumn("w", F.sum("turned").over(upto))
    begins = (F.col("turned") == 1) | (F.col("i") == 0)
    first = F.first(F.when(F.col("leads"), F.struct("line", "head")), ignorenulls=True).over(upto)
    past = F.collect_list(F.struct("line", "body", "before", "leads")).over(order.rowsBetween(-history, -1)) if history else F.array().cast("array<struct<line:string,body:bigint,before:bigint,leads:boolean>>")
    return t.withColumns({"system": first, "past": past}).select(
        "c", "i", "leads", "head", "body", "before", "ahead", "room", "w", "line", "at", "long", (F.col("role") == "assistant").alias("target"),
        F.when(begins & (F.col("w") > 0), F.col("system")).alias("system"), F.when(begins, F.col("past")).alias("past"),
    )


def windows(rows: DataFrame, budget: int = 2048, history: int = 4, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each window: conv_id, window, formatted, loss (start and length in code points of formatted) and n_tokens."""
    t = _turns(rows, budget, history, conv_id, turn, role, text)
    whole = t.groupBy("c", "w").agg(
        F.array_sort(F.collect_list(F.struct("i", "line", "at", "long", "target", "ahead"))).alias("new"),
        F.sum("body").alias("spent"), F.sum(F.when(F.col("leads"), F.col("head")).otherwise(0)).alias("led"), F.min("before").alias("start"), F.min("ahead").alias("from"), F.max("room").alias("room"),
        F.first("system", ignorenulls=True).alias("system"), F.first("past", ignorenulls=True).alias("past"),
    )
    again = F.filter("past", lambda p: ~p["leads"] & (F.col("start") - p["before"] <= F.col("room") - F.col("spent")))
    whole = whole.withColumn("again", again)
    joined = lambda lines: F.array_join(F.transform(lines, lambda x: x["line"]), "")
    whole = whole.withColumn("known", F.concat(F.coalesce("system.line", F.lit("")), joined("again"), F.lit(NEW)))
    # Where the new turns begin in this text, less where they begin in the conversation's.
    shift = F.char_length("known") - F.col("from")
    loss = F.transform(F.filter("new", lambda x: x["target"]), lambda x: F.struct((shift + x["ahead"] + x["at"]).cast("int").alias("start"), x["long"].alias("length")))
    tokens = F.coalesce("system.head", F.lit(0)) + F.aggregate("again", F.lit(0).cast("long"), lambda n, x: n + x["body"]) + F.col("spent") + F.col("led")
    return whole.select(F.col("c").alias("conv_id"), F.col("w").cast("int").alias("window"), F.concat("known", joined("new")).alias("formatted"), loss.alias("loss"), tokens.alias("n_tokens"))


def read_back(made: DataFrame) -> DataFrame:
    """What the windows say of each conversation, parsed from them alone: n_turns and the digests of turns and of the text under the loss mask."""
    lines = F.split(F.substring_index("formatted", NEW, -1), r"<\|im_end\|>\n")
    turns = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    header = lambda x: F.substring_index(x, "\n", 1)
    said = lambda x: unescaped(F.substr(x, F.char_length(header(x)) + 2))
    one = made.withColumn("turns", turns).select(
        "conv_id", "window", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda x: F.concat(_role(header(x)), F.lit("\n"), said(x), F.lit("\n"))), "").alias("all"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"]))), "").alias("learnt"),
    )
    both = one.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "all", "learnt"))).alias("w"))
    learnt = F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    return both.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["all"]), ""), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )
