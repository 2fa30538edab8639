"""Chat formatting with budgeted windows, with DataFrame functions only.

Template: every turn is `<|im_start|>role LF text <|im_end|> LF`. Control strings inside texts and roles get an escape
mark after their first character, and marks already there are doubled, so no control string survives inside a text and
the escape can be undone exactly.

Windows: the running sum of turn tokens over a conversation cuts it into turn-aligned spans of about `budget` tokens;
each turn is new in one window. A window also repeats the conversation's leading system turn and as many turns before
the span as fit into `history` tokens. Only assistant texts that are new in the window are under the loss mask, so
every assistant text counts once. A turn longer than the budget stays whole. Tokens are counted as UTF-8 bytes / 4
and 4 for the frame.

Defined cases: null text, role or turn: empty, empty, first; a null conv_id is a conversation of its own; turns that
tie are ordered by role and text and all stay; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "␛"
#: Control strings that must not survive inside a text.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    quoted = "|".join("(?<=" + _quote(c[0]) + ")(?=" + _quote(c[1:]) + ")" for c in CONTROLS)
    return F.regexp_replace(doubled, quoted, ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def escape_role(role: Column) -> Column:
    """Also keeps line feeds out, which end the role in the template."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "␤"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, f"(?<!{ESCAPE})((?:{ESCAPE * 2})*){ESCAPE}␤", "$1\n"))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "<>[]|/" else c for c in text)


def format_conversations(turns: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """(conv_id, window, formatted, loss array<struct<start,length>>, n_repeated): start and length in code points from 0,
    n_repeated the number of leading turns that an earlier window has already shown.

    turns: conv_id long, turn long, role string, text string.
    """
    role, text = (f(F.coalesce(F.col(c).cast("string"), F.lit(""))) for f, c in ((escape_role, "role"), (escape, "text")))
    rows = turns.select("conv_id", F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", F.ceil(F.octet_length("text") / 4) + 4)
    conversation = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = (
        rows.withColumn("n", F.row_number().over(conversation))
        .withColumn("upto", F.sum("tokens").over(conversation.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("new_in", F.floor((F.col("upto") - F.col("tokens")) / budget))
    )
    system = (F.col("n") == 1) & (F.col("role") == "system")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumn("last", F.max("new_in").over(whole)).withColumn("starts", F.collect_set("new_in").over(whole))
    # later windows that repeat the turn: those whose span begins less than `history` tokens after its end
    reach = F.when(system, F.col("last")).otherwise(F.least("last", F.ceil((F.col("upto") - F.col("tokens") + history) / budget) - 1))
    fits = lambda w: system | (w * budget >= F.col("upto")) & (w * budget - F.col("upto") + F.col("tokens") <= history)
    own = F.col("new_in")
    later = F.filter(F.array_sort("starts"), lambda w: (w > own) & (w <= reach) & fits(w))
    shown = rows.withColumn("window", F.explode(F.concat(F.array(own), later)))
    piece = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    shown = shown.withColumn("piece", piece).withColumn("new", F.col("window") == own)
    inside = Window.partitionBy("conv_id", "window").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece")).over(inside)
    span = F.struct((end - len(END) - 1 - F.length("text")).cast("long").alias("start"), F.length("text").cast("long").alias("length"))
    shown = shown.withColumn("span", F.when(F.col("new") & (F.col("role") == "assistant"), span))
    parts = F.array_sort(F.collect_list(F.struct("n", "piece", "span", "new")))
    return shown.groupBy("conv_id", "window").agg(parts.alias("p")).select(
        "conv_id",
        "window",
        F.array_join("p.piece", "").alias("formatted"),
        F.filter("p.span", lambda s: s.isNotNull()).alias("loss"),
        F.size(F.filter("p.new", lambda x: ~x)).alias("n_repeated"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>, loss_text, formatted_chars) per conversation, from the output of
    format_conversations alone: new turns of all windows in order, and all text under the loss mask."""
    cut = F.split("formatted", _quote(START))
    framed = F.transform(F.slice(cut, F.lit(2), F.size(cut)), lambda p: F.split(p, _quote(END))[0])
    turns = F.transform(
        framed,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    one = formatted.select(
        "conv_id", "window", F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns), F.lit(1))).alias("turns"),
        F.array_join(masked, "").alias("masked"), F.length("formatted").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "turns", "masked", "chars")))
    return one.groupBy("conv_id").agg(ordered.alias("w")).select(
        "conv_id",
        F.flatten("w.turns").alias("turns"),
        F.array_join("w.masked", "").alias("loss_text"),
        F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )
