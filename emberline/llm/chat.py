"""Relational chat formatting, with Spark expressions only.

A turn list becomes one string: ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Adjacent turns of
one role share a message; their texts are kept apart by ``<|im_sep|>``. Inside texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (and a line feed inside a role ``&nl;``), so no text can forge a
marker and everything is read back as it was.

Running sums and cuts go by blocks, so work grows in proportion to a conversation. The method collects
a conversation into one row: it has to fit into a task, and its text below Spark's 2 GB for a value.

Null roles and texts read as empty; turns order by (turn, role, text), null turns first; repeated
rows stay repeated; rows without conv_id form one conversation; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Lengths that are summed, and code points that are cut, in one block.
SUMS, CUTS = 256, 4096


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)


def _with_starts(rows: DataFrame, lengths: str, out: str) -> DataFrame:
    """``rows`` plus the running sums before each of the ``lengths``: block sums first, then inside each block."""
    some = lambda b, n: F.slice(lengths, b * SUMS + 1, n)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUMS).cast("int")), lambda b: _sum(some(b, F.lit(SUMS))))
    before = F.transform("__sums", lambda _, b: _sum(F.slice("__sums", F.lit(1), b)))
    starts = F.transform(before, lambda base, b: F.transform(some(b, F.lit(SUMS)), lambda _, i: base + _sum(some(b, i))))
    return rows.withColumn("__sums", sums).withColumn(out, F.flatten(starts)).drop("__sums")


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans): the text and the code point spans (start, length) under the loss mask."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    opens = F.filter(
        F.sequence(F.lit(0), F.size("t") - 1),
        lambda i: (i == 0) | (F.get(F.col("t"), i)["role"] != F.get(F.col("t"), i - 1)["role"]),
    )
    merged = sorted_turns.withColumn("o", opens).withColumn(
        "messages",
        F.transform("o", lambda at, j: F.slice(F.col("t"), at + 1, F.coalesce(F.get(F.col("o"), j + 1), F.size("t")) - at)),
    )
    # Each turn gives a head (markers before the text) and its escaped text; a tail closes each message.
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m,
                lambda t, i: F.struct(
                    F.when(i == 0, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))).otherwise(F.lit(SEP)).alias("head"),
                    escape(t["text"]).alias("body"),
                    F.when(i == F.size(m) - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                    (t["role"] == trained_role).alias("loss"),
                ),
            ),
        )
    )
    laid = merged.select("conv_id", pieces.alias("p"))
    laid = laid.withColumn("n", F.transform("p", lambda p: (F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).cast("long")))
    placed = F.zip_with(
        "p",
        "at",
        lambda p, at: F.struct(p["loss"].alias("loss"), F.struct((at + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")).alias("span")),
    )
    spans = F.transform(F.filter(placed, lambda x: x["loss"]), lambda x: x["span"])
    text = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return _with_starts(laid, "n", "at").select("conv_id", text.alias("formatted"), spans.alias("spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, spans, turns, loss_texts), all read from the formatted string and its spans."""
    messages = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.flatten(
        F.transform(
            F.slice(messages, F.lit(1), F.size(messages) - 1),
            lambda m: F.transform(
                F.split(F.substr(m, F.instr(m, "\n") + 1), r"<\|im_sep\|>", -1),
                lambda t: F.struct(
                    _unescape_role(F.substr(m, F.lit(len(START) + 1), F.instr(m, "\n") - len(START) - 1)).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )
    # A span is cut from the blocks of code points that it touches, never from the front of the whole text.
    first = lambda s: F.floor(s["start"] / CUTS).cast("int")
    count = lambda s: F.least(F.floor((s["start"] + s["length"]) / CUTS).cast("int") - first(s) + 1, F.size("blocks"))
    touched = lambda s: F.array_join(F.slice("blocks", first(s) + 1, count(s)), "")
    loss = F.transform("spans", lambda s: unescape(F.substr(touched(s), (s["start"] % CUTS + 1).cast("int"), s["length"].cast("int"))))
    cut = formatted.withColumn("blocks", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CUTS}}}"), F.lit(0)))
    return cut.select("conv_id", "formatted", "spans", turns.alias("turns"), loss.alias("loss_texts"))


def digest(parsed: DataFrame) -> DataFrame:
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
