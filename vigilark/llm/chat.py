"""Chat formatting in budgeted windows, with built-in functions only.

Turns are ordered by their number. The running total of their tokens deals them to windows: with room R
for new turns and M the longest turn of the conversation, turn i goes to window (tokens before i) / (R - M + 1),
so that a window's new turns never need more than R unless one turn alone does. The first system turn
is repeated in every later window, and so are the last turns of the window before, as far as ``history``
tokens reach. Only new assistant texts are under the loss mask: repeated ones are masked out.

A window reads ``<|im_start|>role`` line break, text ``<|im_end|>`` line break for each turn; ``\\`` and
``<|`` in texts and roles are escaped, so ``unescape`` gives them back and nothing inside can be a mark.

Defined cases: a null text or role is empty; turns that tie in number are ordered by role and text, then as
equal rows; rows without conversation id form one conversation with a null id; other columns are not read;
an empty table gives an empty result. A window is bounded by its budget, or by its one long turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: a bar after a backslash of odd order, then doubled backslashes."""
    # Doubled backslashes are set aside first; the stand-in cannot occur, as a single one is always followed by a bar.
    aside = F.replace(text, F.lit("\\\\"), F.lit("\\-"))
    return F.replace(F.replace(aside, F.lit("<\\|"), F.lit("<|")), F.lit("\\-"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    aside = F.replace(role, F.lit("\\\\"), F.lit("\\-"))
    aside = F.replace(F.replace(aside, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.replace(aside, F.lit("\\-"), F.lit("\\"))


def word_tokens(text: Column) -> Column:
    """A turn's tokens by default: a quarter of its characters, and four for its marks."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens=word_tokens) -> DataFrame:
    """conv_id, window, formatted, segments.

    ``segments``, in the order of ``formatted``: position (the turn's place in the conversation from 0),
    kind (``new``, ``history`` or ``system``), start and end (code points of the escaped text), loss.
    """
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text"))).withColumns({
        "position": F.row_number().over(order) - 1,
        "before": F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "longest": F.max("tokens").over(own),
    })
    first_system = F.min(F.when(F.col("role") == "system", F.col("position"))).over(own)
    rows = rows.withColumn("system", F.coalesce(F.col("position") == first_system, F.lit(False)))
    system_tokens = F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(own), F.lit(0))
    rows = rows.withColumn("room", F.lit(budget - history) - system_tokens).withColumn(
        "slot", F.floor(F.col("before") / F.greatest(F.col("room") - F.col("longest") + 1, F.lit(1))))
    rows = rows.withColumns({
        "window": F.dense_rank().over(own.orderBy("slot")) - 1,
        "slot_end": F.max(F.col("before") + F.col("tokens")).over(Window.partitionBy("conv_id", "slot")),
    }).withColumn("last", F.max("window").over(own))
    # A turn is new in its window, history in the next one if near its end, and the system turn is in all later ones.
    again = (F.col("window") < F.col("last")) & (F.col("slot_end") - F.col("before") <= history)
    copy = F.array(F.struct(F.col("window").alias("window"), F.lit("new").alias("kind")))
    none = F.array().cast("array<struct<window:int,kind:string>>")
    later = F.when(
        F.col("system") & (F.col("window") < F.col("last")),
        F.transform(F.sequence(F.col("window") + 1, F.col("last")),
                    lambda w: F.struct(w.alias("window"), F.lit("system").alias("kind")))
    ).when(again, F.array(F.struct((F.col("window") + 1).alias("window"), F.lit("history").alias("kind")))).otherwise(none)
    dealt = rows.withColumn("copy", F.explode(F.concat(copy, later))).select(
        "conv_id", F.col("copy.window").alias("window"), F.col("position"), F.col("copy.kind").alias("kind"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        ((F.col("role") == "assistant") & (F.col("copy.kind") == "new")).alias("loss"))
    packed = dealt.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "head", "body", "loss"))).alias("turns"))
    sizes = F.transform("turns", lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
    begins = F.slice(F.aggregate(sizes, F.array(F.lit(0)), lambda a, v: F.array_append(a, F.element_at(a, -1) + v)),
                     F.lit(1), F.size("turns"))
    return packed.select(
        "conv_id", "window",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.zip_with("turns", begins, lambda t, b: F.struct(
            t["position"].alias("position"), t["kind"].alias("kind"), (b + F.length(t["head"])).alias("start"),
            (b + F.length(t["head"]) + F.length(t["body"])).alias("end"), t["loss"].alias("loss"))).alias("segments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, position, role, text and loss_text of every turn, once each, from the windows alone.

    The windows are cut at their marks; which turns are new and what is under the loss mask comes from ``segments``.
    """
    parts = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.lit(1), F.size("segments"))
    turns = formatted.select("conv_id", F.explode(F.zip_with(parts, "segments", lambda p, s: F.struct(
        p.alias("part"), s.alias("at"),
        F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]).alias("span")))).alias("t"))
    head = F.instr("t.part", "\n")
    return turns.filter("t.at.kind = 'new'").select(
        "conv_id", F.col("t.at.position").alias("position"),
        unescape_role(F.substring("t.part", F.lit(len(START) + 1), head - len(START) - 1)).alias("role"),
        unescape(F.substring("t.part", head + 1, F.length("t.part"))).alias("text"),
        F.when(F.col("t.at.loss"), unescape(F.col("t.span"))).otherwise("").alias("loss_text"))
