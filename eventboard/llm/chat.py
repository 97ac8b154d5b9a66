"""Chat formatting in budgeted windows, in DataFrame functions only.

Each turn costs its pieces (runs of letters and digits, other signs one by one) plus three for its marks. Prefix
sums of these costs choose windows that end between turns: as many turns as the budget holds once the system turn
and the history allowance are taken off. Every window begins with the system turn, windows after the first repeat
up to ``history`` preceding turns that fit in the allowance, and only turns that appear for the first time are
targets: repeated assistant turns are masked. A single turn beyond the budget is a window of its own, uncut.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can contain a mark and reading back undoes both; roles are URL-encoded.

Defined results: a NULL text or role is empty. Turns of equal number are ordered by role, then text; repeated rows
are turns of their own. A NULL ``conv_id`` is one conversation, a NULL ``turn`` comes first. A conversation of only a
system turn is one window. Other columns are ignored; an empty table gives no windows. A conversation is one record
of the output's digest, so one task holds the turns of one conversation at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
BUDGET = 512
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.url_encode(role), F.lit("\n"), escape(text), F.lit(END))


def _running(lengths: Column) -> Column:
    """Totals before each item of a short array."""
    return F.aggregate(
        lengths,
        F.struct(F.array().cast("array<long>").alias("before"), F.lit(0).cast("long").alias("sum")),
        lambda acc, n: F.struct(
            F.concat(acc["before"], F.array(acc["sum"])).alias("before"), (acc["sum"] + n).alias("sum")
        ),
        lambda acc: acc["before"],
    )


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY_TURNS,
    history_tokens: int = HISTORY_TOKENS,
) -> DataFrame:
    """``conv_id, window, text, n_repeated, loss_spans``; spans are code points of ``text``, end exclusive."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    counted = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("cost", (F.regexp_count("text", F.lit(PIECE)) + 3).cast("long"))
        .withColumn("at", F.row_number().over(order))
        .withColumn("upto", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    fields = ("at", "cost", "upto", "role", "text")
    talks = counted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))
    system = F.element_at("turns", 1)["role"] == "system"
    talks = talks.withColumn("n_system", F.when(system, 1).otherwise(0)).withColumn(
        "room", budget - F.when(system, F.element_at("turns", 1)["cost"]).otherwise(0)
    )
    # Where windows begin: the first turn whose prefix sum leaves the room counted from the window's first turn.
    begins = F.aggregate(
        F.expr("slice(turns, n_system + 1, size(turns))"),
        F.struct(
            F.array().cast("array<int>").alias("begins"),
            F.lit(0).cast("long").alias("base"),
            F.lit(0).cast("long").alias("room"),
        ),
        lambda acc, t: F.when(
            (F.size(acc["begins"]) == 0) | (t["upto"] - acc["base"] > acc["room"]),
            F.struct(
                F.concat(acc["begins"], F.array(t["at"])).alias("begins"),
                (t["upto"] - t["cost"]).alias("base"),
                F.when(F.size(acc["begins"]) == 0, F.col("room")).otherwise(F.col("room") - history_tokens).cast("long").alias("room"),
            ),
        ).otherwise(acc),
        lambda acc: acc["begins"],
    )
    talks = talks.withColumn("begins", begins).withColumn(
        "begins", F.when(F.size("begins") == 0, F.array(F.lit(2))).otherwise(F.col("begins"))
    )
    spans = talks.select(
        "conv_id",
        "turns",
        "n_system",
        F.posexplode(
            F.transform(
                "begins",
                lambda b, k: F.struct(
                    b.alias("first"),
                    F.coalesce(F.get("begins", k + 1) - 1, F.size("turns")).alias("last"),
                ),
            )
        ).alias("window", "span"),
    )
    # History: preceding turns, not the system turn, whose costs together stay in the allowance.
    first, last = F.col("span.first"), F.col("span.last")
    base = F.when(first > 1, F.element_at("turns", F.greatest(first - 1, F.lit(1)))["upto"]).otherwise(0)
    recent = F.expr(f"slice(turns, greatest(span.first - {history}, n_system + 1), least({history}, span.first - 1 - n_system))")
    before = F.when(
        F.col("window") > 0, F.filter(recent, lambda t: F.col("base") - t["upto"] + t["cost"] <= history_tokens)
    ).otherwise(F.slice("turns", 1, 0))
    whole = (
        spans.withColumn("base", base)
        .withColumn("before", before)
        .withColumn("head", F.expr("slice(turns, 1, n_system)"))
        .withColumn("targets", F.expr("slice(turns, span.first, span.last - span.first + 1)"))
        .withColumn("n_repeated", F.when(F.col("window") > 0, F.col("n_system") + F.size("before")).otherwise(0))
        .withColumn("shown", F.concat("head", "before", "targets"))
        .withColumn("parts", F.transform("shown", lambda t: _rendered(t["role"], t["text"])))
        .withColumn("place", _running(F.transform("parts", lambda p: F.char_length(p).cast("long"))))
    )
    tail = len(END)
    lost = F.transform(
        "shown",
        lambda t, k: F.when(
            (t["role"] == "assistant") & (k >= F.col("n_repeated")),
            F.struct(
                (F.get("place", k) + len(BEGIN) + F.char_length(F.url_encode(t["role"])) + 1).cast("long").alias("start"),
                (F.get("place", k) + F.char_length(F.get("parts", k)) - tail).cast("long").alias("end"),
            ),
        ),
    )
    return whole.select(
        "conv_id",
        "window",
        F.array_join("parts", "").alias("text"),
        F.col("n_repeated").cast("int").alias("n_repeated"),
        F.filter(lost, lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts of each conversation, parsed from the windows of ``windows``."""
    pieces = F.filter(F.split("text", r"<\|im_end\|>\n"), lambda p: p != "")
    turn = F.transform(
        F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces)),
        lambda p: F.concat(
            F.url_decode(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), "\n", 1)),
            F.lit("\n"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)),
            F.lit("\n"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    per_window = formatted.select(
        "conv_id",
        F.struct("window", turn.alias("turns"), loss.alias("loss"), F.char_length("text").cast("long").alias("chars")).alias("w"),
    )
    return (
        per_window.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("w")).alias("ws"))
        .select(
            "conv_id",
            F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
            F.array_join(F.flatten(F.transform("ws", lambda w: w["loss"])), "").alias("loss"),
            F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc + w["chars"]).alias("formatted_chars"),
            F.size("ws").cast("long").alias("n_windows"),
        )
    )


def digests(formatted: DataFrame) -> DataFrame:
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
