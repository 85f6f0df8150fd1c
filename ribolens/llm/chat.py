"""Chat formatting in budgeted windows, with DataFrame functions alone.

A turn becomes ``<|role|>`` newline, text, ``<|end|>`` newline. Prefix sums of the turns' tokens place each turn on a
line that is cut every ``stride`` tokens: turns inside a cell form a window, a turn across a cut is one of its own, so a
window's own turns never pass the stride unless a single turn does. A window begins with the conversation's system turn
and up to ``history_turns`` of the turns before it, as far as ``history`` tokens reach; those repeated turns are masked.
The loss mask covers the assistant's text in a window's own turns, so each is a target exactly once.

Prefix sums run over blocks of a range partitioning and are joined by the blocks' totals, so that one conversation may
hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, parallel

END = "<|end|>\n"
#: Strings that a text can't hold unescaped: the template's own, and those of other common templates.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")
BUDGET = 1024
HISTORY_TURNS = 4
#: Characters that count as a token, rounded up for each turn.
TOKEN = 4


def escape(c: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string; unescape() takes them back."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, idx, tokens before, role, and the formatted turn with the length of its header and its text."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    header = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    rows = rows.withColumns({"header": header, "body": escape(F.col("text"))})
    rows = rows.withColumn("piece", F.concat("header", "body", F.lit(END)))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "piece",
        F.length("header").alias("head"),
        F.length("body").alias("size"),
        F.ceil(F.length("piece") / TOKEN).cast("long").alias("tokens"),
    )
    order = ["turn", "role", "text"]
    dealt = rows.repartitionByRange(parallel(spark), "conv_id", *order).withColumn("block", F.spark_partition_id())
    dealt = materialize(dealt, "turns")
    inside = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = dealt.withColumns({"nth": F.count(F.lit(1)).over(inside), "sum": F.sum("tokens").over(inside)})
    totals = dealt.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("all").over(before), F.lit(0)).alias("all_before"),
    )
    joined = dealt.join(totals, dealt["conv_id"].eqNullSafe(totals["c"]) & (dealt["block"] == totals["b"]))
    return joined.select(
        "conv_id", "role", "piece", "head", "size", "tokens",
        (F.col("n_before") + F.col("nth") - 1).alias("idx"),
        (F.col("all_before") + F.col("sum") - F.col("tokens")).alias("start"),
    )


def format_chat(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, target: str = "assistant") -> DataFrame:
    """One row per window: conv_id, window (in order), formatted, repeated, loss (array of start, length).

    ``repeated`` leading turns of ``formatted`` come from earlier windows; ``loss`` gives the target texts by code points
    of ``formatted``. Half the budget is for a window's own turns, a quarter for history; a system or single turn that is
    longer is kept whole. Rows are ordered by turn, then role and text; nulls first; equal rows are turns of their own. A
    null role or text counts as empty; rows with a null conv_id form one conversation. Columns but conv_id, turn, role,
    text are ignored; no rows give no windows.
    """
    stride, history = budget // 2, budget // 4
    start, end = F.col("start"), F.col("start") + F.col("tokens") - 1
    cell = F.floor(start / stride)
    own = materialize(_turns(conversations).withColumn("window", 2 * cell + (cell != F.floor(end / stride)).cast("long")), "own")
    system = own.filter("role = 'system'").groupBy("conv_id").agg(F.min_by(F.struct("idx", "piece", "head", "size"), "idx").alias("system"))
    system = system.select(F.col("conv_id").alias("c"), "system.*")
    firsts = own.groupBy("conv_id", "window").agg(F.min("idx").alias("first"), F.min("start").alias("at"))
    firsts = materialize(firsts.filter("first > 0"), "firsts")

    wanted = firsts.select("conv_id", "window", "at", F.explode(F.sequence(F.greatest(F.col("first") - history_turns, F.lit(0)), F.col("first") - 1)).alias("j"))
    some = own.select(F.col("conv_id").alias("c"), "idx", "piece", "head", "size", "start")
    old = wanted.join(some, wanted["conv_id"].eqNullSafe(some["c"]) & (wanted["j"] == some["idx"])).filter(F.col("at") - F.col("start") <= history)
    old = old.select("conv_id", "window", "idx", "piece", "head", "size")
    kept = firsts.join(system, firsts["conv_id"].eqNullSafe(system["c"])).filter("idx < first").select("conv_id", "window", "idx", "piece", "head", "size")
    again = old.unionByName(kept).distinct()  # the system turn may be in the history too

    def part(rows: DataFrame, is_own: bool, is_target: Column) -> DataFrame:
        return rows.select("conv_id", "window", F.struct("idx", "piece", "head", "size", F.lit(is_own).alias("own"), is_target.alias("target")).alias("x"))

    every = part(own, True, F.col("role") == target).unionByName(part(again, False, F.lit(False)))
    windows = every.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("x")).alias("x"))
    mask = F.aggregate(
        "x",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["size"].alias("length"))))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"),
        F.size(F.filter("x", lambda x: ~x["own"])).alias("repeated"),
        mask["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What format_chat() wrote, from its output: conv_id, window, turns (array of role, text), targets (array of text), chars."""
    pieces = F.split("formatted", r"<\|end\|>\n")  # the last is empty
    pieces = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(3), F.instr(p, "|>\n") - 3)).alias("role"),
            unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars"))


def digest(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back. A conversation's digest needs its text as one string, as the hash is sequential."""
    back = read_back(windows)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", "window", text.alias("text"), F.array_join("targets", "").alias("loss"), F.size("turns").cast("long").alias("n"), "chars")
    got = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "text", "loss"))).alias("x"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "")
    return got.select(
        "conv_id",
        "n_turns",
        F.sha2(whole("text"), 256).alias("turns_sha256"),
        F.length(whole("loss")).cast("long").alias("loss_chars"),
        F.sha2(whole("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
