"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens cut a conversation into windows at turns. The window of a turn is
the stretch of `budget` (less what is repeated) in which the turn begins; a turn that crosses the end
of its stretch gets a window of its own. Each window begins with the system turn, then repeats the last
few turns before it, as many as the budget has room for besides the system turn and its own turns. So a
window is over the budget only if the system turn and one turn are, and then it repeats nothing else.
Repeated turns are context: the loss mask covers the assistant texts of a window's own turns alone.

Template: `<turn>ROLE\\nTEXT</turn>\\n` for own turns, `<again>ROLE\\nTEXT</turn>\\n` for repeated ones. In
texts and roles `\\` becomes `\\b` and `<` becomes `\\l`, in roles a line feed becomes `\\n`; so no text can
hold a mark, and reading back is exact.

Everything is DataFrame functions over one shuffle by conversation. Turns of a conversation must meet
in order, as their digest does, so a single conversation is one task's work; its turns pass through
window functions that spill, and arrays hold one window each.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null text or role is empty;
repeated rows are turns of their own; a null conversation id is a conversation; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_TOKENS = 128
HISTORY_TURNS = 2
#: Tokens that the marks of a turn count as.
MARK_TOKENS = 4
SYSTEM, TARGET = "system", "assistant"

_OWN, _AGAIN, _END = "<turn>", "<again>", "</turn>\n"


def _replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(text: Column) -> Column:
    return _replaced(text, ("\\", "\\b"), ("<", "\\l"))


def unescape(text: Column) -> Column:
    return _replaced(text, ("\\l", "<"), ("\\b", "\\"))


def tokens(text: Column) -> Column:
    """Words of a turn, and its marks."""
    return F.regexp_count(text, F.lit("[^ \\t-\\r]+")) + MARK_TOKENS


def format_windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, window, formatted, loss_spans, n_tokens): the windows of each conversation, from 1; spans are code points of `formatted`, ends exclusive."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_id).alias("c"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    turns = turns.withColumn("n", tokens(F.col("text")))
    order = ["turn", "role", "text"]
    by = Window.partitionBy("c").orderBy(*order)
    turns = turns.withColumn("i", F.row_number().over(by))
    by = Window.partitionBy("c").orderBy("i")
    head = (F.col("i") == 1) & (F.col("role") == SYSTEM)
    turns = turns.withColumn("system", head).withColumn("cost", F.when(head, 0).otherwise(F.col("n")))
    kept = F.first(F.when(head, F.col("n")).otherwise(0)).over(by)
    turns = turns.withColumn("stretch", F.greatest(F.lit(1), F.lit(budget - history_tokens) - kept, F.floor((F.lit(budget) - kept) / 2)))
    turns = turns.withColumn("upto", F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("upto") - F.col("cost"))
    place = F.floor(F.col("from") / F.col("stretch"))
    crosses = F.floor((F.greatest(F.col("upto"), F.col("from") + 1) - 1) / F.col("stretch")) != place
    turns = turns.withColumn("span", 2 * place + crosses.cast("int"))
    turns = turns.withColumn("span", F.when(head, F.coalesce(F.lead("span").over(by), "span")).otherwise(F.col("span")))
    turns = turns.withColumn("begins", F.coalesce(F.col("span") != F.lag("span").over(by), F.lit(True)))
    turns = turns.withColumn("window", F.sum(F.col("begins").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("c").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = turns.withColumn("windows", F.max("window").over(whole))
    # what a window has room for besides the system turn and its own turns
    turns = turns.withColumn("room", F.lit(budget) - kept - F.sum("cost").over(Window.partitionBy("c", "window")))
    # the windows in which a turn stands: its own; those that begin soon after it; for the system turn, all
    away = lambda h: F.lead("from", h).over(by) - F.col("from")
    later = [F.when(~F.col("system") & F.lead("begins", h).over(by) & (away(h) <= F.least(F.lit(history_tokens), F.lead("room", h).over(by))), F.lead("window", h).over(by)) for h in range(1, history_turns + 1)]
    turns = turns.withColumn("again", F.array_compact(F.array(*later)) if later else F.expr("cast(array() as array<bigint>)"))
    places = F.when(F.col("system"), F.sequence(F.col("window"), F.col("windows"))).otherwise(F.concat(F.array("window"), "again"))
    rows = turns.select("c", "i", "role", "text", "n", F.posexplode(places).alias("at", "window"))
    mark = F.when(F.col("at") == 0, F.lit(_OWN)).otherwise(F.lit(_AGAIN))
    lead = F.concat(mark, _replaced(escape(F.col("role")), ("\n", "\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    target = (F.col("at") == 0) & (F.col("role") == TARGET)
    rows = rows.select("c", "window", F.struct("i", lead.alias("lead"), body.alias("body"), target.alias("target"), "n").alias("t"))
    grouped = rows.groupBy("c", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.sum("t.n").alias("n_tokens"))
    sizes = F.transform("ts", lambda t: F.length(t["lead"]) + F.length(t["body"]) + len(_END))
    grouped = grouped.withColumn("sizes", sizes)
    begin = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x)
    spans = F.transform("ts", lambda t, i: F.struct((begin(i) + F.length(t["lead"])).alias("start"), (begin(i) + F.length(t["lead"]) + F.length(t["body"])).alias("end"), t["target"].alias("target")))
    spans = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["lead"], t["body"], F.lit(_END))), "")
    return grouped.select(F.col("c").alias(conv_id), F.col("window").cast("int").alias("window"), formatted.alias("formatted"), spans.alias("loss_spans"), F.col("n_tokens").cast("long").alias("n_tokens"))


def own_turns(formatted: Column) -> Column:
    """The turns that a formatted window has not repeated, read back as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, _END, -1), lambda b: F.startswith(b, F.lit(_OWN)))
    inner = F.transform(blocks, lambda b: F.substr(b, F.lit(len(_OWN) + 1)))
    return F.transform(
        inner,
        lambda b: F.struct(
            unescape(_replaced(F.substring_index(b, "\n", 1), ("\\n", "\n"))).alias("role"),
            unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))


def read_back(windows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) of each conversation, from its formatted windows alone: all own
    turns as role, line feed, text, line feed; all text under the loss mask; and the code points of all windows."""
    own = own_turns(F.col("formatted"))
    per = windows.select(
        F.col(conv_id).alias("c"),
        F.struct(
            F.col("window"),
            F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        ).alias("w"),
        F.size(own).cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("chars"),
    )
    out = per.groupBy("c").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.col(f"ws.{name}"), "")
    return out.select(F.col("c").alias(conv_id), "n_turns", joined("turns").alias("turns"), joined("loss").alias("loss"), "formatted_chars")
