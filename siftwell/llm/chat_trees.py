"""Reply trees to conversations: every root-to-leaf path, ranked, and formatted as one text with a loss mask.

Only DataFrame expressions. Pointers are doubled by self-joins (the ancestor 1, 2, 4, ... steps up), and the
paths are then grown downwards from the longest step, so a path of n messages takes log2(n) joins and the
rows in flight are the rows of the result. Join keys hold the message id, so one huge conversation is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import Work, whole_text

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """`<`, any backslashes, `|` gets one more backslash: no mark is left, and unescape undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line without marks: %, line feed and | as percent codes."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("|"), F.lit("%7C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def numbered(messages: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """Messages under inner names. Rows of one (conversation, id) get versions; replies attach to version 1."""
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(node).alias("node"), F.col(parent).alias("parent"), whole_text(role).alias("role"),
        whole_text(text).alias("text"), (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    order = Window.partitionBy("conv", "node").orderBy("parent", "role", "text", "score")
    return rows.withColumn("ver", F.row_number().over(order))


def paths(work: Work, messages: DataFrame) -> DataFrame:
    """(conv, leaf, leaf_ver, node, ver, up): every message of every root-to-leaf path, `up` steps above its leaf.

    A message whose parent is null or absent is a root. Messages on a cycle, or below one, have no root and
    so no path.
    """
    ids = messages.select("conv", "node", "ver", "parent")
    known = ids.where("ver = 1").select(F.col("conv").alias("pconv"), F.col("node").alias("anc"), F.col("ver").alias("anc_ver"))
    step = work.stage(
        ids.join(known, F.col("conv").eqNullSafe(F.col("pconv")) & (F.col("parent") == F.col("anc")))
        .select("conv", "node", "ver", "anc", "anc_ver"), "step")
    levels, rows = [step], step.count()
    while rows:
        last = levels[-1]
        up = last.select(F.col("conv").alias("uconv"), F.col("node").alias("unode"), F.col("ver").alias("uver"),
                         F.col("anc").alias("far"), F.col("anc_ver").alias("far_ver"))
        longer = work.stage(
            last.join(up, F.col("conv").eqNullSafe(F.col("uconv")) & (F.col("anc") == F.col("unode")) & (F.col("anc_ver") == F.col("uver")))
            .select("conv", "node", "ver", F.col("far").alias("anc"), F.col("far_ver").alias("anc_ver")), "step")
        was, rows = rows, longer.count()
        if rows == was:  # no chain ended within twice the length: what is left runs into a cycle
            break
        levels.append(longer)
    parents = step.select(F.col("conv").alias("pconv"), F.col("anc"), F.col("anc_ver")).distinct()
    leaves = ids.join(parents, F.col("conv").eqNullSafe(F.col("pconv")) & F.col("node").eqNullSafe(F.col("anc")) & (F.col("ver") == F.col("anc_ver")), "left_anti")
    if rows:
        endless = longer.select(F.col("conv").alias("econv"), F.col("node").alias("enode"), F.col("ver").alias("ever"))
        leaves = leaves.join(endless, F.col("conv").eqNullSafe(F.col("econv")) & (F.col("node") == F.col("enode")) & (F.col("ver") == F.col("ever")), "left_anti")
    path = leaves.select("conv", F.col("node").alias("leaf"), F.col("ver").alias("leaf_ver"), "node", "ver", F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("conv").alias("jconv"), F.col("node").alias("jnode"), F.col("ver").alias("jver"), "anc", "anc_ver")
        grown = path.join(jump, F.col("conv").eqNullSafe(F.col("jconv")) & (F.col("node") == F.col("jnode")) & (F.col("ver") == F.col("jver"))).select(
            "conv", "leaf", "leaf_ver", F.col("anc").alias("node"), F.col("anc_ver").alias("ver"), (F.col("up") + (1 << k)).alias("up"))
        path = work.stage(path.unionByName(grown), "paths")
    return path


def format_trees(
    messages: DataFrame, conv: str = "conv_id", node: str = "node_id", parent: str = "parent_id", role: str = "role",
    text: str = "text", score: str | None = "score", branches: int | None = 1,
) -> DataFrame:
    """One row per chosen branch: conv, leaf, branch (1 is best), path_score, n_turns, formatted, loss_spans.

    Branches of a conversation are ranked by the sum of their messages' scores (null counts 0), ties by the
    smaller leaf id; the best `branches` are formatted, all for None. A turn reads `<|im_start|>role`, a line
    feed, the escaped text, `<|im_end|>` and a line feed. loss_spans are the (start, length) code points of the assistant
    texts inside `formatted`. Null roles and texts are empty, an empty table gives none, a null conversation
    id is a conversation, repeated (conversation, id) rows are separate replies (see `numbered`), other
    columns are not read.
    """
    work = Work(messages.sparkSession, "chat")
    rows = work.stage(numbered(messages, conv, node, parent, role, text, score), "messages")
    path = paths(work, rows)
    own = rows.select(F.col("conv").alias("mconv"), F.col("node").alias("mnode"), F.col("ver").alias("mver"), "role", "text", "score")
    turns = path.join(own, F.col("conv").eqNullSafe(F.col("mconv")) & F.col("node").eqNullSafe(F.col("mnode")) & (F.col("ver") == F.col("mver")))
    if branches is not None:
        sums = turns.groupBy("conv", "leaf", "leaf_ver").agg(F.sum("score").alias("path_score"))
        best = Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf", "leaf_ver")
        chosen = work.stage(sums.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches), "chosen")
        keep = chosen.select(F.col("conv").alias("cconv"), F.col("leaf").alias("cleaf"), F.col("leaf_ver").alias("cver"))
        turns = turns.join(keep, F.col("conv").eqNullSafe(F.col("cconv")) & F.col("leaf").eqNullSafe(F.col("cleaf")) & (F.col("leaf_ver") == F.col("cver")), "left_semi")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = turns.select("conv", "leaf", "leaf_ver", "up", "score", (F.col("role") == "assistant").alias("learned"),
                         F.concat(head, body, F.lit(CLOSE + "\n")).alias("turn"), F.char_length(head).alias("at"), F.char_length(body).alias("size"))
    before = Window.partitionBy("conv", "leaf", "leaf_ver").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.col("at") + F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)))
    one = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), "turn", "learned", "at", "size")))
    done = turns.groupBy("conv", "leaf", "leaf_ver").agg(one.alias("turns"), F.sum("score").alias("path_score"))
    rank = Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf", "leaf_ver")
    return done.select(
        F.col("conv").alias(conv), F.col("leaf").alias("leaf_id"), F.row_number().over(rank).alias("branch"), "path_score",
        F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t["at"].alias("start"), t["size"].alias("length"))).alias("loss_spans"))


def read_back(formatted: DataFrame, column: str = "formatted", spans: str = "loss_spans") -> DataFrame:
    """Adds `turns` (role, text as they were) and `loss_texts`, both read from the formatted text alone and its spans."""
    parts = F.split(F.col(column), r"<\|im_start\|>")
    turn = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(CLOSE) - 1)).alias("text")))
    texts = F.transform(spans, lambda s: unescape(F.col(column).substr(s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": turn, "loss_texts": texts})
