"""Chat formatting over a prefix tree.

Conversations that share initial turns share nodes.  Every node (a turn after
a certain sequence of turns) is emitted once, depth first, with the position
ids its tokens have in each conversation through it, and every conversation
gets the intervals of the emitted stream that are its turns: the ancestors
its tokens may attend to.  Tokens are code points of the formatted text.

Template: ``<|role|>`` role ``<|text|>`` text ``<|end|>``.  Inside roles and
texts a backslash is doubled and one is put behind the first character of
every control string (``<|``, ``<s>``, ``</s>``, ``<<``, ``[INST]``,
``[/INST]``), so that no text holds a mark; ``unescape`` drops the backslash
of each pair.

How it runs: a turn's prefix id is a running xor of two 64-bit hashes of
(place, role, text), so equal ids mean equal beginnings.  Conversations are
sorted by the list of their turns' hashes: that order keeps those with a
common beginning together, shorter first, which is depth-first order of the
tree, and it deals a beginning that a third of all conversations share over
many tasks.  A conversation's rank is its place in the order; a node belongs
to the first conversation through it (a minimum, pre-aggregated) and is
emitted there.  Offsets are counted within the pack of the conversation's
sort partition, so no task holds a whole tree.

Turns are read in the order of ``turn``; rows with one (conversation, turn)
follow by role and text.  Null role or text: empty.  Null ids form one
conversation.  Repeated rows are repeated turns.  Other columns are not
read.  An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoclust.session import cut

_CONTROL = "(<|\\[)(?=\\||/?s>|<|/?INST\\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\\\\", "\\\\\\\\"), _CONTROL, "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)\\\\(.)", "$1")


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row a turn: conversation, place ``k`` from 1, formatted text,
    prefix id (``p1``, ``p2``), position of its first token."""
    rows = conversations.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # a conversation is one sequence: its rows are sorted (on disk if need be)
    # and read once; the running values hold a few numbers
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat(F.lit("<|role|>"), escape(F.col("role")), F.lit("<|text|>"), escape(F.col("text")), F.lit("<|end|>"))
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("piece", piece)
    rows = rows.withColumn("h1", F.xxhash64("k", "role", "text")).withColumn("h2", F.xxhash64("text", "k", "role"))
    return rows.select("conv_id", "k", "role", "piece", "h1", F.bit_xor("h1").over(sofar).alias("p1"),
                       F.bit_xor("h2").over(sofar).alias("p2"), F.length("piece").cast("long").alias("n"),
                       F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long").alias("position"))


def build(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes``: the emitted stream (``rank, k``: depth-first order;
    ``pack, node``: its place in the pack; ``start, stop``: its interval
    there; ``piece``; ``position``: id of its first token; ``learn``: under the
    loss mask).  ``paths``: a row a turn of each conversation, with the place
    and interval where it was emitted, which is what later turns of the
    conversation attend to."""
    turns = cut(turns_of(conversations), "chat-turns")
    # 8 bytes a turn; the sort key of a conversation
    seqs = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "h1"))),
                                                    lambda x: x.h1).alias("path"))
    ranks = cut(seqs.orderBy("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("rank")),
                "chat-ranks")
    ranked = turns.join(ranks, turns.conv_id.eqNullSafe(ranks.conv_id)).drop(ranks.conv_id)
    # a table of its own, so that the join's shuffle of a very common node can be split
    owners = cut(ranked.groupBy("p1", "p2").agg(F.min("rank").alias("owner")), "chat-owners")
    placed = cut(ranked.join(owners, ["p1", "p2"])
                 .select("conv_id", "rank", "k", "role", "piece", "n", "position", "owner",
                         F.shiftright("owner", 33).alias("pack")), "chat-placed")
    own = placed.filter("rank = owner")
    stream = Window.partitionBy("pack").orderBy("rank", "k")
    nodes = cut(own.withColumn("stop", F.sum("n").over(stream)).withColumn("node", F.row_number().over(stream)).select(
        "rank", "k", "pack", "node", (F.col("stop") - F.col("n")).alias("start"), "stop", "position", "piece",
        (F.col("role") == "assistant").alias("learn")), "chat-nodes")
    paths = placed.select("conv_id", "k", "owner", F.col("position")).join(
        nodes.select(F.col("rank").alias("owner"), "k", "pack", "node", "start", "stop"), ["owner", "k"])
    return nodes, paths


def intervals(paths: DataFrame) -> DataFrame:
    """Ancestor attention of every conversation: its emitted intervals in
    order, neighbours in the stream joined (``conv_id, pack, start, stop,
    position``: the token at ``start + i`` has position id ``position + i``;
    ``first, last``: the nodes that the interval holds)."""
    w = Window.partitionBy("conv_id").orderBy("k")
    new = (~(F.lag("stop").over(w).eqNullSafe(F.col("start")) & F.lag("pack").over(w).eqNullSafe(F.col("pack"))))
    runs = paths.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run", "pack").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("position").alias("position"),
        F.min("node").alias("first"), F.max("node").alias("last"))


def read_back(nodes: DataFrame, attended: DataFrame) -> DataFrame:
    """``conv_id, position, role, text, learn, n_chars`` of every turn, parsed
    from what the conversation's intervals hold of the emitted stream; the
    position ids give the order."""
    # a row a node of an interval, as a table: the join's shuffle of a very common node can be split
    held = cut(attended.select("conv_id", "pack", "start", "position", F.explode(F.sequence("first", "last")).alias("node")), "chat-held")
    got = held.join(nodes.select("pack", "node", F.col("start").alias("at"), "piece", "learn"), ["pack", "node"])
    part = lambda i: unescape(F.regexp_extract("piece", "(?s)^<\\|role\\|>(.*?)<\\|text\\|>(.*)<\\|end\\|>$", i))
    return got.select("conv_id", (F.col("position") + F.col("at") - F.col("start")).alias("position"), part(1).alias("role"),
                      part(2).alias("text"), "learn", F.length("piece").alias("n_chars"))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back through its attention intervals and
    position ids: ``n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``, and ``positions_sha256`` of the position ids of its
    turns' first tokens, comma-joined."""
    nodes, paths = build(conversations)
    turns = read_back(nodes, intervals(paths))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.s), "")
    whole = F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("s"))
    loss = F.when(F.col("learn"), F.struct("position", F.col("text").alias("s")))
    per = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sha2(text(whole), 256).alias("turns_sha256"),
        F.sum(F.when(F.col("learn"), F.length("text")).otherwise(0)).cast("long").alias("loss_chars"),
        F.sha2(text(loss), 256).alias("loss_sha256"), F.sum("n_chars").cast("long").alias("formatted_chars"),
        F.sha2(F.array_join(F.sort_array(F.collect_list("position")).cast("array<string>"), ","), 256).alias("positions_sha256"))
    return per
