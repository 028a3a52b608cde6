"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget runs down a tree (domain, language, source). At each node the
children get shares in proportion to their weights; a child whose subtree can
give less than its share gives all it has, and the rest goes to its siblings.
What all siblings together cannot take shows in their parent's capacity, so it
goes to the parent's siblings, and so on upwards. A leaf gives whole epochs of
its documents and then a prefix, in tokens, of one more epoch in that epoch's
seeded order.

All amounts are integers. Leaves are shared between tasks in pieces of about
PIECE_ROWS rows by the order key, so a leaf with a third of all rows is no single
task's work.

Defined results: null levels are the leaf name "(null)"; null or empty texts
hold no token and are taken whenever their place in the order is reached;
rows that repeat a doc_id share one place in the order and rank by their tokens,
so that the smallest come first; texts are counted whole; an empty table gives an
empty result; other columns are not read. A level named like a column of the
result or a working column (RESERVED) is refused with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.runtime import unused, written

WORDS = r"[^\x20\x09-\x0D]+"
NULL_NAME = "(null)"
#: Rows of a leaf that one window partition gets, about.
PIECE_ROWS = 1 << 9
RESERVED = {"doc_id", "n_tokens", "tokens", "target", "leaf_target", "full_epochs", "in_prefix", "copies", "capacity", "weight", "budget"} | {f"_{x}" for x in ("rows", "order", "owed", "piece", "before", "left", "weights", "full", "rest", "rest_weights", "share", "all", "piece_tokens")}
#: Leaf tables up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 50_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The production tree's first level: four families of sources by their number."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long")
    return F.coalesce(F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), F.lit("other"))


def _weight(level: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), level), F.lit(1)).cast("long")


def _order(seed: int, epochs: Column, doc_id: Column) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NULL_NAME))))


def _leaf(levels: dict[str, Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(NULL_NAME)).alias(n) for n, c in levels.items()]


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Give each node its part of budget: columns budget (of the parent), capacity and weight become target.

    Children are filled in the order of capacity to weight; the first that can
    take its share in full fixes the rate for all after it."""
    by = Window.partitionBy(*parents)
    order = by.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_left": F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_weights": F.sum("weight").over(rest)})
    nodes = nodes.withColumn("_full", _wide(F.col("capacity")) * _wide(F.col("_weights")) <= _wide(F.col("weight")) * _wide(F.col("_left")))
    nodes = nodes.withColumns({"_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(by), "_rest_weights": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by)})
    nodes = nodes.withColumn("_share", _wide(F.col("weight")) * _wide(F.col("_rest")))
    target = F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("cast(_share div nullif(_rest_weights, 0) as bigint)"))
    return nodes.withColumn("target", target).drop("_left", "_weights", "_full", "_rest", "_rest_weights", "_share")


def leaf_targets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget_percent: int, epochs: int) -> DataFrame:
    """leaves: levels and tokens, a row for each leaf. Returns levels, tokens, target."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    parent = None
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        if parent is None:
            everything = F.sum("tokens").over(Window.partitionBy())
            nodes = nodes.withColumn("_all", everything).withColumn("budget", F.expr(f"_all * {budget_percent} div 100")).drop("_all")
        else:
            nodes = nodes.join(parent.select(*path[:-1], F.col("target").alias("budget")), path[:-1])
        parent = share_out(nodes, path[:-1], level)
    return parent.select(*levels, "tokens", "target")


def mix(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], *, tokens: Column, seed: int = 7, budget_percent: int = 60, epochs: int = 2) -> DataFrame:
    """doc_id, the levels, n_tokens, leaf_target, full_epochs, in_prefix and copies of every document.

    copies is how often the mixture holds the document. The order of epoch e is
    by md5 of "seed:e:doc_id"; a document is in the prefix if the tokens up to
    and with it are within what the leaf still owes after its whole epochs."""
    names = list(levels)
    if taken := RESERVED & {n.lower() for n in names}:
        raise ValueError(f"levels may not be named {sorted(taken)}")
    slim = df.select(F.col("doc_id"), *_leaf(levels), tokens.alias("n_tokens"))
    slim = written(slim, "mix-documents")
    leaves = written(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("_rows")), "mix-leaves")
    targets = leaf_targets(leaves.drop("_rows"), names, weights, budget_percent, epochs)
    targets = written(targets.join(leaves.drop("tokens"), names), "mix-targets")
    small = targets.count() <= BROADCAST_LEAVES
    planned = slim.join(F.broadcast(targets) if small else targets, names)
    planned = planned.withColumns({"full_epochs": F.expr("coalesce(target div nullif(tokens, 0), 0)"), "_owed": F.expr("coalesce(target % nullif(tokens, 0), 0)")})
    planned = planned.withColumn("_order", _order(seed, F.col("full_epochs"), F.col("doc_id")))
    # pieces follow the order, as equal shares of its first 32 bits
    pieces = F.ceil(F.col("_rows") / F.lit(PIECE_ROWS)).cast("long")
    planned = planned.withColumn("_piece", F.shiftright(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * pieces, 32))
    place = [*names, "_piece"]
    pieces = planned.groupBy(*place).agg(F.sum("n_tokens").alias("_piece_tokens"))
    before = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*place, F.coalesce(F.sum("_piece_tokens").over(before), F.lit(0)).alias("_before"))
    # dealt by leaf and piece, never by leaf alone
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planned = planned.repartition(parts, *place).join(pieces.repartition(parts, *place), place)
    upto = Window.partitionBy(*place).orderBy("_order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    planned = planned.withColumn("in_prefix", F.col("_before") + F.sum("n_tokens").over(upto) <= F.col("_owed"))
    return planned.select("doc_id", *names, "n_tokens", F.col("target").alias("leaf_target"), "full_epochs", "in_prefix", (F.col("full_epochs") + F.col("in_prefix").cast("long")).alias("copies"))


def drawn(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], *, tokens: Column, seed: int = 7, budget_percent: int = 60) -> DataFrame:
    """The rows with a doc_id, with all their columns, that the mixture of one epoch (mix) holds.

    What a leaf gives ends at one place of its order, so each row is told by its
    own place and that end: only the table of leaves travels. Rows of one leaf
    that agree in doc_id and tokens stay or go together."""
    mixed = mix(df, levels, weights, tokens=tokens, seed=seed, budget_percent=budget_percent, epochs=1)
    names = unused(df, *levels)
    of, end = unused(df.select("*", *[F.lit(0).alias(n) for n in names]), "epochs", "end")
    place = F.struct(_order(seed, F.col("full_epochs"), F.col("doc_id")).alias("order"), F.col("n_tokens").alias("tokens"))
    ends = mixed.where("copies > 0").groupBy(*[F.col(n).alias(own) for n, own in zip(levels, names, strict=True)]).agg(F.max("full_epochs").alias(of), F.max(place).alias(end))
    ends = written(ends, "mix-ends")
    rows = df.where("doc_id is not null").withColumns(dict(zip(names, _leaf(levels), strict=True)))
    rows = rows.join(F.broadcast(ends) if ends.count() <= BROADCAST_LEAVES else ends, names)
    order, last = _order(seed, F.col(of), F.col("doc_id")), F.col(end)["order"]
    # the tokens are counted only where they decide
    return rows.where((order < last) | ((order == last) & (tokens <= F.col(end)["tokens"]))).select(df.columns)
