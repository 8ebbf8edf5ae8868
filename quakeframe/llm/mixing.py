"""Mixing sources to target weights by hierarchical budgeting, in SQL functions.

Leaves of the domain-language-source tree have a size in tokens and may give at most
``epochs`` times it.  The token budget goes down the tree: at each level siblings share
their parent's budget in proportion to their weights, none beyond what its subtree can
give; what one cannot take goes to its siblings first, and since a parent is never asked
for more than its subtree holds, only what all siblings lack reaches the next level up.
Shares are solved in closed form with window sums over the small table of nodes.

A leaf orders its documents anew in each seeded epoch, by md5 of seed, epoch and id, and
gives the shortest prefix of that order that reaches its budget.  To find the end of the
prefix, token sums per (leaf, range of the order) are cumulated first; only the rows of
the one range that holds the end are sorted.  Each document is then compared with its
leaf's end, so that no text is moved.

Defined cases: null domain, lang or source are leaves of their own (shown as null); null
texts have 0 tokens and come with the prefix that passes them; rows that repeat a doc_id
are placed together; an empty table or budget 0 gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

LEAF = ["domain", "lang", "source"]
#: Hex digits of the order key that name a range: 4096 ranges a leaf and epoch.
RANGE_DIGITS = 3


def token_count(text: Column) -> Column:
    """Words of the whole text, as runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The tree's top level: sources are dealt to four domains by their number (none: 0)."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)", 1), F.lit(""))
    return F.concat(F.lit("domain"), F.when(number == "", 0).otherwise(F.try_mod(number.try_cast("long"), F.lit(4))).cast("string"))


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def share_out(nodes: DataFrame, parents: list[str], child: str, budget: str = "parent_budget") -> DataFrame:
    """Adds ``budget`` to nodes (parents, child, weight, capacity, parent_budget).

    Siblings are sorted by capacity per weight.  If the first k of them are full, the rest
    get (budget - full capacity) / remaining weight per unit; the least k for which none
    of the rest overflows is right.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), child)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    level = F.greatest(F.col(budget) - filled, F.lit(0.0)) / F.sum("weight").over(after)
    full = nodes.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("capacity"))
    whole = Window.partitionBy(*parents)
    settled = F.min(F.when(F.col("open"), F.struct(F.col("capacity") / F.col("weight"), F.col(child), F.col("level")))).over(whole)
    full = full.withColumn("settled", settled["level"])
    return full.withColumn("budget", F.least("capacity", F.coalesce(F.col("settled") * F.col("weight"), F.col("capacity")))).drop("level", "open", "settled", budget)


def weight_of(child: str, weights: Mapping[str, float] | None) -> Column:
    """A node's weight relative to its siblings: 1 unless named."""
    column = F.lit(1.0)
    for name, value in (weights or {}).items():
        column = F.when(F.col(child) == name, F.lit(float(value))).otherwise(column)
    return column


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """leaves (domain, lang, source, tokens) with weight, capacity and budget; share is that of all tokens."""
    weights = weights or {}
    tree = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(epochs)))
    whole = tree.agg((F.sum("tokens") * F.lit(float(share))).alias("parent_budget"))
    level, keys = None, []
    for child in LEAF:
        nodes = tree.groupBy(*keys, child).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.where("capacity > 0").withColumn("weight", weight_of(child, weights.get(child)))
        if level is None:
            nodes = nodes.join(F.broadcast(whole))  # a single row
        else:
            met = [nodes[k].eqNullSafe(level[k]) for k in keys]
            on = met[0] if len(met) == 1 else met[0] & met[1]
            nodes = nodes.join(level, on).select(*(nodes[k] for k in keys), child, nodes["capacity"], nodes["tokens"], nodes["weight"], level["budget"].alias("parent_budget"))
        level = share_out(nodes, keys, child)
        keys = [*keys, child]
        if child != LEAF[-1]:
            level = level.select(*keys, "budget")
    return level


def mix(docs: DataFrame, share: float = 0.8, epochs: int = 2, seed: int = 17, weights: Mapping[str, Mapping[str, float]] | None = None, domain: Column | None = None) -> DataFrame:
    """Chosen rows: doc_id, domain, lang, source, epoch, n_tokens, budget (the leaf's, in tokens).

    A document is in epoch e (from 1) if the epochs before it and the prefix of that
    epoch's order before it hold fewer tokens than the leaf's budget.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (domain_of(F.col("source")) if domain is None else domain).alias("domain"),
        "lang",
        "source",
        token_count(F.col("text")).alias("n_tokens"),
    )
    rows = durable(rows)
    leaves = durable(leaf_budgets(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), share, epochs, weights))
    leaf = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in LEAF]
    same = leaf[0] & leaf[1] & leaf[2]
    # The epoch in which a leaf's budget ends, and the tokens that are left for it.
    last = F.ceil(F.col("budget") / F.col("tokens")).cast("int")
    ends = leaves.where("budget > 0").withColumn("last_epoch", last).withColumn("left", F.col("budget") - (F.col("last_epoch") - 1) * F.col("tokens"))
    keyed = rows.alias("r").join(ends.alias("l"), same).select("r.*", "budget", "last_epoch", "left")
    keyed = keyed.withColumn("key", order_key(seed, F.col("last_epoch"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("held"), F.first("left").alias("left"))
    before = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("passed", F.coalesce(F.sum("held").over(before), F.lit(0)))
    cut = durable(ranges.where("passed < left and passed + held >= left").select(*LEAF, "range", "passed"))
    at = same & (F.col("l.range") == F.col("r.range"))
    edge = keyed.alias("r").join(cut.alias("l"), at).select("r.*", "passed")
    order = Window.partitionBy(*LEAF).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("so_far", F.col("passed") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("so_far < left")
    stop = durable(edge.groupBy(*LEAF).agg(F.max("key").alias("stop")))
    placed = keyed.alias("r").join(stop.alias("l"), same, "left").select("r.*", "stop")
    whole = placed.select("*", F.explode(F.expr("case when last_epoch > 1 then sequence(1, last_epoch - 1) else array() end")).alias("epoch"))
    final = placed.where(F.col("stop").isNull() | (F.col("key") <= F.col("stop"))).withColumn("epoch", F.col("last_epoch"))
    return whole.unionByName(final).select("doc_id", *LEAF, "epoch", "n_tokens", F.round("budget", 3).alias("budget"))
