"""Mixing sources to target weights by hierarchical budgeting (operator 9). DataFrame functions only.

A budget of tokens flows down a tree of domains, languages and sources. At each node the
children share it in proportion to their weights, but none gets more than its subtree can
give (its tokens times the allowed epochs): what a child cannot use goes to its siblings,
and only a subtree that is used up as a whole leaves a shortage to the level above. Whole
tokens are dealt; the few that rounding leaves over go to the first unsaturated children.

A leaf then reads its documents in epochs, each a permutation given by an MD5 of seed,
epoch and ``doc_id``: full epochs take everything, the last one a prefix of the budget's
length, whose last document may be taken in part. Positions in that prefix come from sums
over hash buckets, so a leaf that holds a third of all rows is spread over thousands of
groups, and rows are ordered only within the one bucket in which the prefix ends.

Defined results: null keys count as '', a null or empty text as one token. Nodes of weight
0 get nothing. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jouleframe.llm.common import LOCATOR, keep, located

LEVELS = ("domain", "lang", "source")
BUCKET_DIGITS = 3  # hexadecimal: 4,096 buckets a leaf
BYTES_PER_TOKEN = 4


def token_estimate() -> Column:
    """Four UTF-8 bytes a token, one at least."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return F.greatest(F.lit(1), F.ceil(size / BYTES_PER_TOKEN)).cast("bigint")


def domain_of(source: str = "source") -> Column:
    """Four domains by the number in a source's name, which the given tables lack."""
    digits = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]+)", 1)
    return F.when(digits == "", F.lit("d")).otherwise(F.concat(F.lit("d"), (F.substring(digits, -1, 1).cast("int") % 4).cast("string")))


def share(nodes: DataFrame, parent: list[str], budget: str, weight: str, cap: str, order: list[str], out: str) -> DataFrame:
    """Deal ``budget`` (of the parent) to its children: whole tokens, ``cap`` at most.

    Children are ordered by the share at which they are full, so those that are full form a
    prefix, and prefix sums give what is left for the others.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = w.orderBy("_full_at", *order)
    before, onwards = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    d = lambda c: F.col(c).cast("double")
    full_at = F.when(F.col(weight) > 0, d(cap) / d(weight)).otherwise(F.lit(float("inf")))
    x = nodes.withColumn("_full_at", full_at)
    x = x.withColumns({"_used": F.coalesce(F.sum(cap).over(before), F.lit(0)), "_w": F.sum(weight).over(onwards)})
    x = x.withColumn("_full", (F.col(weight) > 0) & (d(cap) * d("_w") <= (d(budget) - d("_used")) * d(weight)))
    x = x.withColumns({"_left": F.col(budget) - F.sum(F.when(F.col("_full"), F.col(cap)).otherwise(0)).over(w),
                       "_open": F.sum(F.when(F.col("_full"), F.lit(0)).otherwise(F.col(weight))).over(w)})
    part = F.when(F.col("_full"), F.col(cap)).when(F.col("_open") == 0, F.lit(0)).otherwise(F.floor(d("_left") * d(weight) / d("_open")))
    x = x.withColumn("_part", F.least(part.cast("bigint"), F.col(cap)))
    # What flooring left over: one token each to the first open children.
    open_ = ~F.col("_full") & (F.col(weight) > 0)
    x = x.withColumns({"_over": F.col(budget) - F.sum("_part").over(w), "_turn": F.sum(F.when(open_, 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    got = F.col("_part") + F.when(open_ & (F.col("_turn") <= F.col("_over")) & (F.col("_part") < F.col(cap)), 1).otherwise(0)
    return x.withColumn(out, got.cast("bigint")).drop("_full_at", "_used", "_w", "_full", "_left", "_open", "_part", "_over", "_turn")


def leaf_budgets(leaves: DataFrame, budget: Column, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the tokens that each is to give.

    ``budget`` is an aggregate over ``tokens``; ``weights`` has a whole-number expression for
    each level. One row a leaf: the table grows with the number of sources, not of documents.
    """
    x = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    root = x.agg(F.least(budget.cast("bigint"), F.sum("cap")).alias("_b0"))
    parent: list[str] = []
    deal = root
    for depth, level in enumerate(LEVELS):
        keys = [*parent, level]
        nodes = x.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", weights[level].cast("bigint"))
        nodes = nodes.join(deal, parent) if parent else nodes.withColumn("_b0", root.select("_b0").scalar())
        nodes = share(nodes, parent, f"_b{depth}", "weight", "cap", [level], f"_b{depth + 1}")
        deal, parent = nodes.select(*keys, f"_b{depth + 1}"), keys
    return leaves.join(deal.withColumnRenamed(f"_b{len(LEVELS)}", "budget"), list(LEVELS))


def mix(docs: DataFrame, budget: Column, weights: dict[str, Column], max_epochs: int = 1, seed: int = 0,
        tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """One row per document and epoch that gives tokens: doc_id, the leaf, epoch, tokens, taken and the locator."""
    return _mix(located(docs, "doc_id", "text", "lang", "source"), budget, weights, max_epochs, seed, tokens, domain)


def _mix(content: DataFrame, budget, weights, max_epochs=1, seed=0, tokens=None, domain=None) -> DataFrame:
    rows = keep(content.select(
        LOCATOR, "doc_id", (domain if domain is not None else domain_of()).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), (tokens if tokens is not None else token_estimate()).alias("tokens")), "mixing")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = keep(leaf_budgets(leaves, budget, weights, max_epochs).select(
        *LEVELS, F.expr("budget div tokens").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest")), "mixing-plan")
    x = rows.join(plan, list(LEVELS))
    whole = (x.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))))
             .withColumn("taken", F.col("tokens")))

    # The epoch that is read in part.
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    y = x.where("rest > 0").withColumn("_h", order).withColumn("_bucket", F.substring("_h", 1, BUCKET_DIGITS))
    key = [*LEVELS, "_bucket"]
    sums = y.groupBy(*key, "rest").agg(F.sum("tokens").alias("_sum"))
    before = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_start") < F.col("rest"))
    y = y.join(sums.drop("rest"), key)
    inside = y.where(F.col("_start") + F.col("_sum") <= F.col("rest")).withColumn("taken", F.col("tokens"))
    w = Window.partitionBy(*key).orderBy("_h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = (y.where(F.col("_start") + F.col("_sum") > F.col("rest"))
            .withColumn("_at", F.col("_start") + F.coalesce(F.sum("tokens").over(w), F.lit(0))).where(F.col("_at") < F.col("rest"))
            .withColumn("taken", F.least(F.col("tokens"), F.col("rest") - F.col("_at"))))
    part = inside.select(*x.columns, "taken").unionByName(edge.select(*x.columns, "taken")).withColumn("epoch", F.col("full").cast("int"))
    out = ["doc_id", *LEVELS, "epoch", "tokens", "taken", LOCATOR]
    return whole.select(*out).unionByName(part.select(*out))


def take_mixed(docs: DataFrame, budget: Column, weights: dict[str, Column], seed: int = 0) -> DataFrame:
    """Whole documents of one epoch that the mixture reads at least in part, with all columns."""
    names = docs.columns
    whole = located(docs, *names)
    chosen = _mix(whole.select("doc_id", "text", "lang", "source", LOCATOR), budget, weights, 1, seed).select(LOCATOR)
    return whole.join(chosen, LOCATOR, "left_semi").select(*names)
