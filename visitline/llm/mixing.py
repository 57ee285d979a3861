"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree has three levels below its root: domain, language, source. A budget of tokens is handed down
from the root: at every node each child gets its share by weight, but no more than its whole subtree
can supply, and what a child can't use goes to its siblings before the parent reports it to its own
siblings. A leaf then takes a prefix of its seeded epochs: all documents in one seeded order, then all
in another, until its budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from visitline.session import materialize

BUCKET_ROWS = 4096  # rows of a leaf that one ordering step sees, about


def token_count(text: Column) -> Column:
    """White-space separated words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share_out(children: DataFrame, parents: DataFrame | None, keys: Sequence[str], total: int = 0) -> DataFrame:
    """Budgets of ``children`` (columns ``keys``, ``weight``, ``supply``) out of their parents' budgets.

    With children ordered by supply per weight, those that can't use their share come first: a child is
    filled if its supply is at most its share of what the children before it left. The others divide the
    rest by weight, rounded down. Weights and supplies are whole numbers, so the result is exact.
    """
    up = list(keys[:-1])
    if parents is None:
        nodes = children.withColumn("_budget", F.lit(total).cast("decimal(38,0)"))
    else:
        nodes = children.join(parents.select(*up, F.col("budget").cast("decimal(38,0)").alias("_budget")), up)
    supply, weight = F.col("supply").cast("decimal(20,0)"), F.col("weight").cast("decimal(10,0)")
    group = W.partitionBy(*(F.col(k) for k in up)) if up else W.partitionBy(F.lit(0))
    order = group.orderBy(F.col("supply") / F.col("weight"), F.col(keys[-1]))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "_left": F.col("_budget") - F.coalesce(F.sum(supply).over(before), F.lit(0)),
            "_weights": F.sum(weight).over(group) - F.coalesce(F.sum(weight).over(before), F.lit(0)),
        }
    )
    filled = (F.col("supply").cast("decimal(18,0)") * F.col("_weights").cast("decimal(18,0)")) <= (
        F.greatest(F.col("_left"), F.lit(0)).cast("decimal(18,0)") * F.col("weight").cast("decimal(18,0)")
    )
    # the first child that isn't filled closes the list of filled ones
    nodes = nodes.withColumn("_open", F.min(F.when(~filled, F.struct(F.col("supply") / F.col("weight"), F.col(keys[-1]).alias("k"), F.col("_left"), F.col("_weights")))).over(group))
    by_weight = F.floor(
        F.greatest(F.col("_open._left"), F.lit(0)).cast("decimal(18,0)") * F.col("weight").cast("decimal(18,0)") / F.col("_open._weights").cast("decimal(18,0)")
    ).cast("bigint")
    first = F.struct(F.col("supply") / F.col("weight"), F.col(keys[-1]).alias("k"))
    full = F.col("_open").isNull() | (first < F.struct(F.col("_open.col1"), F.col("_open.k")))
    return nodes.withColumn("budget", F.when(full, F.col("supply")).otherwise(F.least(by_weight, F.col("supply")))).drop("_budget", "_left", "_weights", "_open")


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Token budget of each leaf ``(domain, lang, source, supply)``; names without a weight have 1."""

    def weighted(df: DataFrame, level: str) -> DataFrame:
        given = weights.get(level, {})
        cases = F.lit(1).cast("bigint")
        for name, w in given.items():
            if int(w) != w or w < 1:
                raise ValueError("weights must be whole numbers of at least 1")
            cases = F.when(F.col(level) == name, F.lit(int(w))).otherwise(cases)
        return df.withColumn("weight", cases.cast("bigint"))

    domains = leaves.groupBy("domain").agg(F.sum("supply").alias("supply"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"))
    top = share_out(weighted(domains, "domain"), None, ["domain"], total)
    middle = share_out(weighted(langs, "lang"), top, ["domain", "lang"])
    return share_out(weighted(leaves, "source"), middle, ["domain", "lang", "source"])


def mix_sources(
    docs: DataFrame,
    domain: Column,
    *,
    share: tuple[int, int] = (1, 2),
    weights: dict[str, dict[str, int]] | None = None,
    epochs: int = 2,
    seed: int = 17,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Documents to train on, once per epoch in which they are taken.

    ``docs`` needs ``doc_id``, ``text``, ``lang``, ``source``; ``domain`` is a text column over them.
    The whole budget is ``share`` (numerator, denominator) of all tokens. ``weights`` has whole-number
    weights by level (``domain``, ``lang``, ``source``) and name, 1 where none is given. A leaf supplies
    its tokens ``epochs`` times; an epoch takes documents by md5 of seed, epoch and id, and the last
    document taken is the one that starts below the budget, so a leaf exceeds its budget by less than
    one document. Returns ``doc_id, epoch, domain, lang, source, n_tokens, leaf_budget``.

    Null lang, source or domain is the name ``''``; documents without tokens are never taken; rows that
    repeat an id are taken each for itself, side by side; null ids order as ``''``. No documents: no rows.
    """
    weights = weights or {}
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tokens = materialize(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"),
        name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"),
    ).where("n_tokens > 0"), "tokens")  # a few dozen bytes a document, read by every later step
    leaf = ["domain", "lang", "source"]
    sizes = tokens.groupBy(*leaf).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count("*").alias("leaf_rows"))
    total = sizes.agg(F.sum("leaf_tokens")).first()[0] or 0
    budgets = leaf_budgets(sizes.withColumn("supply", F.col("leaf_tokens") * F.lit(epochs)), int(total) * share[0] // share[1], weights)
    # Whole epochs need no order; only the epoch in which a leaf's budget ends does.
    whole = F.floor(F.col("budget") / F.col("leaf_tokens"))
    budgets = budgets.select(
        *leaf, F.col("budget").alias("leaf_budget"), whole.cast("int").alias("whole"),
        (F.col("budget") - whole * F.col("leaf_tokens")).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("leaf_rows") / F.lit(bucket_rows))).cast("bigint").alias("parts"),
    )
    rows = tokens.join(budgets, leaf)
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("whole"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ranked = rows.where("rest > 0").withColumn("_key", key).withColumn(
        "_part", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * F.col("parts") / F.lit(1 << 32)).cast("bigint")
    )
    parts = ranked.groupBy(*leaf, "_part").agg(F.sum("n_tokens").alias("_tokens"))
    starts = parts.select(*leaf, "_part", F.coalesce(F.sum("_tokens").over(W.partitionBy(*leaf).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*leaf, "_part").orderBy("_key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    last = (
        ranked.join(starts, [*leaf, "_part"])
        .where("_start < rest")
        .withColumn("_before", F.col("_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .where("_before < rest")
        .withColumn("epoch", F.col("whole") + 1)
    )
    out = ["doc_id", F.col("epoch").cast("int").alias("epoch"), *leaf, "n_tokens", "leaf_budget"]
    return full.select(*out).union(last.select(*out))
