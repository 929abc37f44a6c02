"""Mixing sources to target weights: hierarchical budgets and a token-prefix of a seeded epoch a leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Plans of up to this many leaves are broadcast; larger ones join by shuffle.
BROADCAST_LEAVES = 50_000
#: Hex digits of the order hash that a round of bucket sums looks at; rows of a border bucket that end the rounds.
DIGITS, EDGE = 2, 4096


def n_tokens(text: str) -> Column:
    """Words between ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """A node's integer weight among its siblings; 1 unless given."""
    given = weights.get(level) or {}
    if not given:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[F.lit(x) for k, v in sorted(given.items()) for x in (k, int(v))])
    return F.coalesce(F.element_at(pairs, F.coalesce(F.col(level), F.lit(""))), F.lit(1)).cast("long")


def fill(nodes: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """Split each parent's `budget` among its children by `w`, none above its `cap`: adds `alloc`.

    Children sorted by cap / w run short first. With the first ones full, the rest share what is left
    by weight at one level; the level to take is the highest at which its own child is not full.
    """
    by = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), *order)
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.col("budget") - before) / rest
    nodes = nodes.withColumn("level", level).withColumn("short", F.col("level") >= F.col("cap") / F.col("w"))
    top = F.max(F.when(~F.col("short"), F.col("level"))).over(W.partitionBy(*parent))
    alloc = F.least(F.col("cap"), F.floor(F.coalesce(top, F.lit(1e300)) * F.col("w")))
    alloc = F.when(top.isNull(), F.col("cap")).otherwise(alloc)
    return nodes.withColumn("alloc", alloc.cast("long")).drop("level", "short", "budget")


def leaf_plan(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """Tokens given to each leaf: levels.., t (tokens there are), alloc, full (whole epochs), rest (tokens of one more)."""
    caps = leaves.withColumn("cap", F.col("t") * max_epochs)
    plan = caps.agg(F.floor(F.sum("t") * F.lit(share)).cast("long").alias("alloc"), F.lit(1).alias("_root"))
    for i in range(len(levels)):
        parent = ["_root", *levels[:i]]
        at = caps.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap")).withColumn("_root", F.lit(1)).withColumn("w", weight_of(levels[i], weights))
        same = None
        above = plan.select(*[F.col(c).alias("_p_" + c) for c in parent], F.col("alloc").alias("budget"))
        for c in parent:
            cond = F.col(c).eqNullSafe(F.col("_p_" + c))
            same = cond if same is None else same & cond
        plan = fill(at.join(above, same).drop(*["_p_" + c for c in parent]), parent, [levels[i]])
    t = F.greatest(F.col("t"), F.lit(1))
    same = None
    for c in levels:
        cond = F.col(c).eqNullSafe(F.col("_l_" + c))
        same = cond if same is None else same & cond
    own = leaves.select(*[F.col(c).alias("_l_" + c) for c in levels], "t")
    return plan.join(own, same).select(*levels, "t", "alloc", F.floor(F.col("alloc") / t).cast("long").alias("full"), F.pmod("alloc", t).cast("long").alias("rest"))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float = 0.8, max_epochs: int = 3, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Documents with `copies`, how often a mixture at target weights takes each; DataFrame operations only.

    levels: name -> expression, from the root down; the last is the source. weights: level -> node ->
    integer weight among siblings (1 unless given). The root's budget is share of all tokens. A node's
    budget goes to its children by weight; a child's capacity is its tokens times max_epochs, and what a
    full child cannot take goes to its siblings, and to the parent's siblings only when all of them are
    full (fill()). A leaf takes whole epochs and then the longest prefix, in whole documents, of one
    more epoch whose order is md5 of seed, epoch and id, within its tokens.

    Ids, leaves, token counts and text hashes are checkpointed as one narrow table; texts move through no shuffle. The
    prefix sum is distributed: tokens add up by leaf and 256 buckets of the order hash (map-side), a window over a leaf's
    buckets finds the one at the border, and that one is split by the next digits, until it has at most EDGE rows, whatever
    the leaf's size. Only these are summed row by row. What is left is a cut-off key a leaf, and each document is
    compared with its leaf's. A leaf plan of at most BROADCAST_LEAVES rows, counted first, is broadcast; a larger one is shuffled.

    Null levels form a leaf of their own. Null or empty text has 0 tokens and is taken with a prefix that
    has any tokens; very long texts count like others. Equal ids tie by token count, then text hash; rows equal in all of these are taken
    together or not at all. Null ids order as the text 'null'. An empty table gives an empty result. Adds the level names, n_tokens and copies, overwriting equal names.
    """
    names, k = list(levels), "_mx_"
    keyed = docs.drop(*[c for c in ("n_tokens", "copies") if c in docs.columns])
    for c, e in levels.items():
        keyed = keyed.withColumn(c, e)
    own = [n_tokens(text_col).alias(k + "n"), F.xxhash64(text_col).alias(k + "h")]
    name_of = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    counted = cut(keyed.select(*names, name_of.alias(k + "id"), *own))
    leaves = cut(counted.groupBy(*names).agg(F.sum(k + "n").alias("t")))
    plan = cut(leaf_plan(leaves, names, weights, share, max_epochs))
    small = plan.count() <= BROADCAST_LEAVES

    def on_leaf(rows: DataFrame, side: DataFrame, how: str = "left") -> DataFrame:
        side = side.select(*[F.coalesce(F.col(c), F.lit("\x00")).alias(k + c) for c in names], *[c for c in side.columns if c not in names])
        side = F.broadcast(side) if small else side
        cond = [F.coalesce(rows[c], F.lit("\x00")) == side[k + c] for c in names]
        return rows.join(side, cond, how).drop(*[k + c for c in names])

    order_of = lambda name: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(k + "full").cast("string"), name))
    asked = plan.select(*names, F.col("full").alias(k + "full"), F.col("rest").alias(k + "rest"))
    rows = on_leaf(counted, asked.where(F.col(k + "rest") > 0), "inner").withColumn(k + "order", order_of(F.col(k + "id"))).drop(k + "id")
    edge, left = rows.withColumn(k + "start", F.lit(0).cast("long")), None
    for digits in range(DIGITS, 33, DIGITS):
        by = W.partitionBy(*names).orderBy(k + "bucket")
        sums = edge.groupBy(*names, k + "rest", k + "start", F.substring(k + "order", 1, digits).alias(k + "bucket")).agg(F.sum(k + "n").alias(k + "n"), F.count("*").alias(k + "rows"))
        over = sums.withColumn(k + "to", F.col(k + "start") + F.sum(k + "n").over(by)).where(F.col(k + "to") > F.col(k + "rest"))
        first = F.min(F.struct(F.col(k + "bucket"), (F.col(k + "to") - F.col(k + "n")).alias(k + "start"), F.col(k + "rows"))).alias(k + "b")
        border = cut(over.groupBy(*names).agg(first).select(*names, F.col(k + "b")[k + "bucket"].alias(k + "border"), F.col(k + "b")[k + "start"].alias(k + "start"), F.col(k + "b")[k + "rows"].alias(k + "rows")))
        edge = on_leaf(rows, border, "inner").where(F.col(k + "order").startswith(F.col(k + "border")))
        left = border.agg(F.max(k + "rows")).first()[0]
        if (left or 0) <= EDGE:
            break
    key = [k + "order", k + "n", k + "h"]
    taken = F.col(k + "start") + F.sum(k + "t").over(W.partitionBy(*names).orderBy(*key))
    last = (
        edge.groupBy(*names, k + "rest", k + "start", *key).agg(F.sum(k + "n").alias(k + "t")).withColumn(k + "taken", taken)
        .where(F.col(k + "taken") <= F.col(k + "rest")).groupBy(*names).agg(F.max(F.struct(*key)).alias(k + "last"))
    )
    decide = on_leaf(on_leaf(asked, border.select(*names, k + "border")), last)
    decided = on_leaf(keyed.withColumns({"n_tokens": n_tokens(text_col), k + "h": F.xxhash64(text_col)}), cut(decide)).withColumn(k + "order", order_of(name_of))
    here = F.struct(F.col(k + "order"), F.col("n_tokens").alias(k + "n"), F.col(k + "h"))
    extra = (F.col(k + "rest") > 0) & (F.col(k + "border").isNull() | (F.col(k + "order") < F.col(k + "border")) | F.coalesce(here <= F.col(k + "last"), F.lit(False)))
    copies = F.coalesce(F.col(k + "full"), F.lit(0)) + F.when(extra, 1).otherwise(0)
    return decided.select(*keyed.columns, "n_tokens", copies.cast("long").alias("copies"))


#: Fixed values of the registered query.
SHARE, EPOCHS, SEED = 0.8, 3, 11
WEIGHTS = {"domain": {"domain0": 3, "domain1": 2, "domain2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def production_levels() -> dict[str, Column]:
    """Domain (source number modulo 3), language and source of `documents`."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)"), F.lit(0))
    return {"domain": F.concat(F.lit("domain"), F.pmod(number, F.lit(3)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op4(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), production_levels(), WEIGHTS, SHARE, EPOCHS, SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _level_sql(parent: str, keys: str, name: str, source: str, weight: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    on = " AND ".join(f"c.{x} = p.{x}" for x in parent.split(", ")) if parent else "true"
    return f"""
{name}0 AS (SELECT c.*, p.alloc AS budget FROM (SELECT {keys}, sum(cap) AS cap, {weight} AS w FROM leaves GROUP BY {keys}) c JOIN {source} p ON {on}),
{name}1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM {name}0
    WINDOW q AS ({part} ORDER BY cap::DOUBLE / w, {keys})),
{name}2 AS (SELECT *, max(lvl) FILTER (lvl < cap::DOUBLE / w) OVER ({part}) AS top FROM {name}1),
{name} AS (SELECT {keys}, CASE WHEN top IS NULL THEN cap ELSE least(cap, floor(top * w)) END::BIGINT AS alloc FROM {name}2)"""


OP4_SQL = f"""
WITH d AS (SELECT doc_id, 'domain' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % 3) AS domain, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS t, (sum(n_tokens) * {EPOCHS})::BIGINT AS cap FROM d GROUP BY ALL),
root AS (SELECT floor(sum(t)::DOUBLE * {SHARE})::BIGINT AS alloc FROM leaves),
{_level_sql("", "domain", "a", "root", "CASE domain WHEN 'domain0' THEN 3 WHEN 'domain1' THEN 2 ELSE 1 END")},
{_level_sql("domain", "domain, lang", "b", "a", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END")},
{_level_sql("domain, lang", "domain, lang, source", "c", "b", "1")},
p AS (SELECT c.*, alloc // greatest(t, 1) AS whole, alloc % greatest(t, 1) AS rest FROM c JOIN leaves USING (domain, lang, source)),
o AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('{SEED}:' || whole || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS taken FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN rest > 0 AND taken <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o
"""
