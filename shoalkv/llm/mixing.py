"""Operator 9: mixing sources to target weights, in DataFrame functions only.

Sources form a tree (domain, language, source by default). Integer weights stand at its
nodes; a level's budget is dealt to the children of a node in proportion to their
weights. A child that holds fewer tokens (times the epochs allowed) than its share gets
all it has, and its siblings share the rest; only what a whole family can't supply
goes to the ancestor's other children. Since each node's capacity is known before its
budget is set, one pass from the top does this; a family is solved in closed form by
a window over its children ordered by capacity per weight (integers throughout).

A leaf's budget is spent in epochs: whole passes over its rows, then the longest prefix of
the next epoch's seeded order (md5 of seed, epoch and id) whose tokens fit. The prefix isn't found
by sorting a leaf, which may hold a third of all rows: rows are dealt to ranges of the hash,
the ranges' sums tell in which one the prefix ends, and only that range is ordered. The ranges are summed by blocks first,
so that no window runs over all ranges of a leaf. What then selects a row is its leaf's threshold, a map-side comparison.

Defined cases: a null id counts as the empty text in the order; null levels are named
``unknown``; null text has no tokens and goes with whole epochs, or with the prefix that covers
its place; rows with one id stand or fall together; weights of 0 select nothing; very long texts are counted like others; an empty table gives no
rows; further columns, whatever their names, are passed over by ``select`` and kept by ``selected``; a level with the name of one of the plan's own columns raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, written

#: Expected rows of a leaf in one range of the hash.
RANGE_ROWS = 20_000
#: Ranges of a leaf in one block: a leaf's blocks, and then one block's ranges, are what a window holds.
BLOCK = 4096
#: A plan of at most so many leaves is broadcast (some 100 bytes each); a larger one is joined.
BROADCAST_LEAVES = 20_000

#: Names that the plan's own columns have; a level can't be called so.
RESERVED = frozenset({"doc_id", "n_tokens", "tokens", "n_rows", "capacity", "weight", "budget", "held", "left", "full", "spent", "shares", "own", "target", "passes", "rest", "ranges", "range", "order", "end", "block", "upto", "before", "sum", "at", "epoch", "epochs", "row"})


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


@dataclass
class Mix:
    """``levels``: column expressions from the root down; ``weights``: by path, such as ("web", "en"); a path that isn't
    named weighs ``default``. ``budget``: tokens, or None for ``percent`` of all there are."""

    levels: dict[str, Column]
    weights: dict[tuple[str, ...], int] = field(default_factory=dict)
    default: int = 1
    percent: int = 60
    budget: int | None = None
    epochs: int = 4
    seed: int = 17


def _weight(mix: Mix, names: list[str]) -> Column:
    own = {p: w for p, w in mix.weights.items() if len(p) == len(names)}
    if any(w < 0 or w != int(w) for w in own.values()):
        raise ValueError("weights are whole numbers from 0")
    if not own:
        return F.lit(mix.default).cast("long")
    table = F.create_map(*[x for p, w in own.items() for x in (F.lit("\x1f".join(p)), F.lit(int(w)))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", *names)), F.lit(mix.default)).cast("long")


def _dealt(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` has budget (the parent's), capacity and weight; the result has their own budget."""
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy(F.col("capacity") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = children.where("weight > 0 and capacity > 0")
    ahead = live.select(
        "*",
        (F.sum("capacity").over(order) - F.col("capacity")).alias("held"),
        (F.sum("weight").over(of) - F.sum("weight").over(order) + F.col("weight")).alias("left"),
    )
    full = ahead.withColumn("full", F.col("capacity") * F.col("left") <= (F.col("budget") - F.col("held")) * F.col("weight"))
    rest = full.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(of), F.lit(0)).alias("spent"),
        F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(of), F.lit(1)).alias("shares"),
    )
    share = F.expr("(budget - spent) * weight div shares")
    return rest.select(*children.columns, F.when(F.col("full"), F.col("capacity")).otherwise(share).alias("own"))


def allocate(supply: DataFrame, mix: Mix) -> DataFrame:
    """``supply``: a row for each leaf with its levels, ``tokens`` and ``n_rows``. Adds ``target`` (tokens)."""
    names = list(mix.levels)
    if taken := RESERVED & set(map(str.lower, names)):
        raise ValueError(f"levels can't be named {', '.join(sorted(taken))}")
    leaves = supply.withColumn("capacity", F.col("tokens") * mix.epochs)
    dealt: DataFrame | None = None
    for depth in range(1, len(names) + 1):
        path, parent = names[:depth], names[: depth - 1]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if dealt is not None:
            nodes = nodes.join(dealt.select(*parent, F.col("own").alias("budget")), parent)
        elif mix.budget is not None:
            nodes = nodes.withColumn("budget", F.lit(mix.budget).cast("long"))
        else:
            nodes = nodes.withColumn("budget", F.expr(f"sum(tokens) over () * {int(mix.percent)} div 100"))
        nodes = nodes.drop("tokens").withColumn("weight", _weight(mix, path))
        dealt = _dealt(nodes, parent, path[-1])
    return supply.join(dealt.select(*names, F.col("own").alias("target")), names)


def _leveled(df: DataFrame, mix: Mix, text: str, key: str) -> DataFrame:
    levels = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in mix.levels.items()]
    return df.select(df[f"`{key}`"].cast("long").alias("doc_id"), *levels, n_words(df[f"`{text}`"]).alias("n_tokens"))


def _order(mix: Mix, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("passes").cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _range(order: Column) -> Column:
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).cast("long")


def _joined(rows: DataFrame, plan: DataFrame, names: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(plan) if small else plan, names)


def _reached(sums: DataFrame, names: list[str], place: str) -> DataFrame:
    """``sums``: tokens by leaf and place, ``rest``, and ``before`` (the tokens ahead of these places). Per leaf, as ``at``: the first
    place with which the running sum passes ``rest``, and the tokens ahead of it."""
    upto = Window.partitionBy(*names).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = sums.withColumn("sum", F.col("before") + F.sum("tokens").over(upto)).where("sum > rest")
    return passed.groupBy(*names).agg(F.min_by(F.struct(place, (F.col("sum") - F.col("tokens")).alias("before")), place).alias("at"))


def plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """Per leaf: ``passes`` (whole epochs), ``ranges``, ``end`` and ``upto``: the range and the key in it with which the last
    prefix ends. Second: whether it may be broadcast."""
    names = list(mix.levels)
    supply = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    leaf = allocate(supply, mix).where("tokens > 0").select(
        *names,
        F.expr("target div tokens").alias("passes"),
        F.expr("target % tokens").alias("rest"),
        F.ceil(F.col("n_rows") / RANGE_ROWS).cast("long").alias("ranges"),
    )
    leaf = written(leaf, "leaves")
    small = leaf.count() <= BROADCAST_LEAVES
    placed = _joined(rows, leaf, names, small).withColumn("order", _order(mix, F.col("doc_id"))).withColumn("range", _range(F.col("order")))
    sums = written(placed.groupBy(*names, "rest", "range").agg(F.sum("n_tokens").alias("tokens")).withColumn("block", F.expr(f"range div {BLOCK}")), "sums")
    blocks = sums.groupBy(*names, "rest", "block").agg(F.sum("tokens").alias("tokens")).withColumn("before", F.lit(0).cast("long"))
    block = _reached(blocks, names, "block").select(*names, F.col("at.block").alias("block"), F.col("at.before").alias("before"))
    ended = _reached(sums.join(block, [*names, "block"]), names, "range")
    leaf = written(leaf.join(ended, names).select(*leaf.columns, F.col("at.range").alias("end"), F.col("at.before").alias("before")), "ends")
    last = _joined(rows, leaf, names, small).withColumn("order", _order(mix, F.col("doc_id"))).withColumn("range", _range(F.col("order"))).where("range = end")
    within = Window.partitionBy(*names).orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = last.withColumn("sum", F.col("before") + F.sum("n_tokens").over(within)).where("sum <= rest").groupBy(*names).agg(F.max("order").alias("upto"))
    return written(leaf.join(fits, names, "left").select(*names, "passes", "ranges", "end", F.coalesce("upto", F.lit("")).alias("upto")), "plan"), small


def _epochs(mix: Mix) -> Column:
    order = _order(mix, F.col("doc_id"))
    inside = (_range(order) < F.col("end")) | ((_range(order) == F.col("end")) & (order <= F.col("upto")))
    return F.col("passes") + F.when(inside, 1).otherwise(0)


def select(df: DataFrame, mix: Mix, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each row of ``df`` and epoch in which it is taken: doc_id, the levels, n_tokens, epoch."""
    names = list(mix.levels)
    rows = written(_leveled(df, mix, text, key), "leveled")
    chosen, small = plan(rows, mix)
    taken = _joined(rows, chosen, names, small).withColumn("epochs", _epochs(mix)).where("epochs > 0")
    return taken.select("doc_id", *names, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))


def selected(df: DataFrame, mix: Mix, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df``, with all their columns, once for each epoch in which they are taken."""
    names = list(mix.levels)
    rows = written(_leveled(df, mix, text, key), "leveled")
    chosen, small = plan(rows, mix)
    levels = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in mix.levels.items()]
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df[f"`{key}`"].cast("long").alias("doc_id"), *levels)
    taken = _joined(packed, chosen, names, small).withColumn("epochs", _epochs(mix)).where("epochs > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).alias("epoch"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def documents_mix(**more) -> Mix:
    """The mix of the table ``documents``: a source's domain is its number modulo three."""
    number = F.coalesce(F.nullif(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("")), F.lit("0")).cast("long")
    levels = {"domain": F.concat(F.lit("domain"), (number % 3).cast("string")), "lang": F.col("lang"), "source": F.col("source")}
    domains = {("domain0",): 5, ("domain1",): 3, ("domain2",): 2}
    langs = {(d, x): w for d in ("domain0", "domain1", "domain2") for x, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 2))}
    return Mix(levels=levels, weights=domains | langs, **more)


def mix_sql(percent: int = 60, epochs: int = 4) -> str:
    """The result of ``documents_mix`` in SQL: the same budgets, and each leaf ordered whole."""
    return _MIX_SQL.replace("sum(n_tokens) * 4 AS", f"sum(n_tokens) * {int(epochs)} AS").replace("* 60 // 100", f"* {int(percent)} // 100")


_MIX_SQL = r"""
WITH w AS (
  SELECT * FROM (VALUES ('domain0', 5), ('domain1', 3), ('domain2', 2)) t(domain, weight)
), v AS (
  SELECT * FROM (VALUES ('en', 4), ('de', 2), ('fr', 2), ('es', 2)) t(lang, weight)
), r AS (
  SELECT doc_id,
         'domain' || CAST(CAST(coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), ''), '0') AS BIGINT) % 3 AS VARCHAR) AS domain,
         coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
), s AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 4 AS BIGINT) AS capacity FROM r GROUP BY ALL
), a0 AS (
  SELECT n.domain, n.capacity, coalesce(w.weight, 1) AS weight, (SELECT CAST(sum(tokens) * 60 // 100 AS BIGINT) FROM s) AS budget
  FROM (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity FROM s GROUP BY ALL) n LEFT JOIN w USING (domain) WHERE n.capacity > 0
), b0 AS (
  SELECT *, capacity * (sum(weight) OVER () - sum(weight) OVER o + weight) <= (budget - (sum(capacity) OVER o - capacity)) * weight AS is_full
  FROM a0 WINDOW o AS (ORDER BY capacity / weight, domain ROWS UNBOUNDED PRECEDING)
), c0 AS (
  SELECT domain, CASE WHEN is_full THEN capacity ELSE
    (budget - coalesce(sum(capacity) FILTER (is_full) OVER (), 0)) * weight // coalesce(sum(weight) FILTER (NOT is_full) OVER (), 1) END AS own FROM b0
), a1 AS (
  SELECT n.domain, n.lang, n.capacity, coalesce(v.weight, 1) AS weight, c0.own AS budget
  FROM (SELECT domain, lang, CAST(sum(capacity) AS BIGINT) AS capacity FROM s GROUP BY ALL) n JOIN c0 USING (domain) LEFT JOIN v USING (lang) WHERE n.capacity > 0
), b1 AS (
  SELECT *, capacity * (sum(weight) OVER p - sum(weight) OVER o + weight) <= (budget - (sum(capacity) OVER o - capacity)) * weight AS is_full
  FROM a1 WINDOW p AS (PARTITION BY domain), o AS (PARTITION BY domain ORDER BY capacity / weight, lang ROWS UNBOUNDED PRECEDING)
), c1 AS (
  SELECT domain, lang, CASE WHEN is_full THEN capacity ELSE
    (budget - coalesce(sum(capacity) FILTER (is_full) OVER p, 0)) * weight // coalesce(sum(weight) FILTER (NOT is_full) OVER p, 1) END AS own
  FROM b1 WINDOW p AS (PARTITION BY domain)
), a2 AS (
  SELECT n.*, 1 AS weight, c1.own AS budget FROM s n JOIN c1 USING (domain, lang) WHERE n.capacity > 0
), b2 AS (
  SELECT *, capacity * (sum(weight) OVER p - sum(weight) OVER o + weight) <= (budget - (sum(capacity) OVER o - capacity)) * weight AS is_full
  FROM a2 WINDOW p AS (PARTITION BY domain, lang), o AS (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS UNBOUNDED PRECEDING)
), c2 AS (
  SELECT domain, lang, source, tokens, CAST(CASE WHEN is_full THEN capacity ELSE
    (budget - coalesce(sum(capacity) FILTER (is_full) OVER p, 0)) * weight // coalesce(sum(weight) FILTER (NOT is_full) OVER p, 1) END AS BIGINT) AS own
  FROM b2 WINDOW p AS (PARTITION BY domain, lang)
), m AS (
  SELECT r.*, own // tokens AS passes, own % tokens AS rest,
         md5('17:' || CAST(own // tokens AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM r JOIN c2 USING (domain, lang, source)
), e AS (
  SELECT *, passes + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS epochs FROM m
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(CAST(epochs AS BIGINT))) AS epoch FROM e WHERE epochs > 0
"""

MIX_SQL = mix_sql()
