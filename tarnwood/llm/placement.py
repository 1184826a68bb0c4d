"""Sharding by a hierarchical weighted hash tree.

A key descends from regions to racks to shards. At each node it draws a number
for every child, an exponential variate whose rate is the child's weight, and
goes to the least: child c gets the share weight(c) / sum of weights, and when
one weight changes, only keys that go to or leave that child move. Draws depend
on the key and the child's path alone, so what moves stays inside the subtrees
whose weights change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight. A node's weight is the sum of its children's.
Tree = dict[str, dict[str, dict[str, float]]]

DEFAULT: Tree = {
    "r0": {"k0": {"s0": 4, "s1": 4, "s2": 2}, "k1": {"s0": 4, "s1": 4}, "k2": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}},
    "r1": {"k0": {"s0": 3, "s1": 3, "s2": 3}, "k1": {"s0": 6, "s1": 2}},
    "r2": {"k0": {"s0": 5, "s1": 5}, "k1": {"s0": 2, "s1": 2, "s2": 2, "s3": 2}, "k2": {"s0": 8}},
}


def weight(node) -> float:
    return float(sum(map(weight, node.values()))) if isinstance(node, dict) else float(node)


def draw(key: Column, path: str, w: float) -> Column:
    """-ln(u) / w, u in (0, 1) from 52 bits of the MD5 of the key and the node's path."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + path))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return -F.log(u) / F.lit(w)


def choose(key: Column, children: dict, prefix: str) -> Column:
    """The child with the least draw; equal draws go to the lesser name. Children of no weight are never chosen."""
    live = {c: weight(x) for c, x in children.items() if weight(x) > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*[F.struct(draw(key, prefix + c, w).alias("d"), F.lit(c).alias("c")) for c, w in live.items()]))["c"]


def place(df: DataFrame, tree: Tree = DEFAULT, key: str = "doc_id") -> DataFrame:
    """(key, region, rack, shard) for every row.

    The key is taken as a string of any length, null as ''; equal keys, repeated
    rows included, go to one shard, and equal draws to the lesser name. A key
    column named as one of the results is given as ``key``. Other columns, whatever their names, are not
    read; an empty table gives no rows. A tree in which nothing has weight, or a
    negative weight, is an error. No shuffle takes place.
    """
    leaves = [w for racks in tree.values() for shards in racks.values() for w in shards.values()]
    if not any(w > 0 for w in leaves) or any(w < 0 for w in leaves):
        raise ValueError("weights must not be negative, and one must be positive")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    live = {r: {c: s for c, s in racks.items() if weight(s) > 0} for r, racks in tree.items() if weight(racks) > 0}
    name = "key" if key in ("region", "rack", "shard") else key
    out = df.select(F.col(key).alias(name), k.alias("__key"), choose(k, live, "").alias("region"))
    k = F.col("__key")
    rack = F.lit(None).cast("string")
    for r, racks in live.items():
        rack = F.when(F.col("region") == r, choose(k, racks, f"{r}/")).otherwise(rack)
    out = out.withColumn("rack", rack)
    shard = F.lit(None).cast("string")
    for r, racks in live.items():
        for c, shards in racks.items():
            shard = F.when((F.col("region") == r) & (F.col("rack") == c), choose(k, shards, f"{r}/{c}/")).otherwise(shard)
    return out.withColumn("shard", shard).drop("__key")


def moved(df: DataFrame, before: Tree, after: Tree, key: str = "doc_id") -> DataFrame:
    """The keys whose shard differs between two trees, with both places."""
    a, b = place(df, before, key), place(df, after, key)
    old = a.select(F.col(key), F.concat_ws("/", "region", "rack", "shard").alias("from_shard")).distinct()
    new = b.select(F.col(key).alias("__k"), F.concat_ws("/", "region", "rack", "shard").alias("to_shard")).distinct()
    return old.join(new, F.col(key).eqNullSafe(F.col("__k"))).where("from_shard <> to_shard").drop("__k")


def place_sql(tree: Tree = DEFAULT, table: str = "documents", key: str = "doc_id") -> str:
    """The same in DuckDB's SQL."""
    rows = {1: [], 2: [], 3: []}
    for r, racks in tree.items():
        rows[1].append((r, r, weight(racks)))
        for c, shards in racks.items():
            rows[2].append((r, c, weight(shards)))
            rows[3] += [(f"{r}/{c}", s, float(w)) for s, w in shards.items()]
    values = {n: ", ".join(f"('{a}', '{b}', {w!r})" for a, b, w in x if w > 0) for n, x in rows.items()}
    u = "(('0x' || substr(md5(k || '/' || {path}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    pick = "row_number() over (partition by k order by -ln({u}) / w, c) = 1"
    return f"""
with t1(p, c, w) as (values {values[1]}), t2(p, c, w) as (values {values[2]}), t3(p, c, w) as (values {values[3]}),
keys as (select distinct coalesce({key}::varchar, '') as k from {table}),
a as (select k, c as region from keys, t1 qualify {pick.format(u=u.format(path="c"))}),
b as (select k, region, c as rack from a join t2 on t2.p = region qualify {pick.format(u=u.format(path="region || '/' || c"))}),
d as (select k, region, rack, c as shard from b join t3 on t3.p = region || '/' || rack qualify {pick.format(u=u.format(path="region || '/' || rack || '/' || c"))})
select {key}, region, rack, shard from {table} join d on k = coalesce({key}::varchar, '')"""
