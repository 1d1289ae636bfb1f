"""Operator 5 - sharding by a hierarchical weighted hash tree.

Each row descends region, rack and shard.  At a node every child draws ``-ln(u) / weight`` from a hash of
the row's key and the child's name, and the least draw wins, so a child gets rows in proportion to its
weight and a changed weight moves rows only between children of that node (and below it).

Cases: a null key is placed under the key ``null``; equal keys (ties) always go to the same shard; texts, of any length, are not read; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import shield

#: region -> (weight, {rack: (weight, {shard: weight})})
Tree = dict[str, tuple[float, dict[str, tuple[float, dict[str, float]]]]]


def tree(regions: dict[str, dict[str, int]]) -> Tree:
    """A tree from {region: {rack: number of shards}}; the weight of a node is its number of shards."""
    return {r: (float(sum(racks.values())), {f"{r}/{k}": (float(n), {f"{r}/{k}/s{i}": 1.0 for i in range(n)}) for k, n in racks.items()}) for r, racks in regions.items()}


PRODUCTION = tree({"east": {"k0": 8, "k1": 8, "k2": 4}, "west": {"k0": 8, "k1": 4}, "north": {"k0": 4, "k1": 4, "k2": 2}})


def edges(at: Tree) -> list[tuple[str, str, float]]:
    """(parent, child, weight) of every node; the root is ''."""
    out = []
    for region, (weight, racks) in at.items():
        out.append(("", region, weight))
        for rack, (rack_weight, shards) in racks.items():
            out.append((region, rack, rack_weight))
            out += [(rack, s, w) for s, w in shards.items()]
    if any(w <= 0 for _, _, w in out):
        raise ValueError("weights must be positive")
    return out


def _least(children: Column, key: Column) -> Column:
    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["n"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / child["w"]).alias("d"), child["n"].alias("n"))

    return F.array_min(F.transform(children, draw))["n"]


def shard(docs: DataFrame, at: Tree = PRODUCTION) -> DataFrame:
    """One row (doc_id, region, rack, shard) for each row; no shuffle, only doc_id is read."""
    kids: dict[str, list[tuple[str, float]]] = {}
    for parent, child, weight in edges(at):
        kids.setdefault(parent, []).append((child, weight))
    listed = {p: F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in c]) for p, c in kids.items()}
    below = F.create_map(*[x for p, c in listed.items() for x in (F.lit(p), c)])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = shield(docs).picked().select("doc_id")
    rows = rows.withColumn("region", _least(listed[""], key))
    rows = rows.withColumn("rack", _least(below[F.col("region")], key))
    return rows.withColumn("shard", _least(below[F.col("rack")], key))


def shard_sql(at: Tree = PRODUCTION) -> str:
    values = ", ".join(f"('{p}', '{c}', {w}::DOUBLE)" for p, c, w in edges(at))

    def level(n: int, parent: str, source: str) -> str:
        draw = "-ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || '|' || t.child), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / t.weight"
        return f"l{n} AS (SELECT d.*, t.child AS c{n} FROM {source} d JOIN tree t ON t.parent = {parent} QUALIFY row_number() OVER (PARTITION BY d.rid ORDER BY {draw}, t.child) = 1)"

    return f"""WITH tree(parent, child, weight) AS (VALUES {values}),
    l0 AS (SELECT doc_id, row_number() OVER () AS rid FROM documents),
    {level(1, "''", "l0")}, {level(2, "d.c1", "l1")}, {level(3, "d.c2", "l2")}
    SELECT doc_id, c1 AS region, c2 AS rack, c3 AS shard FROM l3"""
