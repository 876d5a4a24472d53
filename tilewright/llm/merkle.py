"""Merkle dataset manifest with proofs by coordinate lookup.

Every row is a leaf: the hash of its fields. The leaves of a group, in the
order of its ids, are folded run by run until one hash, the subroot, remains;
the subroots, in the order of their groups, are folded to the root. All nodes
are written as a table keyed by (group, level, index). A leaf's proof needs the
other members of its run on each level; which these are follows from its index
and the group's size alone, so leaves explode these coordinates, join the node
table, and order and concatenate what they find.

A node near the top is a sibling of half its group. So levels are taken in
layers of `depth`: the leaves look up the siblings below their block of
arity ** depth leaves only, the blocks (one row each) look up those of the next
layer, and so on; each row then joins the path of its block. No node is asked
for by more than arity ** depth rows, whatever the size of a group, and the
exploded rows are `depth` a leaf instead of the height of the tree. Leaves are
numbered by a sort over ranges, not by a window over a group.

Defined results: a null field is `-`, so it differs from an empty text; a null
group is a group of its own, the first one; null ids come first; rows that share
an id follow each other by their leaf, and equal rows have equal leaves; a lone
leaf is its group's subroot, a lone subroot the root. An empty table gives no
rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

ARITY, DEPTH = 2, 8
PROOF = "array<struct<level:int,left:string,right:string>>"


def field(c: Column) -> Column:
    """A value as `bytes:value`, or `-` for null: no two lists of fields concatenate to the same text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    """The leaf of a row: lowercase hex sha256 of its fields."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """`rows` (g, ...) with i, the number of a row within its g by `order`, and n, the rows of g.

    Rows are dealt out by ranges of (g, order, position), so a large group is many tasks' work; numbers
    within a range are shifted by the rows of the group in earlier ranges, of which there is one row a range.
    """
    keys = ["g", *order, "nr"]
    ranged = rows.withColumn("nr", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = scratch.save(ranged.drop("nr").withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    by_range = Window.partitionBy("g").orderBy("part")
    before = F.coalesce(F.sum("size").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("g", "part", "first", before.alias("before"), F.sum("size").over(Window.partitionBy("g")).alias("n"))
    out = placed.join(starts, ["g", "part"])
    return scratch.save(out.withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("at", "part", "first", "before"))


def power(base: int, exponent: Column) -> Column:
    return F.pow(F.lit(float(base)), exponent).cast("bigint")


def steps(n: Column, arity: int, depth: int) -> Column:
    """How many of the next `depth` levels lie below the top of a group that has n nodes on this one."""
    return sum((F.when(n > arity**k, 1).otherwise(0) for k in range(depth)), F.lit(0))


def up_to(last: Column) -> Column:
    """0, 1, ..., last; nothing where last is negative."""
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def runs_folded(level: Column, arity: int) -> Column:
    """The level above: the hash of every `arity` consecutive nodes, the last run as it is."""
    last = F.ceil(F.size(level) / F.lit(arity)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(F.array_join(F.slice(level, k * arity + 1, F.lit(arity)), ""), 256))


def layer(rows: DataFrame, first: int, arity: int, depth: int) -> DataFrame:
    """The nodes of `depth` levels over `rows` (g, i, n, h), the rows themselves included.

    Columns g, level, i, h, and top with n, the nodes of the next layer's lowest level, for those that form it.
    """
    width = arity**depth
    blocks = rows.groupBy("g", F.floor(F.col("i") / width).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("x"), F.max("n").alias("n"))
    own = F.transform("x", lambda r: r["h"])
    levels = F.aggregate(up_to(steps(F.col("n"), arity, depth) - 1), F.array(own), lambda all_, _: F.concat(all_, F.array(runs_folded(F.element_at(all_, -1), arity))))
    each = blocks.select("g", "b", "n", (F.size("x") >= 0).alias("_"), steps(F.col("n"), arity, depth).alias("steps"), F.posexplode(levels).alias("l", "hs"))
    nodes = each.select("g", "b", "l", "steps", "n", F.posexplode("hs").alias("k", "h"))
    top = F.col("l") == F.col("steps")
    i = F.col("b") * power(arity, depth - F.col("l")) + F.col("k")
    return nodes.select("g", (F.col("l") + first).alias("level"), F.when(top, F.col("b")).otherwise(i).alias("i"), "h", top.alias("top"), F.ceil(F.col("n") / width).cast("bigint").alias("n"))


def siblings(rows: DataFrame, nodes: DataFrame, first: int, arity: int, depth: int) -> DataFrame:
    """For `rows` (g, i, n): g, i and their proof within the layer `nodes`, from coordinates looked up in it."""

    def run(level: Column) -> Column:
        width = power(arity, level)
        own = F.floor(F.col("i") / width)
        start = F.floor(own / arity) * arity
        end = F.least(start + arity, F.ceil(F.col("n") / width)) - 1
        others = F.filter(F.sequence(start, end), lambda at: at != own)
        # a lone member still makes a step: one row without a sibling
        others = F.when(F.size(others) == 0, F.array(F.lit(None).cast("bigint"))).otherwise(others)
        return F.transform(others, lambda at: F.struct(level.alias("l"), at.alias("at"), (at < own).alias("left")))

    coordinates = rows.select("g", F.col("i").alias("own"), F.explode(F.flatten(F.transform(up_to(steps(F.col("n"), arity, depth) - 1), run))).alias("c"))
    coordinates = coordinates.select("g", "own", (F.col("c.l") + first).alias("level"), F.col("c.at").alias("i"), F.col("c.left").alias("left"))
    found = coordinates.join(nodes.where(~F.col("top")).select("g", "level", "i", "h"), ["g", "level", "i"], "left")
    gathered = found.groupBy("g", F.col("own").alias("i")).agg(F.sort_array(F.collect_list(F.struct("level", F.col("i").alias("at"), "left", "h"))).alias("x"))

    def side(level: Column, left: bool) -> Column:
        return F.array_join(F.transform(F.filter("x", lambda s: (s["level"] == level) & (s["left"] if left else ~s["left"])), lambda s: s["h"]), "")

    levels = F.array_distinct(F.transform("x", lambda s: s["level"]))
    return gathered.select("g", "i", F.transform(levels, lambda v: F.struct(v.alias("level"), side(v, True).alias("left"), side(v, False).alias("right"))).alias("own"))


def climb(rows: DataFrame, scratch: Scratch, arity: int, depth: int) -> tuple[list[tuple[DataFrame, DataFrame, int]], DataFrame]:
    """All nodes over `rows` (g, i, n, h), layer by layer, and the tops: g, h, levels."""
    most = rows.agg(F.max("n")).first()[0] or 0
    out, first = [], 0
    levels = F.lit(0)
    for k in range(64):  # levels that a group of n has: as many as powers of the arity are less than n
        if arity**k < most:
            levels = levels + F.when(F.col("n") > arity**k, 1).otherwise(0)
    heights = rows.where(F.col("i") == 0).select("g", levels.alias("height"))
    rows = rows.select("g", "i", "n", "h")
    while most > 1:
        nodes = scratch.save(layer(rows, first, arity, depth))
        out.append((rows, nodes, first))
        rows = nodes.where("top").select("g", "i", "n", "h")
        most = -(-most // arity**depth)
        first += depth
    return out, rows.select("g", "h").join(heights, "g")


def descend(layers: list[tuple[DataFrame, DataFrame, int]], tops: DataFrame, arity: int, depth: int, *kept: str) -> DataFrame:
    """The proofs of the lowest rows: g, i, proof and the columns `kept` of `tops` (g, proof, ...)."""
    above = tops.select("g", F.lit(0).cast("bigint").alias("i"), "proof", *kept)
    for rows, nodes, first in reversed(layers):
        own = rows.select("g", "i").join(siblings(rows, nodes, first, arity, depth), ["g", "i"], "left")
        own = own.withColumn("b", F.floor(F.col("i") / arity**depth))
        joined = own.join(above.withColumnRenamed("i", "b"), ["g", "b"])
        proof = F.concat(F.coalesce("own", F.array().cast(PROOF)), "proof")
        above = joined.select("g", "i", proof.alias("proof"), *kept)
    return above


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def siblings_text(proof: Column) -> Column:
    """All hashes of a proof, level by level, left to right within each."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, *, fields: list[str], group: str, order: list[str], carry: dict[str, Column] | None = None, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """One row a row of `docs`: the columns `order` and `group`, those of `carry`, index, group_size, leaf, subroot, root and proof.

    proof holds a step a level, from the leaf through the subroot to the root: the hashes left and right of the node,
    concatenated. `fold` of leaf and proof gives the root.
    """
    if arity < 2 or depth < 1:
        raise ValueError("a run has at least two members, a layer at least one level")
    scratch = Scratch(docs.sparkSession, "merkle")
    carry = carry or {}
    keys, extra = [f"k{i}" for i in range(len(order))], [f"c{i}" for i in range(len(carry))]
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(
        g.alias("g"), F.col(group).alias("v"), *(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), *(c.alias(k) for c, k in zip(carry.values(), extra, strict=True)),
        digest([F.col(f) for f in fields]).alias("h"),
    )
    leaves = numbered(rows, [*keys, "h"], scratch)
    layers, tops = climb(leaves, scratch, arity, depth)
    # the subroots are the leaves of a second tree, of one group
    tops = scratch.save(tops)
    upper = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "h", "height"), ["of"], scratch)
    upper_layers, root = climb(upper, scratch, arity, depth)
    paths = descend(upper_layers, root.select("g", F.array().cast(PROOF).alias("proof"), F.col("h").alias("root")), arity, depth, "root")
    ends = upper.join(paths, ["g", "i"])
    raised = F.transform("proof", lambda s: F.struct((s["level"] + F.col("height")).cast("int").alias("level"), s["left"].alias("left"), s["right"].alias("right")))
    ends = scratch.save(ends.select(F.col("of").alias("g"), raised.alias("proof"), F.col("h").alias("subroot"), "root"))
    proofs = descend(layers, ends, arity, depth, "subroot", "root")
    out = leaves.join(proofs, ["g", "i"])
    named = [F.col(k).alias(c) for c, k in [*zip(order, keys, strict=True), *zip(carry, extra, strict=True)]]
    own = [] if group in order else [F.col("v").alias(group)]
    return out.select(*named, *own, F.col("i").alias("index"), F.col("n").alias("group_size"), F.col("h").alias("leaf"), "subroot", "root", "proof")
