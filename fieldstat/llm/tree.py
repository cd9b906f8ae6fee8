"""Sharding by a hierarchical weighted hash tree: region, rack and shard are drawn by weight, one level after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_whole

#: region -> rack -> shard number -> weight.
Tree = dict[str, dict[str, dict[int, int]]]
LEVELS = ("region", "rack", "shard")
#: Two regions of two racks of two shards, all of one weight.
BASE: Tree = {"r0": {"k0": {0: 1, 1: 1}, "k1": {2: 1, 3: 1}}, "r1": {"k0": {4: 1, 5: 1}, "k1": {6: 1, 7: 1}}}
#: Hexadecimal digits of the hash that a draw is made of (52 bits).
DIGITS = 13
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def grown(tree: Tree, weight: int = 1) -> Tree:
    """``tree`` with one more shard, in a region of its own.

    No weight below any older region changes, so rows move into the new shard and nowhere else. A shard put
    into an older rack instead would also let rows drawn anew into that region and rack settle on their older shards.
    """
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    name = next(n for n in (f"r{i}" for i in range(len(tree), 2 * len(tree) + 2)) if n not in tree)
    return tree | {name: {"k0": {shard: weight}}}


def tree_of(shards: int) -> Tree:
    """The tree of ``shards`` shards, 8 at least: BASE, and each further one in a region of its own."""
    if shards < 8:
        raise ValueError("8 shards at least")
    tree = BASE
    for _ in range(shards - 8):
        tree = grown(tree)
    return tree


def _children(tree: Tree) -> dict[str, list[tuple[str, float]]]:
    """Path of each inner node -> its children and their weights (of all shards below); what weighs nothing is left out."""
    out: dict[str, list[tuple[str, float]]] = {"": []}
    numbers: list[int] = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            if any(w < 0 for w in shards.values()):
                raise ValueError("weights must not be negative")
            leaves = [(str(s), float(w)) for s, w in shards.items() if w]
            numbers += shards
            if leaves:
                out[f"/{region}/{rack}"] = leaves
                inner.append((rack, sum(w for _, w in leaves)))
        if inner:
            out[f"/{region}"] = inner
            out[""].append((region, sum(w for _, w in inner)))
    if not out[""] or len(set(numbers)) < len(numbers):
        raise ValueError("a tree has a shard of positive weight, and no shard number twice")
    return out


def drawn(key: Column, tree: Tree) -> Column:
    """struct(region, rack, shard) of a text key.

    At each node every child draws ``-ln(u) / weight``, u in (0, 1) from the md5 of the child's path and the key; the least
    wins, which gives each child its share of the weights. A draw depends on that child alone: where a weight grows, rows
    only move into that child, where it shrinks only out of it, and nothing below other children is drawn anew.
    """
    kind = "array<struct<name:string,weight:double>>"
    nodes = F.create_map(*[x for path, own in _children(tree).items() for x in (F.lit(path), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in own]).cast(kind))])

    def down(path: Column) -> Column:
        def draw(child: Column) -> Column:
            bits = F.conv(F.substring(F.md5(F.concat(path, F.lit("/"), child["name"], F.lit(":"), key)), 1, DIGITS), 16, 10).cast("double")
            return F.struct((-F.log((bits + 0.5) / F.lit(16.0**DIGITS)) / child["weight"]).alias("d"), child["name"].alias("name"))

        return F.concat(path, F.lit("/"), F.array_min(F.transform(nodes[path], draw))["name"])

    path = F.lit("")
    for _ in LEVELS:
        path = down(path)
    steps = F.split(path, "/")
    return F.struct(steps[1].alias("region"), steps[2].alias("rack"), steps[3].cast("int").alias("shard"))


def key_of(doc_id: Column) -> Column:
    """The id as text; null ids share the empty key."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def with_slots(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (narrow, with a column shard) and ``slot``: the place in its shard, gapless from 0, in the order of the columns ``order``.

    Rows are dealt over ranges of (shard, order) and numbered behind the counts of earlier ranges: a shard may fill any number
    of tasks. Rows that are equal in all of these columns are dealt by their place in the input, so that one id with a third of all rows is
    cut as well; where ``order`` names all that tells rows apart, the result depends on the rows alone.
    """
    names = list(rows.columns)
    rows = kept_whole(rows).withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("shard", *order, "_tie").sortWithinPartitions("shard", *order, "_tie").drop("_tie")
    rows = kept_whole(rows).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.withColumn("_part", F.shiftright("_at", ROW_BITS))
    parts = rows.groupBy("shard", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("shard", "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    # ranges are cut in order, so there are at most as many rows as partitions and shards together
    out = rows.join(F.broadcast(parts), ["shard", "_part"])
    return out.select(*names, (F.col("_at") + F.col("_shift")).alias("slot"))


def shard_rows(docs: DataFrame, tree: Tree = BASE) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) of every row of ``docs`` (doc_id bigint, text string).

    size: UTF-8 bytes of the text and 1; a null or empty text has 1, and crc32 0. The law is ``key``: doc_id and the tree decide, so rows
    that repeat a doc_id share a shard, as do all null ids, and equal texts of different ids need not. grown_shard: the shard once ``tree``
    has one more. Slots go by doc_id (null first), then crc32 and size; rows equal in all of these are repeated
    rows and take slots next to each other. Extra columns are not read; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit(""))
    key = key_of(F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        drawn(key, tree).alias("at"), drawn(key, grown(tree))["shard"].alias("grown_shard"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", "law", "at.*", "grown_shard")
    out = with_slots(rows, "doc_id", "text_crc32", "size")
    return out.select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, folder: str, tree: Tree = BASE, files: int = 1) -> None:
    """Whole rows of doc_id and text as Parquet, in folders region=/rack=/shard=, up to ``files`` files a shard.

    Rows of a shard are dealt over its files by the hash of id and text. Null ids and texts stay null; an
    empty table writes no shard.
    """
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", drawn(key_of(F.col("doc_id")), tree).alias("at")).select("doc_id", "text", "at.*")
    if files > 1:
        placed = placed.repartition("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(files)))
    else:
        placed = placed.repartition("shard")
    placed.write.partitionBy(*LEVELS).parquet(folder)
