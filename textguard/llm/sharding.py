"""Hierarchical weighted hash tree: region, rack and shard chosen by weighted hash draws.

At each level a key draws, for every child, ``-ln(u) / weight`` with u hashed from the key
and the child's name; the least draw wins (weighted rendezvous). A child is chosen in
proportion to its weight, and when weights change, keys move only into subtrees whose
weight grew or out of those whose weight shrank.

Defined results: a null text has size 1 and the checksum of no bytes; a null id is a
key of its own; repeated rows share a shard and get a slot each; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.common import materialize

#: Region -> rack -> {shard: weight}.
Tree = dict[str, dict[str, dict[int, float]]]
TREE_8: Tree = {
    "region0": {"rack0": {0: 1.0, 1: 1.0}, "rack1": {2: 1.0, 3: 1.0}},
    "region1": {"rack0": {4: 1.0, 5: 1.0}, "rack1": {6: 1.0, 7: 1.0}},
}
#: One more shard in a region of its own: no other subtree's weight changes, so rows move into it only.
TREE_9: Tree = TREE_8 | {"region2": {"rack0": {8: 1.0}}}
#: Hash buckets of a shard within which slots are counted one by one.
SLOT_BUCKETS = 1024
#: Hex digits of a hash that become a number, and the number of their values.
_DIGITS, _VALUES = 13, float(16**13)


def _uniform(key: Column, name: str) -> Column:
    """A number in (0, 1) from the hash of key and name."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(_VALUES)


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _choose(key: Column, node: dict, path: str) -> Column:
    """Shard below a node. Children without weight are never chosen."""
    children = [(name, child) for name, child in node.items() if _weight(child) > 0]
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    below = [F.lit(name) if not isinstance(child, dict) else _choose(key, child, f"{path}/{name}") for name, child in children]
    if len(children) == 1:
        return below[0]
    draws = [-F.log(_uniform(key, f"{path}/{name}")) / F.lit(_weight(child)) for name, child in children]
    least = F.least(*draws)
    chosen = F.when(draws[0] == least, below[0])
    for draw, shard in zip(draws[1:], below[1:], strict=True):
        chosen = chosen.when(draw == least, shard)
    return chosen


def shard_of(key: Column, tree: Tree) -> Column:
    """Integer shard of a string key."""
    return _choose(key, tree, "").cast("int")


def shard_documents(docs: DataFrame, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """Shard, slot and (after growth) next shard of every document.

    Slots are gapless: equal rows are counted first (map-side), then numbered in hash
    order within ``SLOT_BUCKETS`` buckets of each shard, and every bucket starts where the sum
    of those before it ends.
    """
    tree, grown = tree or TREE_8, grown or TREE_9
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(bytes_).cast("long") + 1).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    drawn = same.withColumn("place", F.conv(F.substring(F.md5(F.concat(key, F.lit("/slot"))), 1, _DIGITS), 16, 10).cast("long"))
    drawn = drawn.withColumns({"shard": shard_of(key, tree), "grown_shard": shard_of(key, grown), "bucket": F.expr(f"int(place div {16**_DIGITS // SLOT_BUCKETS})")})
    drawn = materialize(drawn, "drawn")  # a few numbers a row; the texts are read once
    by_bucket = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("inside", F.coalesce(F.sum("copies").over(by_bucket), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = drawn.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = numbered.join(totals, ["shard", "bucket"])
    first = (F.col("base") + F.col("inside")).alias("first")
    out = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_choose(node: dict, path: str) -> str:
    children = list(node.items())
    below = [str(name) if not isinstance(child, dict) else _sql_choose(child, f"{path}/{name}") for name, child in children]
    if len(children) == 1:
        return below[0]
    draws = [f"(-ln((('0x' || substr(md5(doc_id::VARCHAR || '/{path}/{name}'), 1, {_DIGITS}))::BIGINT::DOUBLE + 0.5) / {_VALUES:.1f}) / {_weight(child):.1f})" for name, child in children]
    return "CASE " + " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {b}" for d, b in zip(draws, below, strict=True)) + " END"


# crc32 byte by byte, with the table of the reflected polynomial built on the spot.
ORACLE = f"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
same AS MATERIALIZED (
  SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT text FROM documents), crc),
d AS (
  SELECT doc_id, coalesce(strlen(documents.text), 0)::BIGINT + 1 AS size, text_crc32,
         ('0x' || substr(md5(doc_id::VARCHAR || '/slot'), 1, {_DIGITS}))::BIGINT AS place,
         ({_sql_choose(TREE_8, "")})::INTEGER AS shard, ({_sql_choose(TREE_9, "")})::INTEGER AS grown_shard
  FROM documents JOIN same ON documents.text IS NOT DISTINCT FROM same.text)
SELECT doc_id, size, text_crc32, shard, grown_shard, 'key' AS law,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot
FROM d
"""
