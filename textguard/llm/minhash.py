"""MinHash near-dedup with tensored banding.

Two small collections of sub-keys are made from few minhashes; a table key combines one
sub-key of each collection. ``m`` sub-keys a side give ``m * m`` tables for ``2 * m`` sub-keys'
minhashes. Candidates are verified on full shingle sets.

Links are found without meeting all pairs of a group:

1. equal shingle sets form a class with a number of its own, and one text of it goes on;
2. classes that share a table key are candidates; their full sets are written;
3. a shingle that no other candidate has can be in no intersection, so the number of
   shared shingles bounds every likeness of a class, and most false candidates go here;
4. in each table the member with the greatest shared part is the hub; each class is
   compared with one hub, and components are formed;
5. in tables that still hold several groups, new hubs are drawn, and each class of another
   group meets the one it shares the most tables with: one pair a class, so that a large group
   grows together before pairs across groups are looked at;
6. across components that still share a table, all pairs that may link are verified. Of two classes
   of one hub, each differs from the hub's set in some shingles, its delta. A link bounds how far
   two sets are apart, and so how much their deltas must share: they meet only on one of the rarest
   shingles of their deltas (a prefix filter), or if both deltas are so small that they need share none.

With ``exact`` the keys are no hashes of minhashes but the rarest shingles of each class, as many
as two sets at the threshold must share one of: no link is missed, at the price of more candidates.

Defined results: texts without words (null, empty) have an empty set and no link; a
short text is one shingle; a very long text has its whole set, which one task holds; a document is a
row: rows with one doc_id but several texts are linked each by its own text, and
equal rows get the same result each; the order of rows does not matter. component_id is the least
doc_id reachable; a null id is no id: its row goes if its component has one, and a component
without any has a null component_id and stays. An empty table gives no rows; other columns
are ignored (or passed on by ``keep_first``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm import memory
from textguard.llm.common import Scratch, row_key, small_batches

#: Minhashes in a sub-key; share of pairs at the very threshold that no table may meet.
ROWS, MISS = 2, 5e-4
#: Words whose hash one worker keeps; shingles hashed at a time.
CACHE_WORDS, BLOCK = 250_000, 4096
#: Draws of new hubs in a table.
NEW_HUBS = 4
_SEED = 0x5EED


def tables_a_side(percent: int) -> int:
    """Sub-keys a side so that at most ``MISS`` of the pairs at the threshold meet in no table."""
    p = (percent / 100) ** ROWS
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - p)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_HASHES = memory.keep("minhash", _Hashes())


def shingles(raw: bytes | None, width: int):
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Words part at ASCII white space, A-Z are lowered; fewer words than ``width`` are one shingle.
    """
    import numpy as np

    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _family(n: int):
    """Odd multipliers and offsets of n hash functions."""
    import numpy as np

    rng = np.random.default_rng(_SEED)
    return (rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1))[:, None], rng.integers(0, 2**63, n, np.uint64)[:, None]


def sub_keys(found, family, side: int):
    """Sub-keys of a shingle set: ``side`` for the one collection, then as many for the other."""
    import numpy as np

    times, plus = family
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, (found[None, at : at + BLOCK] * times + plus).min(axis=1), out=least)
    key = np.zeros(2 * side, np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _raw(column):
    import pyarrow as pa

    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def _sign(width: int, side: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        memory.claim("minhash")
        family = _family(2 * side * ROWS)
        for batch in batches:
            n, digest, one, two = [], [], [], []
            for key, raw in zip(batch.column(1).to_pylist(), _raw(batch.column(2)), strict=True):
                found = shingles(raw, width)
                n.append(len(found))
                # a row without shingles is in no class; its own key keeps such rows from meeting in one task
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else key)
                keys = sub_keys(found, family, side) if len(found) else None
                one.append(None if keys is None else keys[:side])
                two.append(None if keys is None else keys[side:])
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(one, pa.list_(pa.int64())), pa.array(two, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "set", "one", "two"])

    return run


def _full(width: int):
    def run(batches):
        import pyarrow as pa

        memory.claim("minhash")
        for batch in batches:
            found = [shingles(raw, width).view("int64") for raw in _raw(batch.column(1))]
            columns = [batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sh"])

    return run


def connected(edges: DataFrame, work: Scratch) -> DataFrame:
    """Components (id, root) of an edge list (a, b): least id reachable, by rounds of hooking and jumping.

    Every round lets each id take the least root among its neighbours and then its root's
    root; rounds are written to shared scratch, and only a count comes to the driver.
    """
    both = work.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id")
    while True:
        seen = roots.select(F.col("id").alias("b"), F.col("root").alias("r"))
        least = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        hooked = roots.join(least, "id").select("id", F.least("root", "r").alias("next"), F.col("root").alias("was"))
        # an id's old root hears of the smaller one too
        told = hooked.select(F.col("was").alias("id"), "next").union(hooked.select("id", "next")).groupBy("id").agg(F.min("next").alias("root"))
        jump = told.select(F.col("id").alias("root"), F.col("root").alias("over"))
        new = told.join(jump, "root", "left").select("id", F.least("root", F.coalesce("over", "root")).alias("root"))
        changed = work.put(new.join(roots.withColumnRenamed("root", "was"), "id").select("id", "root", (F.col("root") != F.col("was")).alias("moved")), "roots")
        roots = changed.select("id", "root")
        if changed.where("moved").limit(1).count() == 0:
            return roots


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sizes of their full sets and of what these have in common.

    A hub has many partners: both joins are inner ones between plain shuffles, so adaptive execution deals the
    partners by their measured size and sends the hub's one row to each task.
    """
    a, b = (sets.select(F.col("id").alias(x), F.col("sh").alias(f"sh_{x}")) for x in "ab")
    met = pairs.select("a", "b").join(a, "a").join(b, "b")
    return met.select("a", "b", F.size("sh_a").alias("n_a"), F.size("sh_b").alias("n_b"), F.size(F.array_intersect("sh_a", "sh_b")).alias("c"))


def _linked(percent: int):
    return F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("c"))


def _may_link(percent: int):
    """Bound from sizes n and shared parts u: the union holds all shingles, the intersection shared ones only."""
    both = F.least("u_a", "u_b")
    return F.lit(100) * both >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - both)


def _near_hub(percent: int):
    """Bound for two classes of one hub whose deltas share nothing: the deltas together are then what they differ in."""
    return (F.col("delta_a") + F.col("delta_b")) * F.lit(100 + percent) <= (F.col("n_a") + F.col("n_b")) * F.lit(100 - percent)


def _early(percent: int):
    """Both ranks of a shared shingle lie within the prefixes that this very pair needs."""
    need = (F.col("delta_a") + F.col("delta_b")) * F.lit(100 + percent) - (F.col("n_a") + F.col("n_b")) * F.lit(100 - percent)
    after = lambda x: (F.col(f"delta_{x}") - F.col(f"rank_{x}") + 1) * F.lit(2 * (100 + percent))
    return (after("a") >= need) & (after("b") >= need)


def _most_apart(percent: int):
    """In how many shingles a class of n may differ from any that it links with: their sizes are within percent."""
    return F.floor(F.col("n") * F.lit(100 - percent) / F.lit(percent) + 1e-9)


def _mixed(rows: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the groups ``on`` that hold several components, with the greatest one of their group as main."""
    parts = rows.groupBy(*on, "root").agg(F.count(F.lit(1)).alias("m"))
    several = parts.groupBy(*on).agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("parts")).where(F.col("parts") > 1)
    return rows.join(several.drop("parts"), on)


def _new_hubs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b): of a few hubs drawn in each table, the one of another group that a class shares the most tables with."""
    drawn = lambda k: F.max_by(F.struct("id", "root"), F.struct(F.xxhash64(F.lit(k), F.col("id")), F.col("id")))
    # of the main group and of the others some hubs each: whoever stands in the one meets the other's
    hubs = open_.groupBy("key", (F.col("root") == F.col("main")).alias("inner")).agg(F.array(*[drawn(k) for k in range(NEW_HUBS)]).alias("hubs"))
    met = open_.select("id", "root", "key").join(hubs.select("key", F.explode("hubs").alias("hub")), "key").where(F.col("hub.root") != F.col("root"))
    shared = met.groupBy("id", F.col("hub.id").alias("hub")).agg(F.count(F.lit(1)).alias("tables"))
    return shared.groupBy(F.col("id").alias("a")).agg(F.max_by("hub", F.struct("tables", "hub")).alias("b"))


_SIDE = ("id", "n", "u", "root", "hub", "main", "delta")


def _pairs(rows: DataFrame, on: list[str], bound, more: tuple[str, ...] = ()) -> DataFrame:
    """Distinct pairs (a, b) of different components that meet on ``on`` and that the bound allows.

    Members of a group's main component are met by those outside of it, never by each other: a
    group of near copies that are one component costs its size times the number of the rest.
    """
    side = lambda r, x: r.select(*on, *[F.col(c).alias(f"{c}_{x}") for c in (*_SIDE, *more)])
    once = (F.col("root_b") == F.col("main_b")) | (F.col("id_a") < F.col("id_b"))
    met = side(rows.where(F.col("root") != F.col("main")), "a").join(side(rows, "b"), on).where((F.col("root_a") != F.col("root_b")) & once & bound)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _deltas(members: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """A row for each of the rarest shingles of a member's delta that others of its hub have in theirs.

    Two sets that link differ in D shingles at most, so deltas of sizes x and y share k = (x + y - D) / 2
    at least, and one shingle is among the x - k + 1 rarest of the one and the y - k + 1 rarest of the other:
    never more than D + 1, as sizes differ by D at most. ``_early`` asks that of a pair's ranks.
    """
    own = sets.select("id", F.col("sh").alias("sh_own"))
    hub = sets.select(F.col("id").alias("hub"), F.col("sh").alias("sh_hub"))
    delta = F.concat(F.array_except("sh_own", "sh_hub"), F.array_except("sh_hub", "sh_own"))
    each = members.join(own, "id").join(hub, "hub").withColumn("s", F.explode(delta)).drop("sh_own", "sh_hub")
    each = work.put(each, "deltas")
    rarity = each.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") > 1)
    # shingles that no other delta has are the rarest of all, so they count among the first
    alone = F.col("delta") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    rank = alone + F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    ranked = each.join(rarity, ["hub", "s"]).withColumn("rank", rank).where(F.col("rank") <= _most_apart(percent) + 1)
    return _mixed(ranked.drop("f"), ["hub", "s"])


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(id, key): the rarest shingles of each class, as many as a pair at the threshold must share one of."""
    each = sets.select("id", "n", F.explode("sh").alias("key"))
    rarity = each.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("f", "key"))
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100 - 1e-9) + 1
    return each.join(rarity, "key").withColumn("rank", rank).where(F.col("rank") <= first).select("id", "key")


def _components(docs: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    """Per row of ``docs``: doc_id, key of the row, n, component (null without an id in it)."""
    spark = docs.sparkSession
    small_batches(spark)
    side = tables_a_side(percent)
    texts = docs.select("doc_id", row_key().alias("key"), "text")
    with Scratch(spark, "minhash") as work:
        signed = work.put(texts.mapInArrow(_sign(width, side), "doc_id long, key binary, n long, set binary, one array<long>, two array<long>"), "signed")
        classes = signed.where(F.col("n") > 0).groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first(F.struct("n", "one", "two")).alias("x"))
        # numbers given while the table is written: they stay, and two classes never share one
        classes = work.put(classes.select(F.monotonically_increasing_id().alias("id"), "set", "doc_id", "key", "x.n", "x.one", "x.two"), "classes")

        def full(of: DataFrame) -> DataFrame:
            """Whole sets of classes; their texts are read again rather than keeping all sets. Equal rows are one."""
            one = texts.where(F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
            return work.put(one.join(of.select("id", "key"), "key").select("id", "text").mapInArrow(_full(width), "id long, n long, sh array<long>"), "sets")

        if exact:
            sets = full(classes)
            tables = _rarest(sets, percent)
        else:
            keys = F.flatten(F.transform("one", lambda a, i: F.transform("two", lambda b, j: F.xxhash64(i, j, a, b))))
            tables = classes.select("id", F.explode(keys).alias("key"))
        met = tables.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
        tables = work.put(tables.join(met, "key", "left_semi"), "tables")
        candidates = tables.select("id").distinct()
        sets = sets.join(candidates, "id", "left_semi") if exact else full(classes.select("id", "key").join(candidates, "id"))
        lone = sets.select("id", F.explode("sh").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where(F.col("c") == 1).groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
        bound = sets.select("id", "n").join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("u"))
        bound = work.put(bound.where(F.lit(100) * F.col("u") >= F.lit(percent) * F.col("n")), "bound")
        sets = sets.join(bound.select("id"), "id", "left_semi")
        roots = _roots(tables, bound, sets, percent, work)
        placed = classes.select("id", "set", "doc_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = placed.groupBy("root").agg(F.min("doc_id").alias("component"))
        found = signed.select("doc_id", "key", "n", "set").join(placed.select("root", "set").join(least, "root").select("set", "component"), "set", "left")
        lonely = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
        return Scratch(spark, "components").put(found.select("doc_id", "key", "n", lonely.alias("component")), "found")


def _roots(tables: DataFrame, bound: DataFrame, sets: DataFrame, percent: int, work: Scratch) -> DataFrame:
    """Steps 4 to 6: components (id, root) of the classes that have a link."""
    live = work.put(tables.join(bound, "id"), "live")
    # 4. hubs: the member of a table with the greatest shared part; a class keeps its best one
    ratio = F.struct((F.col("u") / F.col("n")).alias("r"), (-F.col("id")).alias("i"))
    hubs = live.groupBy("key").agg(F.max(ratio).alias("best"), F.max_by("id", ratio).alias("hub"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    stars = live.join(hubs, "key").groupBy("id").agg(F.max_by("hub", "best").alias("hub"))
    stars = work.put(_common(stars.select(F.col("id").alias("a"), F.col("hub").alias("b")), sets), "stars")
    links = stars.where(F.col("a") != F.col("b")).where(_linked(percent)).select("a", "b")
    delta = F.col("n_a") + F.col("n_b") - 2 * F.col("c")
    hubs = work.put(bound.join(stars.select(F.col("a").alias("id"), F.col("b").alias("hub"), delta.alias("delta")), "id"), "hubs")

    def mixed(roots: DataFrame) -> DataFrame:
        known = hubs.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        return work.put(_mixed(tables.join(known, "id"), ["key"]), "open")

    # 5. a class that links with its hub is of that hub's group, for now
    near = stars.where(_linked(percent)).select(F.col("a").alias("id"), F.col("b").alias("root"))
    above = near.select(F.col("id").alias("root"), F.col("root").alias("over"))
    groups = near.join(above, "root", "left").select("id", F.coalesce("over", "root").alias("root"))
    tried = _common(_new_hubs(mixed(groups)), sets).where(_linked(percent)).select("a", "b")
    links = work.put(links.union(tried), "links")
    roots = connected(links, work)
    open_ = mixed(roots)
    # 6. tables that still hold several components
    may = _may_link(percent)
    across = _pairs(open_, ["key"], may & ((F.col("hub_a") != F.col("hub_b")) | _near_hub(percent)))
    deltas = _deltas(open_.select("id", "n", "u", "root", "hub", "delta").distinct(), sets, percent, work)
    akin = _pairs(deltas, ["hub", "s"], may & _early(percent), ("rank",))
    late = work.put(_common(across.union(akin).distinct(), sets).where(_linked(percent)).select("a", "b"), "late")
    return connected(links.union(late), work) if late.limit(1).count() else roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (the least id of its component)."""
    found = _components(docs, width, percent, exact)
    kept = F.col("component").isNull() | F.col("doc_id").eqNullSafe(F.col("component"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """``docs`` with one document of each component; equal rows stay or go together."""
    found = _components(docs, width, percent, exact)
    gone = found.where(F.col("component").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key()).join(gone, "__key", "left_anti").select(*docs.columns)


# The contract of three words and 0.85 by plain set joins; components as what is reachable.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
