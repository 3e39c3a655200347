"""SpotSigs: signatures are chains of content words that follow common-word anchors.

A text's fingerprint is the set of hashes of its signatures. Sets are compared by Jaccard
likeness, pruned by their lengths first: sets whose lengths differ too much cannot be
alike, and a merge stops once the threshold is out of reach.

Stretches without anchors are represented too: where a text goes ``GAP`` or more content words
from one anchored chain (or its beginning) to the next (or its end), a chain starts at every word
of the stretch. The rule looks at the stretch alone, so it is the same for texts of every size, and
an anchor more or less changes the chains around it only.

Defined results: null is empty; a text without anchored chains but with words has
chains that start at every word; a text without words has the empty fingerprint; two
empty fingerprints are alike (1.0), an empty and a full one are not (0.0); very long texts are
taken whole; repeated rows are compared like others, in one task if id and text are the same; in ties of
``doc_id`` the order is that of a hash of the texts; a null id comes last; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm import memory
from textguard.llm.common import materialize, partitions, small_batches
from textguard.llm.lexicon import ANCHORS, LETTERS

#: Content words in a chain; near duplicates have at least this likeness.
CHAIN, THRESHOLD = 3, 0.8
#: Content words from one anchored chain to the next from which chains start at every word between.
GAP = 8
#: Words whose hash one worker keeps.
CACHE_WORDS = 400_000
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Hashes(dict):
    """64-bit hash of a content word; 0 for an anchor."""

    def __missing__(self, word: str) -> int:
        import xxhash

        found = 0 if word in ANCHORS else xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_HASHES = memory.keep("spotsigs", _Hashes())


def signatures(text: str | None):
    """Sorted distinct 32-bit hashes of a text's spot signatures."""
    import numpy as np

    words = LETTERS.findall((text or "").lower())
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    content = codes[codes != 0]
    if not len(content):
        content, starts = np.where(codes == 0, np.uint64(3), codes), np.arange(len(codes))
    else:
        # an anchor opens a chain at the next content word
        starts = np.unique(np.cumsum(codes != 0)[codes == 0])
        starts = starts[starts < len(content)]
        if not len(starts):
            starts = np.arange(len(content))
        else:
            gaps = np.diff(np.concatenate([[0], starts, [len(content)]]))
            opened = np.repeat(gaps >= GAP, gaps)
            opened[starts] = True
            starts = np.flatnonzero(opened)
    padded = np.concatenate([content, np.zeros(CHAIN, np.uint64)])
    mixed = np.zeros(len(starts), np.uint64)
    for k in range(CHAIN):
        mixed = (mixed ^ padded[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def likeness(a, b, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 as soon as lengths show that ``least`` is out of reach."""
    import numpy as np

    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(found) -> str:
    """A fingerprint as text: the hashes in order, 8 hex digits each."""
    return found.astype(">u4").tobytes().hex()


# ---------------------------------------------------------------- every document against its next


#: Rows of a sample from which a border between ranges is drawn.
SAMPLE = 64


def _place(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the place in the order: k descends with the id, h parts the rows of one id by their texts."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _bounds(rows: DataFrame, ways: int) -> list[tuple[int, int]]:
    """Borders (k, h) between ranges, from a sample whose size goes by the number of ranges only."""
    share = min(1.0, SAMPLE * ways / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("h", "k"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("k", "h").dropDuplicates()
    found = sorted(map(tuple, drawn.collect()))
    return [found[len(found) * i // ways] for i in range(1, ways)] if len(found) >= ways else found


def _range_of(bounds: list[tuple[int, int]]):
    """Number of the range of (k, h): how many borders lie at or below it, by binary search over a batch."""

    @F.pandas_udf("int")
    def number(k: pd.Series, h: pd.Series) -> pd.Series:
        import numpy as np

        kind = np.dtype([("k", "<i8"), ("h", "<i8")])
        place = np.empty(len(k), kind)
        place["k"], place["h"] = k, h
        return pd.Series(np.searchsorted(np.array(sorted(set(bounds)), kind), place, side="right").astype("int32"))

    return number(F.col("k"), F.col("h"))


def _compare(batches):
    import pyarrow as pa

    memory.claim("spotsigs")
    names, held, done, at = [c.split()[0] for c in _OUT.split(", ")], None, [], None

    def result(row, following):
        doc_id, text, sigs = row
        n, (_, other, other_sigs) = len(text), following
        edited = text[: n - n // 2] + other[: n // 2]
        edited_sigs = signatures(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, n, digest, written(sigs), written(edited_sigs), likeness(sigs, edited_sigs), likeness(sigs, other_sigs))

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names=names)

    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != at:
                held, at = None, bucket
            row = (doc_id, text or "", signatures(text))
            if held is not None:
                done.append(result(held, row))
            held = None if guest else row
        if done:
            yield frame(done)
            done = []


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document is the one with the next smaller id (after the least: the greatest).
    Texts move once: they are dealt by ranges of ids (and, within an id, of a hash of the text), and
    the greatest of a range is also sent to the range above as the guest that ends it.
    """
    small_batches(docs.sparkSession)
    rows, ways = _place(docs), 3 * partitions(docs)
    rows = rows.withColumn("b", _range_of(_bounds(rows.select("k", "h"), ways)))
    # the greatest place of each range, as many rows as ranges: it follows the last document of the range above
    top = {r["b"]: (r["t"]["k"], r["t"]["h"]) for r in rows.groupBy("b").agg(F.max(F.struct("k", "h")).alias("t")).collect()}
    filled = sorted(top)
    ends = [(high, *top[low]) for low, high in zip(filled, filled[1:], strict=False)] + [(filled[0], *top[filled[-1]]) for _ in filled[:1]]
    tops = F.broadcast(docs.sparkSession.createDataFrame(ends, "to int, k long, h long"))
    guests = _place(docs).join(tops, ["k", "h"]).dropDuplicates(["to", "k", "h"])
    sent = rows.select("b", F.lit(False).alias("guest"), "doc_id", "text", "k", "h").union(guests.select("to", F.lit(True), "doc_id", "text", "k", "h"))
    order = ("b", "guest", F.col("k").desc(), F.col("h").desc())
    return sent.repartition(ways, "b").sortWithinPartitions(*order).select("b", "guest", "doc_id", "text").mapInArrow(_compare, _OUT)


# ---------------------------------------------------------------- near duplicates


def _sets(batches):
    import pyarrow as pa

    memory.claim("spotsigs")
    for batch in batches:
        found = [signatures(t) for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([hashlib.sha256(x.tobytes()).hexdigest() if len(x) else None for x in found], pa.string()), pa.array([x.astype("int64") for x in found], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "class", "sigs"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class) and pairs of classes (a, b, likeness) at or above the threshold.

    Classes are sets of equal fingerprints, so copies are compared once. Classes are
    partitioned by set length into bands a factor ``threshold`` wide, so that a set meets its
    own band and the next one only; within a band pair, sets meet where they share one of
    their rarest signatures (as many as a pair at the threshold must share), and lengths
    are compared before sets. No pair at the threshold is lost.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets = materialize(docs.select("doc_id", "text").mapInArrow(_sets, "doc_id long, class string, sigs array<long>"), "spots")
    members = sets.select("doc_id", "class")
    classes = materialize(sets.where(F.col("class").isNotNull()).groupBy("class").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")), "spotclasses")
    each = classes.select("class", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").count().where(F.col("count") > 1)
    rank = F.row_number().over(Window.partitionBy("class").orderBy("count", "sig"))
    # signatures met once lead to no pair but count among the rarest
    shared = each.join(rarity, "sig").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("class"))).withColumn("rank", rank)
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    rare = shared.where(F.col("rank") + F.col("n") - F.col("shared") <= length)
    band = F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")
    left = rare.select("sig", F.col("class").alias("a"), F.col("n").alias("n_a"), band.alias("band"))
    right = rare.select("sig", F.col("class").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b") - 1e-9)
    pairs = left.join(right, ["sig", "band"]).where(fits).select("a", "b").distinct()
    one = classes.select(F.col("class").alias("a"), F.col("sigs").alias("sigs_a"))
    two = classes.select(F.col("class").alias("b"), F.col("sigs").alias("sigs_b"))
    both = F.size(F.array_intersect("sigs_a", "sigs_b"))
    alike = pairs.join(one, "a").join(two, "b").select("a", "b", (both / (F.size("sigs_a") + F.size("sigs_b") - both)).alias("likeness"))
    return members, alike.where(F.col("likeness") >= threshold - 1e-12)
