"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

An item is cut into windows of consecutive words, and a window into shingles. Shingles are ordered by
their rarity: the number of documents that hold them. A document that holds a window holds all its shingles, so the
necessary prefix is one: the rarest. Document shingles join windows on it; its place in the window
and the lengths of both say where the window would begin, and the words there are compared exactly.

Only shingles that a Bloom filter of all windows' shingles lets through leave the scan, each with the words
around it, so the texts are read once, whatever the size of the benchmark. The filter's size is bounded; a
benchmark too large for it makes the join longer, never wrong. Windows, shingles and their counts stay in tables.

Defined results: a null text has no words, no hits; very long texts are searched whole; items without words have no
window; null items and items without an id are skipped; rows with one item_id count as one item; rows get a
number of their own, so repeated documents, or several with one id or none, are judged each; an empty table
gives no rows, an empty benchmark no hits; other columns are ignored (or passed on by ``drop_contaminated``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import memory
from textguard.llm.common import Scratch, small_batches

#: Words in a window, and in a shingle.
WINDOW, SHINGLE = 10, 5
#: Bits of the filter: so many a shingle, up to a bound of 32 MB.
BITS_EACH, BITS_LEAST, BITS_MOST = 64, 1 << 16, 1 << 28
#: Words whose hash one worker keeps.
CACHE_WORDS = 400_000
_WORD_BYTES = bytes((b | 32) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WINDOWS = "item string, run string, words int, shingles array<long>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


_HASHES = memory.keep("decontaminate", _Hashes())


def words_of(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lowered, all other ASCII but a-z and 0-9 parts words."""
    return raw.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter text is one window, one without words none."""
    if not words:
        return []
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def shingle_hashes(codes, size: int):
    """Hashes of all runs of ``size`` words, given the words' hashes."""
    import numpy as np

    n = max(0, len(codes) - size + 1)
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _codes(words: list[bytes]):
    import numpy as np

    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _raw(batch):
    import pyarrow as pa

    column = batch.column("text")
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def _windows(size: int):
    def run(batches):
        import pyarrow as pa

        memory.claim("decontaminate")
        for batch in batches:
            items, runs, lengths, shingles = [], [], [], []
            for item, raw in zip(batch.column("item").to_pylist(), _raw(batch), strict=True):
                for window in windows_of(words_of(raw), size):
                    items.append(item)
                    runs.append(b" ".join(window).decode())
                    lengths.append(len(window))
                    shingles.append(shingle_hashes(_codes(list(window)), min(SHINGLE, len(window))).view("int64"))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(runs, pa.string()), pa.array(lengths, pa.int32()), pa.array(shingles, pa.list_(pa.int64()))], names=["item", "run", "words", "shingles"])

    return run


class Filter:
    """Bloom filter of 64-bit hashes with two bits each; ``may`` tests a whole array."""

    def __init__(self, bits: int, words, masks):
        import numpy as np

        self.bits, self.table = bits, np.zeros(bits // 64, np.uint64)
        self.table[words] = masks

    def may(self, hashes):
        import numpy as np

        out = np.ones(len(hashes), bool)
        for at in (hashes, hashes >> np.uint64(32)):
            place = at & np.uint64(self.bits - 1)
            out &= (self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def _filter(hashes: DataFrame, bits: int | None) -> Filter:
    """The filter of a column ``h``; its bits are set in Spark, and as many words as it has come to the driver at most."""
    import numpy as np

    if bits is None:
        bits = min(BITS_MOST, max(BITS_LEAST, 1 << (BITS_EACH * max(1, hashes.count()) - 1).bit_length()))
    place = F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")
    at = hashes.select(place).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("mask")).toArrow()
    return Filter(bits, words["word"].to_numpy(), words["mask"].to_numpy().astype(np.int64).view(np.uint64))


def _scan(shipped, sizes: list[int], size: int, columns: list[str]):
    """Adds to each row the number of words and the shingles that pass: place, hash, and the words around."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memory.claim("decontaminate")
        passed = shipped.value
        for batch in batches:
            counts, places, hashes, around = [], [], [], []
            for raw in _raw(batch):
                words = words_of(raw) if raw else []
                codes, at, found, near = _codes(words), [], [], []
                for m in sizes:
                    own = shingle_hashes(codes, m)
                    for p in np.flatnonzero(passed.may(own)).tolist():
                        at.append(p)
                        found.append(int(own[p].view(np.int64)))
                        near.append(b" ".join(words[max(0, p - size + m) : p + size]).decode())
                counts.append(len(words))
                places.append(at)
                hashes.append(found)
                around.append(near)
            new = [pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(around, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=[*columns, "__words", "__at", "__hash", "__near"])

    return run


def _judged(docs: DataFrame, columns: list[str], benchmark: DataFrame, size: int, bits: int | None) -> DataFrame:
    """``columns`` of every row with n_words, n_hit, n_items, items_sha256 and contaminated as __-columns."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = Scratch(spark, "decontaminate")
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    windows = kept.put(items.mapInArrow(_windows(size), _WINDOWS).distinct(), "windows")
    runs = windows.select("run", "words", "shingles").distinct()
    each = runs.select("run", "words", F.size("shingles").alias("n"), F.posexplode("shingles").alias("off", "h"))
    sizes = [r[0] for r in runs.select(F.least(F.lit(SHINGLE), "words").alias("m")).distinct().collect()]  # five at most
    shipped = spark.sparkContext.broadcast(_filter(each.select("h").distinct(), bits))
    source = docs.select(*columns, *([] if "text" in columns else ["text"]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*columns).schema.fields)
    scanned = source.mapInArrow(_scan(shipped, sizes, size, columns), f"{fields}, __words long, __at array<int>, __hash array<long>, __near array<string>")
    scanned = scanned.select(*columns, F.monotonically_increasing_id().alias("__key"), "__words", F.arrays_zip("__at", "__hash", "__near").alias("__found"))
    rows = kept.put(scanned.withColumn("__met", F.size("__found") > 0), "rows", ("__met",))
    found = rows.where("__met").select("__key", "__words", F.explode("__found").alias("x")).select("__key", "__words", F.col("x.__at").alias("at"), F.col("x.__hash").alias("h"), F.col("x.__near").alias("near"))
    rarity = found.select("__key", "h").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    # a window with a shingle that no document holds occurs nowhere; of the others the rarest shingle is the prefix
    known = each.join(rarity, "h").groupBy("run", "words", "n").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("docs", "h", "off")).alias("p")).where(F.col("known") == F.col("n"))
    prefix = known.select("run", F.col("words").alias("size"), F.col("p.h").alias("h"), F.col("p.off").alias("off"))
    begin = F.col("at") - F.col("off")
    fits = (begin >= 0) & (begin + F.col("size") <= F.col("__words"))
    # of the words around, the window's are those before the shingle by its place, and as many as the window has
    left = F.least(F.col("at"), F.lit(size) - F.least(F.lit(SHINGLE), "size"))
    there = F.array_join(F.slice(F.split("near", " "), left - F.col("off") + 1, F.col("size")), " ")
    hits = kept.put(found.join(prefix, "h").where(fits).where(there == F.col("run")).select("__key", begin.alias("begin"), "size", "run").distinct(), "hits")
    reach = F.aggregate(
        F.array_sort(F.collect_set(F.struct("begin", F.col("size").alias("n")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["begin"] + x["n"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["begin"] + x["n"] - F.greatest(acc["end"], x["begin"]))).alias("sum")),
        lambda acc: acc["sum"],
    )
    covered = hits.groupBy("__key").agg(reach.alias("__hit"))
    named = hits.select("__key", "run").distinct().join(windows.select("run", "item").distinct(), "run").groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("__items"))
    sums = covered.join(named, "__key")
    met = rows.where("__met").join(sums, "__key", "left")
    none = rows.where(~F.col("__met")).withColumns({"__hit": F.lit(None).cast("long"), "__items": F.lit(None).cast("array<string>")})
    every = met.select(*columns, "__words", "__hit", "__items").union(none.select(*columns, "__words", "__hit", "__items"))
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    hit = F.coalesce("__hit", F.lit(0).cast("long"))
    return every.withColumns({"__hit": hit, "__n": F.size(listed).cast("long"), "__sha": F.sha2(F.array_join(listed, ",").cast("binary"), 256)})


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, bits: int | None = None) -> DataFrame:
    """Word counts, hits and items of every row of ``docs``; ``bits`` fixes the filter's size (a power of two from 64 on)."""
    found = _judged(docs, ["doc_id"], benchmark, size, bits)
    return found.select("doc_id", F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.col("__n").alias("n_items"), F.col("__sha").alias("items_sha256"), (F.col("__hit") > 0).alias("contaminated"))


def report_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return find_contamination(docs, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; the rest unchanged."""
    return _judged(docs, docs.columns, benchmark, size, None).where(F.col("__hit") == 0).select(*docs.columns)


# Words as the contract defines them; windows by joining runs of words on their text.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS run
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS run
         FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM dw, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, k, runs.size, item FROM runs JOIN win ON runs.run = win.run AND runs.size = win.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
