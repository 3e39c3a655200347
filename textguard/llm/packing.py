"""Packing along a space-filling curve: neighbouring documents share training sequences.

A document's token ids are hashed into a signed feature vector, projected to a few
dimensions and turned into a Hilbert key. Documents are dealt to tasks by ranges of the
key (ties broken by a hash of the id and then by the row's place, so that a large group of
copies or of rows with one id spreads over tasks), and each task lays its documents end to end and cuts the run into sequences.
What is left at the end of a task is cut into runs whose lengths are powers of two, which
need no padding.

Defined results: null and empty texts consist of the end id; repeated rows are packed
each; a null id is a key like others; a very long text fills as many sequences as it needs; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import bpe, memory
from textguard.llm.common import materialize, partitions, small_batches

#: Ids in a full sequence; hashed features, projected dimensions, bits a dimension of the curve.
MAX_TOKENS, FEATURES, DIMENSIONS, BITS = 2048, 256, 4, 12
#: Ids whose features are summed up at a time.
BLOCK_IDS = 500_000
#: Spread of the projected means; brings them over the whole range of the curve.
SPREAD = 8.0
_TOKENS = "doc_id long, curve long, tie long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(ids_bound: int = 65_536, seed: int = 7):
    """Row k: where token id k, hashed to a signed feature, lands in the projected space."""
    import numpy as np

    rng = np.random.default_rng(seed)
    plane = rng.standard_normal((FEATURES, DIMENSIONS)).astype(np.float32)
    k = np.arange(ids_bound, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(32)
    sign = np.where(k & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return plane[((k >> np.uint64(1)) % np.uint64(FEATURES)).astype(np.int64)] * sign[:, None]


def hilbert_key(cells, bits: int = BITS):
    """Hilbert index of integer points (rows of ``cells``, values below 2**bits).

    Skilling's transform: undo excess work from the top bit down, Gray-encode, then
    interleave the bits of the dimensions.
    """
    import numpy as np

    x = np.array(cells, dtype=np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    mend, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        mend = np.where(x[n - 1] & q, mend ^ (q - 1), mend)
        q >>= 1
    x ^= mend
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _tokens(path: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        memory.claim("bpe")
        enc, end, plane = bpe.encoder(path), end_id.to_bytes(4, "little"), projection()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        def features(raws, n, ids, means):
            """Sums of projected features and stored ids of some documents, all at once."""
            flat = np.frombuffer(b"".join(raws), "<u4")
            starts = np.concatenate([[0], np.cumsum(n)])
            means.append(np.add.reduceat(plane[flat & 0xFFFF], starts[:-1], axis=0) / np.array(n, np.float32)[:, None])
            narrow = int(flat.max()) < 65_536
            stored = flat.astype("<u2") if narrow else flat
            for a, b in zip(starts, starts[1:], strict=False):
                ids.append(squeeze(stored[a:b] if narrow else b"\0" + stored[a:b].tobytes()))

        for batch in batches:
            doc_ids, n, ids, means = batch.column(0).to_pylist(), [], [], []
            raws, held = [], 0
            for text in batch.column(1).to_pylist():
                raws.append(enc.encode(text) + end)
                n.append(len(raws[-1]) // 4)
                held += n[-1]
                if held >= BLOCK_IDS:
                    features(raws, n[-len(raws) :], ids, means)
                    raws, held = [], 0
            if raws:
                features(raws, n[-len(raws) :], ids, means)
            means = np.concatenate([*means, np.zeros((0, DIMENSIONS), np.float32)])
            cells = np.clip(((0.5 + np.arctan(SPREAD * means) / np.pi) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
            ties = [xxhash.xxh64_intdigest(str(d)) >> 1 for d in doc_ids]
            columns = [batch.column(0), pa.array(hilbert_key(cells), pa.int64()), pa.array(ties, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "curve", "tie", "n_tokens", "ids"])

    return run


def _ids(packed: bytes, n: int):
    """Ids of a document from their stored form: 16-bit where all of them fit."""
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=4 * n + 1)
    return np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4", offset=1)


def tail_lengths(n: int) -> list[int]:
    """Powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(limit: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        memory.claim("packing")  # the worker may have encoded before; packing needs no vocabulary
        base, full, held = TaskContext.get().partitionId() << 40, 0, []
        # held: pieces [doc_id, start, ids, doc_tokens, offset] of the sequence that is not yet full
        at, names = 0, [c.split()[0] for c in PIECES.split(", ")]

        def rows(pieces, sequence):
            return [(d, s, len(x), zlib.crc32(x.tobytes()), t, sequence, o) for d, s, x, t, o in pieces]

        def frame(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            out = []
            for doc_id, packed, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, start = _ids(packed, n), 0
                while start < n:
                    part = ids[start : start + limit - at]
                    held.append((doc_id, start, part, n, at))
                    start, at = start + len(part), at + len(part)
                    if at == limit:
                        out += rows(held, base + full)
                        held, at, full = [], 0, full + 1
            if out:
                yield frame(out)
        # the rest: the same run of ids, cut again at powers of two
        out, lengths = [], tail_lengths(at)
        room, offset = (lengths[0] if lengths else 0), 0
        for doc_id, start, ids, n, _ in held:
            while len(ids):
                part = ids[:room]
                out += rows([(doc_id, start, part, n, offset)], base + full)
                start, ids, room, offset = start + len(part), ids[len(part) :], room - len(part), offset + len(part)
                if not room:
                    lengths.pop(0)
                    room, offset, full = (lengths[0] if lengths else 0), 0, full + 1
        if out:
            yield frame(out)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, limit: int = MAX_TOKENS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` ids (a power of two), in curve order.

    The ids are written once to shared scratch; only they, compressed, are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = docs.select("doc_id", "text").mapInArrow(_tokens(tokenizer or bpe.default_path(), end_id), _TOKENS)
    tokens = materialize(tokens.withColumn("place", F.monotonically_increasing_id()), "tokens")
    order = ("curve", "tie", "doc_id", "place")
    dealt = tokens.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids", "n_tokens").mapInArrow(_pack(limit), PIECES)
