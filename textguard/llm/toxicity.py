"""Toxicity: a convolutional text classifier trained in numpy.

Words and their beginnings are hashed into rows of an embedding table; a word's embedding is the sum of
its rows, so an inflected or compound form that was never learned is near to those that were. Filters of
several widths run over the word sequence, each filter keeps its maximum over the whole text, and a
logistic unit weighs the maxima. Scores are calibrated so that each language group's threshold becomes
0.3. The group is read off the text's own function words.

Thresholds come from scores of folds that the scoring model has not seen; the folds hold each group and
class in proportion. A group with few positive rows leans on the threshold of all. The model that scores is then trained
on all labelled rows.

All labelled rows outside the held-out fold are learned from. As many as one shard holds are trained on in one place. Of
more, each shard holds rows of one fold, whose document counts give the words' first embeddings; from there it trains once. The
model is the mean of all shards: embeddings begin at the counts of all rows and move as they did in the shards, weighted by the
documents that have them. The means without a fold's shards and counts have not seen that fold; thresholds come from their
scores of all rows, counted by steps of 1 / GRID.

Defined results: null and empty texts have empty maxima and score by the bias alone; very long texts are scored
whole, in blocks; without labelled rows of both classes every score is 0; repeated rows are scored each;
labels other than 0 and 1 and labels of unknown or null documents are ignored; of several labels of
one id the greatest counts, of several texts of one id one is learned from; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm import memory
from textguard.llm.common import doc_crc, materialize, small_batches
from textguard.llm.lexicon import GROUPS, VOTES, language_group, letter_words

#: Code points of training texts in a shard, about; the steps of a logit in which thresholds are sought; embeddings in one exchanged block.
SHARD_CHARS, GRID, BLOCK_ROWS = 6_000_000, 256, 1024
#: Bounds of ``training_rows``, for each class: documents, and code points of their whole texts. Queries learn from all rows.
TRAIN_DOCS, TRAIN_CHARS = 1500, 1 << 24
#: Rows of the embedding table, its width, filter widths, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 20, 8, (1, 2, 3), 6
EPOCHS, RATE, DECAY, SEED = 6, 0.05, 1e-4, 11
#: Error below which a row teaches the last layer only.
SURE = 0.02
#: Lengths of the beginnings of a word that are hashed beside it.
BEGINNINGS = (4, 6)
#: Documents a word must occur in to get an embedding; documents that halve a word's first odds.
MIN_DOCS, SHRINK = 2, 4.0
#: Folds for calibration; positive rows at which a group's own threshold counts half.
FOLDS, LEAN = 3, 20
#: Scores at or above it are predicted toxic.
THRESHOLD = 0.3
#: Words whose embedding one worker keeps.
CACHE_WORDS = 400_000
#: Words scored at a time; longer texts go in overlapping blocks, whose maxima are the text's.
BLOCK_WORDS = 50_000


def rows_of(words: list[str]):
    """Rows of the embedding table for lower-case words and their beginnings, filled up with the row that stays zero."""
    import zlib

    import numpy as np

    rows = np.full((len(words), 1 + len(BEGINNINGS)), BUCKETS, np.int64)
    rows[:, 0] = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
    for j, n in enumerate(BEGINNINGS, 1):
        at = [k for k, w in enumerate(words) if len(w) > n]
        rows[at, j] = [zlib.crc32(f"{words[k][:n]}*".encode("utf-8", "surrogatepass")) for k in at]
        rows[at, j] &= BUCKETS - 1
    rows[:, 0] &= BUCKETS - 1
    return rows


class _Numbers(defaultdict):
    """Numbers of words, in order of appearance; those that vote for language groups come first."""

    def __init__(self):
        super().__init__()
        self.renew()

    def renew(self) -> None:
        """Forget all words but the voters."""
        self.clear()
        self.default_factory = itertools.count().__next__
        self.filled = 0  # words whose rows were asked for
        for w in VOTES:
            self[w]

    def of(self, words):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def new(self):
        """Rows of the words that came since the last call."""
        words = list(itertools.islice(reversed(self), len(self) - self.filled))[::-1]
        self.filled = len(self)
        return rows_of(words)


class _Vectors(_Numbers):
    """Row of ``table`` with a word's embedding; ``full`` may hold those of several models side by side."""

    def __init__(self, full):
        import numpy as np

        super().__init__()
        self.full, self.models, self.table = full, full.shape[1] // DIM, np.zeros((CACHE_WORDS, full.shape[1]), np.float32)
        self.votes = np.array([[g in v for g in range(len(GROUPS) - 1)] for v in VOTES.values()], np.int64)

    def numbers(self, words: list[str]):
        """Rows of a block of words, valid until the next call."""
        if len(self) + len(words) > CACHE_WORDS:
            self.renew()
        found, at = self.of(words), self.filled
        if at < len(self):
            rows = self.new()
            self.table[at : len(self)] = sum((self.full[rows[:, j]] for j in range(1, rows.shape[1])), self.full[rows[:, 0]])
        return found

    def embedded(self, numbers, model: int = 0):
        """Embeddings of numbered words."""
        return self.table.reshape(-1, DIM).take(numbers * self.models + model if self.models > 1 else numbers, axis=0)

    def group(self, numbers) -> int:
        """``language_group`` of numbered words."""
        import numpy as np

        counts = np.bincount(numbers[numbers < len(VOTES)], minlength=len(VOTES)) @ self.votes
        return int(counts.argmax()) if counts.any() else len(GROUPS) - 1

    def read(self, model: Cnn, text: str | None, place: int = 0) -> tuple[float, int]:
        """Logit by ``model``, whose embeddings are at ``place``, and language group of a whole text."""
        words = letter_words(text or "")
        if len(words) > BLOCK_WORDS:
            return logit(model, lambda a, b: self.embedded(self.numbers(words[a:b]), place), len(words)), language_group(words)
        numbers = self.numbers(words)
        return logit(model, lambda a, b: self.embedded(numbers[a:b], place), len(words)), self.group(numbers)


_WORKER: dict[str, _Vectors] = memory.keep("toxicity", {})


@dataclass
class Cnn:
    rows: object  # trained rows of the embedding table, ascending; the one after the last stays zero
    values: object  # their embeddings; all other rows are zero
    filters: list  # by width: array (width, DIM, FILTERS)
    biases: object
    weights: object
    bias: float
    thresholds: list  # by language group

    def table(self):
        import numpy as np

        full = np.zeros((BUCKETS + 1, DIM), np.float32)
        full[self.rows] = self.values
        return full


def maxima(embedded, filters, biases):
    """Maximum of every filter over the words, after a rectifier, and where it was."""
    import numpy as np

    best, where, n = [], [], len(embedded)
    for f in filters:
        width = len(f)
        if n < width:
            embedded_w = np.vstack([embedded, np.zeros((width - n, DIM), np.float32)])
        else:
            embedded_w = embedded
        m = len(embedded_w) - width + 1
        out = embedded_w[:m] @ f[0]
        for j in range(1, width):
            out += embedded_w[j : m + j] @ f[j]
        at = out.argmax(axis=0)
        best.append(out[at, np.arange(out.shape[1])])
        where.append(at)
    best = np.concatenate(best) + biases
    return np.maximum(best, 0), where


def fit(samples: list[tuple[str, int]], weights: tuple[float, float] = (1.0, 1.0)) -> Cnn | None:
    """Train on (text, label) pairs and calibrate; ``weights``: documents that a sampled row of class 0 and 1 stands for."""
    import numpy as np

    if {y for _, y in samples} != {0, 1}:
        return None
    words = [letter_words(t) for t, _ in samples]
    rows = word_rows(words)
    truth = np.array([y for _, y in samples])
    groups = np.array([language_group(ws) for ws in words])
    fold, met = np.zeros(len(samples), np.int64), {}
    for k in range(len(samples)):
        fold[k] = met.get((groups[k], truth[k]), 0) % FOLDS
        met[groups[k], truth[k]] = met.get((groups[k], truth[k]), 0) + 1
    raw = np.zeros(len(samples))
    for f in range(FOLDS):
        model, held = _train(rows, truth, np.flatnonzero(fold != f)), np.flatnonzero(fold == f)
        full = model.table()
        raw[held] = [logit(model, lambda a, b, r=rows[k]: full[r[a:b]].sum(axis=1), len(rows[k])) for k in held]
    model = _train(rows, truth, np.arange(len(samples)))
    counts = np.where(truth == 1, weights[1], weights[0])
    calibrate(model, raw, truth, groups, counts, np.ones(len(raw)))
    return model


def word_rows(words: Iterable[list[str]]) -> list:
    """For each text, the table's rows of every word, filled up with the row that stays zero."""
    known = _Numbers()
    numbers = [known.of(ws) for ws in words]
    table = known.new()
    return [table[n] for n in numbers]


def calibrate(model: Cnn, raw, truth, groups, counts, documents) -> None:
    """Set the thresholds; a row stands for ``documents`` learned ones, and counts as ``counts``."""
    overall = best_threshold(raw, truth, counts)
    for g in range(len(GROUPS)):
        own = groups == g
        n, size = int((truth * documents)[own].sum()), int(documents[own].sum())
        lean = n / (n + LEAN) if 0 < n < size else 0.0
        model.thresholds[g] = lean * best_threshold(raw[own], truth[own], counts[own]) + (1 - lean) * overall if lean else overall


def document_counts(rows: list, truth, chosen):
    """By table row, the documents of either class that have it."""
    import numpy as np

    pos, neg = np.zeros(BUCKETS + 1, np.int32), np.zeros(BUCKETS + 1, np.int32)
    for k in chosen:
        (pos if truth[k] else neg)[rows[k]] += 1  # a row that is met again is not counted again
    return pos, neg


def _start(rng, pos, neg, n_pos: int, n_neg: int):
    """First embeddings of rows with these document counts; after them one that is zero."""
    import numpy as np

    table = np.zeros((len(pos) + 1, DIM), np.float32)
    table[:-1] = rng.standard_normal((len(pos), DIM)) * 0.02
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    table[:-1, 0] = odds * (pos + neg) / (pos + neg + SHRINK) / 4
    return table


def _train(rows: list, truth, chosen, whole=None) -> Cnn:
    """Adagrad over the chosen samples, one at a time.

    ``whole``: rows that get an embedding, ascending, their document counts, and numbers of documents of either class, where the
    chosen are a shard of more.
    """
    import numpy as np

    rng = np.random.default_rng(SEED)
    if whole is None:
        n_pos = int(truth[chosen].sum())
        pos, neg = document_counts(rows, truth, chosen)
        # words of few documents stay at zero, as unseen ones do: nothing is learned by heart
        seen = np.flatnonzero((pos + neg)[:BUCKETS] >= MIN_DOCS)
        whole = (seen, pos[seen], neg[seen], n_pos, len(chosen) - n_pos)
    seen, n_pos, n_neg = whole[0], max(1, whole[3]), max(1, whole[4])
    table = _start(rng, whole[1], whole[2], n_pos, n_neg)
    place = np.full(BUCKETS + 1, len(seen), np.int64)  # the last row is zero and stays so
    place[seen] = np.arange(len(seen))
    grads = np.full(len(seen) + 1, 1e-2, np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
    for f in filters:  # half of the filters start out looking for words of the positive class
        f[:, 0, : FILTERS // 2] = 1.0 / len(f)
    sums = [np.full(f.shape, 1e-3, np.float32) for f in filters]
    biases = np.full(FILTERS * len(WIDTHS), 0.05, np.float32)
    weights = (np.abs(rng.standard_normal(len(biases))) * 0.3).astype(np.float32)
    wsum, bias, bsum = np.full(len(weights), 1e-3, np.float32), 0.0, 1e-3
    local = {k: place[rows[k].T] for k in chosen if len(rows[k])}
    order = np.array(sorted(local))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in order:
            own, y = local[k], truth[k]
            embedded = table.take(own[0], axis=0)
            for more in own[1:]:
                embedded += table.take(more, axis=0)
            top, where = maxima(embedded, filters, biases)
            p = 1 / (1 + np.exp(-np.clip(top @ weights + bias, -30, 30)))
            g = float(p - y) * (1.0 if y else min(1.0, n_pos / n_neg))
            gtop = g * weights * (top > 0)
            gw = g * top + DECAY * weights
            wsum += gw * gw
            weights -= RATE * gw / np.sqrt(wsum)
            bsum += g * g
            bias -= RATE * g / bsum**0.5
            biases -= 0.01 * gtop
            if abs(g) < SURE:
                continue
            for b, f in enumerate(filters):
                gf = gtop[b * FILTERS : (b + 1) * FILTERS]
                for j in range(len(f)):
                    at = where[b] + j
                    met = np.flatnonzero((gf != 0) & (at < own.shape[1]))
                    if not len(met):
                        continue
                    gk = gf[met, None] * embedded[at[met]]
                    ge = gf[met, None] * f[j][:, met].T
                    sums[b][j][:, met] += (gk * gk).T
                    f[j][:, met] -= 0.3 * RATE * (gk / np.sqrt(sums[b][j][:, met].T)).T
                    for column in own[:, at[met]]:
                        live = column < len(seen)
                        r, ger = column[live], ge[live] + DECAY * table[column[live]]
                        np.add.at(grads, r, (ger * ger).sum(axis=1))
                        np.add.at(table, r, -RATE * ger / np.sqrt(grads[r])[:, None])
    return Cnn(seen, table[:-1], filters, biases, weights, bias, [0.5] * len(GROUPS))


def best_threshold(raw, truth, counts) -> float:
    """Logit of greatest F1, rows counted by ``counts``, in the middle of the gap around it."""
    import numpy as np

    order = np.argsort(-raw, kind="stable")
    hits, taken = np.cumsum((truth * counts)[order]), np.cumsum(counts[order])
    f1 = 2 * hits / (taken + (truth * counts).sum())
    k = int(f1.argmax())
    lower = raw[order[k + 1]] if k + 1 < len(order) else raw[order[k]] - 1
    return float((raw[order[k]] + lower) / 2)


def logit(model: Cnn, embedded, n: int) -> float:
    """Of a text of n words; ``embedded(a, b)`` gives the embeddings of words a to b."""
    import numpy as np

    top, reach = np.maximum(model.biases, 0) * 0, max(WIDTHS) - 1
    # a later block of fewer words than the widest filter would add part windows only: the block before covers it
    for at in range(0, max(min(n, 1), n - reach), BLOCK_WORDS):
        found, _ = maxima(embedded(at, at + BLOCK_WORDS + reach), model.filters, model.biases)
        top = np.maximum(top, found)
    return float(top @ model.weights + model.bias)


def calibrated(raw: float, threshold: float) -> float:
    """Probability scale on which the group's threshold lies at ``THRESHOLD``."""
    import math

    shift = math.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw - threshold + shift))))


def score_texts(model: Cnn, vectors: _Vectors, texts: list[str | None]) -> list[float]:
    """Calibrated score of each whole text."""
    found = [vectors.read(model, text) for text in texts]
    return [calibrated(raw, model.thresholds[group]) for raw, group in found]


def _score(shipped, token: str):
    def run(batches):
        import pyarrow as pa

        memory.claim("toxicity")
        model = shipped.value
        if model and token not in _WORKER:
            _WORKER.clear()
            _WORKER[token] = _Vectors(model.table())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = score_texts(model, _WORKER[token], texts) if model else [0.0] * len(texts)
            kept = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], names=[*names, "score", "predicted"])

    return run


def within(lengths: list[int], most: int) -> list[int]:
    """Places of the texts that fit into ``most`` code points, taken in order; one that does not fit is passed over."""
    taken, held = [], 0
    for k, n in enumerate(lengths):
        if held + n <= most:
            taken.append(k)
            held += n
    return taken


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS, most: int = TRAIN_CHARS) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """A bounded part of the labelled documents outside the held-out fold, and what a row of class 0 and 1 stands for.

    Of each class at most about ``bound``, chosen by a hash of the id, and at most ``most`` code points of whole texts.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(doc_crc(), F.lit(4)) != 2))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000)).cast("double") / 1_000_000
    shares = [min(1.0, bound / max(1, sizes.get(y, 0))) for y in (0, 1)]
    drawn = usable.select("doc_id", "toxic", draw.alias("draw"))
    chosen = materialize(drawn.where(F.col("draw") < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])), "toxic-sample")
    # the sample is bounded by its parameter, so its ids may be sent to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("draw").alias("draw"))
    kept = materialize(one.withColumn("length", F.length("text")), "toxic-texts")
    known = sorted((r["draw"], r["doc_id"], r["toxic"], r["length"]) for r in kept.drop("text").collect())
    stands, ids = [1 / share for share in shares], []
    for y in (0, 1):
        own = [r for r in known if r[2] == y]
        taken = within([r[3] for r in own], most)
        ids += [own[k][1] for k in taken]
        stands[y] *= len(own) / max(1, len(taken))
    fit_in = kept if len(ids) == len(known) else kept.where(F.col("doc_id").isin(ids))
    rows = fit_in.select("doc_id", "text", "toxic").orderBy("doc_id")
    return [(r["text"], int(r["toxic"])) for r in rows.toLocalIterator()], (stands[0], stands[1])


def training_set(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of all labelled documents outside the held-out fold; one text of each id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.pmod(doc_crc(), F.lit(4)) != 2))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.pmod(doc_crc(), F.lit(4)) != 2)).join(usable, "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))
    return one.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(FOLDS)).cast("int"))


def _counted(batches):
    """Documents of each fold and class by table row."""
    import numpy as np
    import pyarrow as pa

    met, known, rows = np.zeros((BUCKETS + 1, 2 * FOLDS), np.int32), _Numbers(), np.zeros((CACHE_WORDS, 1 + len(BEGINNINGS)), np.int64)
    for batch in batches:
        for t, f, y in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
            words, own = list(set(letter_words(t))), []
            for k in range(0, len(words), BLOCK_WORDS):
                block = words[k : k + BLOCK_WORDS]
                if len(known) + len(block) > CACHE_WORDS:
                    known.renew()
                found, at = known.of(block), known.filled
                rows[at : len(known)] = known.new()
                own.append(rows[found].ravel())
            if own:
                met[np.concatenate(own), 2 * f + y] += 1  # a row that is met again is not counted again
    at = np.flatnonzero(met[:BUCKETS].any(axis=1))
    for k in range(0, len(at), 10_000):
        own = at[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *(pa.array(met[own, c], pa.int64()) for c in range(2 * FOLDS))], names=["at", *(f"n{c}" for c in range(2 * FOLDS))])


def _whole(shared, folds: list[int]):
    """What ``_train`` needs of all rows of these folds."""
    at, counts, sizes = shared
    return (at, *(sum(counts[:, 2 * f + y] for f in folds) for y in (1, 0)), *(sum(sizes[2 * f + y] for f in folds) for y in (1, 0)))


def _first(whole):
    """The embeddings that a shard of such rows begins with."""
    import numpy as np

    return _start(np.random.default_rng(SEED), *whole[1:3], max(1, whole[3]), max(1, whole[4]))[:-1]


def _dense(model: Cnn):
    import numpy as np

    return np.concatenate([*(f.ravel() for f in model.filters), model.biases, model.weights, [model.bias]]).astype(np.float64)


def _with_dense(model: Cnn, flat) -> None:
    import numpy as np

    at, flat = 0, np.asarray(flat)
    for b, f in enumerate(model.filters):
        model.filters[b] = flat[at : at + f.size].reshape(f.shape).astype(np.float32)
        at += f.size
    n = len(model.biases)
    model.biases, model.weights, model.bias = flat[at : at + n].astype(np.float32), flat[at + n : at + 2 * n].astype(np.float32), float(flat[-1])


def _trained(shipped):
    """A shard's model: how far embeddings moved, in blocks, weighted; place -1 has all else."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        memory.claim("toxicity")
        table = table.sort_by("doc_id")
        shard, fold = table.column("shard")[0].as_py(), table.column("fold")[0].as_py()
        truth, chosen = np.array(table.column("toxic").to_pylist()), np.arange(table.num_rows)
        rows = word_rows(letter_words(t) for t in table.column("text").to_pylist())
        whole = _whole(shipped.value, [fold])
        model = _train(rows, truth, chosen, whole)
        moved = (model.values - _first(whole)) * sum(document_counts(rows, truth, chosen))[model.rows].astype(np.float32)[:, None]
        places = [k for k in range(0, len(moved), BLOCK_ROWS) if moved[k : k + BLOCK_ROWS].any()]
        out = [(fold, k // BLOCK_ROWS, shard, moved[k : k + BLOCK_ROWS].tobytes()) for k in places]
        out.append((fold, -1, shard, (_dense(model) * len(chosen)).tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["fold", "place", "shard", "moved"])

    return run


def _summed(table):
    """The shards' blocks of one place added up, in the order of the shards."""
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("shard")
    kind, total = (np.float64 if table.column("place")[0].as_py() < 0 else np.float32), 0.0
    for block in table.column("moved"):
        total = total + np.frombuffer(block.as_py(), kind).astype(np.float64)
    return pa.table([table.column("fold").slice(0, 1), table.column("place").slice(0, 1), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["fold", "place", "moved"])


def _judged(shipped):
    """Group, class and logit, in steps, of every row by the model that has not seen its fold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memory.claim("toxicity")
        models = shipped.value
        full = np.zeros((BUCKETS + 1, DIM * len(models)), np.float32)
        for k, m in enumerate(models):
            full[m.rows, DIM * k : DIM * (k + 1)] = m.values
        vectors = _Vectors(full)
        for batch in batches:
            found = [vectors.read(models[f], t, f) for f, t in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            steps = np.rint(np.clip([raw for raw, _ in found], -30, 30) * GRID)
            yield pa.RecordBatch.from_arrays([pa.array([g for _, g in found], pa.int32()), batch.column("toxic"), pa.array(steps.astype(np.int64), pa.int32())], names=["group", "toxic", "step"])

    return run


def _mean(shared, moved: dict, dense: dict, folds: list[int]) -> Cnn:
    """The mean of the shards of these folds: their documents' first embeddings, moved as the shards moved their own on average."""
    import numpy as np

    whole = _whole(shared, folds)
    seen = np.flatnonzero(whole[1] + whole[2] >= MIN_DOCS)  # as in _train
    values = sum(moved[f] for f in folds)[seen]
    values /= (whole[1] + whole[2])[seen, None].astype(np.float32)
    values += _first(whole)[seen]
    nothing = np.zeros(0, np.int64)
    model = _train([], nothing, nothing, (nothing, nothing, nothing, 1, 1))  # of the right shapes
    model.rows, model.values = whole[0][seen], values
    if learned := [f for f in folds if f in dense]:
        _with_dense(model, sum(dense[f] for f in learned) / sum(sum(shared[2][2 * f : 2 * f + 2]) for f in learned))
    return model


def fit_shards(kept: DataFrame, shards: int) -> Cnn:
    """Train on all rows of ``kept`` (doc_id, text, toxic, fold), in ``shards`` or a few more, and calibrate."""
    import numpy as np

    spark = kept.sparkSession
    names = [f"n{c}" for c in range(2 * FOLDS)]
    counted = kept.mapInArrow(_counted, ", ".join(f"{n} long" for n in ["at", *names])).groupBy("at").agg(*[F.sum(n).alias(n) for n in names])
    counted = counted.where(sum((F.col(n) for n in names), F.lit(0)) >= MIN_DOCS).toArrow().sort_by("at")
    found = np.stack([counted.column(n).to_numpy().astype(np.int32) for n in names], axis=1)
    sizes = [0] * (2 * FOLDS)
    for r in kept.groupBy("fold", "toxic").count().collect():
        sizes[2 * r["fold"] + r["toxic"]] = r["count"]
    shared = (counted.column("at").to_numpy(), found, sizes)
    del counted
    shipped = spark.sparkContext.broadcast(shared)
    drawn = F.pmod(F.xxhash64(F.lit("shard"), F.col("doc_id").cast("string")), F.lit(-(-shards // FOLDS)))
    dealt = kept.withColumn("shard", (F.col("fold") + FOLDS * drawn).cast("int")).repartition(4 * shards, "shard")
    blocks = dealt.groupBy("shard").applyInArrow(_trained(shipped), "fold int, place int, shard int, moved binary")
    total = blocks.groupBy("fold", "place").applyInArrow(_summed, "fold int, place int, moved binary").toArrow()
    moved, dense = {f: np.zeros((len(found), DIM), np.float32) for f in range(FOLDS)}, {}
    for f, p, block in zip(*(total.column(c) for c in ("fold", "place", "moved")), strict=True):
        f, k, block = f.as_py(), p.as_py() * BLOCK_ROWS, block.as_buffer()
        if k < 0:
            dense[f] = np.frombuffer(block, np.float64)
        else:
            moved[f][k : k + BLOCK_ROWS] = np.frombuffer(block, np.float32).reshape(-1, DIM)
    del total, block
    models = [_mean(shared, moved, dense, [f for f in range(FOLDS) if f != m]) for m in range(FOLDS + 1)]
    shipped.destroy()
    del moved, shared, found
    memory.release()
    judges = spark.sparkContext.broadcast(models[:FOLDS])
    steps = kept.mapInArrow(_judged(judges), "group int, toxic int, step int").groupBy("group", "toxic", "step").count()
    # clean rows first among equal logits: a threshold never parts those
    counts = steps.orderBy("toxic", "group", "step").toArrow()
    judges.destroy()
    group, truth, step, n = (counts.column(c).to_numpy() for c in ("group", "toxic", "step", "count"))
    calibrate(models[FOLDS], step / GRID, truth, group, n.astype(np.float64), n)
    return models[FOLDS]


def learn(docs: DataFrame, labels: DataFrame) -> Cnn | None:
    """The model of all labelled documents outside the held-out fold; None without both classes."""
    kept = materialize(training_set(docs, labels), "toxic-texts")
    size = kept.agg(F.sum(F.length("text")).alias("chars"), F.count_distinct("toxic").alias("classes")).first()
    if size["classes"] < 2:
        return None
    shards = -(-size["chars"] // SHARD_CHARS)
    if shards > 1:
        return fit_shards(kept, shards)
    return fit([(r["text"], r["toxic"]) for r in kept.orderBy("doc_id").toLocalIterator()])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document; ``held_out`` marks the fold never learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    model = learn(docs, labels)
    shipped = spark.sparkContext.broadcast(model)
    del model
    memory.release()
    held = F.coalesce(F.pmod(doc_crc(), F.lit(4)) == 2, F.lit(False)).alias("held_out")
    token = f"{spark.sparkContext.applicationId}/{shipped._jbroadcast.id()}"
    return docs.select("doc_id", held, "text").mapInArrow(_score(shipped, token), "doc_id long, held_out boolean, score double, predicted int")
