"""Language ID by word-first backoff.

A word seen in training scores by its log frequency in each language; an unseen word
falls back to the longest known character n-grams that cover it, shorter ones only where no
longer one is known. A text's language is the one with the greatest sum over its words.

Words and n-grams are counted in Spark over the whole texts of a sample that is bounded by its number of
documents a language; all of them and all languages enter the model.

Defined results: null and letterless texts give ``und`` with score 0; with nothing to
learn from (an empty table, no lang), every text gives ``und``; rows with a null lang or id teach nothing
or as others; ties go to the language first in sorted order; very long texts are scored whole;
repeated rows are scored each; an empty table gives no rows; other columns of the input pass
through unused, and columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textguard.llm import memory
from textguard.llm.common import doc_crc, small_batches

#: Bound of the training sample: documents a language.
TRAIN_DOCS = 1500
#: Lengths of the n-grams, longest first; weight of a backoff score against a known word's.
GRAMS, BACKOFF = (5, 4, 3, 2, 1), 0.5
#: Times a word and an n-gram must be met; a word met once may be a slip of another language and is left to its n-grams.
WORD_MIN, GRAM_MIN = 2, 3
#: Added to every count.
SMOOTH = 0.2
#: Scores that one worker keeps: words times languages.
CACHE_SCORES = 1_600_000
UNKNOWN = "und"
_LETTERS = r"\p{L}+"


@dataclass
class Model:
    """Centred log frequencies: a row of scores by language for each word and each n-gram."""

    langs: list[str]
    words: dict[str, int]
    word_scores: object
    grams: dict[str, int]
    gram_scores: object

    def score(self, word: str):
        """Log-frequency per language of one lower-case word."""
        import numpy as np

        known = self.words.get(word)
        if known is not None:
            return self.word_scores[known]
        padded, at, rows = f"<{word}>", 0, []
        while at < len(padded):
            for size in GRAMS:
                found = self.grams.get(padded[at : at + size]) if at + size <= len(padded) else None
                if found is not None:
                    rows.append(found)
                    at += max(1, size - 1)
                    break
            else:
                at += 1
        return self.gram_scores[rows].mean(axis=0) * BACKOFF if rows else np.zeros(len(self.langs), np.float32)


def sample_documents(docs: DataFrame, keep: Column, bound: int = TRAIN_DOCS) -> DataFrame:
    """About ``bound`` documents of each language, all where it has fewer, chosen by a hash of the id."""
    usable = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = usable.groupBy("lang").count().collect()  # a row a language
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("langid")), F.lit(1_000_000)).cast("double") / 1_000_000
    if not sizes:
        return usable.select("lang", "text")
    shares = F.create_map(*[F.lit(x) for row in sizes for x in (row["lang"], min(1.0, bound / row["count"]))])
    return usable.where(draw < F.try_element_at(shares, "lang")).select("lang", "text")


def train(docs: DataFrame, keep: Column) -> Model:
    """Count words and n-grams of the sample in Spark; the driver gets those that are met often enough."""
    words = sample_documents(docs, keep).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0))).alias("item"))
    counts = words.groupBy("lang", "item").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit("<"), F.col("item"), F.lit(">"))
    at = lambda size: F.when(F.length(padded) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1))), lambda k: F.substring(padded, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    grams = counts.select("lang", "n", F.explode(F.concat(*map(at, GRAMS))).alias("item")).groupBy("lang", "item").agg(F.sum("n").alias("n"))

    def often(rows: DataFrame, least: int):
        both = rows.groupBy("item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).where(F.col("all") >= least)
        return both.select("item", F.explode("by").alias("b")).select("item", "b.lang", "b.n").toArrow()

    return _model(often(counts, WORD_MIN), often(grams, GRAM_MIN))


def _model(words, grams) -> Model:
    """From Arrow tables (item, lang, n)."""
    langs = sorted({*words["lang"].unique().to_pylist(), *grams["lang"].unique().to_pylist()})
    return Model(langs, *_scores(words, langs), *_scores(grams, langs))


def _scores(table, langs: list[str]):
    """Rows by item, and the smoothed log frequencies by language, centred over the languages."""
    import numpy as np
    import pyarrow as pa

    if not len(table):
        return {}, np.zeros((0, len(langs)), np.float32)
    items, place = table["item"].combine_chunks().dictionary_encode(), {lang: k for k, lang in enumerate(langs)}
    column = table["lang"].combine_chunks().dictionary_encode()
    at = np.array([place[x] for x in column.dictionary.to_pylist()])[column.indices.to_numpy()]
    counts = np.zeros((len(items.dictionary), len(langs)))
    np.add.at(counts, (items.indices.to_numpy(), at), table["n"].cast(pa.float64()).to_numpy())
    logs = np.log((counts + SMOOTH) / (np.maximum(1, counts.sum(axis=0)) + SMOOTH * len(counts)))
    return {x: k for k, x in enumerate(items.dictionary.to_pylist())}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def fit(counts: list[tuple[str, str, int]]) -> Model:
    """The model of given (lang, word, count), without Spark."""
    from collections import Counter

    import pyarrow as pa

    words, grams = Counter(), Counter()
    for lang, word, n in counts:
        words[word, lang] += n
        padded = f"<{word}>"
        for size in GRAMS:
            for k in range(len(padded) - size + 1):
                grams[padded[k : k + size], lang] += n

    def often(found: Counter, least: int):
        total = Counter()
        for (item, _), n in found.items():
            total[item] += n
        rows = [(item, lang, n) for (item, lang), n in found.items() if total[item] >= least]
        return pa.table({"item": pa.array([r[0] for r in rows], pa.string()), "lang": pa.array([r[1] for r in rows], pa.string()), "n": pa.array([r[2] for r in rows], pa.int64())})

    return _model(often(words, WORD_MIN), often(grams, GRAM_MIN))


class _Rows(dict):
    """Row of the score table for a word; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        import numpy as np

        super().__init__()
        self.most = max(1000, CACHE_SCORES // len(model.langs))
        self.model, self.table, self.used = model, np.zeros((self.most + 1, len(model.langs)), np.float32), 1

    def __missing__(self, word: str) -> int:
        row = 0
        if any(c.isalpha() for c in word):
            row = self.used
            self.table[row] = self.model.score(word)
            self.used += 1
        self[word] = row
        return row

    def rows(self, words: list[str]) -> list[int]:
        if self.used + len(words) > self.most:
            self.clear()
            self.used = 1
            if len(words) >= self.most:
                self.table.resize((len(words) + 2, self.table.shape[1]), refcheck=False)
        return [self[w] for w in words]


_SCORERS: dict[str, _Rows] = memory.keep("langid", {})


def _scorer(model: Model, token: str) -> _Rows:
    """One table of word scores per worker; that of an earlier model makes room."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = _Rows(model)
    return _SCORERS[token]


def classify(texts: list[str | None], model: Model, token: str = "") -> tuple[list[str], list[float]]:
    """Language and posterior of each whole text."""
    import re

    import numpy as np

    find, langs, scores = re.compile(r"[^\W\d_]+").findall, [], []
    scorer = _scorer(model, token) if model.langs else None
    for text in texts:
        rows = scorer.rows(find(text.lower())) if scorer is not None and text else []
        rows = np.array(rows, np.int64)
        if not (rows > 0).any():
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        total = scorer.table[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        langs.append(model.langs[best])
        scores.append(float(1.0 / np.exp(total - total[best]).sum()))
    return langs, scores


def _apply(shipped, token: str):
    def run(batches):
        import pyarrow as pa

        memory.claim("langid")
        model = shipped.value
        for batch in batches:
            langs, scores = classify(batch.column("text").to_pylist(), model, token)
            names = [*batch.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) with lang_pred and score added; columns of those names are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(_apply(shipped, str(shipped._jbroadcast.id()) + spark.sparkContext.applicationId), schema)


def predict_documents(docs: DataFrame) -> DataFrame:
    """The contract: learn outside the held-out fold, predict every document."""
    held = F.pmod(doc_crc(), F.lit(5)) == 0
    model = train(docs, ~held)
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    found = identify(rows, model).drop("text")
    del model
    memory.release()
    return found


def keep_identified(docs: DataFrame) -> DataFrame:
    """The pipeline's filter: null and letterless documents go, the rest stay unchanged, also with nothing to learn from."""
    model = train(docs, F.lit(True))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = identify(docs, model).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
    del model
    memory.release()
    return found
