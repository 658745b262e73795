"""Language identification: known words first, shorter and shorter character n-grams for the others.

A word of the model's vocabulary adds its log frequency in each language. A word outside it backs off to its character
n-grams (word borders marked): the longest order of which the model knows any decides, down to single letters. A word
of which nothing is known adds nothing. The prediction is the language with the largest sum (ties: the first by code
point); ``score`` is its share of the likelihood, the evidence of a text counting as ``EVIDENCE`` words at most.

Fitting reads a bounded sample: ``SAMPLE`` documents of each language, chosen by a hash of the id, of the ``LANGUAGES``
most frequent ones. The model holds ``WORDS`` words and ``GRAMS`` n-grams at most, so its size is bounded whatever the
corpus. Prediction covers every whole text.

Whether a text is in any learned language is not read from the score, which only compares the languages: the mean log
frequency of its trigrams (each word in the learned language that fits it best) is held
against the range of that mean in labelled documents that
were not learned from. The range is wider for short texts. It knows nothing of the number of languages.

Edge cases: a null text or one without letters gives ``und`` and score 0, and so does every text when nothing was
learned; letters of which nothing is known give the first language and a score of 1 / languages; null labels and null
ids are not learned from; repeated rows are predicted alike; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import column, fresh, settle, values

#: Documents of each language that the model is fitted on, on average.
SAMPLE = 2000
LANGUAGES, WORDS, GRAMS = 500, 60_000, 120_000
ORDERS = (5, 4, 3, 2, 1)
#: Added to every count.
SMOOTHING = 0.5
EVIDENCE = 10
#: Words outside the vocabulary whose scores a task keeps.
CACHE = 200_000
#: A document is rejected where its mean log frequency of trigrams lies so many deviations under its language's middle.
#: Of the labelled documents of sf0.1 the furthest lie at 9 to 10 (hexadecimal keys, one repeated word).
DEVIATIONS = 12.0
#: Held-out documents of a language from which on the learned ones are not needed for its range, and the trigrams from
#: which on a document counts for the spread between documents.
ENOUGH, LONG = 30, 200

_RUN = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> Counter[str]:
    """Lower-case words (runs of letters) of a text and their counts."""
    if not text:
        return Counter()
    found = Counter(_RUN.findall(text.lower()))
    for word in [w for w in found if not w.isalpha()]:  # numerals such as superscripts are no letters
        n = found.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            found[part] += n
    return found


def grams(word: str, order: int) -> list[str]:
    """N-grams of a word with marked borders; single letters without the borders."""
    if order == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


class Model:
    """Log frequencies by language: ``words`` and ``grams`` map to rows of ``table``."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table

    def backoff(self, word: str) -> np.ndarray | None:
        for order in ORDERS:
            rows = [self.grams[g] for g in grams(word, order) if g in self.grams]
            if rows:
                return self.table[rows].mean(0)
        return None

    def predict(self, text: str | None, cache: dict[str, np.ndarray | None]) -> tuple[str, float]:
        found = letters(text)
        if not found or not self.languages:
            return "und", 0.0
        rows, times, total, n = [], [], np.zeros(len(self.languages)), 0
        for word, k in found.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                times.append(k)
                n += k
                continue
            if word not in cache:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[word] = self.backoff(word)
            if (part := cache[word]) is not None:
                total += k * part
                n += k
        if rows:
            total += np.array(times, float) @ self.table[rows]
        mean = total / max(n, 1) * min(n, EVIDENCE)
        share = np.exp(mean - mean.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())

    def lowest(self) -> np.ndarray:
        """Log frequency, by language, of a trigram that is not there."""
        rows = [k for g, k in self.grams.items() if len(g) == 3]
        return self.table[rows].min(0) if rows else np.zeros(len(self.languages))

    def evidence(self, text: str | None, lowest: np.ndarray, cache: dict[str, tuple[int, float, float]]) -> tuple[int, float, float]:
        """Number of trigrams of a text's distinct words, and the means of the log frequencies of all its trigrams and of the
        squares, each word in the
        learned language that fits it best: a text in two learned languages is no foreign text."""
        n, times, total, squares = 0, 0, 0.0, 0.0
        for word, k in letters(text).items():
            part = cache.get(word)
            if part is None:
                if len(cache) >= CACHE:
                    cache.clear()
                logs = np.array([lowest if (row := self.grams.get(g)) is None else self.table[row] for g in grams(word, 3)])
                best = logs[:, int(logs.sum(0).argmax())]
                part = cache[word] = (len(best), float(best.sum()), float(best @ best))
            n += part[0]
            times += k * part[0]
            total += k * part[1]
            squares += k * part[2]
        return n, total / max(times, 1), squares / max(times, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, kind, n): words (kind 0) and, of each distinct word of a batch, n-grams (kind: order)."""
    for batch in batches:
        by: dict[str, Counter[str]] = {}
        for lang, text in zip(values(batch.column("lang")), values(batch.column("text")), strict=True):
            by.setdefault(lang, Counter()).update(letters(text))
        for lang, found in by.items():
            out = [(w, 0, k) for w, k in found.items()]
            for order in ORDERS:
                pieces: Counter[str] = Counter()
                for word, k in found.items():
                    for g in grams(word, order):
                        pieces[g] += k
                out += [(g, order, k) for g, k in pieces.items()]
            unit, kind, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(unit, pa.string()), pa.array(kind, pa.int32()), pa.array(n, pa.int64())], ["lang", "unit", "kind", "n"])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the rows for which ``learn`` holds and the label is there."""
    pool = docs.where(learn & column(docs, lang_col).isNotNull()).select(
        column(docs, lang_col).cast("string").alias("lang"), column(docs, text_col).cast("string").alias("text"),
        (F.shiftrightunsigned(F.xxhash64(column(docs, id_col)), 11) / F.lit(float(1 << 53))).alias("place"),
    )
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0)))
    upto = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, sample / r.n))])
    taken = pool.where(F.col("place") < F.try_element_at(upto, F.col("lang"))).select("lang", "text")
    counts = settle(taken.mapInArrow(_counts, "lang string, unit string, kind int, n long").groupBy("kind", "unit", "lang").agg(F.sum("n").alias("n")), "counts")
    totals = {(r.kind, r.lang): (r.n, r.units) for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n"), F.count("*").alias("units")).collect()}
    units = counts.groupBy("kind", "unit").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    words = units.where("kind = 0 AND all > 1").orderBy(F.desc("all"), "unit").limit(WORDS).select("unit", "kind", "by").toArrow()
    pieces = units.where("kind > 0 AND all > 1").orderBy(F.desc("all"), "kind", "unit").limit(GRAMS).select("unit", "kind", "by").toArrow()
    scale = np.array([[(totals.get((kind, lang)) or (0, 1))[0] + SMOOTHING * (totals.get((kind, lang)) or (0, 1))[1] for lang in languages] for kind in range(max(ORDERS) + 1)])
    table = np.concatenate([_logs(part, languages, scale) for part in (words, pieces)])
    first = words.num_rows
    return Model(languages, {u: k for k, u in enumerate(words.column("unit").to_pylist())}, {u: first + k for k, u in enumerate(pieces.column("unit").to_pylist())}, table)


def _logs(units: pa.Table, languages: list[str], scale: np.ndarray) -> np.ndarray:
    """Log frequencies (units, languages) from the counts by language of each unit."""
    table = np.zeros((units.num_rows, len(languages)))
    by = units.column("by").combine_chunks()
    if len(by):
        row = np.repeat(np.arange(len(by)), by.value_lengths().to_numpy(zero_copy_only=False))
        pairs = by.flatten()
        lang = pc.index_in(pairs.field("lang"), value_set=pa.array(languages, pairs.field("lang").type))
        table[row, lang.to_numpy(zero_copy_only=False)] = pairs.field("n").to_numpy(zero_copy_only=False)
    return np.log((table + SMOOTHING) / np.maximum(scale[units.column("kind").to_numpy()], 1.0))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with the predicted language and its score, in two more columns whose names come back with it."""
    names = fresh(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cache = Model(**shared.value), {}
        for batch in batches:
            found = [fitted.predict(t, cache) for t in values(batch.column(text_at))]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema), names


def held_out(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: CRC-32 of its id as text, modulo 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(column(docs, id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id") -> Column:
    return ~held_out(docs, id_col) & column(docs, id_col).isNotNull()


def _weigh(model: dict, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, float, float]]]]:
    """Each batch with (language, trigrams, mean, mean square) of each text; language -1: no letters."""
    fitted, cache, seen = Model(**model), {}, {}
    number, lowest = {x: k for k, x in enumerate(fitted.languages)}, fitted.lowest()
    for batch in batches:
        out = []
        for text in values(batch.column(text_at)):
            found = fitted.evidence(text, lowest, seen)
            out.append((number[fitted.predict(text, cache)[0]] if found[0] else -1, *found))
        yield batch, out


def ranges(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> np.ndarray:
    """(languages, 3): middle of the mean log frequency of trigrams in labelled documents, its variance between long
    documents, and the variance of one trigram; from a bounded sample of documents whose label is predicted, held-out
    ones where there are enough."""
    place = F.shiftrightunsigned(F.xxhash64(column(docs, id_col)), 11) / F.lit(float(1 << 53))
    lang = column(docs, lang_col).cast("string")
    pool = docs.where(lang.isin(model.languages) & column(docs, id_col).isNotNull()).select(lang.alias("lang"), column(docs, text_col).cast("string").alias("text"), held_out(docs, id_col).alias("held"), place.alias("place"))
    sizes = pool.groupBy("lang", "held").count().collect()
    upto = F.create_map(*[x for r in sizes for x in (F.lit(f"{str(r.held).lower()} {r.lang}"), F.lit(min(1.0, sample / r["count"])))])
    taken = pool.where(F.col("place") < F.try_element_at(upto, F.concat_ws(" ", F.col("held").cast("string"), "lang"))).select("lang", "held", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(shared.value["languages"])}
        for batch, found in _weigh(shared.value, 2, batches):
            rows = [(held, *f) for label, held, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found, strict=True) if f[0] == number[label]]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [("held", pa.bool_()), ("lang", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), ("squares", pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[c for c, _ in kinds])

    found = taken.mapInArrow(run, "held boolean, lang int, n long, mean double, squares double").toArrow()
    held, of, n, mean, squares = (found.column(c).to_numpy() for c in ("held", "lang", "n", "mean", "squares"))
    out = np.full((len(model.languages), 3), np.nan)
    for k in range(len(model.languages)):
        own = (of == k) & held
        if own.sum() < ENOUGH:
            own = of == k
        if not own.any():
            continue
        order = np.argsort(mean[own])
        middle = mean[own][order][np.searchsorted(np.cumsum(n[own][order]), n[own].sum() / 2)]
        far = np.abs(mean[own] - middle)[n[own] >= LONG]
        spread = 1.4826 * np.median(far) if len(far) else 0.0
        out[k] = middle, spread**2, np.median(squares[own] - mean[own] ** 2)
    return out


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", deviations: float = DEVIATIONS) -> DataFrame:
    """``docs`` without those whose language can't be told: no letters, or trigrams too rare for the predicted language;
    columns unchanged.

    Where no label at all is there to learn from, every document with letters stays.
    """
    model = fit(docs, learnable(docs, id_col), id_col, text_col, lang_col)
    if not model.languages:
        return docs.where(column(docs, text_col).rlike(r"\p{L}"))
    limits = ranges(docs, model, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _weigh(shared.value, text_at, batches):
            lang, n, mean = (np.array([f[k] for f in found]) for k in range(3))
            middle, spread, single = limits[lang.astype(int)].T
            times = np.maximum(n, 1)
            # Every letter stands in three trigrams, so a third of them counts. A language without a range rejects nothing.
            low = mean < middle - deviations * np.sqrt(spread + 3 * single / times)
            yield batch.filter(pa.array((lang >= 0) & ~low))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the three quarters that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, (lang, score) = identify(docs.select("doc_id", "text"), fit(docs, learnable(docs)))
    return found.select("doc_id", held_out(found).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
