"""Repeated passages by sparse suffix arrays.

Of each document's words, only the suffixes at minimiser positions are kept: in every window of ``LENGTH`` words the
position of the smallest hash of ``GRAM`` consecutive words. The choice depends on the content alone, so two copies of a
passage of ``LENGTH`` words keep at least one suffix at the same place in it. Suffixes whose first words occur once are
dropped by a count; the others get their next and previous ``LENGTH`` words, are sorted over the cluster, and each is compared with its
``DEPTH`` neighbours on either side of the sorted order: the common words to the right and to the left, together at least ``LENGTH``, are a
repeated passage. Longer passages come out as the union of what their suffixes find. A second sort, by the words to the
left, finds what the first leaves between suffixes that share much to the right but little to the left.

In a group of at most ``DEPTH`` + 1 suffixes with the same first words all meet each other. In a larger one (a frequent line)
neighbours may hide each other, so there every window of ``LENGTH`` words whose kept suffix is of the group is counted by its
hash as well, with map-side sums: those seen twice are repeated. A window has one kept suffix, so it is counted once.

The sort key ends with the document, so equal suffixes (thousands of copies) are spread over the tasks too; the first
and last suffixes of each task are compared across tasks in a second, small step. Words are compared by 32-bit hashes
beyond the 64-bit hash of the first words.

Edge cases: null texts and texts of fewer than ``LENGTH`` words have no passage; a passage repeated inside one document
counts; repeated rows repeat each other; very long texts are cut into no pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import ascii_words, column, fresh, numbered, settle, texts, values

LENGTH, GRAM = 50, 8
#: Words whose hashes a task keeps.
CACHE = 500_000
#: Suffixes further on in the sorted order that each suffix is compared with.
DEPTH = 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of words, kept for those seen lately."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = digest(w)
        return np.array([known[w] for w in words], np.uint64)


def gram_hashes(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` words from each position on."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def owners(grams: np.ndarray, window: int) -> np.ndarray:
    """Position of the (first) smallest hash in each run of ``window`` hashes."""
    found = []
    for at in range(0, len(grams) - window + 1, 1 << 15):
        part = grams[at : at + (1 << 15) + window - 1]
        found.append(np.lib.stride_tricks.sliding_window_view(part, window).argmin(1) + np.arange(len(part) - window + 1) + at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the smallest of some run of ``window`` hashes."""
    return np.unique(owners(grams, window))


def _sparse(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            rows, grams, places = [], [], []
            for row, text in zip(values(batch.column("row")), texts(batch, "text"), strict=True):
                words = ascii_words(text)
                if len(words) < length:
                    continue
                own = gram_hashes(hashed(words))
                at = minimisers(own, length - GRAM + 1)
                rows.append(np.full(len(at), row))
                grams.append(own[at])
                places.append(at)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], names=["row", "gram", "at"])

    return run


SUFFIX = "row long, gram long, at int, right binary, left binary"


def _suffixes(length: int):
    """The words after (right) and before (left, nearest first) each kept position, as 32-bit hashes; without words, the
    windows (hash and place) whose kept position is of a large group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            out: list[tuple] = []
            for row, text, places in zip(values(batch.column("row")), texts(batch, "text"), values(batch.column("places")), strict=True):
                whole = hashed(ascii_words(text))
                large = np.array([p["at"] for p in places if p["large"]], np.int64)
                if len(large):
                    yield _windows(row, whole, large, length)
                h = whole & np.uint64(0xFFFFFFFF)
                ahead, back = h.astype(">u4").tobytes(), h[::-1].astype(">u4").tobytes()
                n = len(h)
                for p in places:
                    at = p["at"]
                    out.append((row, p["gram"], at, ahead[4 * at : 4 * (at + length)], back[4 * (n - at) : 4 * (n - at + length)]))
                if len(out) >= 20_000:
                    yield _suffix_batch(out)
                    out = []
            if out:
                yield _suffix_batch(out)

    return run


def _windows(row: int, words: np.ndarray, large: np.ndarray, length: int) -> pa.RecordBatch:
    at = np.flatnonzero(np.isin(owners(gram_hashes(words), length - GRAM + 1), large))
    none = pa.nulls(len(at), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(gram_hashes(words, length)[at].view(np.int64)), pa.array(at.astype(np.int32)), none, none], names=["row", "gram", "at", "right", "left"])


def _suffix_batch(out: list[tuple]) -> pa.RecordBatch:
    row, gram, at, right, left = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(gram, pa.int64()), pa.array(at, pa.int32()), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names=["row", "gram", "at", "right", "left"])


def padded(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes as a table of ``length`` columns, and how many of them are there."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
    return np.frombuffer(b"".join(w.ljust(4 * length, b"\0") for w in words), ">u4").reshape(len(words), length), sizes


def common(table: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of leading words that rows i and j share."""
    same = table[i] == table[j]
    first = np.where(same.all(1), table.shape[1], (~same).argmax(1))
    return np.minimum(first, np.minimum(sizes[i], sizes[j]))


FOUND = "row long, start int, end int, later boolean, gram long, at int, right binary, left binary"


def _pairs(table: dict[str, list], length: int) -> pa.RecordBatch:
    """Passages of both sides of each pair of near neighbours and, marked ``later``, once more that of the side which
    comes second in (row, place)."""
    row, gram, at = (np.array(table[c], np.int64) for c in ("row", "gram", "at"))
    right, left = padded(table["right"], length), padded(table["left"], length)
    out = []
    for d in range(1, min(DEPTH, len(row) - 1) + 1):
        i = np.flatnonzero(gram[d:] == gram[:-d])
        reach, back = common(*right, i, i + d), common(*left, i, i + d)
        good = reach + back >= length
        i, j, reach, back = i[good], i[good] + d, reach[good], back[good]
        out += [(row[k], at[k] - back, at[k] + reach, np.zeros(len(k), bool)) for k in (i, j)]
        swap = (row[i] > row[j]) | ((row[i] == row[j]) & (at[i] > at[j]))
        one, two = np.where(swap, j, i), np.where(swap, i, j)
        # What comes second in a text of repetitions begins where the first ends.
        start = np.where(row[one] == row[two], np.maximum(at[two] - back, at[one] + reach), at[two] - back)
        out.append((row[two], start, at[two] + reach, np.ones(len(two), bool)))
    found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    # Of the passages of one row and end, the longest is enough.
    order = np.lexsort((found[1], found[3], found[2], found[0]))
    found = [c[order] for c in found]
    new = np.r_[True, (found[0][1:] != found[0][:-1]) | (found[2][1:] != found[2][:-1]) | (found[3][1:] != found[3][:-1])][: len(order)]
    rows, start, end, later = (c[new] for c in found)
    none = pa.nulls(len(rows))
    columns = [rows, start.astype(np.int32), end.astype(np.int32), later]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary())], names=["row", "start", "end", "later", "gram", "at", "right", "left"])


def _border(table: dict[str, list]) -> pa.RecordBatch:
    """Suffixes at the border of a task; they have no passage."""
    kinds = {"row": pa.int64(), "start": pa.int32(), "end": pa.int32(), "later": pa.bool_(), "gram": pa.int64(), "at": pa.int32(), "right": pa.binary(), "left": pa.binary()}
    n = len(table["row"])
    return pa.RecordBatch.from_arrays([pa.array(table.get(c, [None] * n), kind) for c, kind in kinds.items()], names=list(kinds))


def _neighbours(length: int, borders: bool):
    """Compare each suffix of a sorted stream with the next ones; yields passages and, if asked, the suffixes at its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, list] | None = None
        head = seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = {c: batch.column(c).to_pylist() for c in ("row", "gram", "at", "right", "left")}
            seen += batch.num_rows
            if last is not None:
                table = {c: last[c] + table[c] for c in table}
            elif borders:
                head = min(DEPTH, batch.num_rows)
                yield _border({c: v[:DEPTH] for c, v in table.items()})
            yield _pairs(table, length)
            last = {c: v[-DEPTH:] for c, v in table.items()}
        if last is not None and borders:
            # Of a task with few suffixes, those of its head are there already.
            new = min(DEPTH, seen - head)
            yield _border({c: v[len(v) - new :] for c, v in last.items()})

    return run


def passages(part: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, start, end, later): stretches of words, of at least ``length`` each, of the texts of ``part`` (row, text) that
    occur elsewhere too; those that occur before are there once more, with ``later``."""
    sparse = settle(part.mapInArrow(_sparse(length), "row long, gram long, at int"), "minimisers")
    # Written, so that both sides of the join are dealt anew and a very frequent gram can be split.
    repeated = settle(sparse.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > DEPTH + 1).alias("large")), "repeated")
    kept = sparse.join(repeated, "gram").groupBy("row").agg(F.collect_list(F.struct("at", "gram", "large")).alias("places"))
    found = settle(part.join(kept, "row").mapInArrow(_suffixes(length), SUFFIX), "suffixes")
    suffixes, windows = found.where("right IS NOT NULL"), found.where("right IS NULL").select("row", "gram", "at")
    out = _counted(windows, length)
    for first, second in (("right", "left"), ("left", "right")):
        order = ["gram", first, second, "row", "at"]
        found = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(length, True), FOUND)
        found = settle(found, "passages")
        across = found.where("start IS NULL").select("row", "gram", "at", "right", "left").repartition(1).sortWithinPartitions(*order)
        across = across.mapInArrow(_neighbours(length, False), FOUND)
        both = found.where("start IS NOT NULL").select("row", "start", "end", "later").unionByName(across.select("row", "start", "end", "later"))
        out = out.unionByName(both)
    return out


def _counted(windows: DataFrame, length: int) -> DataFrame:
    """(row, start, end, later) of the windows (row, gram, at) whose hash is there twice."""
    place = F.struct("row", "at")
    # Written, so that both sides of the join are dealt anew and a very frequent window can be split.
    twice = settle(windows.groupBy("gram").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("gram", "first"), "windows")
    hit = windows.join(twice, "gram")
    end = (F.col("at") + length).cast("int")
    every = hit.select("row", F.col("at").alias("start"), end.alias("end"), F.lit(False).alias("later"))
    # What comes second in a text of repetitions begins where the first ends.
    start = F.when(F.col("first.row") == F.col("row"), F.greatest("at", F.col("first.at") + length)).otherwise(F.col("at"))
    again = hit.where(place > F.col("first")).select("row", start.cast("int").alias("start"), end.alias("end"), F.lit(True).alias("later"))
    return every.unionByName(again.where("start < end"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each row, those that touch joined."""
    for batch in batches:
        spans = batch.column("all")
        row = np.repeat(np.arange(len(spans), dtype=np.int64), spans.value_lengths().to_numpy(zero_copy_only=False))
        start, end = (spans.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) + (row << 32) for c in ("start", "end"))
        order = np.argsort(start, kind="stable")
        row, start, upto = row[order], start[order], np.maximum.accumulate(end[order])
        first = np.r_[True, start[1:] > upto[:-1]][: len(start)]
        last = np.r_[first[1:], True][: len(start)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        low = np.int64((1 << 32) - 1)
        pairs = pa.StructArray.from_arrays([pa.array((start[first] & low).astype(np.int32)), pa.array((upto[last] & low).astype(np.int32))], ["start", "end"])
        offsets = np.searchsorted(row[first], np.arange(len(spans) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(kind)], names=["row", "spans"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_words, n_repeated, spans) of each row of ``docs``: words, those inside repeated passages, and the passages as
    spans of words."""
    (row,) = fresh(docs, "row")
    text = column(docs, text_col).cast("string")
    rows = numbered(docs, row)
    ids = rows.select(F.col(row).alias("row"), column(docs, id_col).alias("id"), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words"))
    found = passages(rows.select(F.col(row).alias("row"), text.alias("text")), length)
    out = ids.join(_by_row(found.where("NOT later")), "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return out.select("id", "n_words", covered.alias("n_repeated"), "spans")


def _by_row(spans: DataFrame) -> DataFrame:
    by = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("all"))
    return by.mapInArrow(_merge, T.StructType([T.StructField("row", T.LongType()), T.StructField("spans", SPANS)]))


def cut_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without passages that a neighbour in the suffix order has earlier; the first occurrence of every passage
    stays. Columns are unchanged; a line break marks each cut."""
    row, spans = fresh(docs, "row", "spans")
    rows = numbered(docs, row)
    found = passages(rows.select(F.col(row).alias("row"), column(docs, text_col).cast("string").alias("text")), length)
    found = _by_row(found.where("later")).select(F.col("row").alias(row), F.col("spans").alias(spans))
    out = rows.join(found, row, "left")
    at, span_at = out.columns.index(text_col), out.columns.index(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            each = zip(columns[at].to_pylist(), columns[span_at].to_pylist(), strict=True)
            columns[at] = pa.array([cut_words(t, s) if s else t for t, s in each], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(run, out.schema).select(*[column(docs, c) for c in docs.columns])


def cut_words(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the words of the spans."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    ends = [0, *(places[s["end"] - 1][1] for s in spans)]
    starts = [*(places[s["start"]][0] for s in spans), len(raw)]
    return "\n".join(p for p in (raw[a:b].decode().strip() for a, b in zip(ends, starts, strict=True)) if p)


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least fifty words of every document that occur elsewhere in the corpus."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
