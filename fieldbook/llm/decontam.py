"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) and fed word by word into one
automaton. Document words stream through it while the length of the longest match that ends at each word is tracked; a
word inside an occurrence of a window (``window`` consecutive item words; a shorter item is one window as a whole) is hit.
Stretches in which no pair of neighbouring words occurs in any item cannot reach a window and are passed over with numpy.

The automaton is sent to the tasks, so its size is bounded: items are dealt into shards of at most ``SHARD_BYTES`` of
text, one automaton each, and every further shard is one more pass that adds its spans to the row. No shuffle is needed.

Edge cases: a null or blank text has no words and no hits; a null or blank item never occurs; repeated items count once
per id; a null item id is left out of the digest, but its words are hit; repeated documents stay repeated; empty tables
give empty results or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import column, fresh, settle, texts, values

WINDOW = 10
#: Text of one automaton, in bytes: about 60 MB of Python objects in a task.
SHARD_BYTES = 1_000_000
#: Passes that run in one stage before the rows are written.
PASSES = 4
#: A document is dropped as a whole when more than this share of its words is hit.
COVERAGE = 0.5

_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_UPPER = bytes(range(0x41, 0x5B))
#: A-Z to a-z, every other separator to a blank.
_FOLD = bytes(c + 32 if c in _UPPER else 32 if c in _SEPARATORS else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows each state stands for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.number.setdefault(w, len(self.number) + 1) for w in ws]) for item, ws in items if ws]
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        #: state at a window's end → {window length: item ids}
        self.ends: dict[int, dict[int, set[str | None]]] = {}
        pairs = set()
        for item, code in coded:
            size = min(window, len(code))
            pairs.update(zip(code, code[1:], strict=False))
            for end, state in self._windows(code, size):
                self.ends.setdefault(state, {}).setdefault(size, set()).add(item)
        self.base = len(self.number) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.least = min((min(window, len(code)) for _, code in coded), default=0)
        #: for each state, the states up its suffix links that end a window
        self.marks = self._marks()

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            matched = self.length[state]
        if c in nxt[state]:
            return nxt[state][c], matched + 1
        return 0, 0

    def _windows(self, code: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(end, state that holds the window) for each window of ``size`` words."""
        state = matched = 0
        for end, c in enumerate(code):
            state, matched = self._step(state, matched, c)
            if end + 1 >= size:
                holder = state
                while self.length[self.link[holder]] >= size:
                    holder = self.link[holder]
                yield end, holder

    def _marks(self) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = out[self.link[state]]
            out[state] = (state, *above) if state in self.ends else above
        return out

    def longest(self, code: list[int]) -> list[int]:
        """Length of the longest match that ends at each word."""
        state = matched = 0
        out = []
        for c in code:
            state, matched = self._step(state, matched, c)
            out.append(matched)
        return out

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged hit spans [start, end) of a document's words, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if not self.least or len(found) < self.least:
            return spans, items
        get = self.number.get
        code = np.array([get(w, 0) for w in found], np.int64)
        for s, e in self._stretches(code):
            state = matched = 0
            for at, c in enumerate(code[s:e].tolist(), s):
                state, matched = self._step(state, matched, c)
                longest = 0
                for mark in self.marks[state]:
                    for size, ids in self.ends[mark].items():
                        if size <= matched:
                            longest = max(longest, size)
                            items |= ids
                if longest:
                    start = at + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, items

    def _stretches(self, code: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words whose neighbours all occur as neighbours in some item, long enough for a window."""
        if self.least == 1:
            ok = code > 0
            joined = np.zeros(max(len(code) - 1, 0), bool) | (ok[1:] & ok[:-1])
        else:
            ok = np.ones(len(code), bool)
            joined = np.zeros(max(len(code) - 1, 0), bool)
            if len(self.pairs):
                key = code[:-1] * self.base + code[1:]
                at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                joined = (self.pairs[at] == key) & (code[:-1] > 0) & (code[1:] > 0)
        cuts = np.flatnonzero(~joined) + 1
        bounds = np.r_[0, cuts, len(code)]
        size = np.diff(bounds)
        for k in np.flatnonzero(size >= self.least).tolist():
            if size[k] > 1 or ok[bounds[k]]:
                yield int(bounds[k]), int(bounds[k + 1])


def shards(items: DataFrame, id_col: str, text_col: str, most: int = SHARD_BYTES) -> list[DataFrame]:
    """The items in parts of at most about ``most`` bytes of text (a single longer item is a part of its own)."""
    part = items.select(column(items, id_col).cast("string").alias("item"), column(items, text_col).cast("string").alias("text"))
    total = part.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most)
    if n <= 1:
        return [part]
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("text", "item"), F.lit(2 * n)))
    return [dealt.where(F.col("shard") == k).drop("shard") for k in range(2 * n)]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, coverage: float | None = None) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns, whose names come back with it: the number of words, the hit spans (in words,
    merged) and the sorted ids of the items with occurring windows.

    With ``coverage``, the last pass also acts on what was found: rows of which more is hit go, and hit spans are cut out
    of the other texts."""
    names = fresh(docs, "n_words", "spans", "items")
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.array().cast(SPAN), names[2]: F.array().cast("array<string>")})
    schema = out.schema
    at = [schema.fieldNames().index(n) for n in names]
    text_at = docs.columns.index(text_col)
    parts = shards(items, item_id, item_text, shard_bytes)
    for k, part in enumerate(parts):
        rows = [(r.item, None if r.text is None else r.text.encode()) for r in part.collect()]
        shared = docs.sparkSession.sparkContext.broadcast(vars(Automaton([(item, words(text)) for item, text in rows], window)))
        out = out.mapInArrow(_pass(shared, text_at, at, coverage if k == len(parts) - 1 else None), schema)
        if k % PASSES == PASSES - 1 and k < len(parts) - 1:
            out = settle(out, "spans")
    return out, names


def _pass(shared: Broadcast, text_at: int, at: list[int], coverage: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton.__new__(Automaton)
        vars(auto).update(shared.value)
        for batch in batches:
            n_words, spans, items = [], [], []
            before = zip(values(batch.column(at[1])), values(batch.column(at[2])), strict=True)
            for text, (old, ids) in zip(texts(batch, text_at), before, strict=True):
                found = words(text)
                new, hit = auto.scan(found)
                n_words.append(len(found))
                spans.append([{"start": s, "end": e} for s, e in _merged(new + [(x["start"], x["end"]) for x in old])])
                items.append(sorted({*ids, *(i for i in hit if i is not None)}))
            columns = list(batch.columns)
            columns[at[0]] = pa.array(n_words, pa.int64())
            columns[at[1]] = pa.array(spans, SPAN_ARROW)
            columns[at[2]] = pa.array(items, pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield out if coverage is None else _acted(out, text_at, at, coverage)

    return run


def _acted(batch: pa.RecordBatch, text_at: int, at: list[int], coverage: float) -> pa.RecordBatch:
    """Without the rows of which more than ``coverage`` is hit, and with the hit spans of the others cut out."""
    spans = [[(s["start"], s["end"]) for s in x] for x in values(batch.column(at[1]))]
    hit = [sum(e - s for s, e in x) for x in spans]
    keep = [h <= n * coverage for h, n in zip(hit, values(batch.column(at[0])), strict=True)]
    if any(hit):
        columns = list(batch.columns)
        columns[text_at] = pa.array([cut_words(t, x) for t, x in zip(values(batch.column(text_at)), spans, strict=True)], pa.string())
        batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return batch.filter(pa.array(keep, pa.bool_()))


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of the spans (and what stands between them); a line break marks each cut."""
    if not text or not spans:
        return text
    raw = text.encode()
    folded = raw.translate(_FOLD)
    found = folded.split()
    places, at = [], 0
    for w in found:
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    ends = [0, *(places[e - 1][1] for _, e in spans)]
    starts = [*(places[s][0] for s, _ in spans), len(raw)]
    return "\n".join(p for p in (raw[a:b].decode().strip() for a, b in zip(ends, starts, strict=True)) if p)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, n_chars: str | None = None) -> DataFrame:
    """``docs`` with hit spans cut out of the texts; a document of which more than ``coverage`` of the words is hit goes.

    Clean documents pass unchanged. Columns stay as they are; ``n_chars``, if named, is set anew where the text changed.
    """
    found, (n_words, spans, _) = find_spans(docs, items, text_col, window, coverage=coverage)
    if n_chars:
        changed = F.when(F.size(spans) > 0, F.length(column(found, text_col)).cast(docs.schema[n_chars].dataType)).otherwise(column(found, n_chars))
        found = found.withColumn(n_chars, changed)
    return found.select(*[column(docs, c) for c in docs.columns])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, (n_words, spans, items) = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


#: Every window of ten item words (or the whole of a shorter item) against every run of document words.
OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM wins),
runs AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, sizes WHERE len(ws) >= size)),
met AS (SELECT r.doc_id, r.i, r.size, wins.item_id FROM runs r JOIN wins USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w.ws), 0) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
