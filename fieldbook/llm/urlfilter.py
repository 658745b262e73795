"""URL filters: all glob rules at once by a bit-parallel automaton.

A rule is a host and a path prefix (``example.net/en/``); it fits the host itself, all its subdomains and every path
that starts with the prefix. As a glob over the canonical URL (a dot, the host, a separator symbol, the path) it reads
``*.example.net<separator>/en/*``. All globs are packed into the bits of as many 64-bit words as they need; for each
symbol a mask holds the bits of the positions that read it, and one shift, one AND and one OR per symbol move every rule
of every URL of a batch forward (Shift-And with stars as positions that hold themselves).

Where several rules fit, the longest (characters of host and path) wins; of equally long ones a block. No fit: the
default verdict. The rule set is broadcast, so it may hold ``RULES`` rules at most.

Edge cases: a null URL or one without ``://`` has empty host and path and gets the default, and so does an empty host;
very long URLs are walked to their end in memory bounded by the batch; no rules give the default throughout; repeated
rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import column, texts

RULES = 100_000
DEFAULT = "allow"
#: Symbol that parts host and path; no byte has it.
SEPARATOR = 256
#: State words (URLs x words) that are moved together.
CELLS = 1 << 20

_URL = re.compile(rb"^(?s:.*?)://([^/?#]*)([^?#]*)")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query, in the order of the task.
QUERY_RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def canonical(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    found = _URL.match(url) if url else None
    return (found[1].lower(), found[2]) if found else (b"", b"")


STAR = None


def glob_of(rule: Rule) -> list[int | None]:
    """The rule as symbols; None is a star."""
    return [STAR, *f".{rule.host}".encode(), SEPARATOR, *rule.path.encode(), STAR]


class ShiftAnd:
    """Shift-And over many globs packed side by side. Every symbol of a glob is a bit; a star makes the bit before it
    hold itself (or, at the start, makes the first bit open at every symbol)."""

    def __init__(self, globs: list[list[int | None]]):
        bits = sum(sum(c is not STAR for c in g) + 1 for g in globs)  # one entry bit for each glob
        self.size = max(1, -(-bits // 64))
        self.masks = np.zeros((SEPARATOR + 1, self.size), np.uint64)
        self.hold, self.start = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.ends: list[int] = []
        at = 0
        for glob in globs:
            self._set(self.start, at)
            for c in glob:
                if c is STAR:
                    self._set(self.hold, at)
                else:
                    at += 1
                    self._set(self.masks[c], at)
            self.ends.append(at)
            at += 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def first(self, strings: list[np.ndarray]) -> list[int | None]:
        """For each string, the first glob that matches the whole of it."""
        out: list[int | None] = []
        step = max(1, CELLS // self.size)
        for at in range(0, len(strings), step):
            fits = self.matches(strings[at : at + step])
            out += [int(k) if fit else None for k, fit in zip(fits.argmax(1), fits.any(1), strict=True)] if self.ends else [None] * len(fits)
        return out

    def matches(self, strings: list[np.ndarray]) -> np.ndarray:
        """(strings, globs) booleans: which glob matches the whole of which string."""
        order = sorted(range(len(strings)), key=lambda k: -len(strings[k]))
        lengths = -np.array([len(strings[k]) for k in order], np.int64)
        state = np.tile(self.start, (len(strings), 1))
        one, last = np.uint64(1), np.uint64(63)
        for at in range(0, -int(lengths[0]) if order else 0, 256):
            live = int(np.searchsorted(lengths, -at))  # the strings longer than at come first
            block = np.zeros((live, 256), np.int16)
            for k in range(live):
                part = strings[order[k]][at : at + 256]
                block[k, : len(part)] = part
            for col in range(min(256, -int(lengths[0]) - at)):
                n = int(np.searchsorted(lengths, -(at + col)))
                now = state[:n]
                moved = now << one
                moved[:, 1:] |= now[:, :-1] >> last
                state[:n] = (moved & self.masks[block[:n, col]]) | (now & self.hold)
        out = np.zeros((len(strings), len(self.ends)), bool)
        for g, end in enumerate(self.ends):
            out[order, g] = ((state[:, end // 64] >> np.uint64(end % 64)) & one).astype(bool)
        return out


def symbols(host: bytes, path: bytes) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"." + host, np.uint8).astype(np.int16), np.array([SEPARATOR], np.int16), np.frombuffer(path, np.uint8).astype(np.int16)])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = QUERY_RULES, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; at most {RULES} are broadcast")
    # The best rule first, so that the first fit decides.
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    shared = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in ranked])
    part = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).cast("string").alias("url"))
    schema = T.StructType([part.schema["id"], *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Rule(*r) for r in shared.value]
        automaton = ShiftAnd([glob_of(r) for r in own])
        for batch in batches:
            found = [canonical(u) for u in texts(batch, "url")]
            fits = automaton.first([symbols(h, p) for h, p in found])
            best = [own[k] if k is not None and host else None for k, (host, _) in zip(fits, found, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([h.decode() for h, _ in found], pa.string()), pa.array([p.decode() for _, p in found], pa.string()),
                pa.array([b and b.name for b in best], pa.string()), pa.array([b.verdict if b else default for b in best], pa.string()),
            ], names=schema.fieldNames())

    return part.mapInArrow(run, schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")


OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, rhost, rpath)),
f AS (SELECT h.page_id, r.rhost || r.rpath AS rule, r.verdict FROM h JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)),
b AS (SELECT page_id, rule, verdict FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, verdict DESC, rule) = 1)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)
"""
