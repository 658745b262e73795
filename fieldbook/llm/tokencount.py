"""Edit-aware token counts.

A document's pre-tokens (the pieces that the tokenizer's pattern cuts a text into; merges never cross them) are kept in a
segment tree: leaves hold up to ``LEAF`` pre-tokens, inner nodes the sums of characters and tokens below. An edit
(start, characters removed, text inserted) finds its leaves by the character sums, re-encodes the touched pre-tokens with
some pre-tokens before them, and goes on until a new boundary meets an old one beyond the edit: from there the pattern
reads the same text, so the rest stands. Leaf sums change and are carried up to the root, which holds the document's count.

Vocabulary files come from a path that is a parameter; each distinct pre-token is encoded once in a task and its count kept.

Edge cases: a null text counts as empty, with 0 tokens; edits outside the text are moved to its ends; null or empty edit
lists change nothing; very long texts have deeper trees; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldbook.llm.common import column, values

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond its end that the pattern may look at to cut a pre-token.
LOOKAHEAD = 3
#: Pre-tokens in a leaf, and pre-tokens whose counts a task keeps.
LEAF, CACHE = 64, 500_000


class Counter:
    """Pre-tokens of a text and their token counts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for piece in set(pieces):
            if piece not in known:
                known[piece] = len(self.encoding.encode_ordinary(piece))
        return [known[p] for p in pieces]


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """Lines of a rank file → token bytes and ranks."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Tree:
    """Segment tree over the pre-tokens of a text."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.encoded = counter, text, 0
        pieces = counter.pattern.findall(text)
        sizes, tokens = [len(p) for p in pieces], counter.counts(pieces)
        self.encoded = len(pieces)
        self.leaves = [(sizes[k : k + LEAF], tokens[k : k + LEAF]) for k in range(0, len(pieces), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        for k, (s, t) in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(s), sum(t)
        level = self.width
        while level > 1:
            half = level // 2
            for sums in (self.chars, self.tokens):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _update(self, leaf: int) -> None:
        s, t = self.leaves[leaf]
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(s), sum(t)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, char: int) -> tuple[int, int, int]:
        """(leaf, place in it, first character) of the pre-token that holds ``char``; beyond the end: after the last one."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if before + self.chars[node] <= char:
                before += int(self.chars[node])
                node += 1
        leaf = min(node - self.width, len(self.leaves) - 1)
        if node - self.width > leaf:
            before -= int(self.chars[self.width + leaf])
        place = 0
        for size in self.leaves[leaf][0]:
            if before + size > char:
                break
            before += size
            place += 1
        return leaf, place, before

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` on by ``inserted``."""
        old = self.text
        start = max(0, min(start, len(old)))
        end = min(len(old), start + max(0, removed))
        shift = len(inserted) - (end - start)
        self.text = new = old[:start] + inserted + old[end:]
        first, place, at = self._find(max(0, start - LOOKAHEAD))
        old_sizes = self._from(first, place)
        # Old boundaries are read on demand while the new text is cut again from ``at``.
        boundary, dropped, sizes, pieces = at, 0, [], []
        scan = at
        for found in self.counter.pattern.finditer(new, at):
            scan = found.end()
            pieces.append(found[0])
            sizes.append(len(found[0]))
            while boundary + shift < scan or boundary < end:
                step = next(old_sizes, None)
                if step is None:
                    break
                boundary += step
                dropped += 1
            if boundary >= end and boundary + shift == scan:
                break
        else:
            dropped += sum(1 for _ in old_sizes)  # cut to the end of the text
        self.encoded += len(pieces)
        self._replace(first, place, dropped, sizes, self.counter.counts(pieces))

    def _from(self, leaf: int, place: int) -> Iterator[int]:
        yield from self.leaves[leaf][0][place:]
        for k in range(leaf + 1, len(self.leaves)):
            yield from self.leaves[k][0]

    def _replace(self, leaf: int, place: int, dropped: int, sizes: list[int], tokens: list[int]) -> None:
        s, t = self.leaves[leaf]
        own = min(dropped, len(s) - place)
        self.leaves[leaf] = (s[:place] + sizes + s[place + own :], t[:place] + tokens + t[place + own :])
        self._update(leaf)
        dropped -= own
        while dropped:
            leaf += 1
            s, t = self.leaves[leaf]
            own = min(dropped, len(s))
            self.leaves[leaf] = (s[own:], t[own:])
            self._update(leaf)
            dropped -= own


EDIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("inserted", T.StringType())]))


def recount(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_encoded, n_encoded_again, text): counts before and after each row's edits
    in their order (places count in the text as the edits before left it), pre-tokens encoded at first and again, new text.

    ``vocabulary`` is a rank file that the driver can read; its (fixed) size is what is broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="ascii") as file:
        shared = spark.sparkContext.broadcast(file.read())
    part = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"), edits.cast(EDIT).alias("edits"))
    schema = T.StructType([part.schema["id"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_edits", "n_tokens_after", "n_encoded", "n_encoded_again")], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(read_ranks(shared.value.split("\n")), pattern)
        for batch in batches:
            numbers, after = [], []
            for text, own in zip(values(batch.column("text")), values(batch.column("edits")), strict=True):
                tree = Tree(counter, text or "")
                before, encoded = tree.total, tree.encoded
                own = [e for e in own or [] if e is not None]
                for e in own:
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                numbers.append((before, len(own), tree.total, encoded, tree.encoded - encoded))
                after.append(tree.text if own or text is not None else None)
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)] if numbers else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, pa.array(after, pa.string())], names=schema.fieldNames())

    return part.mapInArrow(run, schema)


#: Edits that the query makes to each document.
EDITS = 4


def derived_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Edits by a rule: at places drawn from a hash of id and number, up to 40 characters go and a piece of up to 60
    characters from elsewhere in the same text comes in their place."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))

    def draw(k: int, part: int, most) -> Column:
        return F.pmod(F.xxhash64(column(docs, id_col).cast("string"), F.lit(k), F.lit(part)), most)

    room = F.length(text).cast("long") + 1
    return F.array(*[
        F.struct(draw(k, 0, room).alias("start"), draw(k, 1, F.lit(41)).alias("removed"), F.substring(text, (draw(k, 2, room) + 1).cast("int"), draw(k, 3, F.lit(61)).cast("int")).alias("inserted"))
        for k in range(EDITS)
    ])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = recount(docs, derived_edits(docs))
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "n_edits", "n_tokens_after", "n_encoded", "n_encoded_again")
