"""Substring dedup by difference-cover anchors.

Windows of ANCHOR words are hashed only at positions whose remainder modulo
PERIOD lies in COVER. For any two occurrences of a stretch of PERIOD - 1 +
ANCHOR words there is a shift below PERIOD that brings both to such positions,
so they share an aligned anchor. Anchors that occur once are dropped. The others
are extended: of the windows around them, those whose hash occurs twice or more
are the repeated stretches, and each of their words is removed.

Blocks of documents send each hash once and hear which ones others have too, so a
passage in a third of all documents costs a block a few bytes. Windows are told
apart by 128 bits of hash, anchors by 64: an anchor that only seems to repeat
adds candidates, never results.

Defined results: a null, empty or blank text has no words; texts shorter than a
window lose nothing; a very long text is a block by itself; rows that repeat, or
share an id, or have none, count as further occurrences, so all windows of
repeated rows go, first ones included; an empty table gives an empty result;
other columns are carried along untouched, whatever their names: input columns
named like the three new ones are replaced by them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrowtext import raw
from .blocks import ANSWER, SENT, Blocks, answered, answers, arrived, grouped, packed_table, sent, table_of
from .common import Shelf, ship
from .rolling import mix, whole_windows, window_hashes, word_hashes

#: Words of a window.
WINDOW = 35
#: A perfect difference set, every remainder is a difference of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
ANCHORS, WINDOWS = 1, 2
#: Turns word hashes into others for the second half of a window's hash.
OTHER = np.uint64(0xA0761D6478BD642F)
NEW = ("n_words", "n_removed", "kept")


def packed_rows(held: list[pa.RecordBatch]) -> dict[str, bytes]:
    return {"rows": packed_table(held)}


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, as their places, whether they occur twice or more, and the number of each entry's pair."""
    order = np.lexsort((low, high))
    first = np.ones(len(high), bool)
    first[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    number = np.empty(len(high), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], np.bincount(number, minlength=int(first.sum())) > 1, number


class Texts:
    """A block with word hashes, the position of each word in its text, and windows."""

    def __init__(self, block: pa.Table, size: int) -> None:
        self.number, self.size = block.column("block")[0].as_py(), size
        self.rows = table_of(block.column("rows")[0]).combine_chunks()
        self.text = self.rows.column("text").chunk(0) if self.rows.num_rows else pa.array([], pa.string())
        self.words, self.firsts = word_hashes(self.text)
        self.n_words = np.diff(self.firsts)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the anchors, their distinct hashes in order, and the number of each anchor's hash."""
        size = self.size - PERIOD + 1
        hashes = window_hashes(self.words, size)
        position = np.arange(len(hashes)) - np.repeat(self.firsts[:-1], self.n_words)[: len(hashes)]
        at = np.flatnonzero(whole_windows(self.firsts, size, len(hashes)) & np.isin(position % PERIOD, COVER))
        keys, _, number = grouped(hashes[at])
        return at, keys, number

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that contain a repeated anchor, and both halves of their hashes."""
        at, _, number = self.anchors()
        found = at[repeated[number].astype(bool)] if len(at) else at
        whole = whole_windows(self.firsts, self.size, max(0, len(self.words) - self.size + 1))
        starts = np.flatnonzero(self.spread(np.maximum(found - PERIOD + 1, 0), found + 1)[: len(whole)] & whole)
        if not len(starts):
            return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return starts, window_hashes(self.words, self.size)[starts], window_hashes(mix(self.words ^ OTHER), self.size)[starts]

    def spread(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which words lie in one of the stretches."""
        size = len(self.words) + 1
        return np.cumsum(np.bincount(begin, minlength=size) - np.bincount(end, minlength=size))[:-1] > 0


def anchor_hashes(block: pa.Table, size: int, parts: int) -> pa.Table:
    t = Texts(block, size)
    _, keys, number = t.anchors()
    again = np.bincount(number, minlength=len(keys)) > 1
    return sent(t.number, parts, keys, np.zeros(len(keys), np.uint64), again.astype(np.uint8))


def candidate_windows(block: pa.Table, right: pa.Table, size: int, parts: int) -> pa.Table:
    t = Texts(block, size)
    _, high, low = t.candidates(heard(right, ANCHORS))
    at, again, _ = distinct(high, low)
    return sent(t.number, parts, high[at], low[at], again.astype(np.uint8))


def repeated(rows: pa.Table) -> pa.Table:
    """Of one part: for each hash that a block has sent, whether it occurs twice or more in all blocks together."""
    blocks, sizes, (high, low, again) = arrived(rows, np.uint64, np.uint8)
    _, several, number = distinct(high, low)
    several |= np.bincount(number, again, len(several)) > 0
    return answers(rows.column("part")[0].as_py(), blocks, sizes, several[number].astype(np.uint8))


def heard(right: pa.Table, kind: int) -> np.ndarray:
    return answered(right.filter(pa.array(right.column("kind").to_numpy() == kind)) if right.num_rows else right, np.uint8)


def kept_words(block: pa.Table, right: pa.Table, size: int) -> pa.Table:
    t = Texts(block, size)
    starts, high, low = t.candidates(heard(right, ANCHORS))
    _, _, number = distinct(high, low)
    starts = starts[heard(right, WINDOWS)[number].astype(bool)] if len(starts) else starts
    gone = t.spread(starts, starts + size)
    so_far = np.r_[0, np.cumsum(gone)]
    removed = so_far[t.firsts[1:]] - so_far[t.firsts[:-1]]
    kept = []
    for i, x in enumerate(raw(t.text)):
        words = x.split()
        kept.append(b" ".join(compress(words, ~gone[t.firsts[i] : t.firsts[i + 1]]) if removed[i] else words))
    columns = {"row": t.rows.column("row"), "text": t.text, "n_words": pa.array(t.n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    return pa.table(columns | {"kept": pa.array(kept, pa.binary()).cast(pa.string())})


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words left, joined by one space.

    The result is lazy and reads the blocks in the shared folder.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words or more")
    ship(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "substrings")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("row"), F.col(text_col).alias("text"))
    blocks = Blocks(d, shelf, packed_rows, ["rows"], block_bytes=block_bytes)
    parts = blocks.parts

    def told(rows: DataFrame, kind: int) -> DataFrame:
        return shelf.stored(rows.groupBy("part").applyInArrow(repeated, ANSWER).withColumn("kind", F.lit(kind)), f"repeated-{kind}")

    anchors = told(blocks.each(lambda b: anchor_hashes(b, window, parts), SENT), ANCHORS)
    windows = told(blocks.met(anchors, lambda b, r: candidate_windows(b, r, window, parts), SENT), WINDOWS)
    kinds = StructType([*d.schema]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    found = blocks.met(anchors.union(windows), lambda b, r: kept_words(b, r, window), kinds)
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in NEW], *NEW)
