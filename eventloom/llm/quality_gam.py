"""Quality classifier: an additive model with pairwise interactions, scored by adding table entries.

Training is cyclic boosting: round by round, each feature in turn gets one
shallow tree on its bins, fitted to the current residuals; its leaf values are
added to the feature's lookup table. Then the pairs of features whose residuals
differ most over their joint (coarser) bins get tables in the same way. A score
is the sigmoid of the intercept and of one entry per table.

The labelled rows that train are bounded by ``sample`` (those with the smallest
hashes of their ids); features of every text, labelled or not, come from whole
texts in Spark tasks. Labels, language, source and ids are never features.

Defined results: a null or empty text has zero features and a score like any
other; a very long text is one row like any other; a row without an id has no
label and is not held out; labels that are null are left out, repeated ones count
as given rows within the bound;
without a training label every score is 0.5; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import by_bytes, raw
from .common import ship

#: Most labelled rows that train.
SAMPLE = 40_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, LEAVES, RATE, RIDGE = 150, 60, 4, 0.15, 5.0
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_chars", "long_words", "short_words", "distinct_words", "repeat_lines", "log_lines", "words_per_line",
    "upper_share", "digit_share", "mark_share", "symbol_share", "blank_share", "sentence_ends", "capital_starts", "repeat_triples",
    "top_word_share", "high_bytes", "bracket_share", "quote_share",
)

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b".,;:!?", "symbol": b"#*$%&|<>~^_=+@\\/", "blank": b" \t\n\x0b\x0c\r",
    "bracket": b"()[]{}", "quote": b"\"'`",
}


def features(text: bytes) -> list[float]:
    n = len(text) or 1
    count = lambda kind: n - len(text.translate(None, _CLASSES[kind])) if text else 0
    words = text.split()
    k = len(words) or 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = list(zip(words, words[1:], words[2:], strict=False))
    chars = n - count("blank") if text else 0
    ends = sum(text.count(x) for x in (b". ", b"! ", b"? ", b".\n", b"!\n", b"?\n"))
    starts = sum(1 for w in words if 65 <= w[0] <= 90)
    high = len(text) - len(text.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(len(words)), chars / k, float((sizes > 12).sum()) / k, float((sizes < 3).sum()) / k, len(seen) / k,
        1 - len(set(lines)) / len(lines) if lines else 0.0, np.log1p(len(lines)), len(words) / max(1, len(lines)),
        count("upper") / n, count("digit") / n, count("mark") / k, count("symbol") / k, count("blank") / n, ends / k, starts / k,
        1 - len(set(triples)) / len(triples) if triples else 0.0, max(seen.values(), default=0) / k, high / n, count("bracket") / k, count("quote") / k,
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Additive:
    """Cut points and lookup tables: one per feature, one per chosen pair."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cut, x[:, j], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def quantile_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value per bin of a tree that splits the ordered bins at most ``leaves - 1`` times, best gain first."""
    g, h = np.r_[0.0, np.cumsum(gradient)], np.r_[0.0, np.cumsum(weight)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part in parts:
            a, b = part
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), part, int(at[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the logistic loss; deterministic."""
    d = len(FEATURES)
    cuts, pair_cuts = [quantile_cuts(x[:, j], BINS) for j in range(d)], [quantile_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if not len(y):
        return Additive(0.0, cuts, tables, pair_cuts, [], [])
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    slope = lambda: (y - (q := 1 / (1 + np.exp(-margin))), q * (1 - q))
    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slope()
            size = len(tables[j])
            step = RATE * shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), LEAVES)
            tables[j] += step
            margin += step[bins[j]]
    joint = {}
    g, h = slope()
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    for i, j in combinations(range(d), 2):
        wide = len(pair_cuts[j]) + 1
        cell, size = coarse[i] * wide + coarse[j], (len(pair_cuts[i]) + 1) * wide
        joint[i, j] = float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + RIDGE)).sum())
    pairs = sorted(joint, key=lambda k: (-joint[k], k))[:PAIRS]
    pair_tables = [np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables, strict=True):
            g, h = slope()
            # A tree of two levels: the first feature's side is split, then each part along the other side.
            cell = coarse[i] * table.shape[1] + coarse[j]
            gs, hs = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h))
            step = np.zeros(table.shape)
            rows = shallow_tree(gs.sum(1), hs.sum(1), 2)
            for value in np.unique(rows):
                part = rows == value
                step[part] = RATE * shallow_tree(gs[part].sum(0), hs[part].sum(0), 2)
            table += step
            margin += step[coarse[i], coarse[j]]
    return Additive(base, cuts, tables, pair_cuts, pairs, pair_tables)


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in by_bytes(batches):
        x = matrix(raw(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))], ["y", "x"])


def trained(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Additive:
    """The model from at most ``sample`` labelled rows outside the held-out fold."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter((fold(F.col("id")) != 0) & F.col("y").isNotNull())
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Ids may repeat in either table: the bound holds for what trains, not only for the labels.
    texts = texts.orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("text")).limit(sample).select("y", "text")
    rows = texts.mapInArrow(_described, "y double, x array<double>").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten(), np.float64).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same sums in the same order, however tasks ended
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Additive, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, held_out, score and predicted of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(matrix(raw(b.column(1)))))], ["id", "score"])

    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(score, f"id {d.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
