"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles, SHINGLE words each unless the
caller says otherwise (fewer words: the whole sequence). Each shingle's hash
chooses one of BUCKETS buckets; a bucket keeps, of its smallest value, the count
of leading zeros (6 bits) and the mantissa bits after the leading one (10 bits).
Empty buckets borrow from others in a fixed random order, so that short texts
have whole bands too. Bands of these compressed registers make candidate keys.

Candidate pairs are compared by sketches before their texts are. First by a sure
bound: the parities of the shingles of each of PARITIES cells differ in no more
cells than the sets differ in shingles. Then by the registers, cut to 8 bits (3
of the zeros, 5 of the mantissa) and laid out in bit planes: of N registers that
either set fills, C are equal, E of them by mere chance. E follows from both set
sizes, and the similarity is estimated as (C - E) / (N - E). Pairs whose estimate
is clearly below the threshold go no further; the full sets confirm the rest.

Equal sets are one class from the start, so copies are never paired. Within a
key, every class is first held against one leader, which is linear. Links join
classes to components. The classes of keys with different components then meet
by rare shingles, without loss: ordered from the rarest among these classes on,
linked sets share one of the first N - ceil(t N) + 1 of each, and what follows
the first one shared must be enough. What all of them have in common, such as a
common passage, brings no pairs.

Where more than CROWD classes meet in one shingle, as in a large family of near
copies, they are not paired there. Each is held against one of them, the pivot;
the shingles of more than half of those that resemble it are a consensus C.
Jaccard distances obey the triangle inequality, so what is as near to C as links
are (inner) is linked only with what is at most twice as far (the ring). Rings
are written as differences from C: with w = (1 + t) |difference| - (1 - t) N, two
sets are linked just if w + w' <= 2 (1 + t) |shared difference|. So those with
w + least w <= 0 are linked with the class of the least w, and any other pair
shares so much of its differences that it meets by the rarest of these.

Defined results: a document without words is linked with nothing; a very long
text is one row like any other; rows that repeat are copies of each other; rows
that share an id but not a text are judged by their texts, and a component's id
is the smallest of any row in it; rows without an id are linked like others,
their component has the smallest id of the rest, or none, and they count as kept
if there is no other; an empty table gives an empty result; columns other than
the id and the text are not read. Sets are compared by 64-bit hashes of their
shingles, classes by 64-bit sums of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import by_bytes
from .common import Shelf, ship, stored
from .components import components
from .rolling import mix, whole_windows, window_hashes, word_hashes

SHINGLE = 3
THRESHOLD_PERCENT = 85
#: Registers.
BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
#: Sets at the threshold miss all bands in a smaller share of cases: 8 registers in each of 64 bands for 0.85, 6 in each of 85 for 0.8.
MISSED = 2e-9
#: Bits of a register's mantissa below its 6 bits of leading zeros.
MANTISSA = 10
#: Bits of the zeros and of the mantissa that the estimate compares.
CUT_ZEROS, CUT_MANTISSA = 3, 5
PLANES, LONGS = CUT_ZEROS + CUT_MANTISSA, BUCKETS // 64
#: Texts that a worker describes at once.
ROWS_AT_ONCE = 1024
#: An estimate this many standard deviations below the threshold goes no further.
DEVIATIONS = 6.0
#: Cells of the parity sketch.
PARITIES = 512
#: A class of copies is dealt over so many parts where its rows meet their component.
SALTS = 16
#: So many classes that share a rare shingle are paired with each other; more are held against pivots.
CROWD = 16
#: Classes of a crowd that share so many percent with the pivot make the consensus.
RESEMBLING = 50
#: Turns of pivots; what then is outside all rings is paired by its rare shingles alone.
TURNS = 3
#: The list of rows whose texts are needed is broadcast up to so many (about 60 bytes each).
BROADCAST_ROWS = 200_000
EMPTY = np.uint16(0xFFFF)


def shingle_sets(batch: pa.RecordBatch, text: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin (one more at the end)."""
    words, firsts = word_hashes(batch.column(text), lower=True)
    hashes = window_hashes(words, size)
    ok = whole_windows(firsts, size, len(hashes))
    doc = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
    hashes, owner = hashes[ok], doc[: len(ok)][ok]
    n_words = np.diff(firsts)
    for n in range(1, size):  # shorter texts: the whole sequence is the one shingle
        short = np.flatnonzero(n_words == n)
        if len(short):
            sequence = window_hashes(words, n)[firsts[short]]
            hashes, owner = np.r_[hashes, mix(sequence + np.uint64(n))], np.r_[owner, short]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return hashes, np.searchsorted(owner, np.arange(batch.num_rows + 1))


def registers(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of BUCKETS registers per text. The top bits choose the bucket, so the first hash of a bucket is its smallest."""
    docs = len(begin) - 1
    out = np.full((docs, BUCKETS), EMPTY, np.uint16)
    owner = np.repeat(np.arange(docs), np.diff(begin))
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(hashes), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    value = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))  # never zero
    top = np.frexp(value.astype(np.float64))[1]  # bits up to the leading one; rounding may add one
    top -= (value >> np.maximum(top - 1, 0).astype(np.uint64) == 0).astype(top.dtype)
    zeros = (64 - top).astype(np.uint64)
    mantissa = (value << (zeros + np.uint64(1)) % np.uint64(64)) >> np.uint64(64 - MANTISSA)
    out[owner[first], bucket[first]] = ((np.minimum(zeros, np.uint64(62)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def collisions(n: np.ndarray) -> np.ndarray:
    """Expected number of cut registers that two unrelated sets of n shingles have in common, by the chance of each value."""
    zeros, mantissa = np.meshgrid(np.arange(48), np.arange(1 << CUT_MANTISSA), indexing="ij")
    low = 0.5**zeros * (0.5 + 0.5 * mantissa / (1 << CUT_MANTISSA))  # where in a bucket the values of a cell begin
    high = low + 0.5 ** (zeros + 1) / (1 << CUT_MANTISSA)
    above = lambda edge: np.exp(n[:, None, None] * np.log1p(-edge / BUCKETS))
    cell = above(low) - above(high)
    # Zeros are told apart modulo 8 only.
    cell = cell.reshape(len(n), -1, 1 << CUT_ZEROS, 1 << CUT_MANTISSA).sum(1)
    return BUCKETS * (cell**2).sum((1, 2))


#: Log2 of set sizes and the square root of their expected collisions; two sizes together have the product.
SIZES = np.arange(0, 120) / 4
CHANCE = np.sqrt(collisions(2.0**SIZES))


def bit_planes(regs: np.ndarray) -> np.ndarray:
    """Per text which registers are filled, and the bits of their cut values, plane by plane, packed in longs."""
    filled = regs != EMPTY
    cut = (regs >> np.uint16(MANTISSA) & np.uint16((1 << CUT_ZEROS) - 1)) << np.uint16(CUT_MANTISSA) | (regs >> np.uint16(MANTISSA - CUT_MANTISSA) & np.uint16((1 << CUT_MANTISSA) - 1))
    planes = [filled, *((cut >> np.uint16(p) & np.uint16(1)).astype(bool) & filled for p in range(PLANES))]
    return np.concatenate([np.packbits(x, axis=1).view(np.int64) for x in planes], axis=1)


def parities(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """PARITIES bits per text, packed in longs: whether an odd number of its hashes falls in each cell."""
    docs = len(begin) - 1
    cell = np.repeat(np.arange(docs), np.diff(begin)) * PARITIES + (hashes & np.uint64(PARITIES - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=docs * PARITIES) & 1).astype(np.uint8).reshape(docs, PARITIES)
    return np.packbits(odd, axis=1).view(np.int64)


#: For each register the order in which it looks for another to borrow from.
LENDERS = np.argsort(mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64)).reshape(BUCKETS, BUCKETS), 1, kind="stable")


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers filled; rows without any register stay empty."""
    out, rows = regs.copy(), np.flatnonzero((regs == EMPTY).any(1) & (regs != EMPTY).any(1))
    for k in range(BUCKETS):
        if not len(rows):
            break
        part = out[rows]
        lent = regs[rows][:, LENDERS[:, k]]
        part = np.where(part == EMPTY, lent, part)
        out[rows] = part
        rows = rows[(part == EMPTY).any(1)]
    return out


def banded(percent: int) -> int:
    """Registers of a band: as many as leave less than MISSED of the pairs at the threshold without a common band."""
    missed = lambda band: (1 - (percent / 100) ** band) ** (BUCKETS // band)
    return max((band for band in range(1, BUCKETS + 1) if missed(band) < MISSED), default=1)


SETS = "id {id}, t long, s long, n long, keys array<long>"
SKETCHES = "s long, n long, odd array<long>, planes array<long>, chance double"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 2 << 20):
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def listed(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))


def described(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Id, text hash, set fingerprint, set size and band keys."""
    band = banded(percent)
    bands = BUCKETS // band
    powers = (np.arange(1, band + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for batch in slices(batches):
        hashes, begin = shingle_sets(batch, 1, size)
        n = np.diff(begin)
        sums = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)]
        sets = mix(sums[begin[1:]] - sums[begin[:-1]] + n.astype(np.uint64))
        regs = densified(registers(hashes, begin))
        keys = mix((mix(regs[:, : bands * band].reshape(-1, bands, band).astype(np.uint64) + np.uint64(1)) * powers).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets.view(np.int64)), pa.array(n, pa.int64()), listed(keys.view(np.int64))], ["id", "t", "s", "n", "keys"])


def sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Set fingerprint, set size, parities, bit planes of the registers, and the root of the expected collisions."""
    for batch in slices(batches):
        hashes, begin = shingle_sets(batch, 1, size)
        n = np.diff(begin)
        chance = np.interp(np.log2(np.maximum(n, 1)), SIZES, CHANCE)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), listed(parities(hashes, begin)), listed(bit_planes(registers(hashes, begin))), pa.array(chance)], ["s", "n", "odd", "planes", "chance"])


def shingled(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each class: class, size of its set, hash."""
    for batch in slices(batches):
        hashes, begin = shingle_sets(batch, 1, size)
        n = np.diff(begin)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), n)), pa.array(np.repeat(n, n)), pa.array(hashes.view(np.int64))], ["s", "n", "h"])


def beginnings(shingles: DataFrame, percent: int) -> DataFrame:
    """Of each class the rarest shingles, of which linked sets share one, with their places and how common its shingles are; those of one class only are counted but left out."""
    shared = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    own = Window.partitionBy("s")
    # The last of a class has place n, so those that it shares with none come first.
    place = F.col("n") + 1 - F.row_number().over(own.orderBy(F.desc("classes"), F.desc("h")))
    placed = shingles.join(shared, "h").select("s", "n", "h", place.alias("place"), (F.sum("classes").over(own) / F.col("n")).alias("common"))
    return placed.filter(f"place <= n - ceil({percent} * n / 100) + 1").withColumn("turns", F.lit(0))


def meeting(begin: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of different components, without a common ring, whose sets may be linked by what follows a shared shingle."""
    begin = begin.join(label, "s")
    apart = begin.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_and("turns").alias("turns")).filter("lo != hi and turns = 0").select("h")
    begin = begin.join(apart, "h", "left_semi")
    enough = f"{100 + percent} * (1 + least(l.n - l.place, r.n - r.place)) >= {percent} * (l.n + r.n)"
    both = begin.alias("l").join(begin.alias("r"), F.expr(f"l.h = r.h and l.s < r.s and l.c != r.c and l.turns & r.turns = 0 and {enough}"))
    return both.select(F.col("l.s").alias("a"), F.col("r.s").alias("b")).distinct()


def listed_few(rows: DataFrame) -> DataFrame:
    """Stored rows, broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def compared(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs that resemble each other, and whether they are linked."""
    for batch in by_bytes(batches, 1 << 20, text=2):
        sets = [shingle_sets(batch, c, size) for c in (2, 3)]
        near, alike = [], []
        for i in range(batch.num_rows):
            a, b = (h[x[i] : x[i + 1]] for h, x in sets)
            both = len(np.intersect1d(a, b, assume_unique=True))
            near.append(100 * both >= percent * (len(a) + len(b) - both))
            alike.append(100 * both >= min(RESEMBLING, percent) * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"]).filter(pa.array(alike, pa.bool_()))


def differences(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each class of a consensus' ring w, whether it is inner, and its differences from the consensus."""
    for batch in slices(batches):
        hashes, begin = shingle_sets(batch, 1, size)
        most = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for x in batch.column(3)]
        differs = [np.setxor1d(hashes[begin[i] : begin[i + 1]], m, assume_unique=True).view(np.int64) for i, m in enumerate(most)]
        n, other, d = np.diff(begin), np.array([len(m) for m in most], np.int64), np.array([len(x) for x in differs], np.int64)
        within = lambda t: 100 * (n + other - d) >= t * (n + other + d)  # noqa: B023, E731
        w = (100 + percent) * d - (100 - percent) * n
        out = [batch.column(0), batch.column(2), pa.array(w, pa.int64()), pa.array(within(percent), pa.bool_()), pa.array(differs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["a", "s", "w", "inner", "differs"]).filter(pa.array(within(2 * percent - 100), pa.bool_()))


def turned(begin: DataFrame, turn: int, texts: DataFrame, shingles: DataFrame, shelf: Shelf, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One turn of pivots, if there is a crowd: the beginnings that are left, with the turns (bits) that have them in a ring; links; the rings, named by turn and pivot ``a``."""
    crowds = begin.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("common", "s")).alias("top")).filter(f"classes > {CROWD}")
    crowds = shelf.stored(crowds.select("h", F.col("top.s").alias("a")), "crowds")
    if crowds.isEmpty():
        return None
    begin = shelf.stored(begin.join(listed_few(crowds), "h", "left"), "beginnings")
    met = shelf.stored(begin.filter("a is not null").select("a", F.col("s").alias("b")).distinct(), "met")
    alike = shelf.stored(with_texts(met, texts).mapInArrow(lambda x: compared(x, size, percent), "a long, b long, near boolean"), "alike")
    votes = alike.groupBy("a").agg(F.count(F.lit(1)).alias("votes"))
    counts = alike.select("a", F.col("b").alias("s")).join(shingles, "s").groupBy("a", "h").agg(F.count(F.lit(1)).alias("k"))
    consensus = counts.join(votes, "a").groupBy("a").agg(F.collect_list(F.when(F.col("k") * 2 > F.col("votes"), F.col("h"))).alias("most"))
    # Stored, since a join with a group's result in the same stage does not deal out the many classes of one pivot.
    consensus = shelf.stored(consensus, "consensus")
    both = met.withColumnRenamed("b", "s").join(texts, "s").join(consensus, "a").select("a", "text", "s", "most")
    rings = shelf.stored(both.mapInArrow(lambda x: differences(x, size, percent), "a long, s long, w long, inner boolean, differs array<long>"), "rings")
    # The pivot has been held against all others.
    left = begin.filter("a is null or a != s").join(rings.select("a", "s", "inner"), ["a", "s"], "left").filter("inner is null or not inner")
    left = left.withColumn("turns", F.expr(f"if(inner is null, turns, turns | {1 << turn})")).drop("a", "inner", "differs")
    return shelf.stored(left, "beginnings"), alike.filter("near and a != b").select("a", "b"), rings.select(F.lit(turn).alias("turn"), "a", "s", "w", "differs")


def ringed(rings: DataFrame, label: DataFrame, shelf: Shelf, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes of one ring and different components that may be linked."""
    ring = ["turn", "a"]
    rings = rings.join(label, "s")
    least = rings.groupBy(ring).agg(F.min(F.struct("w", "s", "c")).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi")
    rings = rings.join(listed_few(shelf.stored(least.select(*ring, "m"), "least")), ring)
    sure = rings.filter("c != m.c and w + m.w <= 0").select(F.col("s").alias("x"), F.col("m.s").alias("y"))

    # Differences that occur in one component only are shared by no pair.
    parts = rings.select(*ring, "s", "c", "w", F.col("m.w").alias("least"), F.explode("differs").alias("h"))
    rare = parts.groupBy(*ring, "h").agg(F.count(F.lit(1)).alias("classes"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select(*ring, "h", "classes")
    rest = F.row_number().over(Window.partitionBy(*ring, "s").orderBy(F.desc("classes"), F.desc("h")))
    parts = shelf.stored(parts.join(rare, [*ring, "h"]).select(*ring, "h", "s", "c", "w", "least", (rest * (2 * (100 + percent))).alias("rest")), "parts")
    # Of each pair one, l, has w + least > 0. It shares at least w + least with any other; so does r, and more than w - least with any l.
    left, right = parts.filter("w + least > 0 and rest >= w + least"), parts.filter("rest >= w + greatest(least, 1 - least)")
    both = left.alias("l").join(right.alias("r"), F.expr("l.turn = r.turn and l.a = r.a and l.h = r.h and l.s != r.s and l.c != r.c and least(l.rest, r.rest) >= l.w + r.w"))
    return sure.union(both.select("l.s", "r.s")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the threshold."""
    for batch in by_bytes(batches, 1 << 20, text=2):
        sets = [shingle_sets(batch, c, size) for c in (2, 3)]
        linked = []
        for i in range(batch.num_rows):
            a, b = (h[x[i] : x[i + 1]] for h, x in sets)
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= percent * (len(a) + len(b) - both))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def not_far(left: str, right: str, percent: int) -> str:
    """The condition that parities do not rule a link out. Linked sets of together S shingles differ in at most S (100 - t) / (100 + t) of them."""
    unequal = " + ".join(f"bit_count({left}.odd[{i}] ^ {right}.odd[{i}])" for i in range(PARITIES // 64))
    return f"{100 + percent} * ({unequal}) <= {100 - percent} * ({left}.n + {right}.n)"


def similar(left: str, right: str, percent: int) -> str:
    """The condition that the estimate by registers is not clearly below the threshold."""
    t, x, y = percent / 100, f"{left}.planes", f"{right}.planes"
    unequal = lambda i: " | ".join(f"({x}[{LONGS * (p + 1) + i}] ^ {y}[{LONGS * (p + 1) + i}])" for p in range(PLANES))
    either = " + ".join(f"bit_count({x}[{i}] | {y}[{i}])" for i in range(LONGS))
    equal = " + ".join(f"bit_count({x}[{i}] & {y}[{i}] & ~({unequal(i)}))" for i in range(LONGS))
    spread = f"{DEVIATIONS * (t * (1 - t)) ** 0.5} * sqrt(({either}) - {left}.chance * {right}.chance)"
    return f"({equal}) - {left}.chance * {right}.chance >= {t} * (({either}) - {left}.chance * {right}.chance) - {spread}"


def candidates(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of distinct pairs (a, b) of classes that sketches do not rule out: first by the short sketch, then by the registers."""
    out = pairs
    for columns, rule in (("n", "odd"), not_far), (("planes", "chance"), similar):
        sketch = sketches.select("s", *columns)
        both = out.select("a", "b").join(sketch.alias("x"), F.col("a") == F.col("x.s")).join(sketch.alias("y"), F.expr(f"b = y.s and {rule('x', 'y', percent)}"))
        out = both.select("a", "b")
    return out


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = lambda x: texts.select(F.col("s").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones of distinct pairs (a, b) of classes."""
    return with_texts(pairs, texts).mapInArrow(lambda x: confirmed(x, size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` of each row; sets of ``size``-word shingles are linked from a similarity of ``percent`` on."""
    ship(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "near")
    try:
        return stored(_near_duplicates(docs, shelf, size, percent, id_col, text_col), "near-duplicates")
    finally:
        shelf.clear()


def _near_duplicates(docs: DataFrame, shelf: Shelf, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    kind = d.schema["id"].dataType.simpleString()
    sets = shelf.stored(d.mapInArrow(lambda x: described(x, size, percent), SETS.format(id=kind)), "sets")

    # Candidate keys that two classes or more share; one row stands for its class, whatever copies it has.
    first = sets.filter("n > 0").groupBy("s").agg(F.min(F.struct("t", "id")).alias("r")).select(F.col("s").alias("of"), F.col("r.t").alias("of_t"), F.col("r.id").alias("of_id"))
    keys = sets.join(first, F.expr("s = of and t = of_t and id <=> of_id"), "left_semi").select("s", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("s").alias("leader"), F.max("s").alias("last")).filter("leader != last").drop("last")
    shared = shelf.stored(keys.join(leaders, "key").distinct(), "shared")
    needed = shelf.stored(shared.select("s").distinct().join(first, F.col("s") == F.col("of")).drop("s"), "needed")
    found = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = shelf.stored(d.join(found, F.expr("t = of_t and id <=> of_id")).select(F.col("of").alias("s"), "text").dropDuplicates(["s"]), "texts")
    sketches = shelf.stored(texts.mapInArrow(lambda x: sketched(x, size), SKETCHES), "sketches")

    with_leader = shared.filter("s != leader").select(F.col("leader").alias("a"), F.col("s").alias("b")).distinct()
    links = shelf.stored(confirm(shelf.stored(candidates(with_leader, sketches, percent), "pairs"), texts, size, percent), "links")
    label = components(links, shelf)

    # What the leaders left apart: classes of keys with different components.
    known = shared.join(label, F.col("s") == F.col("node"), "left").select("key", "s", F.coalesce("label", "s").alias("c"))
    several = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("key")
    split = shelf.stored(known.join(several, "key", "left_semi").select("s", "c").distinct(), "split")
    shingles = shelf.stored(texts.join(split, "s", "left_semi").mapInArrow(lambda x: shingled(x, size), "s long, n long, h long"), "shingles")
    begin, turns = shelf.stored(beginnings(shingles, percent), "beginnings"), []
    while len(turns) < TURNS and (found := turned(begin, len(turns), texts, shingles, shelf, size, percent)):
        begin = found[0]
        turns.append(found[1:])
    if turns:
        with_pivot, rings = (reduce(DataFrame.union, x) for x in zip(*turns, strict=True))
        links = links.union(with_pivot)
        label = components(links, shelf)
        split = shelf.stored(split.select("s").join(label, F.col("s") == F.col("node"), "left").select("s", F.coalesce("label", "s").alias("c")), "split")
    apart = meeting(begin, split, percent)
    if turns:
        apart = apart.union(ringed(rings, split, shelf, percent)).distinct()
    apart = apart.join(with_leader, ["a", "b"], "left_anti")
    late = shelf.stored(confirm(shelf.stored(candidates(apart, sketches, percent), "pairs"), texts, size, percent), "links")
    if not late.isEmpty():
        label = components(links.union(late), shelf)

    # Only classes with copies or links have another smallest id than their own.
    classes = sets.filter("n > 0").groupBy("s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = classes.join(label, F.col("s") == F.col("node"), "left").withColumn("label", F.coalesce("label", "s"))
    smallest = classes.groupBy("label").agg(F.min("id").alias("component"), F.sum("copies").alias("size")).filter("size > 1")
    moved = classes.join(smallest, "label").select("s", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = sets.select("id", "s", "n", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(moved, ["s", "salt"], "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    kept = F.when(F.col("component").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
