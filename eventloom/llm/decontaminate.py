"""Benchmark decontamination: size-partitioned MinHash containment search, built-in functions only.

Items are sets of 5-word shingles in lower case. The share of an item's shingles
that a document holds is what counts, so only the small side is sketched: an
item of m shingles keeps its k smallest hashes, and documents of any length
offer all their shingle hashes to these minima. Items are partitioned by size in
powers of two, each class with its own k: one more than the largest item of the
class may miss, so at least one minimum of every containing document matches
(no loss), and a document needs at least k minus the missable number of matches.
The remaining pairs are verified by exact containment of the shingles themselves.

Items shorter than a shingle are one shingle of all their words and are looked
for as such among windows of their length.

Defined results: null and blank texts and items match nothing; a very long text
is one row like any other; repeated item rows count once for an item id, and the
texts of rows that share an item id are one item; repeated document rows give one
row; rows that share a document id are judged text by text, and a pair gets the
most shared shingles of any; rows without an id are judged like others and
reported under the null id, items without one too; an empty table gives an empty
result; columns other than the ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lower_ascii, stored, words

SHINGLE = 5
THRESHOLD_PERCENT = 80
#: Items of at most so many shingles (about 60 bytes each) are broadcast; larger sets are shuffled.
BROADCAST_ROWS = 300_000


def windows(w: Column, size: int) -> Column:
    """All stretches of ``size`` words as one array of structs; the caller cuts the tail."""
    return F.arrays_zip(*[F.slice(w, F.lit(i + 1), F.size(w)).alias(f"w{i}") for i in range(size)])


def windows_of(words_col: str, size: int) -> Column:
    return F.slice(windows(F.col(words_col), size), F.lit(1), F.greatest(F.size(words_col) - (size - 1), F.lit(0)))


def shingles(d: DataFrame, key: list[str], size: int) -> DataFrame:
    """One row per shingle position with the ``size`` words in columns w0, w1, ..."""
    return d.select(*key, F.inline(windows_of("w", size)))


def _hash(size: int) -> Column:
    return F.xxhash64(*[f"w{i}" for i in range(size)])


def _joined(size: int) -> Column:
    return F.concat_ws(" ", *[f"w{i}" for i in range(size)])


def item_shingles(items: DataFrame, size: int, item_id: str, text_col: str) -> DataFrame:
    """item, n_words of its shingles (``len``), shingle text and hash, distinct."""
    d = items.select(F.struct(F.col(item_id).alias("id")).alias("item"), words(lower_ascii(F.col(text_col))).alias("w"))
    parts = []
    for n in range(1, size + 1):
        own = d.filter(F.size("w") >= size) if n == size else d.filter(F.size("w") == n)
        parts.append(shingles(own, ["item"], n).select("item", F.lit(n).alias("len"), _joined(n).alias("shingle"), _hash(n).alias("h")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def sketches(of_items: DataFrame, percent: int) -> DataFrame:
    """item, len, h of the minima, and ``least``, how many of them a containing document matches at least."""
    from pyspark.sql import Window as W

    m = of_items.groupBy("item", "len").agg(F.count(F.lit(1)).alias("m"))
    # Size classes: up to 1, 2, 4, 8, ... shingles. An item may miss (100 - percent) per cent of its own.
    m = m.withColumn("largest", F.pow(F.lit(2.0), F.ceil(F.log2("m"))).cast("long"))
    missable = lambda n: F.floor(n * (100 - percent) / 100)
    m = m.withColumn("k", F.least(F.col("m"), 2 * missable(F.col("largest")) + 1))
    m = m.withColumn("least", F.col("k") - F.least(F.col("k") - 1, missable(F.col("m"))))
    rank = F.row_number().over(W.partitionBy("item", "len").orderBy("h"))
    # Distinct shingles with one hash keep their own ranks; a document then matches both.
    kept = of_items.withColumn("rank", rank).join(m, ["item", "len"]).filter("rank <= k")
    return kept.groupBy("item", "len", "m", "least", "h").agg(F.count(F.lit(1)).alias("weight"))


def contaminated(docs: DataFrame, items: DataFrame, *, size: int = SHINGLE, percent: int = THRESHOLD_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc id, item id, ``n_shared``, ``n_item`` and ``containment`` of each pair that reaches the threshold."""
    of_items = stored(item_shingles(items, size, item_id, item_text), "item-shingles")
    sketch = stored(sketches(of_items, percent), "item-sketches")
    lengths = [r[0] for r in sketch.select("len").distinct().collect()]  # at most ``size`` numbers
    # Per item its shingles of one length as one array; of_items is read again only for those.
    whole = of_items.groupBy("item", "len").agg(F.collect_list("shingle").alias("shingles"))
    n_item = of_items.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    if of_items.count() <= BROADCAST_ROWS:  # the sketch has no more rows
        sketch, whole, n_item = F.broadcast(sketch), F.broadcast(whole), F.broadcast(n_item)
    # A row is known by its id and two hashes of its text, ids of items are wrapped too: keys are never null.
    d = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.hash(text_col).alias("u")).alias("doc"), F.col(text_col).alias("text"))
    w = d.select("doc", words(lower_ascii(F.col("text"))).alias("w"))
    candidates = None
    for n in sorted(lengths):
        # The probe joins on the hash alone; a document's repeated shingle counts once.
        hits = shingles(w, ["doc"], n).select("doc", _hash(n).alias("h")).join(sketch.filter(F.col("len") == n), "h")
        hits = hits.groupBy("doc", "item", "m", "least", "h").agg(F.first("weight").alias("weight"))
        found = hits.groupBy("doc", "item", "m", "least").agg(F.sum("weight").alias("found")).filter("found >= least")
        found = found.select("doc", "item", F.lit(n).alias("len"))
        candidates = found if candidates is None else candidates.union(found)
    if candidates is None:
        kinds = d.schema["doc"].dataType, of_items.schema["item"].dataType
        candidates = docs.sparkSession.createDataFrame([], StructType().add("doc", kinds[0]).add("item", kinds[1]).add("len", "integer"))
    candidates = stored(candidates, "candidates")
    # Exact containment: the shingles themselves, of each candidate document against each of its items. Each
    # candidate is a row of its own, so no shingle, however frequent, gathers rows.
    both = d.join(candidates.select("doc", "item").distinct(), "doc").join(whole, "item").withColumn("w", words(lower_ascii(F.col("text"))))
    own = lambda n: F.transform(windows_of("w", n), lambda x: F.concat_ws(" ", *[x[f"w{i}"] for i in range(n)]))
    held = F.coalesce(*[F.when(F.col("len") == n, own(n)) for n in range(1, size + 1)])
    both = both.select("doc", "item", "len", F.size(F.array_intersect(held, F.col("shingles"))).cast("long").alias("n_shared")).distinct()
    exact = both.groupBy("doc", "item").agg(F.sum("n_shared").alias("n_shared")).groupBy("doc.id", "item").agg(F.max("n_shared").alias("n_shared"))
    exact = exact.join(n_item, "item").filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return exact.select(F.col("id").alias(id_col), F.col("item.id").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
