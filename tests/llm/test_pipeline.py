import collections

import corpus_pipeline
from eventloom.llm import near_dedup, quality_rules
from eventloom.llm.common import stored

from .test_operators import LOWER, WORD, brute_components, texts


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    clean = "The river of the town and that house was in the old valley "
    rows += [(100 + i, " ".join(f"{w}{i}x{k}" if k % 3 else w for k, w in enumerate((clean * 6).split())), "en", "s", 0) for i in range(6)]
    rows.append((200, rows[-1][1] + " once", "en", "s", 0))
    item = " ".join(f"item{k}" for k in range(20))
    rows.append((201, rows[-3][1].replace("x", "z") + " " + item, "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judged(docs).filter("kept").collect()}
    left = [(r[0], r[1]) for r in rows if r[0] in kept]
    first = brute_components(left)
    left = [(i, t) for i, t in left if first[i][1] == i]
    seen = collections.Counter(tuple(w[p : p + 35]) for _, t in left for w in [WORD.findall(t)] for p in range(len(w) - 34))
    texts_left = {}
    for i, t in left:
        w = WORD.findall(t)
        gone = {p + k for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for k in range(35)}
        texts_left[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    shown = " " + item.translate(LOWER) + " "
    want = {i for i, t in texts_left.items() if shown not in f" {' '.join(WORD.findall(t.translate(LOWER)))} "}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == want and 200 not in want and 201 not in want and 100 in want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "bpe"]


def test_stages_return_the_columns(spark):
    docs = spark.createDataFrame([(1, None, "x", 1)], "doc_id long, text string, kept string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_rows_are_judged_one_by_one(spark, tmp_path):
    text = lambda k, n=90: " ".join(f"{k}w{i}" for i in range(n))
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(1, text("a"))] * 3  # rows that repeat: one stays
    rows += [(None, text("b")), (7, text("b")), (6, text("b")), (None, text("c")), (None, text("c"))]  # copies without an id
    rows += [(2, text("a")), (2, text("d"))]  # a copy, and a text of its own under the same id
    rows += [(3, text("e") + " " + item), (3, text("f")), (None, text("g") + " " + item), (None, text("h")), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stored(stage(spark, left, str(tmp_path)), name)
    want = [(1, text("a")), (6, text("b")), (None, text("c")), (2, text("d")), (3, text("f")), (None, text("h")), (None, None), (None, None)]
    assert left.columns == docs.columns and sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, want))


def test_an_appended_paragraph_makes_a_near_copy(spark):
    words = [f"w{i}" for i in range(160)]
    texts = [words[:100], words[:120], [f"v{x}" for x in words[:100]], [f"v{x}" for x in words[:130]]]  # 96 / 116 and 96 / 126 of five-word shingles
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 2, 3]
    assert sorted(r.doc_id for r in near_dedup.near_duplicates(docs, size=3, percent=85).filter("kept").collect()) == [0, 1, 2, 3]
    assert near_dedup.banded(85) == 8 and near_dedup.banded(80) == 6
