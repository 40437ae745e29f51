"""Token counts: the library encodes batches inside Arrow functions, only lengths come back.

Texts are cut at ASCII blanks, where a pre-tokenizer that drops white space can
be cut safely: no token and no normalisation step reaches across one. Each
distinct word of a slice goes to the library once; slices are balanced by bytes.
Tokenizers that keep white space (byte-level and sentencepiece files) get whole
texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
and rows without an id give a result each; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import by_bytes, raw
from .common import ship

#: Bytes of words that a worker remembers in each of two generations: the lately used ones stay.
REMEMBERED_BYTES = 32 << 20
#: What Python needs for an entry besides the bytes of the word.
ENTRY_BYTES = 180
#: Words that one call of the library encodes as one text, parted by a special token.
JOINED = 1000


@lru_cache(maxsize=2)
def lengths(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to token counts, and whether texts may be cut at blanks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    drops_blanks = any(s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "\\s" in s["pattern"].get("Regex", "") for s in steps)
    encode = lambda texts: library.encode_batch_fast(texts, add_special_tokens=False)
    whole = lambda texts: [len(x) for x in encode(texts)]
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items() if t.special and not t.normalized}
    if not drops_blanks or not special:
        return whole, drops_blanks
    between, between_id = next(iter(special.items()))

    def parted(words: list[str]) -> list[int]:
        """Lengths of many short texts; special tokens are matched first, so each part is encoded by itself."""
        odd = {w: n for w, n in zip(found, whole(found), strict=True)} if (found := [w for w in words if any(x in w for x in special)]) else {}
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[int] = []
        for e, group in zip(encode([between.join("" if w in odd else w for w in g) for g in groups]), groups, strict=True):
            ids = np.array(e.ids)
            n = np.diff(np.r_[-1, np.flatnonzero(ids == between_id), len(ids)]) - 1
            out += [odd.get(w, k) for w, k in zip(group, n.tolist(), strict=True)]
        return out

    return parted, True


def counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, cut = lengths(path)
    known: dict[bytes, int] = {}
    older: dict[bytes, int] = {}
    held = 0
    for batch in by_bytes(batches):
        texts = raw(batch.column(1))
        if cut:
            split = [t.split() for t in texts]
            if held > REMEMBERED_BYTES:
                older, known, held = known, {}, 0
            new = {w for ws in split for w in ws}.difference(known)
            held += ENTRY_BYTES * len(new) + sum(map(len, new))
            known.update((w, older[w]) for w in new.intersection(older))
            if new := list(new.difference(known)):
                known.update(zip(new, encode([w.decode() for w in new]), strict=True))
            n = [sum(map(known.__getitem__, ws)) for ws in split]
        else:
            n = encode([t.decode() for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit of each row."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    found = d.mapInArrow(lambda batches: counted(path, batches), f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
