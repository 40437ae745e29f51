"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the last token of its encoding is unique. An
automaton over the vocabulary finds the tokens that end at each position; a
candidate is the last token of the prefix if it starts the word or if it is
compatible with the last token of the shorter prefix. Two tokens are compatible
if merging their joined symbols by rank gives back exactly these two, which the
edges of their merge trees tell. Back-pointers from the end give the ids.

Made for vocabularies with a word-end mark whose pre-tokenizer drops white space.

Defined results: a null, empty or blank text has no ids and decodes to the empty
text; a very long text is handled by itself, word by word; repeated rows and rows
without an id give a result each; an empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import by_bytes, raw
from .common import ship

#: Stands for the word-end mark inside the automaton: one character that no byte maps to.
END = "\x00"
#: Bytes of words and their tokens that a worker remembers in each of two generations: the lately used ones stay.
REMEMBERED_BYTES = 32 << 20
#: What Python needs for an entry besides the bytes of its strings.
ENTRY_BYTES = 180
#: Token pairs whose compatibility a worker remembers (about 100 bytes each); beyond it starts anew.
PAIRS = 300_000
NEVER = 1 << 60
#: Longer pre-tokens are not remembered by themselves.
LONGEST = 64


def byte_characters() -> list[str]:
    """The printable stand-in for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Words(dict):
    """Ids of words as bytes; those of a new word are found when it is asked for."""

    def __init__(self, find: Callable[[bytes], bytes]) -> None:
        self.find = find

    def __missing__(self, word: bytes) -> bytes:
        return self.find(word)


class PrefixEncoder:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"))
        self.blanks = regex.compile(r"\s+")
        self.bytes = byte_characters()
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = (left, right), rank
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.size: dict[int, int] = {}
        sound: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in sorted(vocab.items(), key=lambda x: self.made.get(x[1], -1)):
            halves = self.halves.get(i)
            sound[i] = halves is None or sound[halves[0]] and sound[halves[1]] and self.meet(*halves) == self.made[i]
            if sound[i]:
                s = t[: -len(self.mark)] + END if t.endswith(self.mark) else t
                self.size[i] = len(s)
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        #: The text of each id, for many ids at once.
        self.texts = pa.array([self.text.get(i) for i in range(max(self.text) + 1)], pa.string())
        self.whole: dict[str, list[int]] = {}
        self.known = Words(self.entry)
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge (0 left, 1 right) while the token is being merged, first to last, each with the rank of the merge that ends it."""
        if (found := self.edges.get((token, side))) is None:
            found, ends = [(token, NEVER)], token
            while halves := self.halves.get(ends):
                found.append((halves[side], self.made[ends]))
                ends = halves[side]
            found.reverse()
            self.edges[token, side] = found
        return found

    def meet(self, a: int, b: int) -> int | None:
        """The rank of the merge across the border of two adjacent tokens that comes before both are whole or just then; None if none does."""
        xs, ys = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = self.rank.get((x, y), NEVER)
            # Of equal ranks the left one is merged first.
            if across < x_ends and across <= y_ends and across < NEVER:
                return across
            if x_ends == y_ends == NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def word_ids(self, s: str) -> list[int]:
        """Ids of one pre-token, written in stand-in characters."""
        s += END
        last, pairs = [-1] * len(s), self.pairs
        for end, (token, size) in self.automaton.iter(s):
            if last[end] < 0:
                if size > end:
                    last[end] = token
                elif (before := last[end - size]) >= 0:
                    if (fits := pairs.get(pair := before << 32 | token)) is None:
                        fits = pairs[pair] = self.meet(before, token) is None
                    if fits:
                        last[end] = token
        ids, at, sizes = [], len(s) - 1, self.size
        while at >= 0:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def pre_tokens(self, part: str) -> list[str]:
        """The normalised text cut by the vocabulary's pattern; a word of letters, with one sign after it or not, needs no search."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # letter by letter: a final sigma is lowered like any other
            if len(part.split()) > 1:
                part = self.blanks.sub(" ", part)
        part = part.lower()
        if part.isalpha():
            return [part]
        if part[-1] in ".,;:!?" and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return self.words.findall(part)

    def pre_token_ids(self, word: str) -> list[int]:
        """Ids of a pre-token; words differ more than pre-tokens do, by case and signs."""
        if (found := self.whole.get(word)) is None:
            found = self.word_ids(word if word.isascii() and word.isalpha() else "".join([self.bytes[b] for b in word.encode()]))
            if len(word) <= LONGEST:
                self.whole[word] = found
                self.held += ENTRY_BYTES + len(word) + 8 * len(found)
        return found

    def ids(self, text: str) -> list[int]:
        if self.specials is None or not self.specials.search(text):
            words = self.pre_tokens(text) if text else []
            return self.pre_token_ids(words[0]) if len(words) == 1 else [i for word in words for i in self.pre_token_ids(word)]
        out: list[int] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.pre_tokens(part):
                    out += self.pre_token_ids(word)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a tokenizer without a decoder step does."""
        return " ".join([self.text[i] for i in ids])

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The same of each list."""
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.texts.take(ids.values)), " ")

    def entry(self, word: bytes) -> bytes:
        """The ids as int32, of a stretch without blanks."""
        if (found := self.older.get(word)) is None:
            found = array("i", self.ids(word.decode())).tobytes()
        self.known[word] = found
        self.held += ENTRY_BYTES + len(word) + len(found)
        return found

    def forget(self) -> None:
        """Bounds what is remembered."""
        if self.held > REMEMBERED_BYTES:
            self.older, self.known, self.whole, self.held = self.known, Words(self.entry), {}, 0
        if len(self.pairs) > PAIRS:
            self.pairs.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def coded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in by_bytes(batches):
        enc.forget()
        # No token reaches across an ASCII blank.
        ids = [b"".join(map(enc.known.__getitem__, t.split())) for t in raw(batch.column(1))]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), listed, enc.decoded(listed)], ["id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``ids`` (array of int) and ``decoded`` text of each row."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(lambda batches: coded(path, batches), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digested(encoded: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Id, n_tokens and the SHA-256 of ids and decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
