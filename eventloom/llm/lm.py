"""Language-model scores from a weighted backoff automaton of words, word pairs and word triples.

Model: P(w|h) = (1 - l) c(h,w)/c(h) + l P(w|h'), where h' is h without its first
word. One weight l serves all histories of one length whose count has the same
power of two: the share D T/C of their C training n-grams that T distinct ones
give away at discount D. P(w) is (c(w) - D)/N, and all unknown words together
have D V/N. A text starts after a start mark and ends with an end token.

Automaton: a state for each history of one or two words seen in training, and a
root. An arc for each seen n-gram carries log P and leads to the state of the
longest history that it leaves; a failure arc carries log l and leads to the
state of the shorter history. Texts are read from left to right: a word follows
the failure arcs from the state that the words before it left, until there is an
arc for it. The token stream of a block is read in many lanes at once. A lane
that begins inside a text first reads the two words before it, which is all that
a state knows.

The model is never in one place. Blocks of documents send each word once, then
each pair whose words other blocks have too, then each triple whose pairs other
blocks have too, and get the totals back; what can't occur elsewhere stays. Each
block then builds the part of the automaton that its own texts can reach. Only
the training size and two numbers for each power of two come to the driver.

Defined results: a null, empty or blank text is its end token; a very long text
is a block by itself; rows that repeat are further texts, whatever their ids; a
row whose training condition is null trains, and so is not held out; without
training texts all scores are 0; an empty table gives an empty result; other
columns are not read. Words, pairs and triples are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWER, NOBODY, SENT, Blocks, answered, answers, arrived, grouped, packed, packed_table, sent, sent_rows, steps, table_of, unpacked
from .common import Shelf, ship, stored
from .rolling import joined, word_hashes

DISCOUNT = 0.75
START, END = np.uint64(0x1234567887654321), np.uint64(0x0FEDCBA99ABCDEF0)
WORDS, PAIRS, TRIPLES = 1, 2, 3
#: Powers of two that a count may have.
POWERS = 64
#: Lanes in which a block is read.
LANES = 8192


def packed_tokens(held: list[pa.RecordBatch]) -> dict[str, bytes]:
    """A block as row data, its sorted word hashes, and for each token the number of its word."""
    parts, counts, rest = [], [], []
    for b in held:
        words, firsts = word_hashes(b.column("text"), lower=True)
        n = np.diff(firsts)
        out = np.full(len(words) + 2 * len(n), START, np.uint64)
        begin = firsts[:-1] + 2 * np.arange(len(n))
        out[np.arange(len(words)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = words
        out[begin + n + 1] = END
        parts.append(out)
        counts.append(n)
        rest.append(b.drop_columns(["text"]))
    known, _, word = grouped(np.concatenate(parts))
    return {"docs": packed_table(rest), "known": packed(steps(known)), "words": packed(word.astype(np.uint32)), "sizes": packed(np.concatenate(counts))}


class Tokens:
    """All tokens of a block: per text a start, its words and an end."""

    def __init__(self, block: pa.Table) -> None:
        blob = lambda c: block.column(c)[0].as_buffer().to_pybytes()
        self.number = block.column("block")[0].as_py()
        self.docs = table_of(block.column("docs")[0])
        self.train = self.docs.column("train").to_numpy().astype(bool)
        (known,), (word,), (self.n,) = unpacked(blob("known"), np.uint64), unpacked(blob("words"), np.uint32), unpacked(blob("sizes"), np.int64)
        self.known, self.word = np.cumsum(known, dtype=np.uint64), word.astype(np.int64)
        counts = np.ones(len(self.word), bool)
        counts[np.cumsum(self.n + 2) - self.n - 2] = False
        self.at = np.flatnonzero(counts)  # tokens that count: words and ends
        self.doc = np.repeat(np.arange(len(self.n)), self.n + 1)
        self.trains = self.train[self.doc]

    def word_counts(self) -> np.ndarray:
        """Training count of each word; of the start, its training texts."""
        out = np.bincount(self.word[self.at][self.trains], minlength=len(self.known))
        out[self.known == START] = self.train.sum()
        return out

    def find_pairs(self) -> None:
        """``pairs`` in order, their words ``left`` and ``right``, the pair that ends at each counting token, and training counts."""
        x, y = self.word[self.at - 1], self.word[self.at]
        self.pairs, first, self.pair = grouped(joined(self.known[x], self.known[y]))
        self.left, self.right = x[first], y[first]
        self.pair_counts = np.bincount(self.pair[self.trains], minlength=len(self.pairs))

    def find_triples(self) -> None:
        """As for pairs; ``left`` and ``right`` of a triple are its pairs, ``third`` the counting tokens that end one."""
        self.third = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        x, y = self.pair[self.third - 1], self.pair[self.third]
        self.triples, first, self.triple = grouped(joined(self.pairs[x], self.known[self.word[self.at[self.third]]]))
        self.left_pair, self.right_pair = x[first], y[first]
        self.triple_counts = np.bincount(self.triple[self.trains[self.third]], minlength=len(self.triples))

    def hear(self, right: pa.Table, *kinds: int) -> None:
        """The totals over all blocks of what the block has sent, and which of it other blocks have too."""
        kind = right.column("kind").to_numpy() if right.num_rows else np.zeros(0, np.int32)
        answer = lambda k: answered(right.filter(pa.array(kind == k)), np.int64)

        def totals(own: np.ndarray, sent: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total, shared = own.astype(np.int64), np.zeros(len(own), bool)
            shared[sent] = found & 1
            total[shared] = found[found & 1 > 0] >> 1
            return total, shared

        self.word_totals, self.word_shared = totals(self.word_counts(), np.ones(len(self.known), bool), answer(WORDS))
        if PAIRS in kinds:
            self.find_pairs()
            self.pair_totals, self.pair_shared = totals(self.pair_counts, self.word_shared[self.left] & self.word_shared[self.right], answer(PAIRS))
        if TRIPLES in kinds:
            self.find_triples()
            self.triple_totals, _ = totals(self.triple_counts, self.pair_shared[self.left_pair] & self.pair_shared[self.right_pair], answer(TRIPLES))


def power(counts: np.ndarray) -> np.ndarray:
    return (np.frexp(np.maximum(counts, 1).astype(np.float64))[1] - 1).astype(np.uint8)


def by_power(histories: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each power of two of the histories' counts: distinct n-grams seen in training, and how often."""
    seen = counts > 0
    return np.r_[np.bincount(histories[seen], minlength=POWERS), np.bincount(histories[seen], counts[seen], POWERS).astype(np.int64)]


def sent_words(block: pa.Table, parts: int) -> pa.Table:
    t = Tokens(block)
    return sent(t.number, parts, t.known, t.word_counts(), np.zeros(len(t.known), np.uint8))


def _sent_or_summed(t: Tokens, parts: int, keys: np.ndarray, counts: np.ndarray, histories: np.ndarray, go: np.ndarray) -> pa.Table:
    """Those that other blocks may have; the rest as sums."""
    stay = packed(by_power(histories[~go], counts[~go]))
    return pa.concat_tables([sent(t.number, parts, keys[go], counts[go], histories[go]), sent_rows([int(t.number % parts)], NOBODY, [stay])])


def sent_pairs(block: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    t = Tokens(block)
    t.hear(right)
    t.find_pairs()
    return _sent_or_summed(t, parts, t.pairs, t.pair_counts, power(t.word_totals)[t.left], t.word_shared[t.left] & t.word_shared[t.right])


def sent_triples(block: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    t = Tokens(block)
    t.hear(right, PAIRS)
    t.find_triples()
    return _sent_or_summed(t, parts, t.triples, t.triple_counts, power(t.pair_totals)[t.left_pair], t.pair_shared[t.left_pair] & t.pair_shared[t.right_pair])


def totals(rows: pa.Table) -> pa.Table:
    """Of one part: twice the total and one for what several blocks have, 0 for what only one has; and the sums."""
    mine = np.asarray(rows.column("block")) == NOBODY
    sums = np.zeros(2 * POWERS, np.int64)
    for blob in rows.filter(pa.array(mine)).column("blob"):
        sums += unpacked(blob.as_buffer().to_pybytes(), np.int64)[0]
    blocks, sizes, (keys, counts, histories) = arrived(rows.filter(pa.array(~mine)), np.int64, np.uint8)
    known, first, number = grouped(keys)
    total = np.bincount(number, counts, len(known)).astype(np.int64)
    several = np.bincount(number, minlength=len(known)) > 1
    told = known != START  # a text's start is a history, but no token
    sums += by_power(histories[first][told], total[told])
    return answers(rows.column("part")[0].as_py(), blocks, sizes, np.where(several, 2 * total + 1, 0)[number], sums)


class Automaton:
    """The states and arcs that a block's texts can reach, with log10 weights. State 0 is the root, then come words and pairs."""

    def __init__(self, t: Tokens, weights: dict[int, np.ndarray], n: int, v: int) -> None:
        words, pairs, triples = t.word_totals, t.pair_totals, t.triple_totals
        self.words, self.start = len(words), t.known == START
        known = words > 0
        lone = np.where(known, (words - DISCOUNT) / max(n, 1), DISCOUNT * v / n if n else 1.0)
        self.root, self.leads = np.log10(np.where(self.start, 1.0, lone)), np.where(known, 1 + np.arange(len(words)), 0)
        lam, lam2 = weights[PAIRS][power(words)], weights[TRIPLES][power(pairs)]
        self.fail = np.log10(np.r_[1.0, np.where(known, lam, 1.0), lam2])
        self.shorter = np.r_[0, np.zeros(len(words), np.int64), np.where(known[t.right], 1 + t.right, 0)]
        state = 1 + len(words) + np.arange(len(pairs))  # of each pair, where it was seen
        p2 = (1 - lam[t.left]) * pairs / np.maximum(words[t.left], 1) + lam[t.left] * lone[t.right]
        p3 = (1 - lam2[t.left_pair]) * triples / np.maximum(pairs[t.left_pair], 1) + lam2[t.left_pair] * p2[t.right_pair]
        two, three = pairs > 0, triples > 0
        arcs = np.r_[(1 + t.left[two]) * self.words + t.right[two], state[t.left_pair[three]] * self.words + t.right[t.right_pair[three]]]
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(self.arcs // self.words, minlength=len(self.fail)))] if self.words else np.zeros(2, np.int64)
        self.weight = np.log10(np.r_[p2[two], p3[three]])[order]
        self.next = np.r_[state[two], state[t.right_pair[three]]][order]

    def arc(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have an arc for the word, and the arcs of those."""
        key, first = state * self.words + word, self.begin[state]
        some = np.flatnonzero(self.begin[state + 1] > first)
        at = first[some]
        more = self.arcs[at] < key[some]  # not the state's first arc
        at[more] = np.searchsorted(self.arcs, key[some[more]])
        hit = self.arcs[np.minimum(at, len(self.arcs) - 1)] == key[some] if len(some) else np.zeros(0, bool)
        found = np.zeros(len(state), bool)
        found[some[hit]] = True
        return found, at[hit]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one word in each lane: the new states, and the weights of the arcs that were followed."""
        score, state, todo = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(todo):
            found, arcs = self.arc(state[todo], word[todo])
            here, rest = todo[found], todo[~found]
            score[here] += self.weight[arcs]
            state[here] = self.next[arcs]
            root = state[rest] == 0
            ends, todo = rest[root], rest[~root]
            score[ends] += self.root[word[ends]]
            state[ends] = self.leads[word[ends]]
            score[todo] += self.fail[state[todo]]
            state[todo] = self.shorter[state[todo]]
        return state, score

    def read(self, tokens: np.ndarray) -> np.ndarray:
        """The weight of each token in its place; starts have none and set the state."""
        size = max(1, -(-len(tokens) // LANES))
        begin = np.arange(0, len(tokens), size)
        out, state = np.zeros(len(tokens)), np.zeros(len(begin), np.int64)
        for k in range(-2, size):
            at = begin + k
            lane = np.flatnonzero((at >= 0) & (at < len(tokens)))
            word = tokens[at[lane]]
            state[lane], score = self.step(state[lane], word)
            starts = self.start[word]
            state[lane[starts]] = self.leads[word[starts]]
            if k >= 0:
                out[at[lane]] = np.where(starts, 0.0, score)
        return out


def scores(block: pa.Table, right: pa.Table, weights: dict[int, np.ndarray], n: int, v: int) -> pa.Table:
    t = Tokens(block)
    t.hear(right, PAIRS, TRIPLES)
    weight = Automaton(t, weights, n, v).read(t.word)[t.at]
    c = t.word_totals[t.word[t.at]]
    base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    per_text = lambda x: np.bincount(t.doc, x, len(t.n))
    return pa.table({
        "id": t.docs.column("id"), "held_out": pa.array(~t.train, pa.bool_()), "n_tokens": t.n + 1, "n_known": per_text(c > 0).astype(np.int64),
        "train_tokens": np.full(len(t.n), n, np.int64), "base_score": per_text(base), "score": per_text(weight),
    })


def lm_scores(docs: DataFrame, train, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; ``train`` is the condition on rows to learn from."""
    ship(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "lm")
    try:
        d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
        blocks = Blocks(d, shelf, packed_tokens, ["docs", "known", "words", "sizes"], block_bytes=block_bytes)
        parts = blocks.parts

        def counted(rows: DataFrame, kind: int) -> tuple[DataFrame, np.ndarray]:
            found = shelf.stored(rows.groupBy("part").applyInArrow(totals, ANSWER).withColumn("kind", F.lit(kind)), f"totals-{kind}")
            sums = found.filter(F.col("block") == NOBODY).select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()  # 2 * POWERS rows
            return found, np.array([n for _, n in sorted(map(tuple, sums))] or [0] * 2 * POWERS)

        words, sizes = counted(blocks.each(lambda b: sent_words(b, parts), SENT), WORDS)
        pairs, split2 = counted(blocks.met(words, lambda b, r: sent_pairs(b, r, parts), SENT), PAIRS)
        triples, split3 = counted(blocks.met(words.union(pairs), lambda b, r: sent_triples(b, r, parts), SENT), TRIPLES)
        share = lambda s: np.where(s[POWERS:] > 0, DISCOUNT * s[:POWERS] / np.maximum(s[POWERS:], 1), DISCOUNT)
        weights, n, v = {PAIRS: share(split2), TRIPLES: share(split3)}, int(sizes[POWERS:].sum()), int(sizes[:POWERS].sum())
        kinds = f"id {d.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = blocks.met(words.union(pairs).union(triples), lambda b, r: scores(b, r, weights, n, v), kinds)
        return stored(out.withColumnRenamed("id", id_col), "lm-scores")
    finally:
        shelf.clear()
