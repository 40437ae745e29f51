"""Chat formatting by quotation linking, built-in functions only.

A line's quote level is the number of ``>`` before its text. Neighbouring lines
of one level are a passage. Passages and their lines are normalised (lower case,
single blanks) and hashed; so are the unquoted body, paragraphs and lines of the
conversation's messages. The latest earlier message with an equal hash is the
original. A message replies to the original of its outermost, longest linked
passage. Conversations come out without quotes, ordered thread by thread: a
thread is the first message that the replies lead to, and within it each message
is followed by its replies, with all that they led to, before the next reply.

That order comes from a tour that enters and leaves each message of a thread:
pointers to the next step are doubled, round by round, while the steps behind
them are added up, so a thread of any depth takes as many rounds as its size has
bits.

Only the hashes that some quote asks for are kept of the originals, and the
latest original before each quote comes from one ordered pass, never from pairs.

Defined results: a null text is empty; a message without links starts a thread
of its own; a very long text or thread is like any other; rows that repeat (conversation and turn) are one message to link to
and each a row of the result; a null conversation or turn is linked with
nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

MARK = r"^(?:[ \t]*>)+[ \t]?"
#: A line that announces a quote, such as "On Monday Ann wrote:".
ATTRIBUTION = r"(?i)^(?:on|le|am|el) .*(?:wrote|écrit|schrieb|escribió)\s*:$"

#: Messages that one assembled text holds at most; a longer thread goes on in the next part.
MESSAGES_OF_A_PART = 1000


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\x{a0}]+", " "))


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def own_lines(lines: Column) -> Column:
    """Unquoted lines without those that announce a quote on the next line."""
    quoted = lambda x: F.coalesce(x, F.lit("")).rlike(MARK)
    return F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(F.get(lines, i + 1))))


def messages(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    d = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), split_lines(F.col(text)).alias("lines"))
    d = d.withColumn("body", F.regexp_replace(F.array_join(own_lines(F.col("lines")), "\n"), r"^\s+|\s+$", ""))
    return d.withColumn("quoting", F.exists("lines", lambda x: x.rlike(MARK)))


def passages(m: DataFrame) -> DataFrame:
    """conv, turn, passage number, level, and each hash that may lead to the original, with the characters it stands for."""
    lines = m.filter("quoting and conv is not null and turn is not null").select("conv", "turn", "lines").distinct()
    lines = lines.select("conv", "turn", F.xxhash64("lines").alias("text"), F.posexplode("lines").alias("at", "line"))
    lines = lines.select("conv", "turn", "text", "at", level(F.col("line")).alias("level"), F.regexp_replace("line", MARK, "").alias("line"))
    order = W.partitionBy("conv", "turn", "text").orderBy("at")
    change = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    lines = lines.withColumn("change", change).withColumn("passage", F.sum("change").over(order)).filter("level > 0")
    found = lines.groupBy("conv", "turn", "text", "passage", "level").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("x"))
    texts = F.array_union(F.array(F.array_join(F.col("x.line"), " ")), F.col("x.line"))
    found = found.select("conv", "turn", "text", "passage", "level", F.explode(texts).alias("part"))
    found = found.withColumn("part", normalised(F.col("part"))).filter("part != ''")
    return found.select("conv", "turn", "text", "passage", "level", F.xxhash64("part").alias("h"), F.length("part").alias("chars"))


def originals(m: DataFrame) -> DataFrame:
    """conv, turn and the hashes of body, paragraphs and lines."""
    parts = F.flatten(F.array(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    d = m.filter("conv is not null and turn is not null and body != ''").select("conv", "turn", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("part"))
    return d.filter("part != ''").select("conv", "turn", F.xxhash64("part").alias("h"))


def quote_links(m: DataFrame) -> DataFrame:
    """Each passage with ``original``, the turn it was taken from; null where none is found."""
    asked = stored(passages(m), "quotes")
    known = originals(m).join(asked.select("conv", "h").distinct(), ["conv", "h"], "left_semi").distinct()
    # Quotes sort before originals of their own turn, so only earlier turns are seen.
    both = known.select("conv", "h", "turn", F.lit(1).alias("kind"), F.col("turn").alias("of"), *[F.lit(None).cast(t).alias(c) for c, t in (("text", "long"), ("passage", "long"), ("level", "int"), ("chars", "int"))])
    both = both.union(asked.select("conv", "h", "turn", F.lit(0), F.lit(None).cast(dict(both.dtypes)["of"]), "text", "passage", "level", "chars"))
    before = W.partitionBy("conv", "h").orderBy("turn", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("original", F.last("of", ignorenulls=True).over(before)).filter("kind = 0")
    best = F.max_by("original", F.when(F.col("original").isNotNull(), F.struct("chars", "original")))
    return found.groupBy("conv", "turn", "text", "passage", "level").agg(best.alias("original"), F.max(F.when(F.col("original").isNotNull(), F.col("chars"))).alias("chars"))


def thread_roots(parents: DataFrame) -> DataFrame:
    """conv, turn and the first turn that the replies lead to; each round doubles the reach."""
    at = stored(parents.select("conv", "turn", F.col("parent").alias("root")), "threads")
    while True:
        further = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(further, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "threads")
        at = moved.drop("went")
        if moved.filter("went").isEmpty():
            return at


def tour_places(parents: DataFrame) -> DataFrame:
    """conv, turn, ``left`` (messages of the thread from here on, in reply order) and ``depth`` of each message that replies or is replied to."""
    nodes = parents.select("conv", "turn").union(parents.select("conv", F.col("parent"))).distinct()
    sibling = F.lead("turn").over(W.partitionBy("conv", "parent").orderBy("turn"))
    nodes = nodes.join(parents.select("conv", "turn", "parent", sibling.alias("sibling")), ["conv", "turn"], "left")
    nodes = nodes.join(parents.groupBy("conv", F.col("parent").alias("turn")).agg(F.min("turn").alias("child")), ["conv", "turn"], "left")
    step = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    after_enter = F.when(F.col("child").isNotNull(), step(F.col("child"), False)).otherwise(step(F.col("turn"), True))
    after_leave = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), False)).when(F.col("parent").isNotNull(), step(F.col("parent"), True))
    steps = F.array(*[F.struct(step(F.col("turn"), leaves).alias("at"), after.alias("next"), F.lit(int(not leaves)).cast("long").alias("left"), F.lit(-1 if leaves else 1).cast("long").alias("open")) for leaves, after in ((False, after_enter), (True, after_leave))])
    tour = stored(nodes.select("conv", F.inline(steps)), "tour")
    while not tour.filter("next is not null").isEmpty():
        ahead = tour.select("conv", F.col("at").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"), F.col("open").alias("open2"))
        added = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        tour = stored(tour.join(ahead, ["conv", "next"], "left").select("conv", "at", F.col("next2").alias("next"), added("left"), added("open")), "tour")
    # What is opened from here on is closed again, except for the messages above.
    return tour.filter("not at.leaves").select("conv", F.col("at.turn").alias("turn"), "left", (-F.col("open")).alias("depth"))


def reply_ordered(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: ``body`` without quotes, ``n_quotes``, ``parent_turn``, ``thread`` (first turn), ``position`` in it, ``depth`` and ``rendered``.

    Ordered by conversation, thread and position a conversation reads in reply order.
    """
    m = messages(conversations, conv, turn, role, text)
    links = stored(quote_links(m), "links")
    outer = F.struct(-F.col("level"), F.col("chars"), F.col("original"))
    replies = links.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.max_by("original", F.when(F.col("original").isNotNull(), outer)).alias("parent"))
    replies = stored(replies, "replies")
    parents = replies.filter("parent is not null")
    roots, places = thread_roots(parents), tour_places(parents)
    whole = places.select("conv", F.col("turn").alias("root"), F.col("left").alias("size"))
    placed = roots.join(places, ["conv", "turn"]).join(whole, ["conv", "root"]).select("conv", "turn", "root", "depth", (F.col("size") - F.col("left")).alias("position"))
    tree = replies.join(placed, ["conv", "turn"], "left")
    out = m.join(tree, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "body",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("thread"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body").alias("rendered"),
    )


def assembled(ordered: DataFrame, *, conv: str = "conv_id", messages_of_a_part: int = MESSAGES_OF_A_PART) -> DataFrame:
    """Each thread as text in reply order: conversation, ``thread``, ``part`` (long threads have several) and ``text``."""
    part = F.floor(F.col("position") / messages_of_a_part).cast("long")
    lines = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return ordered.groupBy(F.col(conv), "thread", part.alias("part")).agg(F.array_join(F.transform(lines, lambda x: x["rendered"]), "\n\n").alias("text"))
