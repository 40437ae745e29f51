"""Each operator against a plain version of itself, with the awkward rows all of them must bear."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import bpe, chat_quotes, decontaminate, lm, near_dedup, quality_gam, quality_rules, rolling, substring_dedup, token_counts, warc
from eventloom.llm.common import Shelf, vocabulary
from eventloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "block int, h long, s string, row string, page long, conv int, words string"


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "the", "Ré", "ou", "st", "x"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), [word() for _ in range(120)]
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (3, 40, 90)]
    out = [None, "", " \t\n ", "one", "two words", "a b a b a b a b", "# $ % #", "a\n\na\n b\nb", "x\x1cy   z w", "<|endoftext|> it's 12 <|startoftext|>x"]
    out += [shared, shared, prose(30) + " " + shared + "\n" + prose(10), "  " + shared.replace(" ", "\n\n"), *near, " ".join(base), " ".join(base).upper().lower()]
    out += [prose(n) for n in (34, 35, 36, 70, 400)] + [prose(20_000), "y" * 3000, ("ab " * 700).strip()]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0, 0, "", "", 0, 0, "") for i, t in enumerate(texts())]
    rows.append(rows[10])  # a repeated row
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_quality_rules(docs, nothing):
    out = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in pairs(docs):
        w = WORD.findall(t or "")
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p + k for p in range(len(w) - 2) if c[tuple(w[p : p + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered)), t
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judged(nothing).count() == 0
    assert quality_rules.judged(docs).filter("kept").count() == sum(r.kept for r in out.values()) + out[10].kept


def test_classifier(spark, docs, nothing):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "of", "and", "house", "river", "walked", "slowly"]) + str(r.random())[2:5] for _ in range(80)) + "." for _ in range(150)]
    bad = [" ".join(r.choice(["###", "BUY", "***", "NOW!!!"]) for _ in range(80)) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    model = quality_gam.trained(d, labels)
    out = {x.doc_id: x for x in quality_gam.scored(d, model).collect()}
    assert all(out[i].predicted == (i < 150) and out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert quality_gam.scored(docs, model).filter("score between 0 and 1").count() == docs.count()
    assert quality_gam.scored(nothing, model).count() == 0
    empty = quality_gam.trained(nothing, labels)
    assert {x.score for x in quality_gam.scored(docs, empty).collect()} == {0.5}


def test_scores_are_sums_of_table_entries(spark, docs):
    """Each score again, entry by entry, with plain Python."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, len(quality_gam.FEATURES)))
    m = quality_gam.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, got in zip(x.tolist(), m.scores(x), strict=True):
        bins = lambda cuts, j: sum(c <= row[j] for c in cuts[j])  # noqa: B023, E731
        total = m.intercept + sum(t[bins(m.cuts, j)] for j, t in enumerate(m.tables)) + sum(t[bins(m.pair_cuts, i)][bins(m.pair_cuts, j)] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    without = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert [(q.held_out, 0 <= q.score <= 1) for q in quality_gam.scored(without, m).collect()] == [(False, True)] * 2


def test_tables_are_what_is_added():
    x = np.random.default_rng(0).normal(size=(400, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only the pair tells
    m = quality_gam.fit(x, y)
    assert (0, 1) in m.pairs and ((m.scores(x) > 0.5) == (y > 0)).mean() > 0.85


def archived(rows):
    """What the conversion of (page_id, html) rows gives back."""
    ids = {}
    for i, h in rows:
        if i is not None:
            ids[h or ""] = min(i, ids.get(h or "", i))
    none, out = set(), []
    for i, h in rows:
        p, first = (h or "").encode(), ids.get(h or "")
        lone = first is None and p not in none
        none |= {p} if lone else set()
        same = lone or i is not None and i == first
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else first))
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_archives(spark, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    html = ["<p>é</p>", None, "", "x\r\n\r\nWARC/1.1\r\n\nfiledesc://", "<p>é</p>", "y" * 200_000, "<p>é</p>", "z\n\nz"]
    rows = [(i * 3 - 4, u, h, 1) for i, (u, h) in enumerate(zip(["http://a/b c", None, "", "http://x#page-id=5", "u", "v", "w", "ü"], html, strict=True))]
    rows += [rows[0], (None, "n", "<p>é</p>", 1), (None, "n", "only here", 1), (None, None, "only here", 1), (None, None, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    found = warc.converted_pages(pages)
    out = sorted(map(tuple, found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert out == sorted(archived([(i, h) for i, _, h, _ in rows]), key=str)
    assert found.filter("url = 'http://x#page-id=5' and page_id = 5").count() == 1 and found.select("record_id").distinct().count() == len(rows)
    assert found.alias("a").join(found.alias("b"), F.expr("a.refers_to_record = b.record_id and b.record_type = 'response' and a.payload_digest = b.payload_digest")).count() == sum(x[3] == "revisit" for x in out)
    assert warc.converted_pages(pages.limit(0)).count() == 0


def test_foreign_archives(spark, tmp_path):
    """Files as other writers made them: blanks in urls, bare line ends, no blank after a colon, dns and ftp records, gzip members, short dates."""
    one = b"filedesc://IA-001.arc 0.0.0.0 19960923142103 text/plain 200\n" + (b"1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n").ljust(200, b" ")
    records = [
        (b"http://www.dryswamp.edu:80/a b.html 127.10.100.2 19961104142103 text/html", b"HTTP/1.0 200 Document follows\nContent-Type:text/html\nX\n\n<a>\n\n</a>"),
        (b"dns:www.dryswamp.edu 207.241.224.2 199611041421 text/dns", b"19961104142103\nwww.dryswamp.edu. 600 IN A 127.10.100.2\n"),
        (b"http://copy.edu/ 127.10.100.2 19971104142103 text/html", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<a>\n\n</a>"),
        (b"http://no.body/ 1.2.3.4 1998 text/html", b"HTTP/1.0 204 None\n"), (b"ftp://f.org/x 1.2.3.4 19980101000000 application/zip", b"\x00\xff\nPK"),
    ]
    lines = [one, *(h + b" %d\n" % len(b) + b for h, b in records)]
    (tmp_path / "plain.arc").write_bytes(b"".join(x + b"\n" for x in lines))
    two = b"filedesc://v2.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 v2.arc 120\n" + f"2 0 other\n{warc.ARC_FIELDS[2]}\n".encode().ljust(120)
    body = b"HTTP/1.1 404 Not Found\r\n\r\nnothing"
    lines2 = [two, b"http://x.org/%C3%A9 9.9.9.9 20010203040506 text/html 404 abc - 120 v2.arc " + b"%d\r\n" % len(body) + body]
    (tmp_path / "members.arc.gz").write_bytes(b"".join(zlib.compress(x + b"\n\n", wbits=31) for x in lines2))
    shelf = Shelf(spark, "foreign")
    warc.convert(spark, str(tmp_path), f"{shelf.path}/out", shelf)
    got = {r.url: r for r in warc.read_warc(spark, f"{shelf.path}/out", glob="part-*").collect()}
    kinds = {u: (r.record_type, r.date, r.payload_bytes, r.page_id) for u, r in got.items()}
    assert kinds == {
        "http://www.dryswamp.edu:80/a b.html": ("response", "1996-11-04T14:21:03Z", 9, None), "dns:www.dryswamp.edu": ("resource", "1996-11-04T14:21:00Z", len(records[1][1]), None),
        "http://copy.edu/": ("revisit", "1997-11-04T14:21:03Z", 9, None), "http://no.body/": ("response", "1998-01-01T00:00:00Z", 0, None), "ftp://f.org/x": ("resource", "1998-01-01T00:00:00Z", 5, None),
        "http://x.org/%C3%A9": ("response", "2001-02-03T04:05:06Z", 7, None),
    }
    assert got["http://copy.edu/"].refers_to_record == got["http://www.dryswamp.edu:80/a b.html"].record_id
    raw = b"".join(zlib.decompress(p.read_bytes(), 31) for p in sorted((__import__("pathlib").Path(f"{shelf.path}/out")).glob("part-*.gz")))
    assert raw.count(b"WARC-Type: warcinfo") == 2 and b"version block 1 0 Alexa Internet" in raw
    for bad, said in ((one + b"\nhttp://x 0.0.0.0 20000101000000 text/html 9\nabc", "ends inside"), (b"http://x 0.0.0.0 2000 text/html 0\n", "starts with"), (one.replace(b"1 0 Alexa", b"3 0 Alexa"), "isn't known")):
        with pytest.raises(ValueError, match=said):
            list(warc.parsed_arc(bad))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def test_bpe(docs, nothing, library):
    out = {r.doc_id: r for r in bpe.digested(bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"))).collect()}
    counts = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary("word_bpe_49k.json")).collect()}
    for i, t in pairs(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids) == counts[i].n_tokens, t
        assert out[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert counts[i].n_bytes == len((t or "").encode()) and counts[i].over_limit == (len(ids) > 2048)
    assert bpe.encode_decode(nothing, vocabulary("word_bpe_49k.json")).count() == 0
    assert token_counts.token_counts(nothing, vocabulary("word_bpe_49k.json")).count() == 0


def test_bpe_fuzz(library):
    e, r = bpe.encoder(vocabulary("word_bpe_49k.json")), random.Random(2)
    words = ["".join(r.choice("aaabbthehin'sremd é😀ßΣσİﬀÅ1!-=") for _ in range(r.randint(1, 16))) for _ in range(3000)] + ["a" * n for n in range(40)] + ["!=" * n for n in range(30)]
    for w in words:
        assert [x for y in w.encode().split() for x in e.ids(y.decode())] == library.encode(w, add_special_tokens=False).ids, w


def test_bpe_searches_a_pre_token_once(library, monkeypatch):
    e, searched = bpe.PrefixEncoder(vocabulary("word_bpe_49k.json")), []
    monkeypatch.setattr(e, "word_ids", lambda w, find=e.word_ids: searched.append(w) or find(w))
    text = "thenreat Thenreat, THENREAT. thenreat! thenreat"
    assert np.frombuffer(b"".join(map(e.known.__getitem__, text.encode().split())), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(searched) == ["!", ",", ".", "thenreat"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_whole_texts(docs, name):
    path = vocabulary(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(t.encode(x))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert all(got[i] == count(x or "") for i, x in pairs(docs))


def test_decontamination(spark, docs, nothing):
    whole = [t for _, t in pairs(docs) if t and len(WORD.findall(t)) > 30]
    cut = [" ".join(WORD.findall(t)[:20]) for t in whole[:6]]
    rows = [(i, t, 1) for i, t in enumerate([None, "", "one", "two words", "nowhere to be found at all in here", *cut, whole[0].upper(), cut[0] + " and five more words that differ"])]
    items = spark.createDataFrame(rows + [rows[5]], "item_id long, text string, doc int")

    def sets(t):
        w = WORD.findall((t or "").translate(LOWER))
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    def holds(t, s):
        n = len(next(iter(s)))
        w = WORD.findall((t or "").translate(LOWER))
        return len(s & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})

    want = {(i, j, k, len(s)) for i, t in set(pairs(docs)) for j, x, _ in rows if (s := sets(x)) and 100 * (k := holds(t, s)) >= 80 * len(s)}
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(docs, items).collect()]
    assert len(want) > 5 and sorted(got) == sorted(want)
    assert decontaminate.contaminated(nothing, items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_decontamination_without_ids(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    item = lambda k: " ".join(f"{k}item{i}" for i in range(12))
    d = spark.createDataFrame([(None, "x " + item("a")), (None, item("b")), (None, None), (3, item("a") + " y"), (3, item("a")[:-10]), (3, "other"), (4, item("c")), (4, item("c"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item("a")), (2, item("b")), (None, item("c")), (5, "a b"), (5, item("d"))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contaminated(d, items).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, 8, 8), (None, 2, 8, 8), (3, 1, 8, 8), (4, None, 8, 8)], key=str)


def test_quality_rules_line_ends(spark):
    lines = ["\u0085\n\u0085\na b", "x\u2028\nx\u2028\nx", "\r\n\r\n a\r\n a\r", "a...\u0085\nb"]
    d = spark.createDataFrame([(None, t) for t in lines], "doc_id long, text string")
    got = quality_rules.measured(d).select("n_dup_lines", "ellipsis_line_share").collect()
    assert sorted(map(tuple, got)) == sorted([(1, 0.0), (1, 0.0), (1, 0.0), (0, 0.0)])


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return set(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup(spark, docs, nothing):
    want = brute_components(pairs(docs))
    for r in near_dedup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_near_dedup_families(spark):
    r, rows = random.Random(3), []
    for f in range(12):  # families around the threshold, short and long
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([4, 8, 25, 80, 300]))]
        for _ in range(10):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{r.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(d).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows) - 20


def test_classes_meet_by_rare_shingles(spark):
    r = random.Random(11)
    common = set(range(40))  # a passage that all of them have
    sets = [common | {r.randrange(10**9) for _ in range(r.randint(15, 30))} for _ in range(120)]
    for s in sets[:20]:  # and sets near the threshold
        swapped = r.sample(sorted(s), r.randint(1, 8))
        sets.append(s - set(swapped) | {r.randrange(10**9) for _ in swapped})
    rows = spark.createDataFrame([(i, len(s), h) for i, s in enumerate(sets) for h in s], "s long, n long, h long")
    label = spark.createDataFrame([(i, i) for i in range(len(sets))], "s long, c long")
    met = {tuple(x) for x in near_dedup.meeting(near_dedup.beginnings(rows, 85), label, 85).collect()}
    linked = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert linked and linked <= met and len(met) <= 40  # of 9,730 pairs


@pytest.mark.parametrize(("changes", "shared"), [((1, 9), 0), ((5, 8), 0), ((4, 12), 9)])
def test_families_of_near_copies_are_not_paired(spark, monkeypatch, changes, shared):
    plain, late = near_dedup.candidates, []

    def counted(pairs, *rest):
        late.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "candidates", counted)
    r, rows, base = random.Random(13), [], [f"w{i}" for i in range(150)]
    for k in range(240):  # a text with words changed, none without; in some cases a third of them shares some changes
        w = list(base)
        for p in r.sample(range(150), r.randint(*changes)):
            w[p] = f"k{k}p{p}"
        for p in range(0, 15 * shared if k % 3 == 0 else 0, 15):
            w[p] = f"same{p}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert late[-1] <= 240  # of 28,680 pairs


def test_parities_bound_the_difference():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 3, 150, 5000)]
    sets += [np.sort(np.r_[sets[3][k:], r.integers(0, 1 << 63, k).astype(np.uint64)]) for k in (1, 12, 60)]
    begin = np.cumsum([0, *map(len, sets)])
    bits = np.unpackbits(near_dedup.parities(np.concatenate(sets), begin).view(np.uint8), axis=1)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (bits[i] ^ bits[j]).sum() <= len(np.setxor1d(a, b)) and (i != j or not (bits[i] ^ bits[j]).any())
    assert (bits[3] ^ bits[7]).sum() > 80  # few hashes meet in a cell, so the bound is a sharp one


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_substring_dedup(docs, nothing):
    rows = [(i, WORD.findall(t or "")) for i, t in pairs(docs)]
    seen = collections.Counter(tuple(w[p : p + 35]) for _, w in rows for p in range(len(w) - 34))
    want = {}
    for i, w in rows:
        gone = {p + k for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for k in range(35)}
        want[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == sorted((i, *want[i]) for i, _ in rows)
    assert sum(x[1] for x in want.values()) > 500 and substring_dedup.substring_dedup(nothing).count() == 0
    small = substring_dedup.substring_dedup(docs, block_bytes=3000)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in small.collect()) == sorted((i, *want[i]) for i, _ in rows)


def test_substring_dedup_of_awkward_rows(spark):
    """Words that a polynomial hash takes for each other, ids that repeat or lack, names that clash, columns without nulls."""
    bits = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    odd = [(bits(n), bits(n).translate(str.maketrans("ab", "ba"))) for n in (32, 64, 1024, 2048, 4096)]
    hashes, _ = rolling.word_hashes(pa.array([" ".join(x) for x in odd] + [" ".join("xyzzy" * k + "q" for k in range(40))]))
    assert len(set(hashes.tolist())) == len(hashes)
    prose = lambda k, n: [f"{k}{i}" for i in range(n)]
    rows = [(5, " ".join([*prose("p", 34), a])) for a, _ in odd] + [(5, " ".join([*prose("p", 34), b])) for _, b in odd]
    rows += [(None, " ".join(prose("r", 40))), (None, " ".join(prose("r", 40))), (7, " ".join(prose("s", 36))), (7, " ".join(prose("t", 36)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").select(F.lit("k").alias("kept"), "doc_id", "text", F.lit(1).alias("n_words"), F.array(F.struct(F.lit(1).alias("x"))).alias("a b"))
    out = substring_dedup.substring_dedup(d)
    assert out.columns == ["doc_id", "text", "a b", "n_words", "n_removed", "kept"]
    assert sorted((r.n_words, r.n_removed) for r in out.collect()) == sorted([(35, 0)] * 10 + [(40, 40)] * 2 + [(36, 0)] * 2)


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there\nsecond line\n\nPara two"), (1, 1, "b", "> Hello  THERE\n> second line\nyes"), (1, 2, "c", ">> Hello there\n> yes\nno way"),
        (1, 3, "a", "> para TWO\nok\nOn Monday b wrote:\n> unknown text"), (1, 4, "z", None), (2, 0, "x", "> Hello there\nq"), (2, 1, "y", "> q\n> q\nq"), (None, 1, "r", "> q"),
    ]
    c = spark.createDataFrame([(*r, 1) for r in rows + [rows[1]]], "conv_id long, turn long, role string, text string, body int")
    got = sorted(((r.conv_id or 0, r.turn, r.body, r.n_quotes, r.parent_turn, r.thread) for r in chat_quotes.reply_ordered(c).collect()), key=str)
    want = [
        (1, 0, "Hello there\nsecond line\n\nPara two", 0, None, 0), (1, 1, "yes", 1, 0, 0), (1, 1, "yes", 1, 0, 0), (1, 2, "no way", 2, 1, 0), (1, 3, "ok", 2, 0, 0),
        (1, 4, "", 0, None, 4), (2, 0, "q", 1, None, 0), (2, 1, "q", 1, 0, 0), (0, 1, "", 0, None, 1),
    ]
    assert got == sorted(want, key=str)
    assert chat_quotes.reply_ordered(c.limit(0)).count() == 0
    chain = spark.createDataFrame([(1, i, "u", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    assert {r.thread for r in chat_quotes.reply_ordered(chain).collect()} == {0}


def test_reply_order_of_generated_threads(spark):
    """Random trees of replies against a plain walk through them."""
    r, rows, want, texts = random.Random(6), [], [], {}
    for conv in range(12):
        n, parent = r.choice([1, 2, 7, 40]), {}
        body = lambda k: f"conversation {conv} says line {k}\nand more of {k}"  # noqa: B023, E731
        for k in range(n):
            parent[k] = r.choice([None, *range(max(0, k - 4), k)]) if k and conv else k - 1 if k else None
            quote = "" if parent[k] is None else "".join(f"> {x}\n" for x in body(parent[k]).upper().split("\n"))
            rows.append((conv, k, "u", quote + body(k)))
        children = collections.defaultdict(list)
        for k, p in parent.items():
            children[p].append(k)

        def walk(k, root, depth, seen):
            want.append((conv, k, parent[k], root, len(seen), depth))  # noqa: B023
            seen.append(k)
            for c in children[k]:  # noqa: B023
                walk(c, root, depth + 1, seen)
            return seen

        for root in children[None]:
            seen = walk(root, root, 0, [])
            for part in range(0, len(seen), 3):
                texts[conv, root, part // 3] = "\n\n".join(f"<|u|>\n{body(k)}" for k in seen[part : part + 3])
    r.shuffle(rows)
    out = chat_quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(x.conv_id, x.turn, x.parent_turn, x.thread, x.position, x.depth) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(x.conv_id, x.thread, x.part): x.text for x in chat_quotes.assembled(out, messages_of_a_part=3).collect()} == texts


def plain_scores(tokens, train):
    """The model by its formulas, with dictionaries."""
    D, counts, weights = lm.DISCOUNT, [collections.Counter() for _ in range(4)], [None, None, {}, {}]
    for i, w in tokens:
        if train[i]:
            w = ["<s>", *w]
            counts[1].update(w)
            counts[2].update(zip(w, w[1:], strict=False))
            counts[3].update(zip(w, w[1:], w[2:], strict=False))
    history = lambda g: counts[1][g[0]] if len(g) == 2 else counts[2][g[:-1]]
    for k in (2, 3):
        types, sums = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            types[int(math.log2(history(g)))] += 1
            sums[int(math.log2(history(g)))] += c
        weights[k] = {b: D * types[b] / sums[b] for b in types}
    u = {x: c for x, c in counts[1].items() if x != "<s>"}
    n, v = sum(u.values()), len(u)

    def p(g):
        if len(g) == 1:
            return (u[g[0]] - D) / n if g[0] in u else D * v / n
        if not (h := history(g)):
            return p(g[1:])
        l = weights[len(g)].get(int(math.log2(h)), D)  # noqa: E741
        return (1 - l) * counts[len(g)][g] / h + l * p(g[1:])

    for i, w in tokens:
        seq = ["<s>", *w]
        score = sum(math.log10(p(tuple(seq[max(0, k - 2) : k + 1]))) for k in range(1, len(seq)))
        base = sum(math.log10((u.get(y, 0) + 0.5) / (n + 0.5 * (v + 1))) for y in w)
        yield i, not train[i], len(w), sum(y in u for y in w), n, base, score


@pytest.mark.parametrize(("block_bytes", "lanes"), [(1 << 14, 7), (None, 8192)])
def test_lm(docs, nothing, block_bytes, lanes, monkeypatch):
    monkeypatch.setattr(lm, "LANES", lanes)
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + ["</s>"]) for i, t in pairs(docs)]
    want = list(plain_scores(tokens, {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in tokens}))
    rule = quality_gam.fold(F.col("doc_id")) != 1
    got = sorted(map(tuple, lm.lm_scores(docs, rule, block_bytes=block_bytes).collect()))
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:5] == x[:5] and g[5:] == pytest.approx(x[5:])
    assert lm.lm_scores(nothing, rule).count() == 0
    assert {r.score for r in lm.lm_scores(docs, F.lit(False)).collect()} == {0.0}


def test_lm_families(spark):
    """Texts of a few words, so that all orders are seen, unseen and shared between blocks."""
    r = random.Random(8)
    rows = [(i if i % 9 else None, " ".join(r.choice("a b c d e f g".split()) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(None, None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    rule = quality_gam.fold(F.col("doc_id")) != 1
    tokens = [(k, WORD.findall(t or "") + ["</s>"]) for k, (_, t) in enumerate(rows)]
    want = list(plain_scores(tokens, {k: i is None or zlib.crc32(str(i).encode()) % 5 != 1 for k, (i, _) in enumerate(rows)}))
    key = lambda x: (x[0] is None, x[0], *x[1:5], round(x[6], 6))
    got = sorted(map(tuple, lm.lm_scores(d, rule, block_bytes=600).collect()), key=lambda x: str(key(x)))
    for g, x in zip(got, sorted([(rows[k][0], *rest) for k, *rest in want], key=lambda x: str(key(x))), strict=True):
        assert g[:5] == x[:5] and g[5:] == pytest.approx(x[5:])


def test_words_sum_to_one(docs):
    """Known words and the unknown one share the whole probability."""
    counts = np.array([3, 1, 5, 2])
    n, v, D = counts.sum(), len(counts), lm.DISCOUNT
    assert ((counts - D) / n).sum() + D * v / n == pytest.approx(1)
