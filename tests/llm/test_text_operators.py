"""Token counts, media columns, decontamination, main text, archives: edge cases and brute force."""

import hashlib
import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string"
LONG = "wörd and more " * 30_000
EDGE = [(1, None), (2, ""), (3, "   "), (None, "no id"), (5, "same"), (5, "same"), (6, LONG), (7, "a\x1cb\x85c d <|endoftext|> ünï"), (8, "x" * 5000)]


def docs(spark, rows=EDGE, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    from tapeworks.llm.tokens import PreTokens, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    rng = random.Random(3)
    safe = [chr(c) for c in [*range(1, 0x1C), *range(0x20, 0x250)]] + list("–—‘’“”…€") + ["\x1d", "\x85", "　", "٣", "日", "😀"]
    rows = EDGE + [(100 + k, "".join(rng.choices(safe, k=200)) + rng.choice(["", " 's don't", "\n\n  x  "])) for k in range(60)]
    got = token_counts(docs(spark, rows), path, limit=5).collect()
    want = sorted((str(d), len((x or "").encode()), size(x), size(x) > 5) for d, x in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    pre = PreTokens(path)
    assert all(sum(pre.counts(pre.of(x))) == size(x) for _, x in rows if x)


def test_token_counts_of_no_rows(spark):
    from tapeworks.llm.tokens import token_counts

    assert token_counts(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_token_counts_by_small_buckets(spark, monkeypatch):
    """Many buckets, and tasks that forget: the same counts."""
    from tapeworks.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = docs(spark).withColumn("bucket", F.lit(1)).withColumn("a.b", F.lit(1))
    want = sorted(map(str, tokens.token_counts(rows, path).collect()))
    monkeypatch.setattr(tokens, "_BUCKET_BYTES", 5000)
    monkeypatch.setattr(tokens, "_KNOWN", 1)
    assert sorted(map(str, tokens.token_counts(rows, path).collect())) == want


def test_media_that_cannot_be_read(spark):
    from tapeworks.llm.avi import clips, encode, with_features

    good = encode(b"x" * 384)
    media = spark.createDataFrame([(1, bytearray(good)), (1, bytearray(good)), (2, bytearray(good[:300])), (3, bytearray(b"RIFF....")), (4, None), (5, bytearray(b""))], "doc_id long, media binary")
    got = with_features(media).collect()
    assert [(r.doc_id, r.payload_bytes, r.media_bytes) for r in got] == [(1, 384, len(good)), (1, 384, len(good)), (2, None, 300), (3, None, 8), (4, None, None), (5, None, 0)]
    assert got[0].feature == got[1].feature and len(clips(media, "doc_id").collect()) == 2
    assert with_features(media.limit(0)).collect() == []


def test_media_hold_the_payload(spark):
    from tapeworks.llm.avi import clips, with_features, with_media

    made = with_features(with_media(docs(spark).withColumn("media", F.lit(1)).withColumn("feature", F.lit("x"))))
    rows = made.collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        raw = (r.text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:]) and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    timed = clips(with_media(docs(spark, [(1, "a" * 1920 + "~" * 1920)])), "doc_id").collect()
    assert [(c.clip, c.start_s, c.n_frames) for c in timed] == [(0, 0.0, 10), (1, 0.4, 10)]


def test_lossless_frames_bit_by_bit():
    from tapeworks.llm import avi

    data = os.urandom(192 * 7) + bytes([255, 0] * 96)
    stored = avi.encode(data)
    frames, fps = avi.decode(stored)
    assert frames.tobytes() == data and fps == 25
    at, size = avi._index(stored)[0][3]
    assert avi.decode_frame(stored[at : at + size]).tobytes() == data[3 * 192 : 4 * 192]
    with pytest.raises(ValueError):
        avi.decode(b"RIFF....")


ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (9, "short item"), (11, None), (12, "!!"), (9, "short item")]


def brute_leaks(text, items, window=10):
    from tapeworks.llm.common import words

    ws, hit, names = words(text), set(), set()
    for name, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - window + 1) if iw else 0):
            w = iw[k : k + window]
            for j in range(len(ws) - len(w) + 1):
                if ws[j : j + len(w)] == w:
                    hit.update(range(j, j + len(w)))
                    names.add(str(name))
    return len(ws), len(hit), sorted(names)


def test_leaks_by_brute_force(spark, monkeypatch):
    from tapeworks.llm import decontaminate

    rng = random.Random(1)
    vocab = "one two three four five six seven eight nine ten eleven short item".split()
    rows = EDGE + [(50, "X; ONE two, three-four five six seven eight nine ten eleven"), (51, "Short ITEM short item é")] + [(60 + k, " ".join(rng.choices(vocab, k=60))) for k in range(30)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontaminate.WORDS_PER_AUTOMATON, 4):
        monkeypatch.setattr(decontaminate, "WORDS_PER_AUTOMATON", limit)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.leak_report(docs(spark, rows), items).collect())
        want = []
        for d, t in rows:
            n, hit, names = brute_leaks(t, ITEMS)
            want.append((str(d), n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
        assert got == sorted(want)
    found = {r.doc_id: (r.text, r.spans) for r in decontaminate.find_leaks(docs(spark, rows), items).where("n_hit > 0").collect()}
    text, spans = found[51]
    assert text[spans[0].start : spans[0].end] == "Short ITEM short item"


def test_leak_free_rows_keep_clashing_columns(spark):
    from tapeworks.llm.decontaminate import without_leaks

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = docs(spark, [(1, "short item"), (2, "fine"), (3, None)]).withColumn("n_hit", F.lit("mine")).withColumn("spans", F.lit(7))
    kept = without_leaks(rows, items)
    assert kept.columns == rows.columns and sorted((r.doc_id, r.n_hit) for r in kept.collect()) == [(2, "mine"), (3, "mine")]
    assert without_leaks(rows, items.limit(0)).count() == 3


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>A &amp; B</h1><p>First  paragraph
of text.<br>More.<p>Second &copy; one.<aside>Buy now</aside><form><p>Mail?</p></form><script>var x="<p>no</p>";</script><p>Third.</p></article>
<div id="comments"><p>I disagree with all of this text, strongly and at length.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    from tapeworks.llm.html import extract, main_text

    assert main_text(PAGE) == "A & B\n\nFirst paragraph of text. More.\n\nSecond © one.\n\nThird."
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("plain words only") == "plain words only"
    long = "lorem ipsum dolor " * 10
    assert main_text(f"<body><ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul><div><p>{long}</p><p>short</p></div><footer>x</footer></body>") == f"{long.strip()}\n\nshort"
    assert main_text("<nav>never closed <p>" + long) == "never closed\n\n" + long.strip()
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>x" * 20000)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = {r.page_id: (r.text, r.n_chars) for r in extract(rows).collect()}
    assert got[2] == ("", 0) and got[1][1] == len(got[1][0]) and got[None][1] == 20000 + 2 * 19999


def plain_stretches(weight, window=3):
    """Surge and dive by the definition: a line with weight joins the one before if no window between them sums to zero."""
    at = [k for k, w in enumerate(weight) if w]
    groups = []
    for k in at:
        if groups and all(any(weight[j] for j in range(i, i + window)) for i in range(groups[-1][-1], k)):
            groups[-1].append(k)
        else:
            groups.append([k])
    return [(g[0], g[-1] + 1, max(sum(weight[max(0, i) : i + window]) for i in range(g[0] - window + 1, g[-1] + 1)), sum(weight[k] for k in g)) for g in groups]


def test_stretches_by_brute_force():
    from tapeworks.llm.html import SHARE, SURGE, main_text, stretches

    rng = random.Random(6)
    for _ in range(300):
        weight = [rng.choice([0, 0, 0, rng.randrange(1, 200)]) for _ in range(rng.randrange(0, 40))]
        assert stretches(weight) == plain_stretches(weight)
    # Pages without an article: plain lines and furniture, decided by the sums alone.
    for _ in range(200):
        texts = [rng.choice(["", "", "", "x" * rng.randrange(1, 150)]) for _ in range(30)]
        page = "".join(f"<p>{t}</p>" if t else "<footer>f</footer>" for t in texts)
        every = plain_stretches([len(t) for t in texts])
        most = max((s[3] for s in every), default=0)
        chosen = [s for s in every if s[2] >= SURGE and s[3] >= SHARE * most] or sorted(every, key=lambda s: (-s[3], s[0]))[:1]
        assert main_text(page) == "\n\n".join(texts[i] for a, b, *_ in chosen for i in range(a, b) if texts[i])


def test_reading_is_linear():
    import time

    from tapeworks.llm.html import main_text

    for x in ("<form>", "<a ", "<svg ", '<a "', "<div class='x", "<!--", "<script>", "</p", "<", "<article>", "<p>x", "<a\"'<a\"'"):
        start = time.time()
        main_text(x * (1_000_000 // len(x)))
        assert time.time() - start < 10, x


def test_main_text_of_rows(spark):
    from tapeworks.llm.html import extract

    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("a.b", F.lit(1))
    got = extract(rows).collect()
    assert len(got) == 2 and got[0].text == got[1].text and got[0]["a.b"] == 1
    assert extract(rows.limit(0)).collect() == []


PAGES = [(1, "http://a/1", "x" * 1000), (7, "http://a/7", "x" * 1000), (3, None, "x" * 1000), (4, "http://b\r\n", "é" * 499), (5, "u", "é" * 500), (6, "u", "é" * 500), (8, "u", None), (9, "u", ""), (7, "again", "x" * 1000), (None, "n", "x" * 1000), (2, "l", "z" * 3_000_000)]


def test_archives_round_trip(spark, tmp_path):
    from tapeworks.llm import warc

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = warc.archive(pages, folder)
    got = warc.read_records(index).collect()
    assert len(got) == len(PAGES)
    newest = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 1000:
            newest[h] = max(newest.get(h, p), p)
    for r in got:
        own = [h or "" for p, _, h in PAGES if p == r.page_id and len((h or "").encode()) == r.payload_bytes]
        h = own[0]
        assert r.payload_digest == hashlib.sha1(h.encode()).hexdigest()
        top = newest.get(h)
        if top is None or r.page_id == top:
            assert (r.record_type, r.refers_to, r.html) == ("response", None, h)
        else:
            assert (r.record_type, r.refers_to, r.html) == ("revisit", top, None)
    files = os.listdir(tmp_path / "w")
    norm = [f for f in files if f.startswith("norm") and f.endswith(".gz")]
    assert norm and len([f for f in files if f.endswith(".idx")]) == len(norm) == len([f for f in files if f.startswith("mono")])
    for f in norm:
        raw = (tmp_path / "w" / f).read_bytes()
        for line in (tmp_path / "w" / (f.removesuffix(".warc.gz") + ".idx")).read_text().splitlines():
            e = json.loads(line)
            assert zlib.decompress(raw[e["offset"] : e["offset"] + e["length"]], 31).startswith(b"WARC/1.1")
    assert warc.read_records(warc.archive(pages.limit(0), f"file://{tmp_path}/e")).collect() == []


def test_archives_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    from tapeworks.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = spark.createDataFrame([(k, "u", f"page {k} " * 100) for k in range(300)], "page_id long, url string, html string").repartition(8)
    index = warc.archive(pages, f"file://{tmp_path}/w")
    archives = index.select("archive").distinct().count()
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        dealt = warc.dealt(index)
        assert archives > 50 and dealt.rdd.getNumPartitions() == archives
        assert len(index.inputFiles()) > archives // 3
        assert dealt.select(F.spark_partition_id()).distinct().count() > archives // 3
        assert warc.read_records(dealt).count() == 300
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
