"""Personal data, page text, archives, packing, the classifier and the pipeline."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import documents, multiset, pairs_of, prose, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultscope.llm import html, packing, pii, quality, warc

# ------------------------------------------------------------------ personal data
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    total = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits)))
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


TRICKY = ["a@b.c_d@e.f x@y..z", "😀 mail: q.r+s@mail-1.example.com, 1.2.3.4.5 256.1.1.1 000255.1.1.1 1.2.3", "4539 1488 0343 6467 and 4539148803436468 4539-1488-0343-6467-0",
          "+1 (017) 555-7713. +12 3 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "1 " * 9000, "9" * 30_000, "a" * 20_000 + "@", "+" * 50, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "a@b", "@@@"]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("a1 2.@+-(3)b_%4é") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    df = documents(spark, rows=list(enumerate([*TRICKY, *noise])))
    want = []
    for d, t in pairs_of(df):
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, t) if _valid(k, m[0])] for k, p in PLAIN.items()}
        listed = ",".join(f"{k}:{a}:{b}" for k in PLAIN for a, b in spans[k])
        want.append((d, *(len(spans[k]) for k in PLAIN), sha(listed.encode()), listed))
    got = pii.find_pii(df, fit=False).drop("n_added").collect()
    assert multiset(got) == multiset(want)
    assert pii.find_pii(df.where("false")).count() == 0


def test_boosted_trees_add_named_keys_and_leave_prose(spark):
    rng = random.Random(4)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(240):
        text = prose(rng, 30)
        if i % 2:
            text += f' token = "{key()}" ' + prose(rng, 5)
        if i % 3 == 0:
            text += " " + "".join(rng.choice("abcdefghij") for _ in range(30)) + " " + prose(rng, 5)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert np.mean([got[i].n_added > 0 for i in range(240) if i % 2]) > 0.9
    assert np.mean([got[i].n_added > 0 for i in range(240) if i % 2 == 0]) < 0.05
    assert all(r.spans == "" or re.fullmatch(r"[a-z_]+:\d+:\d+(,[a-z_]+:\d+:\d+)*", r.spans) for r in got.values())


def test_fit_takes_the_candidates_of_all_texts(spark, monkeypatch):
    rng = random.Random(5)
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(150)]
    texts = [" ".join(("token = " if (i + j) % 2 else "word ") + k for j, k in enumerate(keys)) for i in range(150)]
    df = spark.createDataFrame([*enumerate(texts), (150, None)], "doc_id long, text string")
    landed, land = [], pii.land
    monkeypatch.setattr(pii, "land", lambda rows, name: landed.append(land(rows, name)) or landed[-1])
    assert pii.train(df) is not None
    fitted = landed[0]
    every = df.select(F.explode(pii.candidates(F.coalesce("text", F.lit(""))))).count()
    assert every > 20_000 and fitted.agg(F.sum("weight")).first()[0] == every
    assert {r[0] for r in fitted.select("label").distinct().collect()} == {0.0, 1.0}


# ------------------------------------------------------------------------- pages
def test_lines_of_awkward_markup():
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><nav>Menu</nav><header><h1>Site</h1></header><!-- <p>no</p> -->
    <article><header><h1>Head&amp;line</h1></header><p>One <b>two<br>three</b>  \n four<p>five &lt;b&gt;<script>var x = "<p>";</script>
    <form><input value="a>b">send</form><aside>aside</aside><div class="x comments">talk</div><ul><li>six<li>seven</ul></article>
    <div class="ad">buy</div><div class="sidebar-left">side</div><footer>&copy; foot</footer><p>after"""
    kept = [t for t, place in html.lines(page) if place != html.OFF]
    assert kept == ["Head&line", "One two three four", "five <b>", "six", "seven", "after"]
    assert [t for t, p in html.lines(page) if p == html.OFF][:2] == ["Menu", "Site"]
    assert html.lines("") == [] and html.lines("a < b") == [("a < b", html.PLAIN)] and html.lines("x <unended") == [("x", html.PLAIN)]


def test_off_markup_never_takes_the_article_with_it():
    def kept(page):
        return [t for t, place in html.lines(page) if place != html.OFF]

    own = "<article><h1>T</h1><p>body text</p></article>"
    for around in ['<div class="layout has-sidebar">{}<div class="sidebar">S</div></div>', '<div id="page" class="header-fixed"><a>skip</a>{}</div>', '<form id="aspnetForm">{}<input>F</form>',
                   "<aside>{}</aside>", '<div class="modal"><main>{}</main></div>', '<nav>n</nav><main><div class="comments">{}</div></main>']:
        assert [t for t in kept(around.format(own)) if t not in ("skip", "F")] == ["T", "body text"], around
    assert kept('<div id="page" class="header-fixed"><p>all the prose there is</p><div class="sidebar-left">side</div></div>') == ["all the prose there is"]
    assert kept('<article><section class="related-work"><p>R</p></section><div class="article-header"><h1>H</h1></div><ul class="related-posts"><li>x</ul></article>') == ["R", "H"]
    # Articles that are comments or teasers go where the page has one of its own.
    assert kept(own + '<aside><article>teaser</article></aside><section class="comments"><article class="comment">c</article></section>') == ["T", "body text"]
    assert kept("<template><article>x</article></template><p>y<p hidden>z") == ["y"]


def test_neighbours_lose_shared_lines_outside_articles(spark):
    def page(i, body):
        return f"<body><div>Welcome to the shop</div><div>Opening hours</div>{body}<div>Imprint and law</div></body>"

    rows = [(i, f"http://h.example/a/{i:03d}", page(i, f"<p>own text {i}</p><p>more {i}</p>")) for i in range(40)]
    rows += [(100, "http://h.example/b/1", page(0, "<article><p>Opening hours</p></article>")), (101, "http://other.example/", page(1, "<p>alone</p>")),
             (102, None, "<p>no url</p>"), (103, "http://e.example/", None), (None, "http://h.example/c", ""), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, lines int, k_page string")
    old, html.PART = html.PART, 7
    try:
        got = {r.page_id: r for r in html.extract(df).collect()}
    finally:
        html.PART = old
    assert all(got[i].text == f"own text {i}\nmore {i}" for i in range(40))
    assert got[100].text == "Opening hours"
    assert got[101].text == "Welcome to the shop\nOpening hours\nalone\nImprint and law"
    assert (got[102].text, got[103].text, got[None].text, got[103].n_chars) == ("no url", "", "", 0)
    assert html.extract(df).count() == len(rows) and html.extract(df.where("false")).count() == 0


def test_copies_are_no_template_and_repeated_lines_go_in_articles(spark):
    prose = ["the first long paragraph of the page on rivers and lakes", "another paragraph on mountains and the sea, as long"]
    body = lambda own: "<body><div>Welcome to the shop</div>" + "".join(f"<p>{t}</p>" for t in own) + "<div>Imprint and law</div></body>"
    rows = [(1, "http://h.example/a/1?utm=x", body(prose)), (2, "http://h.example/a/1?utm=y", body(prose)), (3, "http://h.example/a/1", body(prose)),
            (4, "http://h.example/b", body(["something else altogether, which is on another subject"]))]
    # Copies that differ in a date, over more than one part, and one page of different content behind them.
    rows += [(100 + i, f"http://d.example/a/{i:02d}", body([*prose, f"Updated 2024-01-{i:02d}"])) for i in range(1, 21)]
    rows += [(200, "http://e.example/a/1", body([*prose, "2024-01-01"])), (201, "http://e.example/a/2", body([*prose, "2024-01-02"]))]
    rows += [(121, "http://d.example/z", body(["something else altogether, which is on another subject"]))]
    rng = random.Random(5)
    own = {300 + i: "".join(rng.choice("abcdefgh ") for _ in range(60)).strip() for i in range(15)}
    own = {k: " ".join(v.split()) for k, v in own.items()}
    rows += [(k, f"http://n.example/{k}", f"<article><p>{v}</p><p>Read the newsletter of this house every day, it is free of charge and comes by mail</p><p>About us</p></article>") for k, v in own.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old, html.PART = html.PART, 7
    try:
        got = {r.page_id: r.text for r in html.extract(df).collect()}
    finally:
        html.PART = old
    assert all(got[i] == "\n".join(prose) for i in (1, 2, 3)) and got[4].startswith("something else")
    assert all(got[100 + i] == "\n".join([*prose, f"Updated 2024-01-{i:02d}"]) for i in range(1, 21))
    assert got[200].split("\n") == ["Welcome to the shop", *prose, "2024-01-01", "Imprint and law"]
    assert {k: got[k] for k in own} == own


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(800):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html.common(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


# ---------------------------------------------------------------------- archives
def _pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://x.example/{i} é%20", "<p>" + prose(rng, rng.choice([1, 50, 3000])) + "</p>") for i in range(60)]
    rows += [(i, "u", rows[3][2]) for i in range(100, 130)] + [(200, None, None), (201, "", ""), (None, "n", "only null id"), (7, "again", rows[7][2]), (300, "nested", "\x1f\x8b\x08 WARC/1.0 \r\n\r\n" * 20)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("chunk", [warc.RANGE, 501])
def test_round_trip_of_archives(spark, chunk):
    df = _pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    keep = {}
    for i, p in rows:
        keep[p] = max(keep.get(p, -1), -1 if i is None else i)
    want = [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if keep[p] in (i, -1) else "revisit", None if keep[p] in (i, -1) else keep[p]) for i, p in rows]
    assert multiset(warc.round_trip(df, chunk=chunk).collect()) == multiset(want)
    archives = warc.write_archives(warc.with_kinds(df))
    back = warc.read_archives(archives, chunk).where("record_type = 'response'").collect()
    assert {(r.page_id, r.url, bytes(r.payload)) for r in back} <= {(r.page_id, (r.url or "").replace(" ", "%20"), (r.html or "").encode()) for r in df.collect()}
    assert warc.round_trip(df.where("false")).count() == 0


def test_reader_skips_false_magic_and_owns_by_start():
    payloads = [b"x" * 10, b"\x1f\x8b\x08" * 400, zlib.compress(b"q") + b"\x1f\x8b\x08\x00"]
    data = b""
    for i, p in enumerate(payloads):
        press = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the magic stays visible inside
        data += press.compress(warc.record("response", i, "u", p, warc.digest(p), None)) + press.flush()
    for size in (1, 7, 64, len(data)):
        found = []
        for start in range(0, len(data), size):
            found += [warc.parse(x)["body"] for x in warc.members(io.BytesIO(data), len(data), start, min(start + size, len(data)))]
        assert found == payloads


# ----------------------------------------------------------------------- packing
def test_packing_covers_every_id_once(spark):
    df = documents(spark, rows=[(i, t) for i, t in enumerate([prose(random.Random(i), 30 * i) for i in range(40)] + ["<|endoftext|> a", "w" * 9000, "Ǆ ΣΑΣ ﬁ é", "'s 'S it's"])])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(df).collect()
    want = Counter()
    for d, t in pairs_of(df):
        want[d, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1] += 1
    ids = {(d, len(x)): x for d, x in ((d, [*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for d, t in pairs_of(df))}
    pieces = Counter()
    for r in rows:
        part = ids[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        assert len(part) == r.length
        if want[r.doc_id, r.doc_tokens] == 1:
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert pieces == {k: k[1] * n for k, n in want.items()}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(df.where("false")).count() == 0


def test_sequences_hold_the_ids(spark):
    df = documents(spark, rows=[(i, prose(random.Random(i), 200)) for i in range(12)])
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter(i for _, t in pairs_of(df) for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 1])
    assert Counter(i for r in packing.sequences(df).collect() for i in r.ids) == want


def test_differencing_balances_and_adds_windows_when_needed():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 257, rng.integers(1, 300))
        window = packing.fill(sizes, 2048)
        sums = np.bincount(window, sizes)
        assert sums.max() <= 2048 and len(sums) <= -(-sizes.sum() // 2048) + 1
    assert len(set(packing.fill(np.array([1500, 1500, 1500]), 2048))) == 3


def test_word_cache_is_bounded_and_forgets_nothing_needed():
    words = packing.WordTokens(public_tokenizers.path(packing.TOKENIZER), limit=50)
    rng = random.Random(1)
    for _ in range(6):
        texts = [prose(rng, 12) for _ in range(3)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        ids, ends = words(raw, offsets)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -------------------------------------------------------------------- classifier
def _labelled(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng, rng.choice([40, 120, 400]))
        toxic, poor = int(i % 5 == 0), int(i % 5 == 1)
        if toxic:
            text += " awful vile nasty"
        if poor:
            text = " | ".join(text.split())
        rows.append((i, text))
        labels.append((i, 1 - poor, toxic))
    labels += [(None, 1, 0), (999, 0, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_grades(spark):
    docs, labels = _labelled(spark)
    held = labels.where("doc_id % 4 = 3").select("doc_id")
    model = quality.train(docs, labels, holdout=held)
    got = {r.k_id: r for r in quality.scores(docs, model).collect()}
    right = [(got[i].p_good >= 0.55) == (i % 5 > 1) for i in range(400) if i % 4 == 3]
    assert np.mean(right) > 0.95
    toxic, poor, good = ([got[i].expected_grade for i in range(400) if i % 4 == 3 and (i % 5 == k or k == 2 and i % 5 > 1)] for k in range(3))
    assert np.mean(toxic) < np.mean(poor) < np.mean(good)
    assert np.all(np.diff(model[2]) >= 0)


def test_classifier_edge_cases(spark):
    docs, labels = _labelled(spark)
    df = documents(spark)
    assert quality.classify(df, labels).count() == df.count()  # labels for ids that mean other texts here
    assert quality.classify(df, labels.where("false")).where("kept").count() == df.count()
    assert quality.drop_poor(df, labels.where("false")).count() == df.count()
    assert quality.classify(docs.where("false"), labels).count() == 0
    kept = quality.drop_poor(docs, labels)
    flags = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == flags


# ---------------------------------------------------------------------- pipeline
def test_pipeline_stages_keep_columns_and_their_decisions(spark, tmp_path):
    import corpus_pipeline

    docs, labels = _labelled(spark)
    base = docs.collect()
    bench = " ".join(base[8].text.split()[:12])
    rows = [*((r.doc_id, r.text) for r in base), (1000, base[2].text), (1001, base[3].text + " extra"), (1002, base[2].text)]
    spark.createDataFrame([(*r, "en", "s", len(r[1]), 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, k_text int").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = [{r.doc_id for r in df.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.write.parquet(f"{tmp_path}/{len(ids)}")
        df = spark.read.parquet(f"{tmp_path}/{len(ids)}")
        ids.append({r.doc_id for r in df.select("doc_id").collect()})
    assert {i for i in range(400) if i % 5 > 1} - ids[1] == set() or len({i for i in range(400) if i % 5 > 1} - ids[1]) < 10
    assert ids[1] - ids[2] == {2, 1000} and 1002 in ids[2]
    assert ids[2] - ids[3] == {1001} and ids[3] - ids[4] == {8}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[4]


def test_ranges_are_read_by_many_tasks(spark):
    """A range row is small, but the ranges are dealt over as many tasks (up to ``TASKS``); some get two."""
    rng = random.Random(3)
    rows = [(i, "u", prose(rng, 300)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(warc.with_kinds(df))
    sizes = [r["size"] for r in archives.collect()]
    chunk = sum(sizes) // 40
    ranges = sum(-(-s // chunk) for s in sizes)
    tasks = warc.read_archives(archives, chunk).groupBy(F.spark_partition_id()).count().count()
    assert tasks >= min(ranges, warc.TASKS) * 0.6


# ---------------------------------------------------------------- very long rows
def _timed(fn, seconds):
    import time

    start = time.monotonic()
    out = fn()
    assert time.monotonic() - start < seconds
    return out


@pytest.mark.parametrize("page,left", [
    ("<a " * 700_000, 0), ("<a<a" * 500_000, 0), ("<b>x" * 100_000 + "</i>" * 100_000, 1), ('<div class="has-sidebar">x' * 50_000, 50_000),
    ('<a "" ' * 200_000 + '<a "', 0), ("<p><div>" + "<b>" * 100_000 + "<p>" * 100_000, 0), ("<" * 2_000_000, 1), ("<!x " * 500_000, 0),
])
def test_long_pages_take_linear_time(page, left):
    assert len(_timed(lambda: html.lines(page), 20)) == left


def test_layout_counts_of_nested_elements():
    page = '<div class="has-sidebar"><form><article>' + "own words " * 9 + '</article></form></div><div class="has-sidebar">menu<p>entry</p></div>'
    assert [(t, p) for t, p in html.lines(page) if p != html.OFF] == [(("own words " * 9).strip(), html.ARTICLE)]


def test_long_pages_are_aligned_in_bounded_memory():
    import tracemalloc

    rng = random.Random(11)
    a = [rng.randrange(10**9) for _ in range(20_000)]
    b = [v if rng.random() < 0.5 else rng.randrange(10**9) for v in a]
    tracemalloc.start()
    got = _timed(lambda: html.common(a, b), 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and len(got) >= sum(x == y for x, y in zip(a, b))
    for _ in range(300):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in "ab")
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if u == v else max(table[i][j + 1], table[i + 1][j])
        picked = html.common(x, y)
        rest = iter(y)
        assert len(picked) == table[-1][-1] and all(x[k] in rest for k in picked)


@pytest.mark.parametrize("text,counts", [
    (", ".join(str(i * 7919 % 100_000) for i in range(100_000)), (0, 0)), (" ".join(f"a{i}@b.example" for i in range(40_000)), (40_000, 0)),
    (" ".join(f"+49 170 {i:07d}." for i in range(30_000)), (0, 30_000)), ("k" * 600_000, (0, 0)),
])
def test_personal_data_in_long_texts(spark, text, counts):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = _timed(lambda: pii.find_pii(df, fit=False).first(), 60)
    assert (row.n_email, row.n_phone) == counts
    pairs = df.select(pii.meeting(pii.base_spans(F.col("text"))["phone"], pii.candidates(F.col("text"))).alias("m"))
    assert _timed(lambda: pairs.select(F.size("m").alias("n")).first(), 60).n >= 0


def test_meeting_is_overlap(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(60):
        base = sorted((a, a + rng.randint(1, 9)) for a in rng.sample(range(200), rng.randint(0, 12)))
        found = [(a, a + rng.randint(1, 9)) for a in rng.sample(range(200), rng.randint(0, 12))]
        rows.append(([{"start": a, "end": b} for a, b in base], [{"start": a, "end": b} for a, b in found]))
    df = spark.createDataFrame(rows, "b array<struct<start:int,end:int>>, f array<struct<start:int,end:int>>")
    for r in df.select("b", "f", pii.meeting(F.col("b"), F.col("f")).alias("m")).collect():
        assert [x.c for x in r.m] == r.f
        assert [x.meets for x in r.m] == [any(b.start < c.end and c.start < b.end for b in r.b) for c in r.f]


def test_whole_accounts_and_long_keys_are_proposed(spark):
    text = "pay DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819 or DE89370400440532013000, " + "Zz9" * 60
    df = spark.createDataFrame([(text,)], "t string")
    got = [(c.name, c.text, c.before, c.after) for c in df.select(pii.candidates(F.col("t")).alias("c")).first().c]
    assert {t for n, t, _, _ in got if n == "account"} == {"DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "DE89370400440532013000"}
    assert "Zz9" * 60 in {t for n, t, _, _ in got if n == "key"}
    for _, t, before, after in got:
        at = text.index(t)
        assert before == text[max(0, at - pii.AROUND) : at] and after == text[at + len(t) :][: pii.AROUND]
