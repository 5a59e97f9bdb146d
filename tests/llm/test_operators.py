"""Each operator against brute force, on a small corpus with the awkward cases."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import common, extraction, fingerprints, jaccard, langid, licenses, mixing, packing, queries, topk, urlfilter, warc
from gridloom.sources import staging

WHITE = " \t\n\x0b\x0c\r"


def corpus(n=120, seed=1):
    """Documents with copies, near copies, a shared passage, nulls, blanks, repeats and one very long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda a, b: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(a, b)))
    passage = text(60, 60)
    rows = []
    for i in range(n):
        r = rng.random()
        if r < 0.35 or not rows:
            t = text(1, 90)
        elif r < 0.55:
            t = rng.choice(rows)[1]
        elif r < 0.8:
            words = (rng.choice(rows)[1] or "x").split() or ["x"]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            t = " ".join(words)
        else:
            t = passage + rng.choice(["\n", "  "]) + text(0, 6)
        rows.append((i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None])))
    rows += [(1000, None, "en", "a"), (1001, "", "de", "b"), (1002, " \t\n ", None, "c"), (1003, "one two", "en", "a"), (1004, "ONE two", "en", "a"), (1005, text(9000, 9000), "en", "b"), (None, "alone with no id", None, None), (1006, "12 34 ! ?", "en", "a"), (1007, "\U0001f600 é" * 5, "en", "a")]
    return rows + [rows[5], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(*r, 7, "x") for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, size int, node string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# packing


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    words = queries.vocabulary()
    found = packing.pack_documents(docs, capacity=256, group_windows=8, **words).collect()
    encode = Tokenizer.from_file(words["vocabulary"])
    wanted = Counter()
    for doc_id, text, *_ in rows:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [0]
        wanted[doc_id, len(ids)] += 1
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for doc_id, text, *_ in rows:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [0]
        mine = pieces[doc_id]
        assert sum(p.length for p in mine) == sum(k[1] * v for k, v in wanted.items() if k[0] == doc_id)
        for p in mine:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= 256
    padding = sum(w[0].padded_length - w[0].sequence_tokens for w in windows.values())
    assert padding < 0.05 * sum(w[0].padded_length for w in windows.values())


def test_packing_empty(none):
    assert packing.pack_documents(none, **queries.vocabulary()).collect() == []


def test_fast_ids_are_the_slow_ones(rows):
    words = queries.vocabulary()
    fast, slow = packing.Encoder(**words), packing.Encoder(words["vocabulary"], None, None)
    for text in [r[1] or "" for r in rows] + ["<|endoftext|> a", " a\x85b's 'S 12", "a" * 5000, " \n" * 300]:
        assert fast(text).tolist() == slow(text).tolist()


def test_karmarkar_karp():
    window, most = packing.karmarkar_karp([8, 7, 6, 5, 4], 2)
    assert most == 16 and sorted(np.bincount(window, weights=[8, 7, 6, 5, 4])) == [14, 16]
    window, k = packing.pack_pieces([600] * 5, 1024)
    assert k == 5 and sorted(window) == [0, 1, 2, 3, 4]
    assert packing.pack_pieces([], 8)[1] == 1


# WARC


def test_warc(spark, tmp_path):
    body = "<p>\r\n\r\nWARC/1.1\r\né" * 80
    pages = [(1, "http://a/1", body), (2, "http://a/2", body), (5, None, body), (3, "u\r\nX: y", "short"), (4, "u", "short"), (6, "u", None), (7, "", ""), (None, "n", body), (5, "again", body), (8, "x", body + "!")]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, origin string")
    found = warc.archive_pages(df, str(tmp_path / "w")).collect()
    assert len(found) == len(pages)
    size, digest = len(body.encode()), hashlib.sha1(body.encode()).hexdigest()
    by = defaultdict(list)
    for r in found:
        by[r.page_id].append(r)
    for i in (1, 2, None):
        assert [(r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in by[i]] == [(size, digest, "revisit", 5)]
    assert [r.record_type for r in by[5]] == ["response", "response"]
    for i, text in ((3, "short"), (4, "short"), (6, ""), (7, ""), (8, body + "!")):
        assert [(r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in by[i]] == [(len(text.encode()), hashlib.sha1(text.encode()).hexdigest(), "response", None)]
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert payloads[5] == body.encode() and payloads[8] == (body + "!").encode()
    assert warc.archive_pages(df.limit(0)).collect() == []


def test_warc_repeated_ids(spark):
    """Rows of one page_id with unlike payloads, as responses and as revisits."""
    a, b, c = "a" * 1500, "b" * 3000, "c" * 1200
    pages = [(5, "u", a), (5, "u", b), (3, "v", a), (4, "w", b), (4, "w", c), (7, "x", c), (7, "x", "small")]
    got = warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    key = lambda t: (len(t), hashlib.sha1(t.encode()).hexdigest())
    assert Counter((r.page_id, (r.payload_bytes, r.payload_digest), r.record_type, r.refers_to) for r in got) == Counter([
        (5, key(a), "response", None), (5, key(b), "response", None), (3, key(a), "revisit", 5), (4, key(b), "revisit", 5), (4, key(c), "revisit", 7), (7, key(c), "response", None), (7, key("small"), "response", None),
    ])


def test_warc_large_payloads(spark, tmp_path):
    """Payloads far beyond a read buffer, full of record ends, split over several lines of the reader."""
    pages = [(i, f"http://a/{i}", ("x" * 70_000 + "\r\n\r\n" * i + "WARC/1.1\r\nContent-Length: 3\r\n\r\n") * (1 + 12 * (i == 2)) + "\r\n" * i) for i in range(5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_archives(warc.resolve_revisits(df), path, compression=compression)
        got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect()}
        assert got == {i: html for i, _, html in pages}


def test_warc_files_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(10)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(df), path, file_records=3)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 4
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == list(range(10))


# fingerprints


def shingles_of(text, k=5):
    words = [w for w in (text or "").translate({ord(c): " " for c in WHITE}).split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def hashes_of(spark, texts):
    """63-bit hashes of every shingle of the texts, each hashed by itself."""
    every = sorted({x for t in texts for x in shingles_of(t)})
    df = spark.createDataFrame([(i, list(x)) for i, x in enumerate(every)], "i int, w array<string>").selectExpr("i", "xxhash64(w) & 9223372036854775807 AS h")
    by = {r.i: r.h for r in df.collect()}
    return {x: by[i] for i, x in enumerate(every)}


def brute_sketch(text, hashes, scale=4):
    found = {hashes[x] for x in shingles_of(text)}
    return {h for h in found if h < 2**63 // scale}, min(found, default=None)


def brute_print(sketch):
    kept, least = sketch
    return " ".join(f"{h:016x}" for h in sorted(kept)) if kept else "" if least is None else f"~{least:016x}"


def brute_likeness(a, b):
    return len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] | b[0] else float(a[1] == b[1])


def test_fingerprints(spark, docs, rows, none):
    found = fingerprints.fingerprint_documents(docs).collect()
    assert len(found) == len(rows)
    keyed = spark.createDataFrame([(i, r[1] or "") for i, r in enumerate(rows)], "i int, text string").selectExpr("i", "xxhash64(text) AS h").collect()
    place = {r.i: r.h for r in keyed}
    order = [rows[i] for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), place[i]))]
    texts = []
    for i, (_, text, *_) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        texts.append((text, text[: len(text) - half] + nxt[:half], nxt))
    hashes = hashes_of(spark, [t for three in texts for t in three])
    wanted = Counter()
    for (doc_id, *_), (text, edited, nxt) in zip(order, texts, strict=True):
        a, b, c = (brute_sketch(t, hashes) for t in (text, edited, nxt))
        wanted[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_print(a), brute_print(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == wanted
    assert fingerprints.fingerprint_documents(none).collect() == []
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(4, "a b c d e f g")], "doc_id long, text string")).first()
    assert one.near_next == 1


@pytest.mark.parametrize("named", [0, 3, 300])
def test_rows_without_an_id_are_ranged_too(spark, named):
    """Each text ends in the start of the one after it, whatever the share of rows without a doc_id."""
    texts = [f"{i:04} " + "abcdefgh"[i % 8] * (i % 13) for i in range(400)]
    df = spark.createDataFrame([((i << 54) - 2**61 + i if named == 300 else i, t) if i < named else (None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "xxhash64(text) AS h").cache()
    order = [r.text for r in sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))]
    wanted = Counter()
    for i, t in enumerate(order):
        half = len(t) // 2
        wanted[hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][:half]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in fingerprints.fingerprint_documents(df).collect()) == wanted


def test_sketches_merge_by_union(spark):
    """The merged sketch of two halves that share k - 1 words is that of the whole, also of tiny texts."""
    from pyspark.sql import functions as F

    for words in ([str(i) for i in range(200)], [str(i) for i in range(7)]):
        cut = len(words) // 2
        halves = (" ".join(words), " ".join(words[: cut + 4]), " ".join(words[cut:]))
        df = spark.createDataFrame([halves], "a string, b string, c string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abc"])
        whole, merged = df.select("a", fingerprints.merge(F.col("b"), F.col("c"))).first()
        assert whole == merged


def test_containment_of_unequal_texts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    long = [str(rng.random()) for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(long[500:1500]), " ".join(long))], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = df.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.resemblance(F.col("a"), F.col("b"))).first()
    assert r[0] > 0.97 and abs(r[1] - 0.25) < 0.06


# licences


def test_licenses(spark):
    files = [(1, "p/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "p/a/x", "words alone here"), (3, "p/a/b/y", "code\n# Released under the MIT License.\nmore of the code goes on here for a while and on and on"), (4, "q/z", None), (5, "p/a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "p/a/b/c/d", ""), (7, None, "x"), (8, "top", "nothing"), (9, "p2/x", "a license to thrill")]
    df = spark.createDataFrame([(*f, 1) for f in files], "doc_id long, path string, text string, directory int")
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(df).collect()}
    assert got == {1: ("Apache-2.0", "own"), 2: ("GPL-3.0", "inherited"), 3: ("MIT", "own"), 4: (None, None), 5: ("GPL-3.0", "own"), 6: ("GPL-3.0", "inherited"), 7: (None, None), 8: (None, None), 9: (None, None)}
    assert licenses.scan_licenses(df.limit(0)).collect() == []


# extraction


def test_extraction(spark):
    page = "<html><head><title>t</title><script>if (a<b) '</p>'</script></head><body><nav><ul><li><a href=/x>menu entry</a></li></ul></nav><div class=ad>Buy it now.</div><article><h1>Title here</h1><p>First  paragraph&nbsp;of the &lt;text&gt;, long enough.\n<p><b>Second.<br>Bold &am off</b> one here.</p><!-- <p>no</p> --></article><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (3, "v", "", 1), (4, "w", "<nav><a>only</a></nav>", 1), (1, "u", page, 1)], "page_id long, url string, html string, text int")
    got = extraction.extract_pages(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 5 and texts == {1: "Title here First paragraph of the <text>, long enough. Second. Bold &am off one here.", 2: "", 3: "", 4: ""}
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract_pages(df.limit(0)).collect() == []


def test_extraction_of_bare_pages():
    model = extraction.train(extraction.labelled_pages())
    assert model.extract("<body><p>The first paragraph of the page stands in the body itself, without a container.</p><p>A second one follows it, as long as the first one is.</p></body>").startswith("The first paragraph")
    assert model.extract("<body><nav><a href=/>home</a> <a href=/x>news</a></nav><p>The first paragraph of the page, in the body itself, long enough to be read.</p><p>A second one that follows it.</p><footer>&copy; me</footer></body>") == "The first paragraph of the page, in the body itself, long enough to be read. A second one that follows it."
    assert model.extract("<article><p>Here a&l<b>t;b</b> stays apart, and &lt;i&gt; is text; <math><mi>x</mi></math> too, in words that go on.</p></article>") == "Here a&lt;b stays apart, and <i> is text; x too, in words that go on."


def test_extraction_takes_linear_time():
    """100,000 nested elements, and as many end tags that match nothing."""
    import time

    model = extraction.train(extraction.labelled_pages(60))
    for page in ("<p>" + "<b>x" * 100_000, "<div>" * 100_000 + "</span>" * 100_000 + "text", "<ul>" + "<b>" * 50_000 + "<li>y" * 50_000, "<b>" * 50_000 + "<p>z" * 50_000):
        began = time.perf_counter()
        model.extract(page)
        assert time.perf_counter() - began < 30


def test_elements_end_as_before():
    """Parents in pages with omitted end tags, tables in tables and stray end tags."""
    page = "<table><tr><td>a<table><tr><td>b<tr><td>c</table><td>d<tr><td>e</table><ul><li>f<b>g<li>h<ul><li>i</ul><li>j</ul><p>k<div>l</p>m</i></div>n"
    nodes, runs = extraction.parse(page)

    def path(i):
        return [] if i <= 0 else [*path(nodes[i].parent), nodes[i].tag]

    got = {text: "/".join(path(at)) for at, text in runs if at >= 0}
    inner = "table/tr/td/table/tr/td"
    assert got == {"a": "table/tr/td", "b": inner, "c": inner, "d": "table/tr/td", "e": "table/tr/td", "f": "ul/li", "g": "ul/li/b", "h": "ul/li", "i": "ul/li/ul/li", "j": "ul/li", "k": "p", "l": "div", "m": "div", "n": ""}


def test_marginals_are_exact():
    """Message passing against the sum over all labellings of a small tree."""
    import itertools
    import math

    model = extraction.train(extraction.labelled_pages(60))
    nodes, runs = extraction.parse("<body><div class=ad>x<p>some words</p></div><article><p>more words here</p></article>")
    extraction.measure(nodes, runs)
    got = model.marginals(nodes)
    unary = [sum(model.weights.get(w, 0.0) for w in extraction.features(n)) for n in nodes]
    total, ones = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        if labels[0]:
            continue
        p = 1.0
        for i, y in enumerate(labels[1:], 1):
            q = model.given_parent(nodes[i].tag)[labels[nodes[i].parent]]
            p *= (q if y else 1 - q) * math.exp(unary[i] * y)
        total += p
        for i, y in enumerate(labels):
            ones[i] += p * y
    for i in range(1, len(nodes)):
        assert got[i] == pytest.approx(math.log(ones[i] / (total - ones[i])), abs=1e-6)


def test_extraction_held_out():
    model = extraction.train(extraction.labelled_pages())
    right = total = 0
    for page in extraction.labelled_pages(80, seed=77):
        nodes, runs = extraction.parse(page)
        extraction.measure(nodes, runs)
        belief = model.marginals(nodes)
        labels = []
        for i, n in enumerate(nodes):
            labels.append(1 if 'data-main="1"' in n.attrs else 0 if 'data-main="0"' in n.attrs or not i else labels[n.parent])
            if n.own:
                total += n.own
                right += n.own * ((belief[i] >= 0) == labels[i])
    assert right / total > 0.9


# top-k


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    vectors += [(400 + i, vectors[0][1]) for i in range(90)] + [(600, None), (601, [float("nan")] * 8), (602, [float("inf")] * 8), (603, [1.0] * 7), (604, []), (605, [None] * 8), (50, vectors[50][1])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    v = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantized(F.col("embedding")).alias("v"), "score")
    got = topk.exact_top_k(v, v.where("vec_id % 50 = 0"), 5, cell_values=160, queries_per_block=4, first_queries=3).collect()
    whole = [(i, np.floor(256 * np.array(x, dtype=np.float32).astype(float)).astype(int)) for i, x in vectors if x and len(x) and None not in x and np.isfinite(x).all()]
    wanted = set()
    for q, x in {i: x for i, x in whole if i % 50 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in whole if i != q and len(y) == len(x))[:5]
        wanted |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
    assert topk.exact_top_k(v.limit(0), v, 5).collect() == []


def test_topk_ids_stay_exact(spark):
    """Ids beyond 2**53 next to a null id, and scores beyond 2**53."""
    big = 2**53 + 2
    rows = [(big, [2**30, 1]), (big + 1, [2**30, 3]), (None, [2**30, 2]), (None, [0, 0]), (4, [0, 5])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.exact_top_k(df, df.where(f"vec_id in ({big}, {big + 1})"), 3).orderBy("query_id", "rank").collect()
    top = 2**60
    assert [tuple(r) for r in got] == [(big, 1, big + 1, top + 3), (big, 2, None, top + 2), (big, 3, 4, 5), (big + 1, 1, None, top + 6), (big + 1, 2, big, top + 3), (big + 1, 3, 4, 15)]


def test_lists_are_not_read_to_their_end():
    """Reading stops early where it can, and nothing that belongs to the top is left out."""
    rng = np.random.default_rng(5)
    k, n = 5, 2000
    for make, most in ((lambda size: rng.normal(size=size), 0.8), (lambda size: rng.exponential(size=size) ** 3, 0.4)):
        rows, queries = (np.floor(100 * make((m, 12))).astype(np.int64) for m in (n, 20))
        allowed = np.ones((20, n), dtype=bool)
        scores = queries @ rows.T
        kth = np.sort(scores, axis=1)[:, -k]
        for floors in (np.full(20, -np.inf), kth.astype(float)):
            found, read = topk.no_random_access(queries, rows, allowed, k, floors)
            for i, candidates in enumerate(found):
                assert set(np.flatnonzero(scores[i] >= kth[i])) <= set(candidates) and len(candidates) < n
            share = read.sum() / (20 * n * 12)
        assert 0 < share < most


# URL filter


def test_urls(spark):
    pages = [
        (1, "http://Sub.Example.ORG/es/x?q#f", None), (2, "https://a.com/de/1", ""), (3, "x.net", ""), (4, None, None), (5, "http://org", ""), (6, "https://a.com/fr/2", ""),
        (7, "http://b.net/x", '<link rel="canonical" href="https://a.com/de/1">'), (8, "http://c.net/y", "<META http-equiv='refresh' content='0; url=http://b.net/x'>"),
        (9, "http://d.net/z", "<link href=https://a.com/fr/2 rel=canonical>"), (10, "http://d.net/z", '<meta http-equiv="refresh" content="0;url=http://e.com/de/9">'),
        (11, "http://f.example.org/en/17", ""), (12, "http://f.example.org/fr", '<link rel="canonical" href="/es/gone">'), (13, "http://badorg/", ""), (14, "http://c.net/y", ""),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, node int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, queries.RULES).collect()}
    assert got == {
        1: ("sub.example.org", "/es/x", "example.org/es/", "block"), 2: ("a.com", "/de/1", "com/de/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("org", "", None, "allow"), 6: ("a.com", "/fr/2", "com/fr/", "allow"),
        7: ("b.net", "/x", None, "block"), 8: ("c.net", "/y", None, "block"), 9: ("d.net", "/z", None, "allow"), 10: ("d.net", "/z", None, "allow"),
        11: ("f.example.org", "/en/17", "example.org/en/1", "block"), 12: ("f.example.org", "/fr", "org/", "allow"), 13: ("badorg", "/", None, "allow"), 14: ("c.net", "/y", None, "block"),
    }
    assert urlfilter.filter_urls(df.limit(0), queries.RULES).collect() == []


def test_relative_links(spark):
    """Canonical links and redirects of all forms carry a block; links in comments and scripts do not."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(df, queries.RULES).where("page_id >= 12").collect()}
    assert got == {12: "block", 13: "block", 14: "block", 15: "block", 16: "allow", 17: "allow", 18: "allow"}


@pytest.mark.parametrize(
    ("target", "wanted"),
    [("../g", "http://a/b/g"), ("./g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y#s", "http://a/b/c/g?y#s"), ("../../../g", "http://a/g"), ("..", "http://a/b/"), (".", "http://a/b/c/"), ("../..", "http://a/"), ("g;x=1/../y", "http://a/b/c/y"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("http://h/x", "http://h/x"), ("mailto:x", None), ("", None), ("#s", None)],
)
def test_resolution_of_references(spark, target, wanted):
    """The examples of RFC 3986."""
    from pyspark.sql import functions as F

    assert spark.range(1).select(urlfilter.absolute(F.lit(target), F.lit("http://a/b/c/d;p?q"))).first()[0] == wanted


def test_least_of_hubs_without_bringing_them_together(spark):
    """Rows of keys over the bound are dealt out; nulls in both columns, and every row stays."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, i, None]), rng.choice([None, rng.randrange(10**6)]), i) for i in range(4000)] + [(-1, None, 0)]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    found = common.with_least(df, "k", "v", "i", len(rows))
    least = {}
    for k, v, _ in rows:
        if v is not None:
            least[k] = min(v, least.get(k, v))
    wanted = Counter((k, v, i, None if k is None else least.get(k)) for k, v, i in rows)
    assert Counter(map(tuple, found.collect())) == wanted
    # a hub's rows are in many partitions when the join has to shuffle
    with_shuffle = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {name: spark.conf.get(name) for name in with_shuffle}
    try:
        for name, value in with_shuffle.items():
            spark.conf.set(name, value)
        at = common.with_least(df, "k", "v", "i", len(rows)).where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    assert len(at) == 4 and max(r["count"] for r in at) < 2 * min(r["count"] for r in at)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 600)] + [(7, 7), (None, 3)]
    edges += [(2000, 2001 + i) for i in range(1500)] + [(5000 + i, 4999) for i in range(0, 900, 3)] + [(5000, 2500)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert set(got) == set(near)


# mixing


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / (sum(weigh[s] for s in open_) or 1)
        over = [s for s in open_ if level * weigh[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weigh[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)


def test_mixing(docs, rows, none):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len((t or "").translate({ord(c): " " for c in WHITE}).split(" ")) - (t or "").translate({ord(c): " " for c in WHITE}).split(" ").count("")
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    wanted = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 1 + 0.02 * wanted[s]
    assert mixing.mix_sources(none).collect() == []


def test_mixing_rates(spark):
    """Documents follow the exponential tilt that brings their source to its target (found here by bisection)."""
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 13, 40, 41])), source) for i in range(900) for source in [rng.choice("aaaaabbc")]] + [(None, " ".join(["n"] * rng.randint(1, 30)), "b") for _ in range(60)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_share=16).collect()
    for source in "abc":
        own = sorted((r.size, r.taken) for r in got if r.source == source)
        sizes = np.array([x for x, _ in own], dtype=float)
        target, z = next(r.target for r in got if r.source == source), sizes / sizes.mean()
        low, high = -50.0, 50.0
        for _ in range(200):
            tilt = (low + high) / 2
            rates = np.minimum(2, np.exp(np.clip(tilt * z, -700, 700)))
            low, high = (tilt, high) if (rates * sizes).sum() < target else (low, tilt)
        # whole copies along the sizes keep within one of the summed rates; one document holds the rest
        copies = np.array([t / s for s, t in own])
        ends = [i for i in range(len(own)) if i + 1 == len(own) or own[i + 1][0] != own[i][0]]
        assert max(abs(copies.cumsum()[i] - rates.cumsum()[i]) for i in ends) <= 2.01
        assert abs(sum(t for _, t in own) - target) <= 1


def test_targets_of_many_sources(spark):
    """Sources in code point order over many ranges, some above their caps in several rounds."""
    rng = random.Random(3)
    sizes = {f"s{i:03}é"[rng.randrange(2) :]: rng.choice([1, 10, 100, 1000, 10_000]) for i in range(150)} | {None: 40, "": 7}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2)[0].collect()}
    assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 1.5, 2))


# language ID


def test_langid(spark, docs, rows, none):
    rng = random.Random(5)
    words = {"en": "the of and that with ing er tion".split(), "de": "der die und ein ich sch ung keit".split(), "fr": "le la les que eau oux ment é".split()}
    made = [(i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    df = spark.createDataFrame([(*m, 1) for m in made] + [(900, None, "en", 1), (901, "12 !!", "en", 1), (None, "le la", None, 1)], "doc_id long, text string, lang string, score int")
    got = langid.identify_languages(df).collect()
    truth = {i: lang for i, _, lang in made}
    checked = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(checked) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in checked]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (900, 901)} == {(900, "und", 0.0), (901, "und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 303
    assert langid.identify_languages(none).collect() == []
    assert all(r.lang_pred in {"en", "de", "und"} for r in langid.identify_languages(docs).collect())


def brute_grams(text, bits):
    """Buckets of a text's n-grams, one after the other."""
    plain = "".join(c if c.isalpha() else " " for c in text.lower())
    plain = f" {' '.join(plain.split(' '))} "
    while "  " in plain:
        plain = plain.replace("  ", " ")
    found = Counter()
    for order in (1, 2, 3):
        for at in range(len(plain) - order + 1):
            h = order
            for i, c in enumerate(plain[at : at + order]):
                h = (h ^ ord(c)) * langid.MIX[i] % 2**32
                h ^= h >> 15
            found[h >> (32 - bits)] += 1
    return found


def test_scores_of_a_batch_are_those_of_each_text():
    """Sparse batches, in pieces and whole, against the naive Bayes sum of each text by itself."""
    rng = np.random.default_rng(9)
    log_p = np.log(rng.dirichlet(np.ones(1 << 10), size=3))
    texts = ["Grüße, ab  " * 40, "x", " ..1 a-b\tc", "İstanbul ΑΣ", "the quick " * 300]
    step = langid.STEP
    try:
        for langid.STEP in (step, 17):
            likely, n = langid.score_batch(texts, log_p, 10)
            for i, text in enumerate(texts):
                wanted = brute_grams(text, 10)
                assert n[i] == sum(wanted.values())
                assert likely[i] == pytest.approx([sum(count * of[b] for b, count in wanted.items()) for of in log_p])
    finally:
        langid.STEP = step


def test_posteriors(spark):
    """The model and the scores of a small table against counts made by hand."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aaa bab", "x"), ("bbb aba", "y"), ("abab", "x"), ("ccc", "z"), ("b", "y"), ("aa", None), ("cab", None)] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(brute_grams(t, 14))
    for r in langid.identify_languages(df).collect():
        log = {}
        for lang, seen in counts.items():
            total = sum(seen.values()) + (1 << 14)
            log[lang] = sum(n * np.log((seen[b] + 1) / total) for b, n in brute_grams(rows[r.doc_id][1], 14).items())
        n = sum(brute_grams(rows[r.doc_id][1], 14).values())
        odds = {lang: np.exp((x - max(log.values())) * min(n, 64) / n) for lang, x in log.items()}
        assert r.lang_pred == max(sorted(log), key=log.get) and r.score == pytest.approx(1 / sum(odds.values()))
    many = spark.range(30).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        langid.fit(many, most_langs=20)


# Jaccard join


def brute_components(rows, k, percent):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for doc_id, text, *_ in rows:
        words = [w for w in (text or "").translate(table).translate({ord(c): " " for c in WHITE}).split(" ") if w]
        sets.append((doc_id, {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (3, 50)])
@pytest.mark.parametrize("most_rows", [1024, 6])
def test_jaccard(docs, rows, k, percent, most_rows):
    got = jaccard.jaccard_components(docs, k, percent, most_rows=most_rows, depth=2)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, k, percent)


def test_jaccard_large_ball(spark):
    """One region of near copies far above the task's limit, with chains out of its reach."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for depth in (0, 1, 4):
        got = jaccard.jaccard_components(df, 3, 80, most_rows=10, depth=depth)
        assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 3, 80)


def test_region_links_against_all_pairs():
    """Dividing by pivots, in all mixtures of kinds, connects what all pairs connect."""
    rng = np.random.default_rng(8)
    for case in range(60):
        m, percent = int(rng.integers(2, 150)), int(rng.choice([50, 80, 90]))
        centres = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(int(rng.integers(1, 5)))]
        sets = []
        for _ in range(m):
            one = centres[int(rng.integers(len(centres)))].copy()
            change = rng.integers(0, len(one), int(rng.integers(0, 9)))
            one[change] = rng.integers(0, 60, len(change)).astype(np.uint64)
            sets.append(np.unique(one))
        kinds = np.full(m, jaccard.HOME) if case % 2 else rng.choice([jaccard.HOME, jaccard.VISITOR], m)

        def parts(a, b):
            return {frozenset(p) for p in _components(m, zip(a, b, strict=True))}

        x, y = jaccard.pairs_of(kinds, sets, percent)
        assert parts(*jaccard.region_links(kinds, sets, percent)) == parts(x.tolist(), y.tolist())


def _components(m, edges):
    root = list(range(m))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for i in range(m):
        out[find(i)].add(i)
    return out.values()


def test_jaccard_rows_without_an_id(spark):
    """Very many rows without a doc_id, copies among them, in time that grows with their number only."""
    rows = [(None, f"{i % 1500} a b c d e f {i % 1500} g h") for i in range(6000)] + [(7, "3 a b c d e f 3 g h"), (7, "other words here"), (None, "other words here")]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == Counter({(None, 8, None): 6000 - 4, (None, 8, 7): 4, (7, 8, 7): 1, (7, 1, 7): 1, (None, 1, 7): 1})


def test_sketches_of_unlike_sizes():
    """A small set beside large ones does not blunt their sketches, and no set within reach is ruled out."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64) * np.uint64(2)) for n in rng.integers(5, 3000, 150)]
    for i in range(0, 150, 10):  # near copies
        sets.append(np.unique(np.concatenate([sets[i][: max(1, len(sets[i]) * 24 // 25)], rng.integers(0, 2**63, len(sets[i]) // 50, dtype=np.uint64)])))
    sizes = np.array([len(x) for x in sets])
    for percent in (80, 90, 100):
        near = jaccard.within_reach(sizes, [jaccard.parity(x) for x in sets], percent)
        links = np.zeros(len(sets), dtype=bool)
        for i, a in enumerate(sets):
            for j in range(i):
                if percent * max(sizes[i], sizes[j]) <= 100 * min(sizes[i], sizes[j]) and jaccard.linked(len(np.intersect1d(a, sets[j])), sizes[i], sizes[j], percent):
                    links[[i, j]] = True
        assert not (links & ~near).any()
        assert near.sum() <= links.sum() + 8


@pytest.mark.parametrize(("percent", "most_rows"), [(50, 6), (80, 8), (90, 300), (100, 8)])
def test_deal_sizes(spark, percent, most_rows):
    """All rows of a region whose sizes may link meet in a part of few rows, or are not dealt."""
    rng = random.Random(2)
    rows = [(5, i, rng.choice([7, 7, 7, 8, rng.randint(1, 400)])) for i in range(300)]
    dealt, whole = jaccard.deal_sizes(spark.createDataFrame(rows, "pivot long, cid long, n long"), percent, most_rows)
    held, whole = defaultdict(set), {r.cid for r in whole.collect()}
    for r in dealt.collect():
        held[r.part, r.pair].add(r.cid)
    assert max(map(len, held.values())) <= max(2 * most_rows, 24)
    met = {(a, b) for h in held.values() for a in h for b in h}
    for _, a, n in rows:
        for _, b, m in rows:
            if a != b and percent * m <= 100 * n and percent * n <= 100 * m:
                assert (a, b) in met or {a, b} <= whole


def test_jaccard_crowded_by_chance(spark, monkeypatch):
    """Shingles are fetched for what may link, and not for all of a large region whose sets share a passage only."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 90))) + " " + passage) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(10)]
    written = {}
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: (out := real(df, name), written.__setitem__(name, out[0].count()))[0])
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, sample_rows=1, most_rows=32)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows, 3, 80)
    assert written["members"] <= 200  # several hundred rows are in large regions


def test_materialize_leaves_no_shuffle_files(spark):
    """What a written query has shuffled goes when it is written; the session's setting is as before."""
    name = staging.CLEANUP
    was = spark.conf.get(name, None)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    files = lambda: sum(str(f).endswith(".data") and "shuffle_" in str(f) for f in manager.diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = files()
    staging.materialize(spark.range(1000).repartition(3, "id").groupBy("id").count(), "test")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(name, None) == was


def test_jaccard_empty(none):
    assert jaccard.jaccard_components(none).collect() == []


PAGES = [
    (1, "https://a.net/start", '<meta http-equiv="refresh" content="0; url=https://b.com/de/x">' + "x" * 1000),
    (2, "https://b.com/de/x", "<p>blocked</p>"),
    (3, "HTTPS://A.net/start#top", '<link rel="canonical" href="//b.com/de/x">'),
    (4, "http://c.example.org/en/12?q", "<p>blocked by the longer rule</p>"),
    (5, "http://c.example.org/en/2", "<link rel=canonical href='/es/1'>"),
    (6, "http://c.example.org/es/1", "blocked by its rule, its component is allowed"),
    (7, "ftp://x.com:80/de/", "another host, with its port"),
    (8, None, "é" * 800),
    (9, "no scheme", "é" * 800),
    (10, "http://d.net", None),
    (10, "http://d.net", None),
    (11, "http://ORG/\ny", ""),
    (12, "http://e.net/a/b/c?x=1", "<link rel='alternate canonical' href='../d'><link rel=canonical href=./e/../f/.>"),
    (13, "http://e.net/a/d", "x"),
    (14, "http://e.net/a/b/f/", '<meta content="0;URL=\'?go=1\'" http-equiv="Refresh"><!-- <link rel=canonical href=/clean> -->'),
    (15, "http://e.net/a/b/f/?go=1", "<script>'<link rel=canonical href=/clean>'</script><link data-rel=canonical rel='stylesheet' href=/clean><link rel='canonical' href='https://z.com/de/q&amp;r'>"),
    (16, "http://e.net/clean", "<link rel=canonical href='mailto:me'><link rel=canonical href='#top'><meta http-equiv=refresh content=30>"),
    (17, "http://e.net", "<link rel=canonical href='to/x?u=http://b.com/de/x'>"),
    (18, "http://e.net/to/x?u=http://b.com/de/x", None),
]


@pytest.mark.parametrize("name", ["op2_warc", "op6_topk", "op7_urls", "op10_jaccard"])
def test_query_is_its_sql(spark, rows, name, tmp_path):
    import duckdb

    pages = PAGES
    vectors = [(i, [((i * 7 + j) % 11) / 8 - 0.5 for j in range(4)]) for i in range(120)] + [(150, None), (200, [0.1, None, 0.2, 0.3]), (250, [float("nan")] * 4)]
    connection = duckdb.connect()
    tables = {"pages": (pages, "page_id long, url string, html string"), "documents": (rows, "doc_id long, text string, lang string, source string"), "embeddings": (vectors, "vec_id long, embedding array<float>")}
    for table, (held, schema) in tables.items():
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))
    assert got.count() > 0
