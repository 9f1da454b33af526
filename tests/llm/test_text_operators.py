"""Each operator against a brute-force version, on a fixture of odd rows."""

import hashlib
import math
import random
import re
import struct
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from seqsim.llm import byte_bpe, common, entries, exact_dedup, html_text, language, licenses, minhash_forest, mixing, near_texts, negatives, periodic, quality, simhash, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, uid string, ids string, key string, fp string, size string, kept string, host string, n int, lines string, _id string, _n int, _key string, row string, i int, k int, own string, stays string, common string, copies int, sha string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base = text(120)
    edited = base.split()
    edited[60] = "zebra"
    passage = text(40)
    out = [None, "", "   \n\t", "one", "two words", base, base, " ".join(edited), base.upper(), passage, text(80) + "\n" + passage + "\n" + text(30), passage + " " + text(90)]
    out += ["é" * 150 + " ß漢字 " + "é" * 150, "a" * 3000, "ab" * 1500, "\n".join(["same line here"] * 40), text(20_000), "#*$%&|<> it's we'll\u00a0they'RE 12 ½  x\n\n y", "\x1c\x85\u2028 \u3000z" * 30, "MIT says: Released under the MIT License. So."]
    return out


def odd_rows():
    out = []
    for i, t in enumerate(odd_texts()):
        out.append((i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 5 else None, None, 1, "u", "i", "k", "f", "s", "x", "h", 2, "l", "_i", 3, "_k", "r", 4, 5, "o", "s", "c", 6, "sha"))
    out += [(None, "a null id", "en", "src1", *out[0][4:]), (7, "an id again, another text " * 9, None, None, *out[0][4:]), out[5], out[1]]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(rows, key=repr)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


# --- byte-level BPE


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.vocabulary(entries.ranks_path())[0], special_tokens={})


def test_bpe_like_the_library(spark, odd, empty):
    known = tiktoken_encoding()
    path = entries.ranks_path()
    want = ordered((i, known.encode_ordinary(t or "")) for i, t in (r[:2] for r in odd_rows()))
    got = byte_bpe.encode(odd, path)
    assert got.columns == ["doc_id", "ids", "ends"]
    rows = got.collect()
    assert ordered((r.doc_id, list(r.ids)) for r in rows) == want
    decoded = byte_bpe.decode(got, path).collect()
    assert ordered((r.doc_id, bytes(r.decoded).decode()) for r in decoded) == ordered((i, t or "") for i, t in (r[:2] for r in odd_rows()))
    tokens = byte_bpe.vocabulary(path)[2]
    for r in rows:
        at = 0
        for i, e in zip(r.ids, r.ends, strict=True):
            at += len(tokens[i])
            assert e == at
    assert byte_bpe.decode(byte_bpe.encode(empty, path), path).collect() == []


def test_bpe_boundaries():
    import public_tokenizers

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(0)
    import numpy as np

    letters = "ab'\n\t 1é\u00a0!?srtvemldST漢\U0001f600\x85"
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
        starts = byte_bpe.boundaries(points, np.array([len(text)])).tolist()
        assert starts == [m.start() for m in pattern.finditer(text)] + [len(text)], repr(text)


def test_bpe_over_all_code_points():
    known, path = tiktoken_encoding(), entries.ranks_path()
    import numpy as np

    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    forms = ("a{0}b {0} 1{0}2", "'s{0}'{0}ll  {0}\t{0}", "{0}{0}!{0}")
    for k in range(0, len(points), 1 << 15):
        text = "\n".join(form.format(chr(i)) for i in points[k : k + (1 << 15)] for form in forms)
        want = known.encode_ordinary(text)
        ids, stops, ends = byte_bpe.encoded([text.encode()], path)
        assert np.array_equal(ids, want)
        assert byte_bpe.decoded(ids.astype(np.int64), ends, stops, path)[0].tobytes() == text.encode()


def test_bpe_decoding_by_offsets(spark):
    path = entries.ranks_path()
    rows = byte_bpe.encode(spark.createDataFrame([(1, "naïve 漢字 text, it's"), (2, ""), (3, None)], "doc_id bigint, text string"), path)
    for r in byte_bpe.decode(rows, path).collect():
        tokens, at = byte_bpe.vocabulary(path)[2], 0
        for i, e in zip(r.ids, r.ends, strict=True):
            assert bytes(r.decoded)[at:e] == tokens[i]
            at = e
    both = byte_bpe.encode(spark.createDataFrame([(1, "naïve 漢字 text, it's"), (2, ""), (3, None)], "doc_id bigint, text string"), path, decoded_col="ids_back").collect()
    assert {r.doc_id: bytes(r.ids_back).decode() for r in both} == {1: "naïve 漢字 text, it's", 2: "", 3: ""}
    none = byte_bpe.decode(rows.withColumn("ids", F.when(F.col("doc_id") > 1, F.col("ids"))), path).collect()
    assert {r.doc_id: r.decoded and bytes(r.decoded) for r in none} == {1: None, 2: b"", 3: b""}
    with pytest.raises(Exception, match="don't fit"):
        byte_bpe.decode(rows.withColumn("ends", F.transform("ends", lambda e: e + 1)), path).collect()


def test_bpe_merges_agree():
    ranks = byte_bpe.vocabulary(entries.ranks_path())[0]
    rng = random.Random(2)
    pieces = ["".join(rng.choices("abcdeé 漢", k=rng.randint(1, 30))).encode() for _ in range(400)]
    import numpy as np

    fast = byte_bpe.merged_side_by_side(pieces, entries.ranks_path())
    assert [np.frombuffer(x, np.int32).tolist() for x in fast] == [byte_bpe.merged(p, {k: v for k, v in ranks.items() if k != p or len(p) == 1} if p in ranks else ranks) if p not in ranks else np.frombuffer(x, np.int32).tolist() for p, x in zip(pieces, fast, strict=True)]


# --- suffix dedup


def without_repeats(rows):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of texts in order."""
    seen, out = set(), []
    for t in rows:
        b = t.encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append((len(b), sum(hit), sum(hit[j] and (not j or not hit[j - 1]) for j in range(len(b))), sha(bytes(x for x, h in zip(b, hit, strict=True) if not h))))
    return out


@pytest.mark.parametrize("crowded", [2000, 1])
def test_suffix_dedup(spark, odd, empty, crowded, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rows = sorted((r[:2] for r in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = ordered((i, *x) for (i, _), x in zip(rows, without_repeats([t or "" for _, t in rows]), strict=True))
    out = suffix_dedup.suffix_dedup(odd)
    assert out.columns == ["doc_id", "n_bytes", "spans", "kept"]
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), sha(bytes(r.kept))) for r in out.collect()]
    assert ordered(got) == want
    assert suffix_dedup.suffix_dedup(empty).collect() == []


def test_suffix_dedup_query(spark):
    rows = sorted(r[:2] for r in documents())
    want = ordered((i, *x) for (i, _), x in zip(rows, without_repeats([t or "" for _, t in rows]), strict=True))
    assert ordered(tuple(r) for r in entries.op2_suffix_dedup(spark, SF).collect()) == want


def test_suffix_dedup_after_collisions(spark, monkeypatch):
    """With 1 as a base a hash is the sum of bytes: contexts of equal letters in another order collide."""
    rng = random.Random(13)
    middle = bytes(rng.choices(b"abcdefgh", k=60)).decode()
    left, right = ("".join(rng.choices("xyz", k=90)) for _ in range(2))
    texts = [left + middle + right, "".join(sorted(left)) + middle + right, left[::-1] + middle + right[::-1], left + middle + right]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    want = [(i, *x) for i, x in enumerate(without_repeats(texts))]
    tried = []
    plain = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda rows, base: tried.append(plain(rows, base)) or tried[-1])
    for bases in ((1, *suffix_dedup.CONTEXTS), suffix_dedup.CONTEXTS):
        monkeypatch.setattr(suffix_dedup, "CONTEXTS", bases)
        tried.clear()
        got = suffix_dedup.suffix_dedup(df).collect()
        assert ordered((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), sha(bytes(r.kept))) for r in got) == want
        assert tried[-1] is not None and (bases[0] == 1 or len(tried) == 1)


def test_suffix_dedup_within_tasks(monkeypatch):
    """What a task finds by itself: pieces of a few bytes, an anchor in very many texts, and windows sent before."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(17)
    passage = "".join(rng.choices("abcdefgh", k=140))
    texts = [("".join(rng.choices("mnopq", k=rng.randint(0, 150))) + passage + "".join(rng.choices("mnopq", k=rng.randint(0, 90)))) for _ in range(30)]
    texts = [x for x in texts for _ in range(2)] + texts[:20]
    batch = pa.RecordBatch.from_pydict({"uid": pa.array(range(len(texts)), pa.int64()), "text": texts})
    monkeypatch.setattr(common, "CHUNK_BYTES", 3000)
    rows = [r for b in suffix_dedup.anchor_rows(iter([batch]), suffix_dedup.CONTEXTS[0], 12) for r in b.to_pylist()]
    # a repeat that a task tells by itself is a stretch of bytes that strings of an earlier start cover
    starts = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 99):
            starts.setdefault(t[at : at + 100], (i, at))
    repeats = [r for r in rows if r["repeat"]]
    for r in repeats:
        t, first, last = texts[r["uid"]], r["anchor"] - r["before"], r["anchor"] - r["after"]
        covered = {k for at in range(len(t) - 99) if starts[t[at : at + 100]] < (r["uid"], at) for k in range(at, at + 100)}
        assert set(range(first, last + 100)) <= covered
    assert len(repeats) > 30 and sum(r["before"] - r["after"] > 35 for r in repeats) > 5 and any(r["uid"] >= 60 for r in repeats)
    assert any(r["uid"] < 0 for r in rows) and any(r["crowded"] and r["uid"] >= 0 for r in rows)
    seen = suffix_dedup.Seen()
    buffer, at, size = np.frombuffer(b"abcdefabcdxf", np.uint8), np.array([0]), np.array([6])
    seen.add(np.array([5]), np.array([1]), buffer, at, size)
    ask = lambda uid, start: seen.repeats(np.array([5]), np.array([uid]), buffer, np.array([start]), size).tolist()
    assert ask(2, 0) == [True] and ask(1, 0) == [False] and ask(2, 6) == [False]  # a later text, the same one, other bytes


@pytest.mark.parametrize("limit", [1, 256])
def test_suffix_dedup_keys_keep_all_bits(limit):
    """Anchors have one key in all tasks, those that meet no crowded anchor too; texts are of one anchor each or periodic."""
    import pyarrow as pa

    rng = random.Random(23)
    texts = ["".join(rng.choices("abcdefgh", k=400)) for _ in range(20)] + ["ab" * 300]
    want = {(u, int(k)) for u, t in enumerate(texts) for k in suffix_dedup.anchors([t.encode()], suffix_dedup.CONTEXTS[0])[1]}
    for some in (range(20), range(21)):
        batch = pa.RecordBatch.from_pydict({"uid": pa.array(some, pa.int64()), "text": [texts[i] for i in some]})
        rows = [r for b in suffix_dedup.anchor_rows(iter([batch]), suffix_dedup.CONTEXTS[0], limit) for r in b.to_pylist()]
        assert {r["uid"] for r in rows if r["uid"] >= 0} == set(some)
        assert {(r["uid"], r["key"]) for r in rows if 0 <= r["uid"] < 20} == {(u, k) for u, k in want if u < 20}


@pytest.mark.parametrize("in_task", [256, 8])
def test_suffix_dedup_of_a_common_passage(spark, in_task, monkeypatch):
    rng = random.Random(19)
    passage = "".join(rng.choices("abcdefgh", k=110))
    texts = ["".join(rng.choices("mnopqrst", k=60)) + passage + "".join(rng.choices("mnopqrst", k=60)) for _ in range(80)]
    texts += texts[:9]
    monkeypatch.setattr(suffix_dedup, "CROWDED_IN_TASK", in_task)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), sha(bytes(r.kept))) for r in suffix_dedup.suffix_dedup(df).collect()]
    assert ordered(got) == ordered((i, *x) for i, x in enumerate(without_repeats(texts)))


def test_suffix_sort_orders_and_finds_collisions(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    base = bytes(rng.choices(b"ab", k=130))
    contexts = [base[:k] + bytes(rng.choices(b"ab", k=130 - k)) for k in (130, 130, 110, 105, 40, 130)]
    n = len(contexts)
    args = (np.zeros(n, np.int64), np.arange(n)[::-1].copy(), np.zeros(n, np.int64), np.full(n, 31), np.full(n, 15), contexts)
    want = [any(contexts[j][p : p + 100] == contexts[i][p : p + 100] for j in range(i + 1, n)) for i in range(n) for p in range(31)]
    assert suffix_dedup.repeats_in(*args).tolist() == want
    monkeypatch.setattr(suffix_dedup.Prefixes, "hash", lambda self, a, b: np.zeros(len(np.atleast_1d(a)), np.uint64))  # everything collides
    assert suffix_dedup.repeats_in(*args).tolist() == want


# --- URL filter


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/EN/x", "http://example.net/en/", "http://example.net/en", "https://x.y.example.com/de/?q#f", "http://notexample.com/de/", "http://evil.com/.net/", "http://a.org/fr/1?x", "http://org/fr/", "http://net/", "http://net", "x://a.NET:80/", "http://é.net/ü", "http://a.net?x/", "ftp://u@b.net/#/", "http://a.net/" + "y" * 5000, "a://b://c.net/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[5], "x"), (5, urls[5], "x")], "page_id bigint, url string, host string")

    def want(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in entries.RULES for h, p in [r.prefix.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda r: len(r.prefix), default=None)
        return host, path, best and best.prefix, best.verdict if best else "allow"

    got = [tuple(r) for r in url_filter.filter_urls(df, entries.RULES).collect()]
    assert ordered(got) == ordered([(i, *want(u)) for i, u in enumerate(urls)] + [(None, *want(urls[5])), (5, *want(urls[5]))])
    assert url_filter.filter_urls(df.limit(0), entries.RULES).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_many_globs_over_words():
    globs = [f"*.site{i}.com/a*b/**" for i in range(40)]
    fits = url_filter.Automaton(globs).fits([b".www.site7.com/aXXb/c", b".site39.com/ab/", b".site3.com/a/b/", b""])
    assert [(i.item(), j.item()) for i, j in zip(*fits.nonzero(), strict=True)] == [(0, 7), (1, 39)]  # * stands for no /


# --- HTML


def article(source):
    m = re.search(r"<article.*?</article>", source, re.S)
    t = re.sub(r"<[^>]*>", "", re.sub(r"<(p|br|h1|/p|/h1)\b[^>]*>", " ", m[0]))
    import html

    return " ".join(html.unescape(t).split())


def test_html_query(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in entries.op4_html_text(spark, SF).collect()}
    assert got == {i: article(h) for i, h in pages}


def test_html_kinds(spark):
    prose = "Here is a long paragraph of prose, which goes on for a while. " * 4
    body = f"<h1 class='entry-title'>Title</h1><p>{prose}<p>More &amp; more<br>lines.</p>"
    around = '<nav><a href=/>Home</a></nav>{}<div class="comments"><p>' + prose + '</p></div><aside class="sidebar"><p>' + prose + "</p></aside><form><p>Mail</p></form><footer>c</footer>"
    want = " ".join(f"Title {prose} More & more lines.".split())
    sources = [around.format(f"<article>{body}</article>"), around.format(f'<div class="post-content">{body}</div>'), around.format(f"<main><article>{body}<div class='share'><a>Share</a></div></article></main>"), f"<html><title>No</title><body><script>if (a<b) x='</p>'</script><div class='cookie-notice'>We use cookies</div><article>{body}</article></body>", f"<div id='page'><header class='top'><p>Site</p></header><div class='entry'>{body}<section class='reader-comments'><p>{prose}</p><p>{prose}</p></section></div><div class='related-posts'><p>{prose}</p></div></div>"]
    rows = [(i, "u", s) for i, s in enumerate(sources)] + [(90, None, None), (91, "u", ""), (92, "u", "<p></p>"), (93, "u", "<div" * 2000), (94, "u", "<div>" * 3000), (None, "u", sources[0]), (0, "u", sources[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = html_text.extract(df, html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (want if r.page_id is None or r.page_id < 90 else ""), (r.page_id, r.text[:300])
    assert html_text.extract(df.limit(0), html_text.fit(df.limit(0))).collect() == []


@pytest.fixture(scope="module")
def page_model(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def page_text(source, model):
    page = html_text.parse(source)
    return html_text.main_text(page, model.odds(html_text.features(page, model.said)))


def test_html_blocks_by_their_surroundings(page_model):
    prose = ("Here is a long paragraph of prose, which goes on for a while. " * 4).strip()
    page = "<html><body><nav><a href=/>Home</a></nav>{}<footer>f</footer></body></html>"
    cases = [
        (f"<article><h1>Title</h1><h2 class='section-header'>Part</h2><p>{prose}</p></article>", f"Title Part {prose}"),
        (f"<article><h1>Title</h1><p class='search-results-text'>Some words here.</p><p>{prose}</p></article>", f"Title Some words here. {prose}"),
        (f"<article><header><h1>Title</h1></header><p>{prose}</p></article>", f"Title {prose}"),
        (f"<article><h1>Title</h1><p>{prose}</p><p>{prose}</p></article><div class='rail'><h3>More</h3><p>{prose}</p></div>", f"Title {prose} {prose}"),
        (f"<article><h1>Title</h1><p>{prose}</p></article><div id='disqus_thread'><p>{prose}</p><p>{prose}</p></div>", f"Title {prose}"),
        (f"<article><h1>Title</h1><p>{prose}</p></article><section id='kommentare'><article><p>{prose}</p></article></section>", f"Title {prose}"),
        (f"<article><h1>Title</h1><p>{prose}</p><p>{prose}</p></article><div class='qwertz'><p>{prose}</p></div>", f"Title {prose} {prose}"),
    ]
    for source, want in cases:
        assert page_text(page.format(source), page_model) == want


def test_html_of_other_makes(page_model):
    """Pages of invented makes and names, from words that the model hasn't seen."""
    scores, whole = [], 0
    for k, source in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.1/pages.parquet' WHERE page_id >= 2000 AND page_id < 2100").fetchall():
        rng = random.Random(-k)
        for made in (html_text.varied(source, rng), html_text.composed(html_text.words_of(source, rng), rng)):
            page = html_text.parse(made)
            kept = html_text.labels(page)
            want = "".join(" " if t is None else t for n, t in page.parts if t is None or kept[n]).split()
            got = page_text(re.sub(r" x-label=[01]", "", made), page_model).split()
            scores.append(2 * (Counter(want) & Counter(got)).total() / (len(want) + len(got)))
            whole += want == got
    assert sum(scores) / len(scores) > 0.93 and whole > 0.6 * len(scores)


#: Pages of makes that training pages don't have, by make: {p} and {q} are prose, {{ }} what isn't of the article.
MAKES = {
    "paragraphs as divs": ["<html><body><div><div>{p}</div><div>{q}</div></div></body></html>", "<body>{{<ul><li><a href=/>Home</a></li></ul>}}<div id=a><div>{p}</div><div>{q}</div><div>{p}</div></div></body>"],
    "paragraphs in the body": ["<html><head><title>t</title></head><body><h1>Title</h1><p>{p}</p><p>{q}</p></body></html>", "<h2>Title</h2><p>{p}<p>{q}"],
    "no markup": ["{p}\n{q}", "{p}"],
    "captions": ["<body>{{<nav><a href=/>Home</a></nav>}}<article><h1>Title</h1><p>{p}</p><figure><img src=a><figcaption>A caption here</figcaption></figure><p>{q}</p></article></body>", "<main><figure><figcaption>Over the city</figcaption></figure><p>{p}</p></main>"],
    "header cells": ["<body><article><h1>Title</h1><p>{p}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table></article>{{<footer>f</footer>}}</body>"],
    "lists of links": ["<body>{{<nav><a href=/>Home</a></nav>}}<article><h1>Title</h1><p>{p}</p><ul><li><a href=a>first thing</a></li><li><a href=b>second thing</a></li></ul><p>{q}</p></article></body>"],
    "table layouts": ["<body><table><tr><td>{{<a href=/>Home</a><br><a href=/b>News</a>}}</td><td><h1>Title</h1><p>{p}</p><p>{q}</p></td></tr></table></body>"],
    "lines in one block": ["<body>{{<div id=top><a href=/>Home</a></div>}}<div>{p}<br><br>{q}</div></body>"],
    "remarks of readers": ["<body><main><h1>Title</h1><p>{p}</p><p>{q}</p></main>{{<section id='lesermeinungen'><h3>x</h3><article><p>{p}</p></article></section>}}</body>", "<body><article><h1>Title</h1><p>{p}</p><p>{q}</p></article>{{<div class=talkback><p>{q}</p></div>}}</body>"],
    "side columns": ["<body><article><h1>Title</h1><p>{p}</p><p>{q}</p></article>{{<div class='gutter'><h3>More</h3><p>{q}</p></div><footer>f</footer>}}</body>"],
    "consent": ["<body>{{<div class='einwilligung'><p>We use things. Accept?</p><button>OK</button></div>}}<div class=q><h1>Title</h1><p>{p}</p><p>{q}</p></div></body>"],
}


def test_html_of_makes_written_apart(page_model):
    """The words' F1 by make; a page of prose and nothing else is never empty."""
    rng = random.Random(12)
    prose = lambda: (" ".join(rng.choices("water stone river bridge over under and the long north".split(), k=rng.randint(9, 14))).capitalize() + ". ") * 1
    scores = {}
    for make, pages in MAKES.items():
        for page in pages * 3:
            p, q = ("".join(prose() for _ in range(rng.randint(3, 6))).strip() for _ in "pq")
            whole = page.replace("{p}", p).replace("{q}", q)
            want = " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"<title>.*?</title>|{{.*?}}", " ", whole, flags=re.S)).split()).split()
            got = page_text(whole.replace("{{", "").replace("}}", ""), page_model).split()
            assert got
            scores.setdefault(make, []).append(2 * (Counter(want) & Counter(got)).total() / (len(want) + len(got)))
    means = {make: sum(x) / len(x) for make, x in scores.items()}
    assert min(means.values()) > 0.85 and sum(means.values()) / len(means) > 0.95, means


def test_html_without_marks_or_pages(spark):
    prose = ("Here is a long paragraph of prose, which goes on for a while. " * 3).strip()
    source = f"<html><body><ul class='menu'><li><a href=/>Home</a></li></ul><div class='post'><h1>Title</h1><p>{prose}</p><p>{prose}</p></div><div class='footer'>f</div></body></html>"
    df = spark.createDataFrame([(k, "u", source) for k in range(3)], "page_id bigint, url string, html string")
    for pages in (df, df.limit(0), df.withColumn("html", F.lit(None).cast("string"))):
        got = html_text.extract(df, html_text.fit(pages)).collect()
        assert {r.text for r in got} == {f"Title {prose} {prose}"}


# --- SimHash


def fingerprint(text, width):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(keys, linked):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(keys))]


def component_ids(ids, fps):
    root = classes(fps, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = defaultdict(list)
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r].append(ids[i])
    return [min(least[r], default=None) for r in root]


@pytest.mark.parametrize("crowded", [200, 1])
def test_simhash(spark, odd, empty, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rows = [r[:2] for r in odd_rows()]
    fps = [fingerprint(t, 3) for _, t in rows]
    want = [(i, f, c) for (i, _), f, c in zip(rows, fps, component_ids([r[0] for r in rows], fps), strict=True)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(odd).collect()]
    assert ordered(got) == ordered(want)
    assert simhash.near_groups(empty).collect() == []


@pytest.mark.parametrize("crowded", [200, 1])
def test_simhash_links(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(8)]
    for _ in range(60):
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    tree = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    root = classes(fps, lambda i, j: ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 2)
    assert [tree.get(f, f) for f in fps] == [fps[r] for r in root]


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a bigint, b bigint")
    got = simhash.components(edges).collect()
    assert sorted(r.node for r in got) == list(range(n)) and {r.root for r in got} == {0}


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def test_near_texts(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=220)) for _ in range(10)]
    for _ in range(40):
        t = rng.choice(texts[:4]).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["", None, "short text", "short text"]
    sets = [shingles(t) for t in texts]
    root = classes(texts, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.id: r.root for r in near_texts.near_classes(df).collect()}
    assert got == dict(enumerate(root))
    assert sorted(r.doc_id for r in near_texts.keep_one(df).collect()) == sorted(set(root))
    assert near_texts.keep_one(df.limit(0)).collect() == []


def near_roots(texts):
    sets = [shingles(t) for t in texts]
    return classes(texts, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))


def test_shingle_sets_are_stored_as_they_are(spark):
    """Compression would gain nothing and hold large buffers."""
    sets = near_texts.shingle_sets(spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "uid bigint, text string"), 5)
    files = [pq.ParquetFile(x.removeprefix("file://")) for x in sets.inputFiles()]
    groups = [f.metadata.row_group(k) for f in files for k in range(f.metadata.num_row_groups)]
    assert groups and {g.column(c).compression for g in groups for c in range(g.num_columns)} == {"UNCOMPRESSED"}
    assert sets.count() == 20


def test_near_texts_among_odd_ids(spark):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    copies = [t + " end" for t in texts]
    rows = [*enumerate(texts + copies), (None, texts[3] + " null"), (None, "a null id of its own"), (5, "id five again"), (30, "twice"), (30, "twice"), (7, copies[8])]
    rows.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    root = near_roots([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in near_texts.keep_one(df).collect()]
    assert ordered(got) == ordered([r for k, r in enumerate(rows) if root[k] == k])


@pytest.mark.parametrize("cross", [near_texts.CROSS, 20])
def test_near_texts_in_large_groups(spark, cross, monkeypatch):
    """Thousands of near copies and of texts that share a passage: one class, and none; pairs stay few."""
    monkeypatch.setattr(near_texts, "CROSS", cross)
    rng = random.Random(51)
    word = lambda: f"w{rng.randrange(20_000)}"
    base, passage, texts = [word() for _ in range(140)], [word() for _ in range(60)], []
    for k in range(2000):
        copy = list(base)
        copy[rng.randrange(140)] = f"edit{k}"
        own = [word() for _ in range(60)]
        at = rng.randrange(60)
        texts += [" ".join(copy), " ".join(own[:at] + passage + own[at:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    sets = near_texts.shingle_sets(common.keyed(df, "doc_id", "text"), 5)
    held = near_texts.entries(sets, near_texts.equal_links(sets, 0.8), 0.8)
    tree = common.saved(simhash.components(near_texts.center_links(held, sets, 0.8)).withColumnRenamed("node", "uid"))
    rest = near_texts.open_members(held, tree, sets)
    assert rest.where("root != bulk").count() < 20 * len(texts)
    assert sorted(r.doc_id for r in near_texts.keep_one(df).collect()) == [0, *range(1, 4000, 2)]


def test_near_texts_by_fingerprints(spark):
    """SimHash links copies with a word changed; what it proposes is verified: equal fingerprints of other texts are no links."""
    rng = random.Random(29)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:-1], f"new{i}"]) for i, x in enumerate(base)]
    df = spark.createDataFrame(list(enumerate(texts)), "uid bigint, text string").repartition(3)
    sets = near_texts.shingle_sets(df, 5)
    fp = [simhash.fingerprint(t.encode(), 5) for t in texts]
    near = {(i, j) for i in range(12) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2}
    got = {(r.b, r.a) for r in near_texts.fingerprint_links(df, sets, 5, 0.8).collect()}
    assert got == near and got <= {(i + 6, i) for i in range(6)} and len(got) > 2
    assert near_texts.fingerprint_links(df, sets, 5, 1.0).collect() == []


def test_near_texts_meet_further_centers(spark, monkeypatch):
    """Two families with shingles in common whose members are near their own, after a first center that is near to none."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(4000)]
    shared, one, two = (rng.sample(words, 70) for _ in range(3))
    texts = [" ".join(shared + rng.sample(words, 60))]
    texts += [" ".join(shared + own + rng.sample(words, 3)) for own in (one, two) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    tried, plain = [], near_texts.likely
    monkeypatch.setattr(near_texts, "likely", lambda pairs, *a: tried.append(pairs.count()) or plain(pairs, *a))
    sets = near_texts.shingle_sets(common.keyed(df, "doc_id", "text"), 5)
    held = near_texts.entries(sets, near_texts.equal_links(sets, 0.8), 0.8).withColumn("cu", F.lit(0).cast("bigint"))
    alone = spark.createDataFrame([], "uid bigint, root bigint")
    rest = near_texts.open_members(common.saved(held), alone, sets)
    rest, tree = near_texts.further_centers(rest, alone, sets, 0.8)
    more = near_texts.cross_links(rest, sets, 0.8)
    roots = {r.node: r.root for r in near_texts.joined_tree(tree, near_texts.merged(tree, more)).collect()}
    assert roots == {i: 1 if i <= 40 else 41 for i in range(1, 81)}
    assert tried[-1] < 200 < 2 * 40 * 39 / 2  # what is compared member by member
    got = {r.id: r.root for r in near_texts.near_classes(df).collect()}
    assert got == {0: 0} | roots


@pytest.mark.parametrize("seen", [near_texts.SEEN, 3])
def test_near_texts_meet_in_one_entry(spark, seen, monkeypatch):
    """Outsiders that share many entries, some of them not the first, are one row a pair; with fewer keys known, none is lost."""
    monkeypatch.setattr(near_texts, "SEEN", seen)
    facts = {"at": 0, "cu": 0, "bulk": 0, "n": 100} | dict.fromkeys(near_texts.P, 0)
    held = {uid: [k for k in range(60) if k % (1 + uid % 3) == 0 and k >= uid % 20] for uid in range(1, 31)}
    rows = [Row(key=k, uid=uid, root=uid if uid % 5 else 0, o=uid * 7919 % 31, **facts) for uid, keys in held.items() for k in keys]
    want = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b]) and (a % 5 or b % 5)}
    got = [tuple(r) for r in near_texts.cross_pairs(common.saved(spark.createDataFrame(rows).withColumn("n", F.col("n").cast("int"))), 0.8).collect()]
    assert set(got) == want
    assert len(got) == len(want) or seen == 3


def test_near_texts_on_odd_rows(spark, odd):
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    root = near_roots([r[1] for r in rows])
    got = near_texts.keep_one(odd)
    assert got.columns == odd.columns
    assert ordered(tuple(r) for r in got.collect()) == ordered(r for k, r in enumerate(rows) if root[k] == k)


@pytest.mark.parametrize("added", [15, 60, 200])
def test_near_texts_with_passages_added(spark, added):
    rng = random.Random(31)
    texts = []
    for _ in range(40):
        base = [f"w{int(20_000 ** rng.random())}" for _ in range(7 * added)]
        passage = [f"w{int(20_000 ** rng.random())}" for _ in range(added)]
        at = rng.choice([0, len(base), rng.randrange(len(base))])
        texts += [" ".join(base), " ".join(base[:at] + passage + base[at:])]
    root = near_roots(texts)
    assert len(set(root)) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: r.root for r in near_texts.near_classes(df).collect()} == dict(enumerate(root))


def test_near_texts_of_drifting_copies(spark):
    rng = random.Random(41)
    texts = []
    for g in range(3):
        now = [f"g{g}w{rng.randrange(2000)}" for _ in range(300)]
        for k in range(30):
            texts += [" ".join(now), " ".join([*now, f"g{g}k{k}"])]
            at = rng.randrange(280)
            now = now[:at] + [f"g{g}w{rng.randrange(2000)}" for _ in range(20)] + now[at + 20 :]
    rng.shuffle(texts)
    root = near_roots(texts)
    assert len(set(root)) <= 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: r.root for r in near_texts.near_classes(df).collect()} == dict(enumerate(root))


# --- mixing


def targets(sizes):
    """Water-filling, the plain way: sizes by source, in order."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows, got):
    sizes, count = Counter(), []
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    aims = targets(dict(sizes))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        assert r.copies in (0, 1, 2) and 0 <= r.rate <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= largest[s], (s, taken[s], aims[s])
    rates = Counter()
    for r in got:
        rates[r.source] += r.rate * r.size
    for s in sizes:
        assert rates[s] == pytest.approx(aims[s], rel=1e-5, abs=1e-6)
    return count


def test_mixing(spark, odd, empty):
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    got = mixing.mix(odd).collect()
    check_mix(rows, got)
    assert ordered(got) == ordered(mixing.mix(odd.repartition(5)).collect())
    assert mixing.mix(empty).collect() == []
    copies = Counter((r.doc_id, r.source, r.size) for r in got for _ in range(r.copies))
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    back = Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in mixed.collect())
    assert set(back) == {k for k in copies} and all(back[k] >= copies[k] for k in copies)


def test_mixing_query(spark):
    got = entries.op6_mixing(spark, SF).collect()
    assert {r.doc_id for r in got} == {r[0] for r in documents()}
    assert all(r.taken <= 2 * r.size for r in got)
    check_mix([(i, t, s) for i, t, _, s in documents()], mixing.mix(common.table(spark, SF, "documents")).collect())


def dither(i, source):
    """Spark's hash of (id, source), a null leaving the seed as it is, as a number in [0, 1)."""
    h = 42
    for data in (None if i is None else struct.pack("<q", i), None if source is None else source.encode()):
        h = h if data is None else xxhash.xxh64_intdigest(data, h)
    return (h >> 11) / 2**53


def plain_mix(got):
    """Rates by bisection, one tilt for each source, and copies from the rates given."""
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    rates, copies = {}, Counter()
    for s, rows in by.items():
        words, docs, target = rows[0].source_size, len(rows), rows[0].target
        mean = max(words / docs, 1)
        rate = lambda lam, size: 2 / (1 + (2 / 1.5 - 1) * math.exp(min(700, -lam * size / mean)))  # noqa: B023, E731
        if target >= 2 * words * (1 - 1e-9):
            tilt = 1e9
        else:
            lo, hi = -1e3, 1e3
            for _ in range(200):
                tilt = (lo + hi) / 2
                lo, hi = (tilt, hi) if sum(r.size * rate(tilt, r.size) for r in rows) < target else (lo, tilt)
        for r in rows:
            rates[s, r.size] = rate(tilt, r.size)
        marks = sorted((k - (r.rate + dither(r.doc_id, s)), r.size) for r in rows if r.size for k in (1, 2))
        best, total, cut = abs(target), 0, None
        for n, (at, size) in enumerate(marks):
            total += size
            if (n + 1 == len(marks) or marks[n + 1][0] > at) and abs(total - target) < best:
                best, cut = abs(total - target), at
        for r in rows:
            if r.size:
                copies[r.doc_id, s, r.size, sum(cut is not None and k - (r.rate + dither(r.doc_id, s)) <= cut for k in (1, 2))] += 1
    return rates, copies


def test_mixing_against_a_plain_version(spark, odd):
    for docs in (odd, common.table(spark, SF, "documents")):
        got = mixing.mix(docs).collect()
        rates, copies = plain_mix(got)
        for r in got:
            assert r.rate == pytest.approx(rates[r.source, r.size], rel=1e-4)
        assert Counter((r.doc_id, r.source, r.size, r.copies) for r in got if r.size) == copies


# --- exact dedup


def test_exact_dedup(spark, odd, empty):
    rows = [(r[0], r[1] or "") for r in odd_rows()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    for incoming in (entries.new_batch(), F.lit(False), F.lit(True), F.rand(3) < 0.5):
        got = exact_dedup.exact_dedup(odd, incoming).collect()
        assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == ordered((i, top[t], len(groups[t]), sha(t.encode())) for i, t in rows)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t.encode()) for t in groups)
    assert exact_dedup.exact_dedup(empty, entries.new_batch()).collect() == []
    kept = exact_dedup.keep_distinct(odd, entries.new_batch())
    assert kept.columns == odd.columns
    assert ordered((r.doc_id, r.text or "") for r in kept.collect()) == ordered((top[t], t) for t in groups)
    same = [(3, "equal text", "b"), (3, "equal text", "a"), (2, "equal text", "c"), (None, "x", "d"), (None, "x", "c")]
    for n in (1, 4):
        df = spark.createDataFrame(same, "doc_id bigint, text string, source string").repartition(n)
        assert ordered(tuple(r) for r in exact_dedup.keep_distinct(df, entries.new_batch()).collect()) == ordered([same[1], same[4]])


def test_fuse_filters():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        made = exact_dedup.fuse(keys)
        assert exact_dedup.let_through(keys, *made).all()
        others = rng.integers(0, 1 << 60, 100_000, dtype=np.uint64)
        assert exact_dedup.let_through(others, *made).mean() < 0.001


# --- quality


def facts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(hit)


def verdicts(rows, limits):
    """base_failed, kept for rows (text, host)."""
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    held, docs = defaultdict(set), defaultdict(set)
    for k, (t, h) in enumerate(rows):
        who = t or "" if limits.distinct == "texts" else k
        docs[h].add(who)
        for line in (t or "").split("\n"):
            held[h, norm(line)].add(who)
    out = []
    for t, h in rows:
        n, _, _, _, repeat = facts(t)
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if len(held[h, norm(x)]) > limits.min_docs and len(held[h, norm(x)]) > limits.host_share * len(docs[h]))
        failed = n < limits.min_words or 100 * repeat > limits.max_repeat_percent * n
        out.append((failed, not failed and n - gone >= limits.left_share * n))
    return out


def test_quality(spark, odd, empty):
    rng = random.Random(8)
    common_lines = [" ".join(f"c{i}" for i in range(60)), " ".join(f"d{i}" for i in range(40))]
    rows = [(1000 + i, "\n".join([*rng.sample(common_lines, rng.randint(0, 2)), " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(10, 90)))]), rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(r[0], r[1], r[3]) for r in odd_rows()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limits = quality.Limits(min_docs=5, host_share=0.2, left_share=0.5)
    want = [(i, *facts(t), *v) for (i, t, _), v in zip(rows, verdicts([r[1:] for r in rows], limits), strict=True)]
    got = quality.quality(df, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert ordered(tuple(r) for r in got) == ordered(want)
    assert any(not w[-1] and not w[-2] for w in want)
    assert quality.quality(empty).collect() == []
    good = quality.keep_good(odd)
    assert good.columns == odd.columns
    kept = Counter(r.doc_id for r in quality.quality(odd).where("kept").collect())
    assert Counter(r.doc_id for r in good.collect()) == kept
    documents = quality.Limits(min_docs=5, host_share=0.2, left_share=0.5, distinct="documents")
    want = [(i, *v) for (i, _, _), v in zip(rows, verdicts([r[1:] for r in rows], documents), strict=True)]
    assert ordered(tuple(r) for r in quality.quality(df.repartition(4), documents).select("doc_id", "base_failed", "kept").collect()) == ordered(want)


def test_common_lines_leave_the_text(spark):
    rng = random.Random(9)
    own = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    menu, footer = "Home  About\tContact us now", own(150)
    rows = []
    for i in range(1200):
        host = "hot" if i < 1000 else f"small{i % 4}"
        lines = [own(40), own(40), "", own(5)]
        if i % 3 == 0:
            lines[1:1] = [menu.lower() if i % 2 else menu + " "]
        if i % 10 == 0 or i >= 1000 and i % 2:
            lines.append(footer)
        if i % 30 == 0:
            lines = [menu, footer, own(10), own(10)]
        rows.append((i, "\n".join(lines), host))
    rows += [rows[3], (None, rows[6][1] + "\nmore", "hot"), (9000, rows[12][1], "other")]
    limits = quality.Limits()
    plain = lambda line: " ".join(WORD.findall(line)).lower()
    held, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        hosts[h].add(t)
        for line in t.split("\n"):
            held[h, plain(line)].add(t)
    stays = lambda h, line: not plain(line) or not (len(held[h, plain(line)]) > limits.min_docs and len(held[h, plain(line)]) > limits.host_share * len(hosts[h]))
    v = verdicts([r[1:] for r in rows], limits)
    want = [(i, "\n".join(x for x in t.split("\n") if stays(h, x)), h) for (i, t, h), (_, kept) in zip(rows, v, strict=True) if kept]
    got = [tuple(r) for r in quality.keep_good(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)).collect()]
    assert ordered(got) == ordered(want)
    assert sum(not base and not kept for base, kept in v) > 10  # depleted
    changed = [h for (i, t, h) in want if (i, t, h) not in set(rows)]
    assert changed.count("hot") > 100 and sum(h.startswith("small") for h in changed) > 10


# --- licenses


def license_rows(rows):
    def words(t):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]

    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    out = []
    for i, t in rows:
        own = grams(words(t))
        for name, template in licenses.TEMPLATES.items():
            want = grams(words(template))
            n, need = len(want), set(want)
            share = {a: len(need & set(own[a : a + n])) / len(need) for a in range(len(own))}
            if any(s >= 0.8 for s in share.values()):
                out.append((i, name, max(share.values())))
    return out


def test_licenses(spark, odd, empty):
    long = licenses.TEMPLATES["MIT notice"]
    more = [(500, "x y " + long.replace("charge", "cost") + " z"), (501, long.upper() + "\n" + long), (502, licenses.TEMPLATES["Apache-2.0"] + " and licensed under CC BY-NC 4.0, too."), (503, "released under the MIT")]
    mit, apache = licenses.TEMPLATES["MIT text"], licenses.TEMPLATES["Apache-2.0 header"].split()
    more += [(504, f"/* {mit} */ code"), (505, " ".join(apache[:20] + ["really"] + apache[20:])), (506, " ".join(apache[: len(apache) // 2])), (507, (mit + " x ") * 30), (508, licenses.TEMPLATES["GPL-2.0 header"])]
    rows = [r[:2] for r in odd_rows()] + [(i, t) for i, t, _, _ in documents()] + more
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.license, r.containment) for r in licenses.scan(df).collect()]
    assert ordered(got) == ordered(license_rows(rows))
    assert licenses.scan(odd).columns == ["doc_id", "license", "n_windows", "first_word", "containment"]
    assert licenses.scan(empty).collect() == []


# --- languages


def test_language(spark, odd, empty):
    got = {r.doc_id: r for r in entries.op10_language(spark, SF).collect()}
    docs = documents()
    import zlib

    assert {i: r.held_out for i, r in got.items()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    tested = [(got[i].lang_pred, lang) for i, t, lang, _ in docs if got[i].held_out and any(c.isalpha() for c in t or "")]
    assert sum(a == b for a, b in tested) >= 0.9 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language.fit(odd)
    rows = language.predict(odd, model).collect()
    letters = [any(unicodedata.category(c)[0] == "L" for c in r[1] or "") for r in odd_rows()]
    assert Counter(r.lang_pred for r in rows) == Counter("en" if x else "und" for x in letters)
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}
    assert language.predict(empty, model).collect() == []


def plain_grams(text):
    """Buckets of the 1- to 3-grams of a text, one at a time."""
    text, out, full = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ", [], (1 << 32) - 1
    for at in range(len(text)):
        h = 0
        for n in range(1, 4):
            if at + n > len(text):
                break
            h = ((h ^ (ord(text[at + n - 1]) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[n - 1] & full)) * 0x27D4EB2F) & full
            if text[at : at + n].strip(" "):
                m = (h + n) & full
                out.append((((m ^ (m >> 15)) * 0x2C1B3C6D) & full) >> 18)
    return out


def test_language_against_a_plain_version(spark):
    import zlib

    docs = documents()
    counts, seen = defaultdict(Counter), Counter()
    for i, t, lang, _ in docs:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(plain_grams(t))
            seen[lang] += 1
    logs = {x: (math.log(seen[x] / seen.total()), {}, c, math.log(c.total() + 0.5 * (1 << 14))) for x, c in counts.items()}
    got = {r.doc_id: r for r in entries.op10_language(spark, SF).collect()}
    for i, t, _, _ in docs:
        grams = Counter(plain_grams(t))
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        total = {x: prior + sum(n * (math.log(c[g] + 0.5) - whole) for g, n in grams.items()) for x, (prior, _, c, whole) in logs.items()}
        best = max(sorted(total), key=total.get)
        share = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert got[i].score == pytest.approx(share, abs=2e-3)
        if share > 0.6:
            assert got[i].lang_pred == best


def test_language_ties(spark):
    model = language.fit(spark.createDataFrame([("b", "same text"), ("a", "same text")], "lang string, text string"))
    rows = language.predict(spark.createDataFrame([(1, "same"), (1, "same"), (None, "other words")], "doc_id bigint, text string"), model).collect()
    assert [r.lang_pred for r in rows] == ["a"] * 3 and all(r.score == pytest.approx(0.5) for r in rows)


def test_language_scores(spark):
    rows = [("en", "the cat sat"), ("en", "the dog"), ("de", "der hund und die katze")]
    names, matrix = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    counts = {n: Counter() for n in names}
    for lang, t in rows:
        counts[lang].update(language.grams([t.encode()])[0].tolist())
    for k, n in enumerate(names):
        total = sum(counts[n].values()) + language.PRIOR * language.BUCKETS
        for b in range(0, language.BUCKETS, 37):
            assert matrix[b, k] == pytest.approx(math.log((counts[n][b] + language.PRIOR) / total), rel=1e-5)
    assert matrix[language.BUCKETS].tolist() == pytest.approx([math.log(1 / 3), math.log(2 / 3)], rel=1e-5)


# --- pipeline and SQL


def test_pipeline_on_odd_rows(spark, odd, empty):
    """Null and repeated ids, extra columns of any name, long texts and no rows at all, through every stage."""
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = common.saved(stage(spark, docs, SF))
            if name != "tokens":
                assert docs.columns == columns
    rows = sorted((r for r in odd_rows() if not (facts(r[1])[0] < 50 or 2 * facts(r[1])[4] > facts(r[1])[0])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    last = {r[1]: r for r in rows}
    rows = [r for r in rows if last[r[1]] is r]
    root = near_roots([r[1] for r in rows])
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.saved(stage(spark, docs, SF))
    assert ordered(tuple(r) for r in docs.collect()) == ordered(r for k, r in enumerate(rows) if root[k] == k)


def test_stages_send_few_rows_at_a_time(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(12_000).selectExpr("id as doc_id", "string(id) as text", "'a' as source").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        stage(spark, docs.limit(0), SF)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == corpus_pipeline.ARROW_ROWS
    got = [r.n for r in docs.mapInArrow(sizes, "n bigint").collect()]
    assert sum(got) == 12_000 and max(got) == corpus_pipeline.ARROW_ROWS


def test_stages_read_without_vectored_io(spark):
    docs = spark.createDataFrame([(1, "some words", "a")], "doc_id bigint, text string, source string")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(corpus_pipeline.VECTORED)
        stage(spark, docs, SF)
        seen = spark._jsparkSession.sessionState().newHadoopConf()  # what Parquet's readers are given
        assert seen.get(corpus_pipeline.VECTORED) == "false"


def test_pipeline(spark):
    rows = documents()
    v = verdicts([(t, s) for _, t, _, s in rows], quality.Limits())
    rows = [r for r, (_, kept) in zip(rows, v, strict=True) if kept]
    last = {t: i for i, t, *_ in sorted(rows)}
    rows = sorted(r for r in rows if last[r[1]] == r[0])
    sets = [shingles(r[1]) for r in rows]
    root = classes(rows, lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for f in stages[:3]:
        docs = common.saved(f(spark, docs, SF))
        assert docs.columns == columns
    assert sorted(r.doc_id for r in docs.collect()) == [r[0] for r in rows]
    known = tiktoken_encoding()
    ids = {i: known.encode_ordinary(t) for i, t, *_ in rows}
    mixed = stages[3](spark, docs, SF)
    assert mixed.columns == columns
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in mixed.collect())
    for r in got:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), sha(" ".join(map(str, ids[r.doc_id])).encode()))


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = db.execute(entries.ORACLES[name]).df()
    got = entries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    norm = lambda df: ordered(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].astype(object).values.tolist())
    assert norm(got) == norm(want)


def test_simhash_query(spark):
    rows = [r[:2] for r in documents()]
    fps = [fingerprint(t, 3) for _, t in rows]
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, component_ids([r[0] for r in rows], fps), strict=True)]
    assert ordered(tuple(r) for r in entries.op5_simhash(spark, SF).collect()) == ordered(want)


def test_bpe_query(spark):
    known = tiktoken_encoding()
    want = []
    for i, t, *_ in documents():
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert ordered(tuple(r) for r in entries.op1_byte_bpe(spark, SF).collect()) == ordered(want)


# --- MinHash forest


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def linked_sets(rows, width, share):
    """(id, size, component, kept) of rows (id, text), by comparing all."""
    sets = [shingle_set(t, width) for _, t in rows]
    tree = list(range(len(rows)))

    def find(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= share * len(x | sets[j]):
                tree[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            ids[find(i)].append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        own = min(ids[find(i)], default=None) if sets[i] else k
        out.append((k, len(sets[i]), own, own == k))
    return ordered(out)


def edited_texts(seed, groups, size, edits):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(1, size))
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("leaf", [minhash_forest.LEAF, 2])
def test_minhash_forest(spark, odd, empty, leaf, monkeypatch):
    """leaf 2: nearly all regions are crowded, and prefix filtering finds the links."""
    monkeypatch.setattr(minhash_forest, "LEAF", leaf)
    got = lambda df: ordered(tuple(r) for r in minhash_forest.near_sets(df).collect())
    assert got(odd) == linked_sets([(r[0], r[1]) for r in odd_rows()], 2, 80)
    rows = list(enumerate(edited_texts(3, 25, 60, 8)))
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == linked_sets(rows, 2, 80)
    assert got(empty) == []


def test_minhash_forest_in_a_large_group_and_a_common_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(90)], " ".join(word() for _ in range(40))
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(50)) + " " + passage for _ in range(60)] + ["far away words here"]
    rows = list(enumerate(texts))
    got = ordered(tuple(r) for r in minhash_forest.near_sets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    assert got == linked_sets(rows, 2, 80)


def test_minhash_regions_hold_similar_sets():
    """How often a tree brings two sets together is as the similarity says."""
    import numpy as np

    rng = np.random.default_rng(2)
    both = 0
    for _ in range(60):
        whole = rng.integers(-(2**63), 2**63, 180)
        a, b = np.unique(whole[:162]), np.unique(whole[18:])  # 144 of 180: 0.8
        _, long = minhash_forest.prefix_keys([a, b])
        both += int((long[0] == long[1]).sum())
    assert both / (60 * minhash_forest.TREES) == pytest.approx(0.8**3, abs=0.05)


# --- periodic runs


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words, letters = [], "abcdefghij"[: rng.choice([1, 2, 3, 10])]
        while len(words) < rng.choice([5, 30, 150, 400]):
            part = rng.choices(letters, k=rng.randint(1, rng.choice([3, 10, 40]))) * rng.choice([1, 1, 2, 3, 5, 9])
            words += part[: len(part) - rng.randint(0, 2)]
        out.append(" \n".join(words))
    return out


def test_periodic_runs(spark, odd, empty, monkeypatch):
    rows = [(i, t) for i, t in enumerate(periodic_texts(5, 120))]
    long = random.Random(1).choices(["a", "b", "c"], k=700)
    rows += [(1000, " ".join(long * 3)), (1001, "a " * 5000), (1002, " ".join(["ab", "cd"] * 900 + ["e"] + ["ab"] * 900))]
    monkeypatch.setattr(common, "CHUNK_BYTES", 5000)
    for df, held in ((spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), rows), (odd, [(r[0], r[1]) for r in odd_rows()])):
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()]
        want = []
        for i, t in held:
            words = WORD.findall(t or "")
            runs = plain_runs(words)
            want.append((i, len(words), sorted(runs, key=lambda r: (r[0], r[2])), plain_collapsed(words, runs)))
        assert ordered(got) == ordered(want)
    assert periodic.periodic_runs(empty).collect() == []


def test_op12_plants_and_digests(spark):
    import zlib

    got = {r.doc_id: r for r in entries.op12_periodic_runs(spark, SF).collect()}
    planted = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        if n > 1200:
            continue
        runs = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        o = got[r.doc_id]
        assert (o.n_runs, o.start, o.length, o.period, o.exponent_milli) == (len(runs), *best, milli)
        assert (o.runs_sha256, o.collapsed_sha256) == (sha(lines.encode()), sha(plain_collapsed(words, runs).encode()))
    assert planted > 5 and len(got) == 200


# --- hard negatives


def plain_negatives(rows, anchor):
    held = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            new = (label, v)
            held[i] = min(held.get(i, new), new)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in held.items()}
    score = lambda a, b: sum(x * y for x, y in zip(q[a][1], q[b][1], strict=False))
    out = []
    for a in filter(anchor, q):
        rest = sorted(((-score(a, i), i) for i in q if i != a))
        for s, p in [x for x in rest if q[x[1]][0] == q[a][0]][:5]:
            some = [(t, i) for t, i in rest if q[i][0] != q[a][0] and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(some)]
    return ordered(out)


@pytest.mark.parametrize("window, rows_of_a_task", [(256, 1 << 13), (3, 20)])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_hard_negatives(spark, kind, window, rows_of_a_task, monkeypatch):
    monkeypatch.setattr(negatives, "WINDOW", window)
    monkeypatch.setattr(negatives, "ROWS", rows_of_a_task)
    monkeypatch.setattr(negatives, "ANCHORS", rows_of_a_task)
    rng = random.Random(4)
    near = [rng.gauss(0, 0.3) for _ in range(6)]
    vector = lambda i: [x + rng.gauss(0, 0.02) for x in near] if i % 3 == 0 else [rng.gauss(0, 0.5) for _ in range(6)]
    rows = [(i, vector(i), i % 4 if i % 5 else 1) for i in range(150)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(20)]  # equal vectors: ties by id
    rows += [(300, None, 1), (301, [0.1, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 0), (304, [0.1] * 6, None), (None, [0.2] * 6, 1), (305, [], 1), (306, [1.0], 2), (307, [0.2] * 9, 3), (308, [0.0] * 6, 1), (309, [1e4] * 6, 1), (310, [3e7] * 6, 2), (311, [-1e5] * 6, 2)]
    rows += [rows[7], (11, [0.3] * 6, 0)]  # ids again
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumns({"id": F.lit(1), "q": F.lit("q"), "norm": F.lit(2)})
    held = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = negatives.hard_negatives(df.repartition(3), F.col("id") % 10 == 0)
    assert ordered(tuple(r) for r in got.collect()) == plain_negatives(held, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).collect() == []


def test_hard_negatives_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(10**5, 3 * 10**6)) for _ in range(3)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("id") % 5 == 0)
    assert ordered(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 5 == 0)
    import numpy as np

    a = np.array([[2.0**40, 1.0], [1.0, 1.0]])
    assert negatives.scores(a, np.array([[2.0**40, -1.0]])).tolist() == [[2**63 - 1], [2**40 - 1]]



def test_rows_are_numbered_by_id_and_text(spark, odd):
    """Null, repeated and other ids: numbers are in the order of (id, text), and only odd rows are sorted by their texts."""
    strings = odd.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    for df in (odd, strings, odd.where("doc_id in (3, 4, 9)"), strings.limit(0)):
        got = sorted(tuple(r) for r in common.keyed(df, "doc_id", "text").collect())
        key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
        want = sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=key)
        assert [r[1:] for r in got] == want and len({r[0] for r in got}) == len(got)
    one = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(odd.where("doc_id is not null")).collect()]
    two = [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(strings.where("doc_id is not null").withColumn("doc_id", F.lpad(F.substring("doc_id", 2, 9), 4, "0"))).collect()]
    assert ordered((int(r[0]), *r[1:]) for r in two) == ordered(one)
    kept = near_texts.keep_one(strings).collect()
    assert len(kept) == near_texts.keep_one(odd).count()
