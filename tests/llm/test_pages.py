"""WARC round trips, URL rules and models, and main text."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from marketlens.llm import html_text, url_filter, warc
from marketlens.llm.url_filter import Rule

URL_RULES = [Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True)]

SCHEMA = "page_id long, url string, html string, id long, host string, key string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, 1, "h", "k", "p") for k, u, h in rows], SCHEMA).repartition(3)


PAGES = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, "http://a/3", None), (5, None, ""), (7, "http://b/ x\r\ny", "é" * 100_000), (9, "http://b", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://a/2", "same"), (None, "http://n", "same")]


def _b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("smallest", [0, 5])
def test_warc_round_trip(spark, monkeypatch, smallest):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    manifest = warc.write_archives(pages(spark, PAGES), revisit_from=smallest)
    rows = warc.read_archives(manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(rows) == len(PAGES)
    first = {}
    for k, _, h in PAGES:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = []
    for k, _, h in PAGES:
        ref = first[h or ""] if k is not None and first[h or ""] != k and len((h or "").encode()) >= smallest else None
        want.append((str(k), "response" if ref is None else "revisit", str(ref), len((h or "").encode()), _b32(h), None if ref is not None else (h or "").encode()))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload))) for r in rows)
    assert {r.problem for r in rows} == {None}


def test_warc_empty(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_warc_members_and_damage():
    record = warc.page_record(4, "http://x", b"payload" * 50_000, None)
    two = record + warc.page_record(5, "http://y", b"", 4)
    found = list(warc.records(io.BytesIO(two)))
    assert [r["problem"] for r in found] == [None, None] and found[0]["payload"] == b"payload" * 50_000 and found[1]["payload"] is None
    plain = zlib.decompress(record, 31)
    pack = lambda data: io.BytesIO((c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(data) + c.flush())
    assert "digest" in next(warc.records(pack(plain.replace(b"payload", b"payl0ad", 1))))["problem"]
    assert "shorter" in next(warc.records(pack(plain[:-20])))["problem"]
    assert "after its block" in next(warc.records(pack(plain + b"more")))["problem"]
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.records(io.BytesIO(record[:-30])))
    with pytest.raises(zlib.error):
        list(warc.records(io.BytesIO(record[:100] + b"\0" * 40 + record[140:])))


URLS = {
    "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"), "https://example.net": ("example.net", "", None), "http://x.net/": ("x.net", "/", "net/"),
    "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/"), "http://notexample.com/de/1": ("notexample.com", "/de/1", None), "http://z.org/fr/?a=/": ("z.org", "/fr/", "org/fr/"),
    "http://z.org?x=http://net/": ("z.org", "", None), "no scheme/net/": ("", "", None), "a://b://c.net/d": ("b:", "//c.net/d", None), "": ("", "", None), None: ("", "", None), "http://É.NET/é": ("É.net", "/é", "net/"),
}


def test_rules(spark):
    rows = url_filter.ruled(spark.createDataFrame([(u,) for u in URLS], "url string"), URL_RULES).collect()
    assert {r.url: (r.host, r.path, r.rule) for r in rows} == URLS


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_model_scores_by_the_definition(spark, monkeypatch, most):
    """Scores from the counts, handed out or joined, equal those of plain dictionaries; so does the limit."""
    monkeypatch.setattr(url_filter, "BROADCAST_COUNTS", most)
    rng = random.Random(0)
    urls = {kind: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(40)] for kind, letters in (("block", "abcx"), ("allow", "abcy"))}
    rows = [(u, kind) for kind, some in urls.items() for u in some] + [(None, "allow"), ("abc", None)]
    test = ["abcab", "xxx", "yy", "", "é", "abcab", "y" * 3000, None]
    model = url_filter.train(spark.createDataFrame(rows, "url string, ruled string"))
    data = spark.createDataFrame([(k, u) for k, u in enumerate(test)], "u long, url string").withColumn("found", url_filter.F.lit(1))
    got = {r.u: r.url_score for r in url_filter.scored(data, model, "url", ["u"]).collect()}
    held = {r.url for r in spark.createDataFrame(rows, "url string, ruled string").filter(f"pmod(xxhash64(cast(coalesce(url, '') as binary)), {url_filter.FOLD}) = 0").collect()}
    train = {kind: [(u or "").encode() for u, k in rows if k == kind and u not in held] for kind in urls}

    def slow(kind, url):
        grams = [{} for _ in range(url_filter.ORDER + 1)]
        for u in train[kind]:
            line = b"\2" * url_filter.ORDER + u + b"\3"
            for at in range(url_filter.ORDER, len(line)):
                for k in range(url_filter.ORDER + 1):
                    cell = grams[k].setdefault(line[at - k : at], {})
                    cell[line[at]] = cell.get(line[at], 0) + 1
        line, total = b"\2" * url_filter.ORDER + url + b"\3", 0.0
        for at in range(url_filter.ORDER, len(line)):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                cell = grams[k].get(line[at - k : at], {})
                p = (cell.get(line[at], 0) + url_filter.PRIOR * p) / (sum(cell.values()) + url_filter.PRIOR)
            total += np.log(p)
        return total / (len(url) + 1)

    def both(u):
        return slow("allow", (u or "").encode()) - slow("block", (u or "").encode())

    assert got == pytest.approx({k: both(u) for k, u in enumerate(test)}, abs=1e-9)
    left = [(both(u), kind) for u, kind in rows if kind and u in held]

    def errors(limit):
        return sum((s >= limit) != (kind == "allow") for s, kind in left if kind == "allow") / max(1, sum(k == "allow" for _, k in left)) + sum(s >= limit for s, k in left if k == "block") / max(1, sum(k == "block" for _, k in left))

    assert errors(model.limit) <= min(errors(k * url_filter.STEP) for k in range(-2000, 2000)) + 1e-9


def test_revisits_are_held_against_responses(spark):
    found = warc.read_archives(warc.write_archives(pages(spark, PAGES)))
    assert warc.unlike_responses(found).count() == 0
    other = found.withColumn("payload_digest", warc.F.when(warc.F.col("record_type") == "revisit", "X").otherwise(warc.F.col("payload_digest")))
    assert warc.unlike_responses(other).count() == found.filter("record_type = 'revisit'").count() > 0


def test_judge(spark):
    rng = random.Random(1)
    urls = [f"http://s{rng.randrange(9)}.example.org/fr/good{rng.randrange(999)}" for _ in range(150)] + [f"http://w{rng.randrange(9)}.cheap.net/buy-pills{rng.randrange(999)}" for _ in range(150)]
    more = ["http://q.example.org/en/good7", "http://q.cheap.com/buy-pills-now", None, "", "http://q.cheap.com/buy-pills-now"]
    rows = url_filter.judge(pages(spark, [(k, u, None) for k, u in enumerate(urls + more)]), URL_RULES).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 305 and all(by[k].verdict == ("allow" if k < 150 else "block") for k in range(300))
    assert (by[300].verdict, by[301].verdict, by[304].verdict) == ("allow", "block", "block") and by[300].rule is None
    alone = url_filter.judge(pages(spark, [(1, "http://x.com", None), (None, None, None)]), URL_RULES).collect()
    assert {r.verdict for r in alone} == {"allow"}


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><header><p>Site</p></header>
<article><header><h1>Head &amp; line</h1></header><p><b>One <i>two</i>\n three.<br>four<p>Caf&eacute;&#33;&nbsp;x <img class="ad" src=x> <a
href='>'>link</a></p><div id="cookie-notice">Cookies</div><aside>Side</aside><ul><li>a<li>b</ul><form>Mail <input></form><pre> x  y </pre>
<section class="comments"><p>First!</p></section><footer>By me</footer>tail 1 < 2</article><footer>&copy; x</footer></body></html>"""


def test_blocks():
    blocks, sure = html_text.blocks_of(HTML)
    assert blocks == ["Head & line", "One two three. four", "Café! x link", "a", "b", "x y", "tail 1 < 2"] and all(sure)
    assert html_text.blocks_of("") == ([], [])
    assert html_text.blocks_of("just <b>bold</b>text &am") == (["just boldtext &am"], [False])
    assert html_text.blocks_of("<div><p>cut off <a href='x")[0] == ["cut off"]
    assert html_text.blocks_of("<p>a</p></article></div><script>x")[0] == ["a"]
    assert html_text.blocks_of("<main><p>m</p></main><p>outside</p>") == (["m", "outside"], [True, False])
    assert html_text.blocks_of("<p>lead</p><article><p>a</p></article>") == (["lead", "a"], [False, True])
    assert html_text.blocks_of('<p class="advert">Buy now<p>Real text')[0] == ["Real text"]
    assert html_text.blocks_of('<ul><li class="share"><p>Share<li>Real <b>item</ul>after')[0] == ["Real item", "after"]
    assert html_text.blocks_of('<table><tr><td class="ad">x<td>y<tr class="promo"><td>z<tr><td>u</table>')[0] == ["y", "u"]
    kept = '<h1 class="notice-of-race">a</h1><div class="search-results">b</div><p id="related-work">c</p>'
    assert html_text.blocks_of(kept)[0] == ["a", "b", "c"]
    assert html_text.blocks_of("<article></article><p>only this</p>")[0] == ["only this"]


def test_repeated_runs():
    rng = random.Random(2)
    for length in (1, 3, 8):
        pages_ = [[rng.randrange(1, 4) for _ in range(rng.randint(0, 30))] for _ in range(6)]
        flat = np.array([x for k, p in enumerate(pages_) for x in [*p, 100 + k]])
        page = np.array([k for k, p in enumerate(pages_) for _ in [*p, 0]])
        got, want = html_text.repeated(flat, page, length), np.zeros(len(flat), int)
        runs = {}
        for at in range(len(flat) - length + 1):
            if page[at] == page[at + length - 1]:
                runs.setdefault(tuple(flat[at : at + length]), []).append(at)
        for places in runs.values():
            want[places] = len(set(page[places]))
        assert got.tolist() == want.tolist()


def _slow_texts(rows):
    """By the docstring, with plain dictionaries: one host's (blocks, sure) to texts."""
    run = html_text.RUN
    distinct = set((tuple(b), tuple(s)) for b, s in rows)
    seen = {}
    for k, (blocks, _) in enumerate(distinct):
        words = [w for b in blocks for w in b.split(" ")]
        for at in range(len(words) - run + 1):
            seen.setdefault(tuple(words[at : at + run]), set()).add(k)
    n = len(distinct)
    open_from, sure_from = max(html_text.MIN_PAGES, html_text.MIN_SHARE * n), max(html_text.BLOCK_PAGES, html_text.BLOCK_SHARE * n)
    texts = []
    for blocks, sure in rows:
        words = [w for b in blocks for w in b.split(" ")]
        most = [0] * len(words)
        for at in range(len(words) - run + 1):
            pages_ = len(seen[tuple(words[at : at + run])])
            most[at : at + run] = [max(x, pages_) for x in most[at : at + run]]
        parts, at = [], 0
        for b, s in zip(blocks, sure, strict=True):
            parts.append((b, s, b.split(" "), most[at : at + len(b.split(" "))]))
            at += len(b.split(" "))
        gone = [s and min(m) >= max(open_from, sure_from) for _, s, _, m in parts]
        if sum(len(p[3]) for g, p in zip(gone, parts, strict=True) if g) > html_text.COPY_SHARE * sum(len(p[3]) for p in parts if p[1]):
            gone = [False] * len(parts)
        cut = sum(x >= open_from for _, s, _, m in parts if not s for x in m) <= html_text.COPY_SHARE * len(words)
        out = [b if s or not cut else " ".join(x for x, y in zip(w, m, strict=True) if y < open_from) for g, (b, s, w, m) in zip(gone, parts, strict=True) if not g]
        texts.append("\n".join(x for x in out if x))
    return texts


@pytest.mark.parametrize(("words", "few"), [(1 << 18, 1 << 20), (60, 1 << 20), (60, 0)])
def test_hosts_against_brute_force(spark, monkeypatch, words, few):
    """Small shards, and runs that are joined instead of handed out, change nothing."""
    monkeypatch.setattr(html_text, "SHARD_WORDS", words)
    monkeypatch.setattr(html_text, "BROADCAST_RUNS", few)
    monkeypatch.setattr(html_text, "SLICE", 7)
    rng = random.Random(words + few)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, rows = [line(9), line(12), line(30)], []
    for k in range(90):
        body = [f"<p>{line(rng.choice([3, 12, 25]))}</p>" for _ in range(rng.randint(1, 4))]
        body += [f"<p>{line(2)} {c}</p>" for c, share in zip(common, (0.6, 0.2, 0.09), strict=True) if rng.random() < share]
        rng.shuffle(body)
        if k % 3 == 0:
            body = [body[0], "<article>", *body[1:], f"<p>{common[0]}</p>", "</article>"]
        rows.append((k, "http://h/x" if k % 5 else "http://g/y", "".join(body)))
    rows += [(100 + k, u, h) for k, (_, u, h) in enumerate(rows[:1] * 40 + rows[5:9])]
    want = {}
    for url in ("http://h/x", "http://g/y"):
        mine = [r for r in rows if r[1] == url]
        want |= dict(zip((r[0] for r in mine), _slow_texts([html_text.blocks_of(r[2]) for r in mine]), strict=True))
    assert {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()} == want


def test_main_text(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(10**7))
    body = [" ".join(word() for _ in range(40)) for _ in range(30)]
    notice = "please read our very long terms of use before you go on"
    rows = [(k, "http://h/x", f"<div><p>{notice}</p><p>{b} {notice} {b[:20]}</p></div>") for k, b in enumerate(body)]
    shared = " ".join(word() for _ in range(60))
    rows += [(100 + k, "http://g/x", f"<article><p>{shared}</p><p>{b}</p></article>") for k, b in enumerate(body[:5])]
    rows += [(200, "http://h/x", None), (201, None, "<p>alone</p>"), (None, "http://h/x", "<p>nul</p>"), (201, None, "<p>alone</p>"), (202, "http://h/y", "<article><p>" + body[0] + "</p></article>")]
    found = html_text.main_text(pages(spark, rows))
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[k] == [f"{b} {b[:20]}"] for k, b in enumerate(body))
    assert all(got[100 + k] == [f"{shared}\n{b}"] for k, b in enumerate(body[:5]))
    assert (got[200], got[201], got[None], got[202]) == ([""], ["alone"] * 2, ["nul"], [body[0]])
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    def text(k):
        return " ".join(f"p{k}w{i}" for i in range(30))

    menu = " ".join(f"menu{i}" for i in range(10))
    for form, before in (("<article><p>{}</p></article>", ""), ("<p>{}</p>", ""), ("<div>{}</div>", f"<p>{menu}</p>")):
        rows = [(k, "http://h/x", before + form.format(text(max(0, k - 19)))) for k in range(30)]
        got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
        assert got == {k: text(max(0, k - 19)) for k in range(30)}
    same = html_text.main_text(pages(spark, [(k, "http://h/x", f"<p>{text(1)}</p>") for k in range(3)])).collect()
    assert [r.text for r in same] == [text(1)] * 3
