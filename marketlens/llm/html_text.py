"""Main text of web pages: a host's suffix array finds what its pages repeat; markup says what else isn't content.

A page is read once, tolerantly: comments, scripts, styles and forms go, elements that by name, role, or a whole class or
id are menus, headers, footers, sidebars, notices, adverts or comments go with all they hold, character references are
decoded, and what is left falls into blocks. Blocks inside <article> or <main> are sure, all others are open.

The words of a host's distinct pages (pages of equal blocks are one) are put one after another, pages parted by a
sentinel, and their suffixes are sorted by prefix doubling. Neighbours that agree in RUN words at least mark repeated
runs. A run on at least MIN_PAGES of the host's distinct pages and MIN_SHARE of them is boilerplate: it is cut out of open
blocks, whose unique runs stay. A sure block only goes if all of it is boilerplate on BLOCK_PAGES and BLOCK_SHARE of the
pages. A page of which that would take more than COPY_SHARE is a copy with edits and keeps the blocks in question.

Counts are of the whole host. A large host's pages are dealt out in shards, fewer than the pages that make boilerplate,
each with its own suffix array. A run that all shards together repeat often enough is, in one of them at least, as often
as its share: these runs are candidates, no other can be boilerplate, and their pages are then counted over all shards.
So the shards decide nothing but the size of a task. Marked runs are few, ten times the words of a mean page a host at
most; few in all are handed to the tasks, more are met in a shuffle by host and slice of pages.

A null html is empty, a null URL has an empty host; rows with null or repeated ids are extracted like others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import look_up, materialise, of_checked_size, pieces
from marketlens.llm.url_filter import host_and_path

RUN, MIN_PAGES, MIN_SHARE, BLOCK_PAGES, BLOCK_SHARE, COPY_SHARE = 8, 3, 0.1, 8, 0.5, 0.75
#: Words of a shard, if the host has pages enough for several; and pages of a slice that marked runs are brought to.
SHARD_WORDS, SLICE = 1 << 16, 512
#: Marked runs that are handed to all tasks; more are joined.
BROADCAST_RUNS = 1 << 20

#: HTML's elements and the names by which sites mark what isn't content.
RAW = ("script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "label", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright",
    "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination",
    "pager", "paywall", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
    "ad-banner", "ad-container", "ad-slot", "comment-list", "comment-section", "comments-area", "cookie-banner", "cookie-bar", "cookie-consent", "cookie-notice", "legal-notice", "main-menu", "main-nav",
    "nav-bar", "newsletter-signup", "related-articles", "related-posts", "share-buttons", "side-bar", "site-footer", "site-header", "site-nav", "skip-link", "social-share", "top-nav", "user-comments",
}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Elements that end, without a tag of their own, where one of the second kind begins.
_IMPLIED = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}


def _unwanted(tag: str, attrs: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return tag not in ("html", "body", "article", "main") and not NAMES.isdisjoint(f"{found.get('class', '')} {found.get('id', '')}".lower().split())


def blocks_of(page: str) -> tuple[list[str], list[bool]]:
    """The blocks of a page, in order, and whether each is content for sure."""
    blocks: list[str] = []
    sure: list[bool] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # open elements: name, whether it is skipped, whether it is content
    skipped = content = 0
    at, end = 0, len(page)

    def close() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                blocks.append(text)
                sure.append(content > 0)
            parts.clear()

    def leave(k: int) -> None:
        """Ends the open elements from the k-th on."""
        nonlocal skipped, content
        if any(main for _, _, main in open_[k:]):
            close()
        for _, drop, main in open_[k:]:
            skipped, content = skipped - drop, content - main
        del open_[k:]

    while at < end:
        m = _TAG.search(page, at)
        if not skipped and (stop := m.start() if m else end) > at:
            parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            if not skipped:
                close()
        elif tag == "br" and not skipped:
            parts.append(" ")
        if m[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag in VOID:
            if tag == "hr" and open_ and open_[-1][0] == "p":
                leave(len(open_) - 1)
            continue
        if tag in _RAW_END:
            if not m[3].endswith("/"):
                done = _RAW_END[tag].search(page, at)
                at = done.end() if done else end
            continue
        if tag in BLOCKS or tag == "option":
            for k in range(len(open_) - 1, -1, -1):
                name = open_[k][0]
                if tag in _IMPLIED.get(name, ()):
                    leave(k)
                elif name in BLOCKS and name not in ("address", "div", "p"):
                    break
        drop = _unwanted(tag, m[3]) and not (tag == "header" and content and not skipped)
        main = tag in ("article", "main") or "main" in m[3] and re.search(r"role\s*=\s*[\"']?main\b", m[3]) is not None
        open_.append((tag, drop, main))
        skipped, content = skipped + drop, content + main
    close()
    return blocks, sure


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE, _CUT = 0x9E3779B97F4A7C15, 1 << 16
_UP, _DOWN = _powers(_BASE, _CUT + 1), _powers(pow(_BASE, -1, 1 << 64), _CUT + 1)


def words_of(blocks: Sequence[str]) -> np.ndarray:
    """The words of the blocks as numbers, end to end: hashes by differences of prefix sums over their bytes."""
    data = np.frombuffer(" ".join(blocks).encode(errors="replace"), np.uint8)
    ends = np.append(np.nonzero(data == 32)[0], len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    out, k = [np.empty(0, np.uint32)], 0
    while k < len(ends) and len(data):
        e = max(k + 1, int(np.searchsorted(ends, starts[k] + _CUT, "right")))
        piece = data[starts[k] : ends[e - 1]].astype(np.uint64) + np.uint64(1)
        up, down = (_UP, _DOWN) if len(piece) <= _CUT else (_powers(_BASE, len(piece) + 1), _powers(pow(_BASE, -1, 1 << 64), len(piece) + 1))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        a, z = starts[k:e] - starts[k], ends[k:e] - starts[k]
        h = (sums[z] - sums[a]) * down[a]
        out.append(((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
        k = e
    return np.concatenate(out)


def run_keys(words: np.ndarray) -> np.ndarray:
    """A number for each run of RUN words."""
    if len(words) < RUN:
        return np.empty(0, np.int64)
    out = np.zeros(len(words) - RUN + 1, np.uint64)
    for k in range(RUN):
        out = (out ^ words[k : len(words) - RUN + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def suffix_order(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first words (at least `length`), by prefix doubling; and each suffix's rank at that length.

    words are numbers above zero; suffixes of equal rank agree in their first `length` words."""
    n, rank, have = len(words), words.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)  # the two halves may overlap
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1 + int(after.max(initial=0))) + after, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        have += step
    return np.argsort(rank, kind="stable"), rank


def repeated(words: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """For each place the number of distinct pages that have the run of `length` words that begins there; 0 where a page ends first."""
    n = len(words)
    at = np.zeros(n, np.int64)
    if n < length:
        return at
    order, rank = suffix_order(words, length)
    r, p = rank[order], page[order]
    by_page = np.lexsort((p, r))
    r, p, order = r[by_page], p[by_page], order[by_page]
    new = np.ones(n, bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    start = np.ones(n, bool)
    start[1:] = r[1:] != r[:-1]
    group = np.cumsum(start) - 1
    at[order] = np.bincount(group, new)[group].astype(np.int64)
    at[: n - length + 1][page[: n - length + 1] != page[length - 1 :]] = 0
    at[n - length + 1 :] = 0
    return at


def shard_runs(pages: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """The runs that at least so many of the pages, given by their words, share: keys and pages."""
    known, flat = np.unique(np.concatenate(pages), return_inverse=True)
    sizes = np.array([len(x) for x in pages])
    ends = np.cumsum(sizes + 1) - 1
    line = np.empty(len(flat) + len(pages), np.int64)
    line[ends] = len(known) + 1 + np.arange(len(pages))  # a sentinel of its own for each page
    inside = np.ones(len(line), bool)
    inside[ends] = False
    line[inside] = flat + 1
    shared = repeated(line, np.repeat(np.arange(len(pages)), sizes + 1), RUN)
    own = np.concatenate([np.empty(0, np.int64), *(shared[e - n : e - RUN + 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True) if n >= RUN)])
    keys = np.concatenate([run_keys(x) for x in pages])
    often = own >= max(2, least)
    keys, first = np.unique(keys[often], return_index=True)
    return keys, own[often][first]


def clean(blocks: Sequence[str], sure: Sequence[bool], level: Callable[[np.ndarray], np.ndarray] | None) -> str:
    """The main text of a page; level: for keys of runs 0, 1 (boilerplate) or 2 (of sure blocks as well)."""
    if level is None:
        return "\n".join(blocks)
    flat = words_of(blocks)
    marks = level(run_keys(flat))
    if not marks.any():
        return "\n".join(blocks)
    words = [b.split(" ") for b in blocks]
    here = np.zeros(len(flat), np.int8)
    for k in range(RUN):
        np.maximum(here[k : k + len(marks)], marks, out=here[k : k + len(marks)])
    ends = np.cumsum([len(w) for w in words])
    parts = [here[e - len(w) : e] for e, w in zip(ends.tolist(), words, strict=True)]
    whole = [bool(s) and p.min() == 2 for s, p in zip(sure, parts, strict=True)]
    n_sure = sum(len(p) for s, p in zip(sure, parts, strict=True) if s)
    if sum(len(p) for x, p in zip(whole, parts, strict=True) if x) > COPY_SHARE * n_sure:
        whole = [False] * len(whole)
    cut_open = sum(int((p > 0).sum()) for s, p in zip(sure, parts, strict=True) if not s) <= COPY_SHARE * len(flat)
    kept = []
    for text, is_sure, gone, w, p in zip(blocks, sure, whole, words, parts, strict=True):
        if gone:
            continue
        if is_sure or not cut_open or not p.any():
            kept.append(text)
        elif rest := " ".join(x for x, m in zip(w, p.tolist(), strict=True) if not m):
            kept.append(rest)
    return "\n".join(kept)


def _levels(keys: np.ndarray, levels: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Looks runs up in sorted keys."""

    def find(runs: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(runs), np.int8)
        at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        return np.where(keys[at] == runs, levels[at], 0).astype(np.int8)

    return find


Work = Callable[[pa.RecordBatch, Callable[[str], Callable[[np.ndarray], np.ndarray] | None]], pa.RecordBatch]


def _with_runs(pages: DataFrame, columns: list[str], runs: DataFrame, schema: str, work: Work) -> DataFrame:
    """work(batch of the pages' columns, host -> looking up its runs) over all pages; runs(host, key, level)."""
    if runs.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        t = runs.orderBy("host", "key").toArrow()
        host, key, level = t.column("host").to_pylist(), t.column("key").to_numpy(), t.column("level").to_numpy()
        edge = [k for k in range(len(host)) if k == 0 or host[k] != host[k - 1]]
        table = {host[s]: (key[s:e], level[s:e]) for s, e in zip(edge, [*edge[1:], len(host)], strict=False)}
        shared = pages.sparkSession.sparkContext.broadcast(table)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                yield work(b, lambda host: _levels(*shared.value[host]) if host in shared.value else None)

        return pages.select(columns).mapInArrow(over, schema)
    size = materialise(pages.groupBy("host").agg(F.count("*").alias("w")), "html-slices")
    slices = F.ceil(F.coalesce("w", F.lit(1)) / SLICE).cast("long")
    left = look_up(pages.select(columns), size, ["host"], "w", pages.count(), F.col("uid"))
    left = left.withColumn("slice", F.pmod(F.xxhash64("uid"), slices)).select(*columns, "slice")
    right = runs.join(size, "host").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).select("host", "slice", "key", "level")

    def beside(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        theirs = theirs.sort_by("key")
        look = _levels(theirs.column("key").to_numpy(), theirs.column("level").to_numpy())
        mine = mine.select(columns)
        none = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in mine.schema], names=columns)
        return pa.Table.from_batches([work(b, lambda host: look) for b in mine.to_batches(max_chunksize=256) or [none]])

    return left.groupBy("host", "slice").cogroup(right.groupBy("host", "slice")).applyInArrow(beside, schema)


def _host_runs(parsed: DataFrame) -> DataFrame:
    """host, key, level of the runs that are boilerplate on their host; parsed: uid, host, k (of the blocks), n_words, blocks."""
    total = parsed.count()
    copies = parsed.groupBy("host", "k").agg(F.count("*").alias("w"), F.min("uid").alias("first")).filter("w > 1")
    copies = materialise(copies, "html-copies")

    def once(*columns: str) -> DataFrame:
        """The first of equal pages."""
        return look_up(parsed.select("uid", "host", "k", *columns), copies, ["host", "k"], "w", total, F.col("uid")).filter("first is null or first = uid")

    distinct, narrow = once("n_words", "blocks").select("uid", "host", "n_words", "blocks"), once("n_words")
    hosts = narrow.groupBy("host").agg(F.count("*").alias("w"), F.sum("n_words").alias("words"))
    least = F.greatest(F.lit(float(MIN_PAGES)), F.lit(MIN_SHARE) * F.col("w"))
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.col("words") / SHARD_WORDS), F.ceil(least) - 1)).cast("long")
    hosts = materialise(hosts.select("host", "w", least.alias("least"), shards.alias("shards")).filter(F.col("w") >= MIN_PAGES), "html-hosts")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            words = pa.array([words_of(x.as_py()).tobytes() for x in b.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], words], ["host", "shard", "shards", "least", "words"])

    placed = look_up(distinct, hosts, ["host"], "w", total, F.col("uid")).filter("least is not null and n_words > 0")
    placed = placed.select("host", F.pmod(F.xxhash64("uid"), F.col("shards")).alias("shard"), "shards", "least", "blocks")
    spelled = placed.mapInArrow(spell, "host string, shard long, shards long, least double, words binary")

    def sort(shard: pa.Table) -> pa.Table:
        pages = [np.frombuffer(x.as_py(), np.uint32) for x in shard.column("words")]
        host, number, least = (shard.column(c)[0].as_py() for c in ("host", "shards", "least"))
        keys, n = shard_runs(pages, least / number)
        return pa.table({"host": pa.array([host] * len(keys), pa.string()), "key": keys, "n": n, "parts": np.full(len(keys), number, np.int64)})

    found = materialise(spelled.groupBy("host", "shard").applyInArrow(sort, "host string, key long, n long, parts long"), "html-runs")
    alone = found.filter("parts = 1").select("host", "key", "n")
    many = found.filter("parts > 1").select("host", "key", F.lit(1).cast("long").alias("level")).distinct()
    if not many.isEmpty():

        def seen(b: pa.RecordBatch, look: Callable) -> pa.RecordBatch:
            held: dict[str, list[np.ndarray]] = {}
            for host, blocks in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if look(host) is None:
                    continue
                keys = np.unique(run_keys(words_of(blocks.as_py())))
                held.setdefault(host, []).append(keys[look(host)(keys) > 0])
            rows = [(h, *np.unique(np.concatenate(k), return_counts=True)) for h, k in held.items()]
            hosts_ = [h for h, k, _ in rows for _ in range(len(k))]
            keys_, n_ = (np.concatenate([np.empty(0, np.int64), *(r[i] for r in rows)]) for i in (1, 2))
            return pa.RecordBatch.from_arrays([pa.array(hosts_, pa.string()), pa.array(keys_), pa.array(n_)], ["host", "key", "n"])

        large = of_checked_size(hosts.filter("shards > 1").select("host"))
        whole = _with_runs(distinct.join(large, "host", "left_semi").select("host", "blocks", "uid"), ["host", "blocks", "uid"], materialise(many, "html-candidates"), "host string, key long, n long", seen)
        alone = alone.unionAll(whole.groupBy("host", "key").agg(F.sum("n").alias("n")))
    sure = F.greatest(F.lit(float(BLOCK_PAGES)), F.lit(BLOCK_SHARE) * F.col("w"))
    runs = alone.join(of_checked_size(hosts), "host").filter(F.col("n") >= F.col("least"))
    runs = runs.select("host", "key", F.when(F.col("n") >= sure, 2).otherwise(1).cast("long").alias("level"))
    return materialise(runs, "html-marks")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points)."""
    host, _ = host_and_path(F.col(url_col))
    kind = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [blocks_of(x.as_py() or "") for x in b.column(3)]
            same = [xxhash.xxh64_intdigest("\n".join(f[0]).encode(errors="replace") + bytes(f[1])) - (1 << 63) for f in found]
            size = [sum(x.count(" ") + 1 for x in f[0]) for f in found]
            cols = [pa.array(same, pa.int64()), pa.array(size, pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["id", "url", "host", "k", "n_words", "blocks", "sure"])

    schema = f"id {kind.simpleString()}, url string, host string, k long, n_words long, blocks array<string>, sure array<boolean>"
    parsed = materialise(rows.mapInArrow(read, schema).withColumn("uid", F.monotonically_increasing_id()), "html-blocks")

    def write(b: pa.RecordBatch, look: Callable) -> pa.RecordBatch:
        texts = [clean(x.as_py(), s.as_py(), look(h)) for h, x, s in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    out = f"`{id_col}` {kind.simpleString()}, url string, text string, n_chars long"
    return _with_runs(parsed, ["id", "url", "host", "blocks", "sure", "uid"], _host_runs(parsed), out, write)
