"""URL filters: rules on host and path, and for all other URLs a ratio of two character language models.

A rule is a host and a path. It fits URLs of that host and of its subdomains whose path starts with the rule's; the
longest fitting rule decides. URLs that rules decide are the accepted and rejected examples for two variable-order
Markov models over the URL's bytes: each order's estimate is smoothed with that of the next lower one,
(n(context, byte) + PRIOR * lower) / (n(context) + PRIOR), down to a uniform base, so a context that was never seen
leaves the choice to a shorter one. Counts cover all examples but every FOLD-th (by a hash of the URL), exactly: a kind, an
order, a context and a byte are one number. Up to BROADCAST_COUNTS counts are handed to the tasks; more are joined to the
URLs' own contexts and bytes. The left-out examples calibrate the limit: of the values of the difference in
log-likelihood per byte, that which gives the fewest errors of the two kinds, each as a share of its kind.

A null URL is empty, with empty host and path. If either kind has no examples, `default` is the verdict. Rows are judged
one by one, so null and repeated ids do no harm; only id and URL are read, so other columns can have any name. A URL's
length is not limited.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import attach, materialise, pieces

ORDER, PRIOR, FOLD = 5, 2.0, 5
#: Counts (16 bytes each) that are handed to all tasks.
BROADCAST_COUNTS = 1 << 21
#: URLs worked on at once, and distinct numbers that a task counts before it passes them on.
URLS, COUNTED = 4096, 1 << 19
#: Scores are binned so finely, up to +-BINS / 2 steps, to choose the limit.
STEP, BINS = 0.005, 4000
_BEGIN, _END = 2, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule (null if none fits) and ruled (allow, block or null)."""
    host, path = host_and_path(F.col(url_col))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, "allow" if r.allow else "block").otherwise(verdict)
    return urls.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})


def grams(urls: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order from 0 on a number for each byte and its context, the context alone being that number // 256; and each byte's URL."""
    data = np.frombuffer(b"".join(bytes([_BEGIN]) * ORDER + u + bytes([_END]) for u in urls), np.uint8).astype(np.int64)
    size = np.array([len(u) + 1 for u in urls], np.int64)
    row = np.repeat(np.arange(len(urls)), size)
    at = np.arange(len(row)) + ORDER * (row + 1)
    context, out = np.zeros(len(row), np.int64), []
    for k in range(ORDER + 1):
        if k:
            context = context | data[at - k] << 8 * (k - 1)
        out.append((np.int64(k) << 48 | context << 8) + data[at])
    return out, row


_KIND = 1 << 52


def log_ratio(urls: list[bytes], keys: np.ndarray, counts: np.ndarray, context_keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """The difference in log-likelihood per byte, positive for accepted, given sorted keys with their counts."""
    found, row = grams(urls)
    total = np.zeros(len(urls))

    def look(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, values[at], 0)

    for kind, sign in ((0, -1.0), (1, 1.0)):
        p = np.full(len(row), 1 / 256)
        for g in found:
            both = g + kind * _KIND
            p = (look(keys, counts, both) + PRIOR * p) / (look(context_keys, context_counts, both >> 8) + PRIOR)
        total += sign * np.bincount(row, np.log(p), len(urls))
    return total / np.bincount(row, minlength=len(urls))


@dataclass
class Model:
    """Counts by number (key, n), those of contexts as negative keys, and the limit."""

    counts: DataFrame
    size: int
    limit: float


def _urls(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _tables(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From all counts: sorted keys of grams with counts, and of contexts with theirs."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    of_context = keys < 0
    contexts, m = -1 - keys[of_context][::-1], n[of_context][::-1]
    return keys[~of_context], n[~of_context], contexts, m


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "ruled") -> Model | None:
    """From rows whose label is allow or block; None if one of them doesn't occur."""
    kind = F.when(F.col(label_col) == "allow", 1).when(F.col(label_col) == "block", 0).cast("long")
    rows = labelled.select(kind.alias("kind"), F.coalesce(url_col, F.lit("")).cast("binary").alias("u")).filter("kind is not null")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("u"), F.lit(FOLD)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([np.empty(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([np.empty(0, np.int64), *(n for _, n in held)]), len(keys)).astype(np.int64)

        for b in pieces(batches, URLS):
            found, row = grams(_urls(b.column(1)))
            kinds = b.column(0).to_numpy()[row] * _KIND
            held.append(np.unique(np.concatenate([g + kinds for g in found] + [-1 - ((g + kinds) >> 8) for g in found]), return_counts=True))
            if sum(len(k) for k, _ in held) > COUNTED:
                held = [summed()]
                if len(held[0][0]) > COUNTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["key", "n"])

    counts = rows.filter("not held").select("kind", "u").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter("key is not null"), "url-counts")
    both = counts.filter(F.col("key").isin([-1, -1 - (_KIND >> 8)])).count()  # the two kinds' empty contexts
    if both < 2:
        return None
    model = Model(counts, counts.count(), 0.0)
    held = scored(rows.filter("held").select("kind", "u"), model, "u", ["kind"])
    bin_of = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("url_score") / STEP) + BINS // 2))
    bins = np.zeros((2, BINS))
    for r in held.select("kind", bin_of.alias("b")).groupBy("kind", "b").count().collect():
        bins[r["kind"], r["b"]] = r["count"]
    if bins.sum(axis=1).all():
        share = np.cumsum(bins / bins.sum(axis=1, keepdims=True), axis=1)
        errors = np.concatenate([[1.0], share[1] + 1 - share[0]])  # below the limit: blocked
        best = np.nonzero(errors <= errors.min() + 1e-12)[0]
        model.limit = float((best.mean() - BINS // 2) * STEP)
    return model


def scored(urls: DataFrame, model: Model, url_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and url_score."""
    rows = urls.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(url_col, F.lit("")).cast("binary").alias("u"))
    kinds = ", ".join(f"k{i} {urls.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    names, m = [f"k{i}" for i in range(len(keep))], len(keep)
    if model.size <= BROADCAST_COUNTS:
        t = model.counts.toArrow()
        shared = urls.sparkSession.sparkContext.broadcast(_tables(t.column("key").to_numpy(), t.column("n").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, URLS):
                s = log_ratio(_urls(b.column(m)), *shared.value) if b.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(s)], [*names, "url_score"])

        found = rows.mapInArrow(run, f"{kinds}, url_score double")
    else:
        found = _scored_by_join(rows, model, kinds, names)
    return found.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "url_score")


def _scored_by_join(rows: DataFrame, model: Model, kinds: str, names: list[str]) -> DataFrame:
    """Each distinct URL's numbers meet their counts in a shuffle, and are gathered by URL."""
    m = len(names)
    distinct = materialise(rows.groupBy("u").agg(F.count("*").alias("w")).withColumn("uid", F.monotonically_increasing_id()), "url-distinct")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            found, row = grams(_urls(b.column(1)))
            keys = np.concatenate([x for g in found for k in (0, _KIND) for x in (g + k, -1 - ((g + k) >> 8))])
            uid = np.tile(b.column(0).to_numpy()[row], 4 * len(found))
            pairs = np.unique(np.stack([uid, keys]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["uid", "key"])

    wanted = distinct.select("uid", "u").mapInArrow(spell, "uid long, key long")
    often = materialise(wanted.groupBy("key").agg(F.count("*").alias("w")).join(model.counts, "key"), "url-wanted")
    total = often.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    met = attach(wanted, often, ["key"], "w", total, F.col("uid")).filter("n is not null")
    by_url = met.groupBy("uid").agg(F.collect_list(F.struct("key", "n")).alias("found"))  # as many as twelve times a URL's bytes, twice

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 256):
            out = []
            for u, found in zip(_urls(b.column(0)), b.column(2), strict=True):
                keys, n = (x.to_numpy() for x in found.values.flatten()) if found.is_valid and len(found.values) else (np.empty(0, np.int64),) * 2
                out.append(log_ratio([u], *_tables(keys, n))[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], ["u", "w", "url_score"])

    scores = materialise(distinct.join(by_url, "uid", "left").select("u", "w", "found").mapInArrow(weigh, "u binary, w long, url_score double"), "url-scores")
    return attach(rows, scores, ["u"], "w", rows.count(), F.xxhash64(*names)).select(*names, "url_score")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, url_score (null without a model)."""
    rows = ruled(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), rules, "_url")
    model = train(rows, "_url")
    keep = ["_id", "host", "path", "rule", "ruled"]
    if model is None:
        found, by_model = rows.select(*keep, F.lit(None).cast("double").alias("url_score")), F.lit(default)
    else:
        found, by_model = scored(rows, model, "_url", keep), F.when(F.col("url_score") >= model.limit, "allow").otherwise("block")
    return found.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "url_score")
