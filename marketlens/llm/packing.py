"""Mixture-controlled packing: deficit round-robin over source queues, laid out on one line of tokens.

Each source is a queue of documents. In a round of `window` tokens (a sequence's length) a queue's deficit counter is
credited its share of the window, it serves as many whole tokens as the counter holds, and the rest is carried to the
next round. Counters start at different fractions of a token, so that many small queues don't serve in the same rounds.
After m rounds a queue with weight w of W has so served floor(m * window * w / W + fraction) tokens, which no earlier
round needs to be run for: a token's round, and the place in the line at which the round begins, follow from its position
in the queue. When a queue runs out, the others share its part from the next round on; there are at most as many such
phases as queues. Rounds follow each other on one line of tokens that is cut every `length` tokens, so only the last
sequence is padded, and every sequence holds its sources in proportion, to a token or so each.

Texts are turned into ids once, and cut where the ids lie: a position in a queue is that in the task's part of the queue,
counted while the task reads, and the tokens of the parts before, a small table by queue and part. No ids are shuffled.
Weights are each source's share of all tokens unless given. Every source with a given share has a queue of its own, and so
have the QUEUES sources with most rows; sources beyond that take turns in MERGED queues by a hash of their name, each of
which gets the shares of its sources in all.

A null text is empty (the end id alone), a null source is a queue of its own, rows with null or repeated ids are packed
like any others, other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import look_up, materialise, pieces, small_table
from marketlens.llm.tokens import tokenizer

LENGTH, END_ID = 2048, 1
#: Sources with queues of their own, besides those with given shares, and queues that all other sources share.
QUEUES, MERGED = 1024, 64


def units_of(totals: list[int], weights: list[float]) -> list[int]:
    """Weights as whole numbers above zero, as fine as 64 bits allow for so many tokens."""
    fine = min(1 << 24, (1 << 61) // max(1, sum(totals)))
    return [max(1, round(w * fine / (sum(weights) or 1))) for w in weights]


def credits_of(queues: int, whole: int) -> list[int]:
    """What deficit counters start with, in parts of a token of which `whole` are one: evenly spread fractions."""
    return [int((j * 0.6180339887498949) % 1 * whole) for j in range(queues)]


@dataclass
class Phase:
    """Rounds first+1 .. last, in which the queues with weights above zero are served from base on."""

    first: int
    last: int
    base: np.ndarray
    weights: np.ndarray
    credit: np.ndarray


class Schedule:
    """What deficit round-robin has served of each queue after any round."""

    def __init__(self, totals: list[int], weights: list[float], window: int):
        self.totals, self.window = np.array(totals, np.int64), window
        units = units_of(totals, weights)
        base, first = [0] * len(totals), 0
        self.phases: list[Phase] = []
        while left := [j for j, t in enumerate(totals) if t > base[j]]:
            whole = sum(units[j] for j in left)
            credit = credits_of(len(totals), whole)
            last = first + min(-(((totals[j] - base[j]) * whole - credit[j]) // -(window * units[j])) for j in left)
            on = set(left)
            weights_ = np.array([u if j in on else 0 for j, u in enumerate(units)], np.int64)
            self.phases.append(Phase(first, last, np.array(base, np.int64), weights_, np.where(weights_ > 0, credit, 0)))
            base, first = self._served(self.phases[-1], np.array([last]))[0].tolist(), last

    def _served(self, p: Phase, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each queue that rounds 1 to r have served, for rounds r of a phase: rounds by queues."""
        return np.minimum(self.totals, p.base + ((rounds - p.first)[:, None] * self.window * p.weights + p.credit) // p.weights.sum())

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Cuts runs of tokens (queue, start in it, number): the run, offset in it, tokens, sequence, offset there, of each piece in turn."""
        found: list[tuple[np.ndarray, ...]] = []
        for k, p in enumerate(self.phases):
            after = self.phases[k + 1].base if k + 1 < len(self.phases) else self.totals
            low, high = np.maximum(start, p.base[queue]), np.minimum(start + n, after[queue])
            run = np.nonzero(low < high)[0]
            if not len(run):
                continue
            j, low, high = queue[run], low[run], high[run]
            step, whole = self.window * p.weights[j], int(p.weights.sum())
            r0, r1 = (p.first - (p.credit[j] - (x - p.base[j] + 1) * whole) // step for x in (low, high - 1))  # the rounds that serve the first and the last token
            many = r1 - r0 + 1
            at = np.repeat(np.arange(len(run)), many)
            r = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + r0[at]
            rounds, which = np.unique(r, return_inverse=True)
            for s in range(0, len(rounds), 4096):  # a bounded table of rounds by queues at a time
                here = np.nonzero((which >= s) & (which < s + 4096))[0]
                then, now = self._served(p, rounds[s : s + 4096] - 1), self._served(p, rounds[s : s + 4096])
                line = then.sum(axis=1)[:, None] + np.cumsum(now - then, axis=1) - (now - then)  # where a queue's part of a round begins
                i, q = which[here] - s, j[at[here]]
                x, end = np.maximum(low[at[here]], then[i, q]), np.minimum(high[at[here]], now[i, q])
                found.append((run[at[here]], x, end - x, line[i, q] + x - then[i, q]))
        run, x, size, line = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        keep = size > 0
        run, x, size, line = run[keep], x[keep], size[keep], line[keep]
        many = (line + size - 1) // length - line // length + 1
        at = np.repeat(np.arange(len(run)), many)
        seq = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + (line // length)[at]
        a, z = np.maximum(line[at], seq * length), np.minimum(line[at] + size[at], (seq + 1) * length)
        order = np.lexsort((a, run[at]))
        out = run[at], x[at] + a - line[at] - start[run[at]], z - a, seq, a - seq * length
        return tuple(c[order] for c in out)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", queue: Column | None = None, words: int | None = None) -> DataFrame:
    """id, queue, part, before (tokens of the queue that the part has before), n_tokens, ids (little-endian, as narrow as the vocabulary allows); written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = tokenizer(vocabulary, words), {}
        end = np.array([end_id], t.wide)
        for b in pieces(batches, give_back=True, keep=True):
            ids = [np.concatenate([t.encode(x.as_py() or ""), end]) for x in b.column(3)]
            before = []
            for q, x in zip(b.column(1).to_pylist(), ids, strict=True):
                before.append(seen.get(q, 0))
                seen[q] = before[-1] + len(x)
            cols = [*b.columns[:3], pa.array(before, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.dtype.itemsize for x in ids], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "queue", "part", "before", "n_tokens", "ids", "wide"])

    queue = F.lit(0) if queue is None else queue
    rows = docs.select(F.col(id_col).cast("long").alias("id"), queue.cast("int").alias("queue"), F.spark_partition_id().alias("part"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "id long, queue int, part int, before long, n_tokens long, ids binary, wide int"), "packing-tokens")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, window: int | None = None, shares: Mapping[str, float] | None = None, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", words: int | None = None) -> DataFrame:
    """Pieces of documents in sequences: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    shares: target token proportions of some sources, one in all at most; the others divide the rest as they divide their tokens.
    words: how many a worker's tokenizer keeps, if not as many as tokens.CACHE; it decides no result.
    """
    if sum((shares or {}).values()) > 1 + 1e-9 or min((shares or {}).values(), default=1) <= 0:
        raise ValueError("shares must be above zero, and one in all at most")
    shares, source = dict(shares or {}), F.col(source_col).cast("string")
    spark = docs.sparkSession
    rows = docs.groupBy(source.alias("s")).agg(F.count("*").alias("n"))
    largest = [r.s for r in rows.orderBy(F.desc("n"), F.asc_nulls_first("s")).limit(QUEUES).collect()]
    own = [*largest, *sorted(set(shares) - set(largest))]
    numbers = F.broadcast(small_table(spark, list(enumerate(own)), "_queue int, _source string"))
    named = docs.select(F.col(id_col).alias("_id"), source.alias("_s"), F.col(text_col).alias("_text")).join(numbers, F.col("_s").eqNullSafe(F.col("_source")), "left")
    merged = F.pmod(F.xxhash64("_s"), F.lit(MERGED)) + len(own)
    tokens = tokenised(named, vocabulary, end_id, "_id", "_text", F.coalesce("_queue", merged), words)

    parts = materialise(tokens.groupBy("queue", "part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("w")), "packing-parts")
    sums = {r.queue: r.t for r in parts.groupBy("queue").agg(F.sum("t").alias("t")).collect()}  # as many as queues
    totals = [sums.get(q, 0) for q in range(len(own) + MERGED)]
    given = {q: shares[s] for q, s in enumerate(own) if s in shares}
    natural = max(1, sum(t for q, t in enumerate(totals) if q not in given))
    weights = [given.get(q, max(1e-12, 1 - sum(given.values())) * t / natural) for q, t in enumerate(totals)]
    plan = Schedule(totals, weights, window or length)
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("queue", "part", "w", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    placed = look_up(tokens, materialise(bases, "packing-bases"), ["queue", "part"], "w", tokens.count(), F.col("id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, give_back=True):
            ids = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            n = b.column(3).to_numpy()
            run, at, size, seq, offset = plan.pieces(b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy(), n, length)
            data = [ids[k][s : s + m].tobytes() for k, s, m in zip(run.tolist(), at.tolist(), size.tolist(), strict=True)]
            crc = pa.array(map(zlib.crc32, data), pa.int64())
            cols = [b.column(0).take(pa.array(run)), *map(pa.array, (at, size)), crc, *map(pa.array, (n[run], seq, offset)), *([pa.array(data, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, fields)

    fields = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = ", ".join(f"`{c}` {'binary' if c == 'ids' else 'long'}" for c in fields)
    return placed.select("id", "queue", (F.col("base") + F.col("before")).alias("place"), "n_tokens", "ids", "wide").mapInArrow(cut, schema)
