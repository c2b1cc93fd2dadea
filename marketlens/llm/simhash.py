"""Near-duplicates by SimHash, found through the anchors of a covering code.

A fingerprint bit is set if it is set in over half of the XXH64 values of a text's 4-word shingles. Two fingerprints
link if at most `threshold` bits differ.

The 64 bits are cut into an even number of blocks of odd length. In each block the two constant words are a code that
covers it with radius (length - 1) / 2 (the perfect repetition code), so their products, one bit per block, are anchors
that cover all fingerprints. Take two that differ in at most t bits: some word half-way between them differs from
either in at most ceil(t / 2) bits, and its anchor is within every block's radius of it. So if each fingerprint is
replicated to every anchor whose distances exceed the blocks' radii by at most ceil(t / 2) bits in all, every link
meets at an anchor. (Both sides are replicated, hence half the threshold.) More blocks mean more anchors, smaller
groups and more replicas; their number is chosen from the number of distinct fingerprints.

At an anchor all pairs are compared; only a spanning forest of the links found is passed on. Anchors are counted before
fingerprints are sent to them: one with more than GROUP is dealt out in blocks by a hash, and each two blocks meet in a
group of their own, so no anchor goes through one task. Equal fingerprints are one node from the start. Null ids take no part in links and have no component; null and empty
texts have fingerprint zero.
An empty table gives no rows; further columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import attach, look_up, materialise, pieces
from marketlens.llm.graph import components

BITS, SEED, SHINGLE = 64, 42, 4
#: Rows of an anchor that are compared at once; larger anchors are dealt out in blocks of about so many, compared two by two.
GROUP = 4096
#: Mean group size to aim for.
MEAN_GROUP = 1024


def fingerprint(data: bytes) -> int:
    """Of UTF-8 text: 64 bits, zero if it has no words."""
    return majority(shingle_hashes(data, SHINGLE))


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text's lower-cased words, repeats included; a shorter text is one shingle."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1], ends[width - 1 :]
    return np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        cut = h[at : at + (1 << 14)].astype("<u8")
        ones += np.unpackbits(cut.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(x.as_py() or b"") for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def blocks(k: int) -> list[int]:
    """Lengths of k blocks, all odd and as equal as can be, that make up the 64 bits; k is even."""
    base = BITS // k - (BITS // k + 1) % 2
    longer = (BITS - k * base) // 2
    return [base + 2] * longer + [base] * (k - longer)


def replicas_each(k: int, flips: int) -> float:
    """Mean number of anchors that a random fingerprint is replicated to."""
    from math import comb

    total = np.eye(1, flips + 1)[0]
    for n in blocks(k):
        one = np.eye(1, flips + 1)[0]
        for minority in range((n - 1) // 2 + 1):
            if (cost := (n + 1) // 2 - minority) <= flips:
                one[cost] += comb(n, minority) * 2 / 2**n
        total = np.convolve(total, one)[: flips + 1]
    return float(total.sum())


def choose_blocks(n: int, flips: int) -> int:
    """The fewest blocks for which the mean group is small enough, 40 at most."""
    return next((k for k in range(8, 40, 2) if replicas_each(k, flips) * n / 2**k <= MEAN_GROUP), 40)


def anchors(fp: np.ndarray, k: int, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """All (row, anchor) for which the distances of fp[row] to the anchor exceed the radii by at most flips bits."""
    row, anchor, left = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.full(len(fp), flips, np.int8)
    cost, at = np.empty((k, len(fp)), np.int8), 0
    for j, n in enumerate(blocks(k)):
        ones = np.bitwise_count((fp >> np.uint64(at)) & np.uint64(2**n - 1)).astype(np.int8)
        anchor |= (2 * ones > n).astype(np.int64) << j
        cost[j] = (n + 1) // 2 - np.minimum(ones, n - ones)
        at += n
    for j in range(k):
        price = cost[j][row]
        can = left >= price
        row, anchor, left = np.concatenate([row, row[can]]), np.concatenate([anchor, anchor[can] ^ (1 << j)]), np.concatenate([left, left[can] - price[can]])
    return row, anchor


def merge(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the components that the links i-j connect; lab[x] <= x is the smallest row known of x's component."""
    while len(i):
        i, j = lab[i], lab[j]
        apart = i != j
        i, j = i[apart], j[apart]
        low = np.minimum(i, j)
        np.minimum.at(lab, i, low)
        np.minimum.at(lab, j, low)
        while (lab[lab] != lab).any():
            lab = lab[lab]
    return lab


def links_within(fp: np.ndarray, threshold: int, parted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row, smaller row) of the links among fp; parted: only links between its two values count."""
    lab = np.arange(len(fp))
    step = max(1, (1 << 18) // max(1, len(fp)))  # the matrix of differences stays at 2 MB
    for at in range(0, len(fp), step):
        near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, at:]) <= threshold
        if parted is not None:
            near &= parted[at : at + step, None] != parted[None, at:]
        i, j = np.nonzero(near)
        up = i < j
        lab = merge(lab, i[up] + at, j[up] + at)
    far = np.nonzero(lab != np.arange(len(fp)))[0]
    return far, lab[far]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, np.ndarray, bool]]:
    """From sorted batches: (key, the other columns as rows, whether the key's rows end here), pieces of at most GROUP rows and one batch."""
    key, held, rows = None, [], 0
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.nonzero(new)[0].tolist(), len(new)]
        data = np.stack(cols[keys:], axis=1)
        for s, e in zip(edge, edge[1:], strict=False):
            now = tuple(c[s].item() for c in cols[:keys])
            if key is not None and now != key:
                yield key, np.concatenate(held), True
                held, rows = [], 0
            if rows > GROUP:
                yield key, np.concatenate(held), False
                held, rows = [], 0
            key = now
            held.append(data[s:e])
            rows += e - s
    if key is not None:
        yield key, np.concatenate(held), True


def near_links(nodes: DataFrame, threshold: int = 4) -> DataFrame:
    """nodes(node, fp), fp distinct -> a(long), b(long): links whose components are those of all links."""
    flips = (threshold + 1) // 2
    k = choose_blocks(nodes.count(), flips)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2 * GROUP):
            node, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            row, anchor = anchors(fp.view(np.uint64), k, flips)
            for at in range(0, len(row), 1 << 16):
                r = row[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[at : at + (1 << 16)], node[r], fp[r])], ["anchor", "node", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the rows of two blocks of an anchor, or within one."""
        held: list[np.ndarray] = []
        for key, rows, ends in runs(batches, 3):
            held.append(rows)
            if not ends:
                continue
            rows, held = np.concatenate(held), []
            if len(rows) < 2:
                continue
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            i, j = links_within(rows[:, 1].astype(np.int64).view(np.uint64), threshold, rows[:, 2] if key[1] != key[2] else None)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(rows[i, 0]), pa.array(rows[j, 0])], ["a", "b"])

    near = nodes.select("node", "fp").mapInArrow(replicate, "anchor long, node long, fp long")
    large = materialise(near.groupBy("anchor").agg(F.count("*").alias("w")).filter(F.col("w") > GROUP), "simhash-large")
    rows = large.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    dealt = look_up(near, large, ["anchor"], "w", rows, F.col("node")) if rows else near.withColumn("w", F.lit(1))
    n = F.ceil(F.coalesce("w", F.lit(1)) / GROUP).cast("long")
    dealt = dealt.select("anchor", "node", "fp", F.pmod(F.xxhash64("node"), n).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("o"))
    dealt = dealt.select("anchor", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "node", "fp", (F.col("block") < F.col("o")).cast("long").alias("side"))
    dealt = dealt.repartition("anchor", "p", "q").sortWithinPartitions("anchor", "p", "q")
    return materialise(dealt.mapInArrow(compare, "a long, b long"), "simhash-links")


def near_duplicates(docs: DataFrame, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    nodes = prints.filter(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("node"), F.count("*").alias("w"))
    nodes = materialise(nodes, "simhash-nodes")
    roots = components(near_links(nodes, threshold), "simhash-components")
    part_of = nodes.join(roots, "node", "left").select("fp", "w", F.coalesce("root", "node").alias("component_id"))
    out = attach(prints, materialise(part_of, "simhash-classes"), ["fp"], "w", prints.count(), F.col(id_col))
    return out.select(
        id_col,
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )
