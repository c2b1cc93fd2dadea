"""The near-duplicate stage: SimHash first, then what fingerprints can't promise, by exact overlap of word shingles.

Two texts link if the Jaccard similarity of their sets of 5-word shingles (XXH64, lower case) is at least 4/5. That is no
bound on differing bits of a fingerprint, so candidates come in two ways, and each is checked on the whole texts.

1. SimHash: fingerprints of the shingles, compared at the anchors of a covering code (see simhash), THRESHOLD bits.
2. Prefixes, which miss nothing: put every set in one common order. Sets of n shingles that link share at least
   ceil(4n / 5), so they share one of the first n - ceil(4n / 5) + 1 of either. Only shingles in the prefixes of two texts
   or more matter. Shingles that are common in a sample of documents come last in the order, which keeps groups small.

Links of a group's rows to its smallest row are checked first. Where a large group still has several components, each row of
a smaller one is then hooked to two rows of larger ones, the first that it may link to and the most similar: so copies that
link among each other, but not to the smallest, come together with a few pairs a row. Only rows of components that are
different after that are compared pair by pair, so a large group of copies costs its number of rows, not its square. Texts are
fetched only for pairs that can still link by two exact bounds: what follows the first shared shingle in both orders, and the parity bits of the two whole
sets. A set of n shingles has at least n such bits, each saying whether an odd number of its hashes falls there; every bit in
which two sets differ is a shingle that one of them alone has. FOLD words of such bits are compared where pairs are made,
and a pair is made only in the group of the first shingle that it shares: rows carry the EARLIER shingles before theirs (a pair
that shares one of still earlier ones alone is made again, and dropped as a repetition). A group of texts that nearly link is
still compared row by row; what leaves the comparison are pairs that may link.

Frequent shingles are counted before rows move, and rows of hot ones are dealt out. Texts of fewer than 5 words are one
shingle, null and empty texts have none. Null ids take no part in links. Rows equal in id and text share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import simhash
from marketlens.llm.common import attach, attach_wide, bitmap, look_up, materialise, may_be_in, of_checked_size, pieces, text_hash, without
from marketlens.llm.graph import components

#: The least similarity, 4/5, is written out in whole numbers below.
SHINGLE, THRESHOLD = 5, 4
#: Which shingles are common is learnt from one document in SAMPLE_EVERY, or more of a small table: SAMPLE_DOCS. A share of the
#: documents, since otherwise the largest group of which the sample has no sign grows with the input. It decides no result.
SAMPLE_EVERY, SAMPLE_DOCS, MIN_COMMON, MAX_COMMON = 8, 8192, 2, 1 << 18
#: Rows of a group that are compared in one piece.
GROUP = 1024
#: Groups with fewer rows make few pairs; their rows are not hooked first. Hooks are sought so many times, or until none is found.
HOOKED, ROUNDS = 256, 2
#: Words of parity bits that are compared in the join, and earlier shared shingles that a row carries there.
FOLD, EARLIER = 8, 64


def shingles(data: bytes) -> np.ndarray:
    """Of UTF-8 text: the distinct hashes of its shingles, sorted."""
    return np.unique(simhash.shingle_hashes(data, SHINGLE))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 9 * shared >= 4 * (len(a) + len(b))


def parity(own: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each of as many bits as there are hashes, or the next power of two (64 at least)."""
    size = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(17)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch(own: np.ndarray) -> list[int]:
    """The parity of FOLD * 64 bits, however many hashes there are, as signed words."""
    odd = np.bincount((own >> np.uint64(17)).astype(np.int64) & (FOLD * 64 - 1), minlength=FOLD * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def far_apart(a: bytes, b: bytes, n: int) -> bool:
    """By their parity bits, two sets of n shingles in all differ in more than may be; the longer bits are folded to the shorter."""
    x, y = (np.frombuffer(bits, np.uint64) for bits in sorted((a, b), key=len))
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return 9 * int(np.bitwise_count(folded ^ x).sum()) > n


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and how often the sample has them."""
    every = max(1, min(SAMPLE_EVERY, rows.count() // SAMPLE_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, give_back=True):
            found = np.concatenate([np.empty(0, np.uint64), *(shingles(x.as_py()) for x in b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    sample = rows.filter(F.pmod("node", F.lit(every)) == 0).select("t").mapInArrow(run, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= MIN_COMMON).orderBy(F.desc("c"), "h").limit(MAX_COMMON).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _read(rows: DataFrame) -> DataFrame:
    """node, fp (fingerprint), n (size of the set), bits (their parity), sketch (the same in FOLD words), prefix (the first hashes in the common order); no rows without words."""
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in pieces(batches, give_back=True):
            out: list[tuple] = []
            for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                every = simhash.shingle_hashes(x.as_py(), SHINGLE)
                if not len(every):
                    continue
                own = np.unique(every)
                c = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    c = np.where(known[at] == own, often[at], 0)
                prefix = own[np.lexsort((own, c))[: len(own) // 5 + 1]].view(np.int64)
                fp = simhash.majority(every)
                out.append((node, fp - (1 << 64) if fp >> 63 else fp, len(own), parity(own), sketch(own), prefix))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names, types = ["node", "fp", "n", "bits", "sketch", "prefix"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return materialise(rows.mapInArrow(run, "node long, fp long, n int, bits binary, sketch array<long>, prefix array<long>"), "copies-sets")


def _can_link(x: str, y: str) -> Column:
    """Enough follows the shared shingle in both orders."""
    left = F.least(*(F.col(f"{s}.n") - F.col(f"{s}.place") for s in (x, y)))
    return 9 * left >= 4 * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def _may_link(x: str, y: str) -> Column:
    """By their sketches they may, and none of the shingles carried by both comes before the shared one."""
    apart = sum((F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(FOLD)), F.lit(0))
    return (9 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n")) & ~F.arrays_overlap(f"{x}.before", f"{y}.before")


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


def _both_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs(a, b) with table(node, v), several of a node being equal: a, b, v_a, v_b."""
    n, found = pairs.count(), pairs
    for end, other in (("a", "b"), ("b", "a")):
        weight = pairs.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("w"))
        side = table.join(of_checked_size(weight), "node").groupBy(F.col("node").alias(end)).agg(F.any_value("v").alias(f"v_{end}"), F.any_value("w").alias(f"w_{end}"))
        found = attach_wide(found, materialise(side, "copies-ends"), [end], f"w_{end}", n, F.col(other))
    return found.select("a", "b", "v_a", "v_b")


def _checked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8192, give_back=True):
            both = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            keep = [not far_apart(x["bits"], y["bits"], x["n"] + y["n"]) for x, y in both]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, give_back=True):
            keep = [similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs.distinct(), name + "-pairs")
    pairs = materialise(_both_ends(pairs, sets.select("node", F.struct("n", "bits").alias("v"))).mapInArrow(near, "a long, b long"), name + "-near")
    return materialise(_both_ends(pairs, rows.select("node", F.col("t").alias("v"))).mapInArrow(same, "a long, b long"), name + "-links")


def _by_fingerprint(sets: DataFrame) -> DataFrame:
    """Candidate pairs: rows of equal fingerprints and the first of them, and firsts within THRESHOLD bits."""
    firsts = materialise(sets.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("w")), "copies-fingerprints")
    first = firsts.filter("w > 1").select("fp", F.col("node").alias("first"), "w")
    same = look_up(sets.select("node", "fp"), materialise(first, "copies-equal"), ["fp"], "w", sets.count(), F.col("node")).filter("first <> node")
    same = same.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))
    return same.unionAll(simhash.near_links(firsts.select("node", "fp"), THRESHOLD).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def hooks(rows: np.ndarray, parted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (node, n, place, root, block, sketch...): pairs of a row of a smaller component and one of a larger that it may
    link to, the one of the smallest node and the most similar one; parted: only of different blocks."""
    node, n, place, root, block = rows[:, :5].T
    words, behind = rows[:, 5:].view(np.uint64), n - place
    _, which, size = np.unique(root, return_inverse=True, return_counts=True)
    rank = np.lexsort((np.arange(len(size)), size)).argsort()[which]  # of a row's component, by size
    order, found = np.argsort(node), []
    step = max(1, (1 << 17) // max(1, len(rows)))
    for at in range(0, len(rows), step):
        i = slice(at, at + step)
        both = n[i, None] + n[None, order]
        apart = sum(np.bitwise_count(words[i, None, k] ^ words[None, order, k]).astype(np.int64) for k in range(words.shape[1]))
        may = (9 * apart <= both) & (9 * np.minimum(behind[i, None], behind[None, order]) >= 4 * both) & (rank[i, None] < rank[None, order])
        if parted:
            may &= block[i, None] != block[None, order]
        row = np.nonzero(may.any(axis=1))[0]
        for pick in (may[row].argmax(axis=1), np.where(may[row], apart[row] / both[row], np.inf).argmin(axis=1)):
            found.append((row + at, order[pick]))
    return tuple(np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row of a block of a group once for every block that it meets; p and q are the two."""
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return dealt.withColumns({"p": F.least("piece", "other"), "q": F.greatest("piece", "other")})


def _hooked(between: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that hook components of a group to larger ones of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for key, rows, ends in simhash.runs(pieces(batches, 8192, give_back=True), 3):
            held.append(rows)
            if not ends:
                continue
            rows, held = np.concatenate(held), []
            i, j = hooks(rows, key[1] != key[2])
            if len(i):
                a, b = rows[i, 0], rows[j, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = _dealt(between.join(sets.select("node", "sketch"), "node"))
    wide = [F.col(c).cast("long").alias(c.removeprefix("x.")) for c in ("x.n", "x.place", "root", "piece")]
    dealt = dealt.select("h", "p", "q", "node", *wide, *(F.col("sketch")[k].alias(f"s{k}") for k in range(FOLD)))
    return dealt.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q").mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(node) with the root of their component."""
    roots = materialise(components(links, "copies-roots"), "copies-roots")
    return rows.join(of_checked_size(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_links(rows: DataFrame) -> DataFrame:
    """rows(node, t), t binary -> a(long), b(long): links whose components are those of all links."""
    sets = _read(rows)
    entries = sets.select("node", "n", F.posexplode("prefix").alias("place", "h"))
    repeated = materialise(entries.groupBy("h").agg(F.count("*").alias("w")).filter("w > 1"), "copies-repeated")
    total = repeated.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    maybe = may_be_in(entries, bitmap(repeated, ["h"]), ["h"]).filter("_hit")
    met = look_up(maybe, repeated, ["h"], "w", total, F.col("node")).filter("w is not null")
    met = materialise(met.select("h", F.struct("node", "n", "place").alias("x")), "copies-met")
    leads = materialise(met.groupBy("h").agg(F.min("x").alias("lead"), F.count("*").alias("w")), "copies-leads")
    star = attach(met, leads, ["h"], "w", total, F.col("x.node")).filter(F.col("x.node") != F.col("lead.node"))
    candidates = star.filter(_can_link("x", "lead")).select(*_pairs("x", "lead"))
    links = _checked(candidates.unionAll(_by_fingerprint(sets)), sets, rows, "copies-star")
    rooted = materialise(_rooted(met.withColumn("node", F.col("x.node")), links).select("h", "x", "root"), "copies-rooted")
    mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("w")).filter("low <> high").select("h", "w")
    parts = F.ceil(F.col("w") / GROUP).cast("int")
    mixed = attach(rooted, materialise(mixed, "copies-mixed"), ["h"], "w", total, F.col("x.node")).filter("w is not null")
    mixed = mixed.select("h", "x", "root", "w", parts.alias("pieces"), F.pmod(F.xxhash64("x.node"), parts).cast("int").alias("piece"), F.col("x.node").alias("node"))
    mixed = materialise(mixed, "copies-between")
    for _ in range(ROUNDS):
        large = mixed.filter(F.col("w") >= HOOKED)
        if large.isEmpty() or (found := _checked(_hooked(large, sets), sets, rows, "copies-hooks")).isEmpty():
            break
        links = links.unionAll(found)
        mixed = _rooted(mixed.drop("root"), links)
    mixed = mixed.join(sets.select("node", "sketch"), "node")
    earlier = F.collect_list("h").over(Window.partitionBy("node").orderBy("x.place").rowsBetween(-EARLIER, -1))
    mixed = mixed.withColumn("x", F.struct("x.*", *(F.col("sketch")[k].alias(f"s{k}") for k in range(FOLD)), earlier.alias("before")))
    dealt = materialise(_dealt(mixed).select("h", "x", "root", "piece", "p", "q"), "copies-dealt")
    one = dealt.filter("piece = p").select("h", "p", "q", "x", "root")
    two = dealt.filter("piece = q").select("h", "p", "q", F.col("x").alias("y"), F.col("root").alias("other"))
    across = one.join(two, ["h", "p", "q"]).filter("root <> other and (p < q or x.node < y.node)").filter(_can_link("x", "y") & _may_link("x", "y")).select(*_pairs("x", "y"))
    return links.unionAll(_checked(across, sets, rows, "copies-across"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of links, that with the smallest id; rows with a null id stay."""
    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    named = named.withColumn("node", F.xxhash64("id", "h"))
    rows = named.select("node", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    roots = materialise(components(near_links(rows), "copies-components"), "copies-components")
    linked = roots.select("node", "root").unionAll(roots.select(F.col("root").alias("node"), "root")).distinct()
    members = materialise(named.select("id", "h", "node").join(of_checked_size(linked), "node"), "copies-members")
    first = materialise(members.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("w")), "copies-firsts")
    found = attach(members, first, ["root"], "w", members.count(), F.col("node"))
    gone = found.filter(F.struct("id", "h") != F.col("first")).select("id", "h")
    return without(docs, materialise(gone, "copies-dropped"), id_col, text_col)
