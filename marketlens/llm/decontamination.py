"""Benchmark decontamination by greedy string tiling.

Words (lower-cased runs of letters and digits of any script) are compared, so case, punctuation and kinds of space don't
hide a copy. A document and an item become a pair if they share a seed, a run of SEED words, or of all its words for a
shorter item, found by a running Karp-Rabin hash: the hash of any run is a difference of prefix sums. On each pair the
longest common run of unmarked words, a seed at least, is marked as a tile, again and again, until none is left; tiles
never overlap, so passages put in another order are still covered. Runs of a length are found through a table of hashes
of the item's runs; if two texts share a run they share its beginning, so the longest is found by halving. Memory is
linear in the two texts, and there are no more rounds than different lengths of tiles. A document is contaminated if
tiles cover `min_coverage` of an item's words.

Null texts and items have no words and match nothing. Rows with null or repeated ids are reported like others. The items
are handed out in blocks of bounded size, and each block is held against all documents.
An empty table gives no rows; further columns don't matter, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm.common import kept_rows, pieces

SEED, MIN_COVERAGE = 5, 0.5
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Bytes of joined text hashed at once; longer texts go in several cuts that overlap by a seed.
CUT = 1 << 18
#: Base of the polynomial, odd so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
#: What is neither ASCII nor part of a word in any script.
_BETWEEN = re.compile(r"[^\w\x00-\x7f]+")
_WORDS = bytes(b if b > 127 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii():
        text = _BETWEEN.sub(" ", text)
    return text.encode(errors="replace").translate(_WORDS).split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BASE, 2 * CUT), _powers(pow(BASE, -1, 1 << 64), 2 * CUT)


def run_hashes(words: list[bytes], width: int = SEED) -> np.ndarray:
    """The hash of each run of `width` words; equal runs have equal hashes."""
    out, n = [np.empty(0, np.uint64)], len(words)
    at = 0
    while at + width <= n:
        size, end = 0, at
        while end < n and (size < CUT or end < at + width):
            size += len(words[end]) + 1
            end += 1
        out.append(_hash_cut(words[at:end], width))
        at = end - width + 1
    return np.concatenate(out)


def _hash_cut(words: list[bytes], width: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8).astype(np.uint64)
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_powers(BASE, len(data) + 1), _powers(pow(BASE, -1, 1 << 64), len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1], ends[width - 1 :]
    return (sums[ends] - sums[starts]) * down[starts]


class _Runs:
    """Hashes of a text's runs of any length, by prefix sums over its words' hashes."""

    def __init__(self, words: list[bytes]):
        own = run_hashes(words, 1)
        own = (own ^ own >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        n = len(words)
        self.down = _powers(pow(BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * _powers(BASE, n + 1)[:n], out=self.sums[1:])

    def of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Where a run of that many unmarked words begins."""
    taken = np.concatenate([[0], np.cumsum(marked)])
    return taken[length:] == taken[:-length]


def tiles(a: list[bytes], b: list[bytes], width: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word lists: (start in a, start in b, words)."""
    width = min(width, len(b))
    if not width or len(a) < width:
        return []
    ra, rb = _Runs(a), _Runs(b)
    in_a, in_b, found = np.zeros(len(a), bool), np.zeros(len(b), bool), []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in b of unmarked runs of that length that both have; and those in a of all, sorted by hash, with the hashes."""
        at_a = np.nonzero(_free(in_a, length))[0]
        ha = ra.of(length)[at_a]
        order = np.argsort(ha, kind="stable")
        ha, at_a = ha[order], at_a[order]
        at_b = np.nonzero(_free(in_b, length))[0]
        hb = rb.of(length)[at_b]
        place = np.minimum(np.searchsorted(ha, hb), max(0, len(ha) - 1))
        hit = ha[place] == hb if len(ha) else np.zeros(len(hb), bool)
        return at_b[hit], at_a, ha

    longest = min(len(a), len(b))
    while longest >= width:
        low, high = width - 1, longest  # runs of `low` words are shared, or too short; none longer than `high` are
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < width:
            break
        at_b, at_a, ha = common(low)
        hb, left = rb.of(low), {}
        for y in at_b.tolist():  # ties go to what comes first in the item, then in the text
            if in_b[y : y + low].any():
                continue
            h = hb[y]
            if h not in left:
                left[h] = at_a[np.searchsorted(ha, h, "left") : np.searchsorted(ha, h, "right")].tolist()[::-1]
            while left[h] and in_a[left[h][-1] : left[h][-1] + low].any():
                left[h].pop()
            if left[h]:
                x = left[h].pop()
                if a[x : x + low] == b[y : y + low]:
                    in_a[x : x + low] = in_b[y : y + low] = True
                    found.append((x, y, low))
        longest = low - 1  # what is left of longer runs is shorter
    return found


class _Items:
    """A block of items with the hashes of their seeds, made once in a worker."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.items, self.seeds = items, None

    def __getstate__(self) -> dict:
        return {"items": self.items, "seeds": None}

    def index(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By width of seeds: sorted hashes, the items they are of, and a bit for each hash's last bits."""
        if self.seeds is None:
            self.seeds = {}
            for width in sorted({min(SEED, len(w)) for _, w in self.items}):
                mine = [(k, run_hashes(w, width)) for k, (_, w) in enumerate(self.items) if min(SEED, len(w)) == width]
                every, owner = np.concatenate([h for _, h in mine]), np.repeat([k for k, _ in mine], [len(h) for _, h in mine])
                order = np.argsort(every, kind="stable")
                likely = np.zeros(1 << _FILTER_BITS, bool)
                likely[every >> np.uint64(64 - _FILTER_BITS)] = True
                self.seeds[width] = every[order], owner[order], likely
        return self.seeds

    def found_in(self, text: str | None, min_coverage: float) -> list[tuple]:
        """item, coverage, tiles, tiled words and words of the items that a text covers."""
        words, out = words_of(text), []
        for width, (every, owner, likely) in self.index().items():
            h = run_hashes(words, width)
            h = np.unique(h[likely[h >> np.uint64(64 - _FILTER_BITS)]])
            low, high = np.searchsorted(every, h, "left"), np.searchsorted(every, h, "right")
            for k in sorted({int(o) for s, e in zip(low.tolist(), high.tolist(), strict=True) for o in owner[s:e]}):
                item, w = self.items[k]
                got = tiles(words, w)
                if (total := sum(n for _, _, n in got)) and total / len(w) >= min_coverage:
                    out.append((item, total / len(w), len(got), total, len(w)))
        return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[_Items]:
    """The items in blocks of about BLOCK_BYTES, one at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = int(-(-size // BLOCK_BYTES)) or 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        yield _Items([(r.item, w) for r in block if (w := words_of(r.t))])


def contamination(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated document and item: id, item, coverage, n_tiles, tiled_words, item_words."""
    kinds = [docs.schema[id_col].dataType, benchmark.schema[item_col].dataType]
    names = [id_col, item_col, "coverage", "n_tiles", "tiled_words", "item_words"]
    types = [*map(to_arrow_type, kinds), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(names, [*(k.simpleString() for k in kinds), "double", "long", "long", "long"], strict=True))

    def against(block: _Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                out = [(key.as_py(), *row) for key, text in zip(b.column(0), b.column(1), strict=True) for row in shared.value.found_in(text.as_py(), min_coverage)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    found = [against(block) for block in _blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionAll, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text covers a benchmark item, decided row by row where they lie."""
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(b: pa.RecordBatch, shared: Broadcast = shared) -> list[bool]:
            return [not shared.value.found_in(x.as_py(), min_coverage) for x in b.column(0)]

        docs = kept_rows(docs, [text_col], keep)
    return docs
