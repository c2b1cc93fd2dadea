"""Language-model scores from a hierarchical Pitman-Yor model with Chinese-restaurant seating.

There is a restaurant for every previous word that occurs in the training texts, and one for the start of a text; they
share the root restaurant as parent, whose base is uniform. Dishes are words, the end of a text, and RARE, which stands
for the words outside the HEAD most frequent ones and for words that occur once (a pair of words that has one of these in
it occurs once as well). Which of its words RARE stands for is a further restaurant, with a uniform base over the rare
words and one unknown, seated for all words of a count at once. Counts cover all training texts. Word counts and restaurants grow with the corpus and stay
distributed; what is handed to all tasks is bounded: HEAD words of at most LONGEST bytes, and the root's probabilities.

Restaurants are kept whole, many to a row, each row's arrays sorted by context and dish; a menu has HEAD + 2 dishes at
most. Pairs are counted in the tasks that read texts, then by slot: contexts with more than SPLIT customers are split by
dish into slots of their own, and put together when counted. Rare contexts are told apart by 42 bits of a hash.

Seating is sampled by blocked Gibbs sweeps: all customers of a dish are taken out of a restaurant and seated anew, given
its other tables as of the sweep before and the root's probabilities. Up to EXACT customers, the number of tables t is
drawn from its exact conditional distribution, S(c, t) (strength + discount T) ... (strength + discount (T + t - 1)) p^t,
S being generalised Stirling numbers; beyond that their ratios come from the saddle points of their generating
function, and more than FEW tables are drawn from a normal distribution at the peak. A restaurant's tables are its parent's customers. After BURN_IN sweeps the predictive
probabilities of SAMPLES sweeps are averaged. Randomness is a hash of sweep, context and dish, and a sweep replays those
before it from the root's probabilities, so no state is kept between tasks and a task that runs again finds the same
seats. Discounts are n1 / (n1 + 2 n2) of a level's counts, strengths are STRENGTH.

To score, the pairs of all texts meet the restaurants by slot; split contexts are met in as many copies as they have
slots. Words outside HEAD meet their counts in a join (a word that is frequent there all the same is split by Spark's
skew-join rule). A null text is empty: its one token is the end. Rows with null or repeated ids are scored like others.
An empty table gives no rows; further columns don't matter, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlens.llm.common import materialise, pieces

HEAD, LONGEST = 1 << 19, 64
BURN_IN, SAMPLES, EXACT, FEW, STRENGTH = 2, 4, 64, 64, 1.0
#: Distinct words that a task counts before it passes them on, and tokens whose pairs it sorts at once.
COUNTED, CHUNK = 400_000, 1 << 21
#: Tokens of a slot, the fewest slots, and customers from which a context has slots of its own.
SLOT, SLOTS, SPLIT = 1 << 21, 64, 1 << 21
#: Stands for the end of a text in the table of counts; no word can be a space.
END = b" "
#: Bits of a dish in the number of a pair; the bit that marks a rare context.
_DISH, _TAIL = 20, 1 << 42


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, sweep: int, k: int) -> np.ndarray:
    """Numbers in [0, 1) from a 64-bit mix of key, sweep and k."""
    return mix(key.astype(np.uint64) + np.uint64((sweep * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))).astype(np.float64) / 2.0**64


@lru_cache(maxsize=4)
def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to EXACT: the weight of all ways to seat c customers at t tables."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        s[c + 1, t] = np.logaddexp(s[c, t - 1], s[c, t] + np.log(c - discount * np.minimum(t, c)))
    return s


@lru_cache(maxsize=4)
def _saddles(discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """On a grid of log(c / t - 1): log f(z) and half the log of the curvature, at the saddle point z where z f'(z) / f(z) = c / t."""
    x = np.linspace(-18, 28, 4000)
    low, high = np.full(len(x), -60.0), np.full(len(x), 690.0)  # log(z / (1 - z))
    for _ in range(70):
        middle = (low + high) / 2
        y = 1 / (1 + np.exp(middle))
        rise = (1 - y) * discount * y ** (discount - 1) / -np.expm1(discount * np.log(y)) - 1
        rise = np.where(middle < -9, (1 - discount) / 2 * np.exp(middle), rise)
        up = np.log(np.maximum(rise, 1e-300)) < x
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    y, g = 1 / (1 + np.exp(low)), 1 + np.exp(x)
    z = 1 - y
    f = np.where(low < -9, np.exp(low), -np.expm1(discount * np.log(y)) / discount)
    bend = g - g * g + z * z * (1 - discount) * y ** (discount - 2) / f
    bend = np.where(low < -6, (1 - discount) / 2 * np.exp(low), bend)
    return x, np.log(f), np.log(np.maximum(bend, 1e-300)) / 2


def log_ratio(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t + 1) / S(c, t) for many customers c: by saddle points, mended by what they miss at EXACT customers for so few tables."""
    return _saddle_ratio(c, t, discount) + np.interp(t, np.arange(1, EXACT // 2 + 1), _missed(discount), right=0.0)


@lru_cache(maxsize=4)
def _missed(discount: float) -> np.ndarray:
    s, t = log_stirling(discount)[EXACT], np.arange(1, EXACT // 2 + 1)
    return s[t + 1] - s[t] - _saddle_ratio(np.full(len(t), float(EXACT)), t.astype(np.float64), discount)


def _saddle_ratio(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same by the saddle points of S's generating function f(z)^t, f(z) = (1 - (1 - z)^d) / d, alone."""
    x, log_f, bend = _saddles(discount)

    def at(tables: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(c / tables - 1, 1e-8))

    curve = np.interp(at(t), x, bend) - np.interp(at(t + 1), x, bend) + np.log(t / (t + 1)) / 2
    return np.where(t >= c, -np.inf, np.interp(at(t + 0.5), x, log_f) - np.log(t + 1) + curve)


def draw(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes with c > 0 customers, given the other tables of their restaurant and the parent's probability."""
    tables = np.ones(len(c))
    if (np.diff(c) < 0).any():
        order = np.argsort(c, kind="stable")
        tables[order] = draw(c[order], others[order], p[order], discount, key[order], sweep)
        return tables
    s, u, step = log_stirling(discount), uniform(key, sweep, 1), np.arange(EXACT)
    edge = np.searchsorted(c, np.arange(2, EXACT + 2))
    for n in range(2, EXACT + 1):
        at = slice(edge[n - 2], edge[n - 1])
        if at.stop > at.start:
            pull = (STRENGTH + discount * (others[at, None] + step[None, 1:n])) * p[at, None]
            if n == 2:
                tables[at] = 1 + (u[at] * (1 + pull[:, 0] / (1 - discount)) >= 1)
                continue
            w = _weights(pull, s[n, 1 : n + 1])
            tables[at] = 1 + (w[:, :-1] <= u[at, None] * w[:, -1:]).sum(axis=1)
    at = slice(edge[-1], len(c))
    if at.stop > at.start:
        tables[at] = draw_many(c[at], others[at], p[at], discount, u[at], uniform(key[at], sweep, 2))
    return tables


def _weights(pull: np.ndarray, log_s: np.ndarray) -> np.ndarray:
    """Running sums of the weights of 1, 2, ... tables, but for a factor: rows of pulls towards the second table and on."""
    if len(log_s) <= 24:  # far from the limits of doubles
        w = np.ones((len(pull), len(log_s)))
        np.cumprod(pull * np.exp(np.diff(log_s)), axis=1, out=w[:, 1:])
        return np.cumsum(w, axis=1)
    w = np.zeros((len(pull), len(log_s)))
    np.cumsum(np.log(pull) + np.diff(log_s), axis=1, out=w[:, 1:])
    return np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)


def draw_many(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Beyond EXACT customers: by ratios of neighbours, in full if there are few tables, else by a normal at their peak."""
    c = c.astype(np.float64)

    def gain(t: np.ndarray) -> np.ndarray:
        return log_ratio(c, t, discount) + np.log((STRENGTH + discount * (others + t)) * p)

    low, high = np.ones(len(c)), c.copy()
    for _ in range(60):  # gain falls as t grows: the peak is where it is zero
        middle = (low + high) / 2
        up = gain(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    slope = (gain(low * 0.99) - gain(low * 1.01)) / (0.02 * low)
    wide = 1 / np.sqrt(np.maximum(slope, 1e-12))
    tables = np.clip(np.round(low + 0.5 + wide * np.sqrt(-2 * np.log1p(-u)) * np.cos(2 * np.pi * v)), 1, c)
    few = np.nonzero(~(low + 6 * wide < FEW))[0]
    few = np.setdiff1d(np.arange(len(c)), few)
    for at in np.array_split(few, max(1, len(few) * FEW >> 20)):
        if len(at):
            t = np.arange(1.0, FEW)[None, :]
            w = log_ratio(c[at, None], t, discount) + np.log((STRENGTH + discount * (others[at, None] + t)) * p[at, None])
            w = np.concatenate([np.zeros((len(at), 1)), np.cumsum(w, axis=1)], axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (w[:, :-1] <= u[at, None] * w[:, -1:]).sum(axis=1)
    return tables


def _discount(n1: float, n2: float) -> float:
    return float(min(0.95, max(0.05, n1 / (n1 + 2 * n2)))) if n1 else 0.05


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """w (binary), c: how often each word is in the texts, and the end, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(held.keys()), list(held.values())
            for at in range(0, len(words), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 15)], pa.binary()), pa.array(n[at : at + (1 << 15)], pa.int64())], ["w", "c"])
            held.clear()

        held: Counter[bytes] = Counter()
        for b in batches:
            for x in b.column(0):
                held.update(tokens_of(x.as_py()))
                if len(held) > COUNTED:
                    yield from out()
            held[END] += b.num_rows
        yield from out()

    counts = train.select(F.col(text_col).cast("binary")).mapInArrow(run, "w binary, c long")
    return materialise(counts.groupBy("w").agg(F.sum("c").alias("c")).filter("c > 0"), "lm-counts")


def _level(counts: DataFrame, size: int) -> int:
    """The lowest count whose words, and all more frequent ones, are no more than that many."""
    eighth = F.floor(F.log2("c") * 8).cast("int")
    found, seen = 1 << 62, 0
    for _, low, n in sorted(counts.groupBy(eighth.alias("e")).agg(F.min("c"), F.count("*")).collect(), reverse=True):
        seen += n
        found = low if seen <= size else found
    return found


class Vocabulary:
    """Numbers of dishes and contexts, and the slots that contexts go to."""

    def __init__(self, words: list[bytes], counts: np.ndarray, ends: int, slots: int):
        self.words, self.counts, self.ends, self.slots = words, counts, ends, slots
        self.rare, self.end, self.width = len(words), len(words) + 1, len(words) + 2
        customers = np.concatenate([counts, [0, ends]])
        self.parts = np.where(customers > SPLIT, -(-customers // SPLIT), 1).astype(np.int64)
        self.first = slots + np.cumsum(self.parts) - self.parts  # first slot of a context that has its own
        self._place: dict[bytes, int] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None}

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Dishes of words; -1 for rare ones."""
        if self._place is None:
            self._place = {w: i for i, w in enumerate(self.words)}
        return np.fromiter(map(self._place.get, tokens, repeat(-1)), np.int64, len(tokens))

    def pairs(self, tokens: list[bytes], ids: np.ndarray) -> np.ndarray:
        """A number for each token of a text, the end included, with the word before."""
        before = ids.copy()
        for i in np.nonzero(ids < 0)[0].tolist():
            before[i] = _TAIL | xxhash.xxh64_intdigest(tokens[i]) >> 22
        before = np.concatenate([[self.end], before])
        return before << _DISH | np.append(np.where(ids < 0, self.rare, ids), self.end)

    def slot(self, pairs: np.ndarray, part: np.ndarray | int) -> np.ndarray:
        """The slot of pairs; part says which of its slots a split context uses."""
        context = pairs >> _DISH
        out = (mix(context) % np.uint64(self.slots)).astype(np.int64)
        head = np.nonzero(context < self.width)[0]
        split = head[self.parts[context[head]] > 1]
        u = context[split]
        out[split] = self.first[u] + (part if isinstance(part, int) else part[split]) % self.parts[u]
        return out


def _pack(x: np.ndarray) -> bytes:
    """First all lowest bytes, then the next ones: the upper ones hardly take any room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def _unpack(x: bytes, kind: str) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


MENUS = "slot long, context binary, sizes binary, dish binary, n binary"


def _by_slot(slot: np.ndarray) -> np.ndarray:
    """A stable order by slot."""
    return np.argsort(slot.astype(np.uint16) if slot.max(initial=0) < 1 << 16 else slot, kind="stable")


def _menus(slot: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted pairs with their counts as a row a slot."""
    order = _by_slot(slot)
    slot, pairs, n = slot[order], pairs[order], n[order]
    edge = np.concatenate([np.nonzero(np.diff(slot, prepend=-1))[0], [len(slot)]])
    rows = []
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        context = pairs[s:e] >> _DISH
        start = np.nonzero(np.diff(context, prepend=-1))[0]
        sizes = np.diff(np.append(start, e - s))
        rows.append((int(slot[s]), _pack(context[start]), _pack(sizes.astype("<u4")), _pack((pairs[s:e] & ((1 << _DISH) - 1)).astype("<u4")), _pack(n[s:e].astype("<u8"))))
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["slot", "context", "sizes", "dish", "n"])


def _read_menu(context: bytes, sizes: bytes, dish: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs and their counts."""
    pairs = np.repeat(_unpack(context, "<i8"), _unpack(sizes, "<u4")) << _DISH | _unpack(dish, "<u4").astype(np.int64)
    return pairs, _unpack(n, "<u8").astype(np.int64)


def _sum_menus(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = rows.num_rows
    if many == 1:
        return _read_menu(*(rows.column(c)[0].as_py() for c in ("context", "sizes", "dish", "n")))
    for k, row in enumerate(zip(*(rows.column(c) for c in ("context", "sizes", "dish", "n")), strict=True)):
        held.append(_read_menu(*(x.as_py() for x in row)))
        if sum(len(x) for x, _ in held) > max(SLOT // 4, len(pairs)) or k == many - 1:
            pairs, at = np.unique(np.concatenate([pairs, *(x for x, _ in held)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *(x for _, x in held)]), len(pairs)).astype(np.int64)
            held = []
    return pairs, n


class Restaurants:
    """The restaurants of a row, seated sweep by sweep."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray, discount: float):
        self.pairs, self.n, self.d = pairs, n, discount
        context = pairs >> _DISH
        start = np.nonzero(np.diff(context, prepend=-1))[0]
        self.contexts, self.row = context[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(pairs))))
        self.dish, self.size = pairs & ((1 << _DISH) - 1), np.bincount(self.row, n, len(start))
        several = np.nonzero(n > 1)[0]
        self.several = several[np.argsort(n[several], kind="stable")]  # as draw() has them
        self.key, self.t = mix(pairs[self.several]), np.ones(len(n))
        self.least = np.bincount(self.row, minlength=len(start)).astype(np.float64)
        self.tables, self.now = self.least, np.ones(len(several))
        self.of_several = self.n[self.several], self.row[self.several], self.dish[self.several]

    def sweep(self, root: np.ndarray, number: int) -> None:
        n, row, dish = self.of_several
        self.now = draw(n, self.tables[row] - self.now, root[dish].astype(np.float64), self.d, self.key, number)
        self.t[self.several] = self.now
        self.tables = self.least + np.bincount(row, self.now - 1, len(self.contexts))


def train_pairs(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """The restaurants' customers: rows of whole restaurants (MENUS); a split context has a row of its own, with its first slot."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, many = shared.value, [], 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return _menus(v.slot(pairs, pairs & ((1 << _DISH) - 1)), pairs, n)

        for b in batches:
            for x in b.column(0):
                tokens = tokens_of(x.as_py())
                held.append(v.pairs(tokens, v.ids(tokens)))
                many += len(tokens) + 1
                if many >= CHUNK:
                    yield out()
                    held, many = [], 0
        yield out()

    def merge(rows: pa.Table) -> pa.Table:
        pairs, n = _sum_menus(rows)
        return pa.Table.from_batches([_menus(np.full(len(pairs), rows.column("slot")[0].as_py()), pairs, n)])

    def join(rows: pa.Table) -> pa.Table:
        pairs, n = _sum_menus(rows)
        return pa.Table.from_batches([_menus(np.full(len(pairs), shared.value.first[pairs[0] >> _DISH]), pairs, n)])

    cells = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, MENUS).groupBy("slot").applyInArrow(merge, MENUS)
    if vocabulary.parts.max(initial=1) == 1:
        return materialise(cells, "lm-restaurants")
    cells = materialise(cells, "lm-cells")
    split = cells.filter(F.col("slot") >= vocabulary.slots)
    whole = split.groupBy(F.xxhash64("context").alias("c"), "context").applyInArrow(join, MENUS)
    return materialise(cells.filter(F.col("slot") < vocabulary.slots).unionAll(whole), "lm-restaurants")


@dataclass
class Model:
    """What scoring needs: distributed counts and restaurants, and the root's probabilities after each sweep."""

    counts: DataFrame
    restaurants: DataFrame
    tokens: int
    distinct: int
    vocabulary: Vocabulary
    discount: float
    roots: list[np.ndarray]
    rare_from: int
    rare: dict[str, float | list[float]]


def _sums(restaurants: DataFrame, discount: float, roots: list[np.ndarray], width: int) -> tuple[np.ndarray, int, int]:
    """Tables by dish after a sweep for each root, of dishes with one customer and of the others; and those with one and two customers."""
    shared = restaurants.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones, twos = np.zeros(width), 0, 0
        for b in batches:
            for row in zip(*(b.column(k) for k in range(1, 5)), strict=True):
                r = Restaurants(*_read_menu(*(x.as_py() for x in row)), discount)
                for k, root in enumerate(shared.value):
                    r.sweep(root, k)
                total += np.bincount(r.dish, r.t, width)
                ones, twos = ones + int((r.n == 1).sum()), twos + int((r.n == 2).sum())
        dish = np.nonzero(total)[0]
        dish, total = np.append(dish, [width, width + 1]), np.append(total[dish], [ones, twos])
        yield pa.RecordBatch.from_arrays([pa.array(dish.astype(np.int32)), pa.array(total.astype(np.int64))], ["dish", "t"])

    got = restaurants.select("slot", "context", "sizes", "dish", "n").mapInArrow(run, "dish int, t long").groupBy("dish").agg(F.sum("t").alias("t")).toArrow()  # at most HEAD + 4
    total = np.zeros(width + 2)
    total[got.column("dish").to_numpy()] = got.column("t").to_numpy()
    return total[:width], int(total[width]), int(total[width + 1])


def root_after(opened: np.ndarray, tables: np.ndarray, sweep: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The root's probabilities and tables when its customers have been seated; without a sweep each dish has one table."""
    width, d = len(opened), _discount((opened == 1).sum(), (opened == 2).sum())
    there = np.nonzero(opened > 0)[0]
    now = (opened > 0).astype(np.float64)
    if sweep is not None and len(there):
        now[there] = draw(opened[there].astype(np.int64), tables.sum() - tables[there], np.full(len(there), 1 / width), d, mix(there), sweep)
    p = (opened - d * now + (STRENGTH + d * now.sum()) / width) / (STRENGTH + opened.sum())
    return p.astype(np.float32), now


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all texts of docs and seats the restaurants."""
    counts = word_counts(docs, text_col)
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = counts.filter((F.col("w") != END) & (F.octet_length("w") <= LONGEST) & (F.col("c") > 1))
    least = _level(short, HEAD)
    head = short.filter(F.col("c") >= least).toArrow().sort_by([("c", "descending"), ("w", "ascending")])
    ends = next((r.c for r in counts.filter(F.col("w") == END).collect()), 0)
    slots = max(SLOTS, -(-n // SLOT))
    vocabulary = Vocabulary(head.column("w").to_pylist(), head.column("c").to_numpy(), ends, slots)
    restaurants = train_pairs(docs, vocabulary, text_col)

    opened, n1, n2 = _sums(restaurants, 0.5, [], vocabulary.width)
    d, roots = _discount(n1, n2), []
    p, tables = root_after(opened, np.zeros(vocabulary.width), None)
    for sweep in range(BURN_IN + SAMPLES):
        roots.append(p)
        opened, _, _ = _sums(restaurants, d, roots, vocabulary.width)
        p, tables = root_after(opened, tables, sweep)
    roots.append(p)

    rare = {r.c: r.n for r in _rare_words(counts, least).groupBy("c").agg(F.count("*").alias("n")).collect()}  # rare words' counts are few
    rare_d, base, tables = _discount(rare.get(1, 0), rare.get(2, 0)), 1 / (sum(rare.values()) + 1), [float(sum(rare.values()))]
    for sweep in range(BURN_IN + SAMPLES):
        tables.append(rare_tables(rare, tables[-1], base, rare_d, sweep))
    customers = sum(c * m for c, m in rare.items())
    return Model(counts, restaurants, n, distinct, vocabulary, d, roots, least, {"discount": rare_d, "base": base, "customers": customers, "tables": tables, "counts": sorted(rare)})


def _rare_words(counts: DataFrame, least: int) -> DataFrame:
    """The words that are no dishes."""
    dish = (F.octet_length("w") <= LONGEST) & (F.col("c") > 1) & (F.col("c") >= least)
    return counts.filter((F.col("w") != END) & ~dish)


def _shares(c: int, tables: float, base: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables of a rare word with c customers, given all rare words' tables, and how likely they are."""
    others = max(0.0, tables - 1)
    if c > EXACT:
        u = (np.arange(256) + 0.5) / 256
        t = draw_many(np.full(256, c), np.full(256, others), np.full(256, base), discount, u, np.arange(256) * 0.6180339887498949 % 1)
        return t, np.full(256, 1 / 256)
    pull = (STRENGTH + discount * (others + np.arange(1, c)))[None, :] * base
    w = np.diff(_weights(pull, log_stirling(discount)[c, 1 : c + 1])[0], prepend=0.0)
    return np.arange(1.0, c + 1), w / w.sum()


def rare_tables(counts: dict[int, int], tables: float, base: float, discount: float, sweep: int) -> float:
    """Tables of all rare words after a sweep, drawn for all words of a count at once; counts: words by their count."""
    rng, total = np.random.default_rng(sweep), 0.0
    for c, many in sorted(counts.items()):
        t, share = _shares(c, tables, base, discount)
        total += float(t @ rng.multinomial(many, share))
    return total


def rare_log_p(c: int, rare: dict) -> float:
    """log10 of the averaged predictive probability of a word with that count among the rare ones; c is 0 for unknown words."""
    d, total = rare["discount"], 0.0
    for s in range(BURN_IN, BURN_IN + SAMPLES):
        own = 0.0
        if c:
            t, share = _shares(c, rare["tables"][s], rare["base"], d)
            own = c - d * float(t @ share)
        total += (own + (STRENGTH + d * rare["tables"][s + 1]) * rare["base"]) / (STRENGTH + rare["customers"])
    return float(np.log10(total / SAMPLES))


def pair_log_p(pairs: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None, roots: list[np.ndarray], discount: float) -> np.ndarray:
    """log10 of the averaged predictive probabilities of sorted pairs, given the restaurants they may be in."""
    dish, total = pairs & ((1 << _DISH) - 1), np.zeros(len(pairs))
    r = Restaurants(*(known or (np.empty(0, np.int64), np.empty(0, np.int64))), discount)
    context = pairs >> _DISH

    def look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        hit = np.nonzero(at < len(keys))[0]
        hit = hit[keys[at[hit]] == wanted[hit]]
        return hit, at[hit]

    here, place = look(r.contexts, context)
    same, entry = look(r.pairs, pairs)
    for k in range(BURN_IN + SAMPLES):
        r.sweep(roots[k], k)
        if k < BURN_IN:
            continue
        weight, own = np.ones(len(pairs)), np.zeros(len(pairs))
        weight[here] = (STRENGTH + discount * r.tables[place]) / (STRENGTH + r.size[place])
        own[same] = (r.n[entry] - discount * r.t[entry]) / (STRENGTH + r.size[r.row[entry]])
        total += own + weight * roots[k + 1][dish]
    return np.log10(total / SAMPLES)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    context, rare, v = docs.sparkSession.sparkContext, model.rare, model.vocabulary
    n, d, ends = model.tokens, model.discount, model.vocabulary.ends
    lone = float(np.log10(n + model.distinct + 1))
    shared, roots = context.broadcast(v), context.broadcast(model.roots)
    kind = docs.schema[id_col].dataType
    types = [pa.int64(), to_arrow_type(kind), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), *[pa.binary()] * 4]
    names = ["uid", "id", "w", "n", "known", "base", "slot", "context", "sizes", "dish", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, log_c = shared.value, np.log10(shared.value.counts + 1.0)
        held: list[np.ndarray] = []
        many, first = 0, None

        def batch(rows: int, **columns: pa.Array | list) -> pa.RecordBatch:
            made = {c: x if isinstance(x, pa.Array) else pa.array(x, types[names.index(c)]) for c, x in columns.items()}
            return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(rows, t) for c, t in zip(names, types, strict=True)], names)

        def pairs_out() -> pa.RecordBatch:
            """A row a slot: pairs, how often each occurs, and in which texts (counted from uid on)."""
            pairs, doc = np.concatenate([np.empty(0, np.int64), *held]), np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(pairs)
            pairs, doc = pairs[order], doc[order]
            slot = v.slot(pairs, int(first or 0) >> 3)
            order = _by_slot(slot)
            slot, pairs, doc = slot[order], pairs[order], doc[order]
            edge = np.concatenate([np.nonzero(np.diff(slot, prepend=-1))[0], [len(slot)]])
            out = []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                start = np.nonzero(np.diff(pairs[s:e], prepend=-1))[0]
                own = pairs[s:e][start]
                ctx = own >> _DISH
                change = np.nonzero(np.diff(ctx, prepend=-1))[0]
                often = np.diff(np.append(start, e - s))
                menu = np.concatenate([[len(change)], np.diff(np.append(change, len(own))), often])
                out.append((int(slot[s]), _pack(ctx[change]), _pack(menu.astype("<u4")), _pack((own & ((1 << _DISH) - 1)).astype("<u4")), _pack(doc[s:e].astype("<u4"))))
            slots, *blobs = zip(*out, strict=True)
            return batch(len(out), uid=[first] * len(out), slot=slots, **dict(zip(("context", "sizes", "dish", "docs"), blobs, strict=True)))

        for b in pieces(batches):
            size, known, base, tail, times, owners = [], [], [], [], [], []
            for uid, text in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                tokens = tokens_of(text.as_py())
                i = v.ids(tokens)
                mine = i[i >= 0]
                size.append(len(tokens) + 1)
                known.append(len(mine) + (ends > 0))
                base.append(float(log_c[mine].sum()) + float(np.log10(ends + 1)) - lone * (len(tokens) + 1))
                outside = Counter(tokens[x] for x in np.nonzero(i < 0)[0].tolist())
                tail += outside
                times += outside.values()
                owners.append(len(outside))
                first = uid if first is None else first
                held.append(v.pairs(tokens, i))
                many += len(tokens) + 1
                if many >= CHUNK:
                    yield pairs_out()
                    held, many, first = [], 0, None
            yield batch(b.num_rows, uid=b.column(0), id=b.column(1), n=size, known=known, base=base)
            for at, uid in zip(range(0, len(tail), 1 << 16), np.array_split(np.repeat(b.column(0).to_numpy(), owners), range(1 << 16, len(tail), 1 << 16)), strict=False):
                yield batch(len(uid), uid=uid, w=tail[at : at + (1 << 16)], n=times[at : at + (1 << 16)])
        if held:
            yield pairs_out()

    tagged = docs.select(F.monotonically_increasing_id().alias("uid"), id_col, F.col(text_col).cast("binary").alias("t"))
    schema = f"uid long, id {kind.simpleString()}, w binary, n long, known long, base double, slot long, context binary, sizes binary, dish binary, docs binary"
    rows = materialise(tagged.mapInArrow(run, schema), "lm-rows")

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        known = _sum_menus(theirs) if theirs.num_rows else None
        chunk, texts, times, pairs = [], [], [], []
        for first, *row in zip(*(mine.column(c) for c in ("uid", "context", "sizes", "dish", "docs")), strict=True):
            ctx, sizes, dish, doc = (_unpack(x.as_py(), k) for x, k in zip(row, ("<i8", "<u4", "<u4", "<u4"), strict=True))
            m = int(sizes[0])
            pairs.append(np.repeat(ctx, sizes[1 : m + 1]) << _DISH | dish.astype(np.int64))
            times.append(sizes[m + 1 :])
            chunk.append(first.as_py())
            texts.append(doc)
        if not pairs:
            return pa.table({"chunk": pa.array([], pa.int64()), "texts": pa.array([], pa.binary()), "lp": pa.array([], pa.binary())})
        distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
        lp, at, out = pair_log_p(distinct, known, roots.value, d), np.split(at, np.cumsum([len(x) for x in pairs])[:-1]), []
        for place, often, doc in zip(at, times, texts, strict=True):
            total = np.bincount(doc, np.repeat(lp[place], often))
            there = np.nonzero(total)[0]
            out.append((_pack(there.astype("<u4")), _pack(total[there].astype("<f4"))))
        return pa.table({"chunk": chunk, "texts": pa.array([x for x, _ in out], pa.binary()), "lp": pa.array([x for _, x in out], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        """The sums of a chunk's texts over all slots."""
        doc, lp = (np.concatenate([_unpack(x.as_py(), k) for x in rows.column(c)]) for c, k in (("texts", "<u4"), ("lp", "<f4")))
        total = np.bincount(doc, lp.astype(np.float64))
        there = np.nonzero(total)[0]
        return pa.table({"uid": rows.column("chunk")[0].as_py() + there, "own": total[there]})

    first, parts = v.first[v.parts > 1], v.parts[v.parts > 1]
    copies = F.col("slot")
    if len(first):
        number = dict(zip(first.tolist(), parts.tolist(), strict=True))
        sizes = docs.sparkSession.createDataFrame(list(number.items()), "slot long, parts long")
        there = model.restaurants.join(F.broadcast(sizes), "slot", "left")
        copies = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.coalesce("parts", F.lit(1)) - 1))
    else:
        there = model.restaurants
    there = there.select(copies.alias("slot"), "context", "sizes", "dish", "n")
    asked = rows.filter("slot is not null").select("slot", "uid", "context", "sizes", "dish", "docs")
    own = asked.groupBy("slot").cogroup(there.groupBy("slot")).applyInArrow(meet, "chunk long, texts binary, lp binary")
    own = own.groupBy("chunk").applyInArrow(add, "uid long, own double")

    by_count = docs.sparkSession.createDataFrame([(c, rare_log_p(c, rare)) for c in rare["counts"]], "c long, lp double")
    few = _rare_words(model.counts, model.rare_from).join(F.broadcast(by_count), "c").select("w", "c", "lp")
    unknown = rare_log_p(0, rare)
    tail = rows.filter("w is not null").select("uid", "w", "n").join(few, "w", "left")
    sums = tail.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("tail_base"),
        F.sum(F.col("n") * F.coalesce("lp", F.lit(unknown))).alias("tail_own"),
    )
    whole = rows.filter("w is null and slot is null").select("uid", "id", "n", "known", "base").join(sums, "uid", "left").join(own, "uid", "left")
    score_ = F.col("own") + F.coalesce("tail_own", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        score_.alias("score"),
        F.pow(F.lit(10.0), -score_ / F.col("n")).alias("perplexity"),
    )
