"""Quality classification: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on every trusted row (of equal ones, one), but for each HELD_OUT-th trusted id (by a hash), which is left out for the limits.
N-grams are counted and joined as tables: trigram counts, continuation counts of their suffixes, three discounts an order
from counts of counts, the mass each context leaves to the next lower order, and by joins the interpolated probabilities.
Words are told apart by XXH64, n-grams by the exclusive or of their words' hashes, rotated by their place (of 10^9 n-grams, two
share a key with a chance of 3 %).

The tables grow with the input and stay distributed. A text's log probability is a sum over its words, pairs and triples:
each n-gram that the model has corrects what the order below says of it (own), and what it leaves as a context to the order
below (ahead) counts if a word follows; n-grams that the model lacks add nothing. So the n-grams of all texts meet one table by
one key, and are summed. The HEAD most frequent ones are handed to the tasks instead, with the same values: they are most
of the tokens, and none of the hot keys that the model has is left to the join. Texts are told apart by their hashes there.

All whole texts are scored. A language's limit is the QUANTILE of the perplexities of its trusted documents that were
left out, or of all languages' where it has fewer than MIN_TRUSTED; a document above its limit is not kept. Texts without
words have no perplexity and are not kept. A null language is a language of its own. Rows with null or repeated ids are
scored like others.
An empty table gives no rows; further columns don't matter, whatever they are called.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import look_up, materialise, of_checked_size, pieces, placed, text_hash

log = logging.getLogger(__name__)

QUANTILE, MIN_TRUSTED, HELD_OUT = 0.98, 20, 5
#: N-grams whose values are handed to all tasks (24 bytes each); it decides no result.
HEAD = 1 << 20
#: Of sample_of() alone.
TRAIN_DOCS, TRAIN_WORDS = 4000, 1_000_000
#: Words whose hashes a task keeps.
_CACHED = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _hash(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


#: Stands before the first word of a text; no word can be a space.
START = _hash(b" ")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        found = self[word] = _hash(word)
        return found


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.view(np.uint64)
    return (x << np.uint64(bits) | x >> np.uint64(64 - bits)).view(np.int64)


def _key(*words: str) -> Column:
    """Of an n-gram in columns; as keys_of() has it."""
    found = F.col(words[-1])
    for bits, w in enumerate(reversed(words[:-1]), 1):
        found = found.bitwiseXOR(F.shiftleft(w, bits).bitwiseOR(F.shiftrightunsigned(w, 64 - bits)))
    return found


def keys_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the hashes of a text's words: keys of all n-grams that end at its words or are contexts of the first ones, and whether a word follows."""
    line = np.concatenate([[START, START], ids])
    two = line[1:] ^ _left(line[:-1], 1)
    three = two[1:] ^ _left(line[:-2], 2)
    ends = np.ones(len(line) - 1, bool)
    ends[-1] = False
    return np.concatenate([line[1:], two, three]), np.concatenate([ends, ends, ends[1:]])


@dataclass
class Model:
    """table: key, own, ahead (log10) of all n-grams but the head's; head: the same as arrays, sorted; spare: log10 probability of an unknown word."""

    table: DataFrame
    head: tuple[np.ndarray, np.ndarray, np.ndarray]
    spare: float
    words: int


def _discounts(table: DataFrame) -> list[float]:
    """Of counts 1, 2 and 3 or more."""
    n = table.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def _less(d: list[float]) -> Column:
    return F.col("c") - F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _masses(table: DataFrame, by: list[str], d: list[float]) -> DataFrame:
    """Each context's total count and what its discounts leave to the lower order."""
    kinds = [F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.count_if(F.col("c") > 2)]
    left = sum((kind * x for kind, x in zip(kinds, d, strict=True)), F.lit(0.0))
    return table.groupBy(*by).agg(F.sum("c").alias("total"), (left / F.sum("c")).alias("mass"))


def sample_of(trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For a model of a bounded sample, which classify() does not use: at most TRAIN_DOCS distinct ids of trusted rows, of TRAIN_WORDS words in all; their texts in t. A text that no longer fits is left out, the next ones are tried."""
    ids = trusted.filter(F.col(id_col).isNotNull()).select(id_col).distinct()
    ids = materialise(ids.orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_DOCS), "quality-sample")
    texts = trusted.join(F.broadcast(ids), id_col).select(id_col, F.col(text_col).alias("t")).distinct()  # an id that very many equal rows repeat is one row
    size = F.size(F.split(F.coalesce("t", F.lit("")), r"[\x20\x09-\x0D]+"))
    most = TRAIN_WORDS

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for b in batches:
            fits = []
            for n in b.column(2).to_pylist():
                fits.append(n <= left)
                left -= n if fits[-1] else 0
            yield b.select([id_col, "t"]).filter(pa.array(fits, pa.bool_()))

    ordered = texts.withColumn("n", size).repartition(1).sortWithinPartitions(F.xxhash64(id_col), id_col, "t")  # TRAIN_DOCS rows, or a few more
    kind = trusted.schema[id_col].dataType.simpleString()
    sample = materialise(ordered.mapInArrow(fitting, f"`{id_col}` {kind}, t string"), "quality-texts")
    if sample.isEmpty() and not texts.isEmpty():
        raise ValueError(f"each sampled trusted text has more than {most} words: there is nothing to train on")
    return sample


def _once(rows: DataFrame) -> DataFrame:
    """rows(id, t), of rows equal in both one; only repeated rows are shuffled with their texts."""
    rows = rows.withColumn("h", text_hash(F.col("t")))
    again = materialise(rows.groupBy("id", "h").agg(F.count("*").alias("n")).filter("n > 1").select("id", "h"), "quality-repeated")
    if again.isEmpty():
        return rows.select("t")
    again = of_checked_size(again)
    first = rows.join(again, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.any_value("t").alias("t"))
    return rows.join(again, ["id", "h"], "left_anti").select("t").unionAll(first.select("t"))


def train(texts: DataFrame, text_col: str = "t") -> Model:
    """Counts and joins the n-grams of all texts."""

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Hashes()
        for b in pieces(batches, give_back=True):
            ids = [np.array([START, START, *map(number.__getitem__, words_of(x.as_py()))], np.int64) for x in b.column(0)]
            u, v, w = (np.concatenate([np.empty(0, np.int64), *(x[k : len(x) - 2 + k] for x in ids)]) for k in range(3))
            for at in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (u, v, w)], ["u", "v", "w"])

    three = texts.select(F.col(text_col).cast("binary")).mapInArrow(trigrams, "u long, v long, w long")
    three = materialise(three.groupBy("u", "v", "w").agg(F.count("*").alias("c")), "quality-trigrams")
    two = materialise(three.groupBy("v", "w").agg(F.count("*").alias("c")), "quality-bigrams")
    one = materialise(two.groupBy("w").agg(F.count("*").alias("c")), "quality-words")
    d1, d2, d3 = _discounts(one), _discounts(two), _discounts(three)
    total, words, n1, n2, n3 = one.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *(F.count_if(x) for x in (F.col("c") == 1, F.col("c") == 2, F.col("c") > 2))).first()
    spare = (d1[0] * n1 + d1[1] * n2 + d1[2] * n3) / total / (words + 1) if total else 1.0
    m2 = materialise(_masses(two, ["v"], d2), "quality-masses-2")
    m3 = materialise(_masses(three, ["u", "v"], d3), "quality-masses-3")
    p1 = one.select("w", (_less(d1) / F.lit(max(total, 1)) + F.lit(spare)).alias("p1"), F.col("c").alias("c1"))
    lower = F.col("mass") * F.col("p1")
    p2 = two.join(p1.drop("c1"), "w").join(m2, "v").select("v", "w", "c", (_less(d2) / F.col("total") + lower).alias("p2"), lower.alias("low"))
    p2 = materialise(p2, "quality-pairs")
    lower = F.col("mass") * F.col("p2")
    p3 = three.join(p2.select("v", "w", "p2"), ["v", "w"]).join(m3, ["u", "v"]).select(_key("u", "v", "w").alias("key"), F.log10((_less(d3) / F.col("total") + lower) / lower).alias("own"), F.lit(0.0).alias("ahead"), "c")
    zero = F.lit(0.0)
    ahead = F.coalesce(F.log10("mass"), zero).alias("ahead")
    singles = p1.join(m2.select(F.col("v").alias("w"), "mass", "total"), "w", "full")
    singles = singles.select(F.col("w").alias("key"), F.coalesce(F.log10(F.col("p1") / F.lit(spare)), zero).alias("own"), ahead, F.greatest(F.coalesce("c1", F.lit(0)), F.coalesce("total", F.lit(0))).alias("c"))
    pairs = p2.join(m3.select(F.col("u").alias("v"), F.col("v").alias("w"), "mass", "total"), ["v", "w"], "full")
    pairs = pairs.select(_key("v", "w").alias("key"), F.coalesce(F.log10(F.col("p2") / F.col("low")), zero).alias("own"), ahead, F.greatest(F.coalesce("c", F.lit(0)), F.coalesce("total", F.lit(0))).alias("c"))
    table = materialise(singles.unionAll(pairs).unionAll(p3), "quality-table")
    head = table.orderBy(F.desc("c"), "key").limit(HEAD).select("key", "own", "ahead").toArrow().sort_by("key")
    return Model(table.select("key", "own", "ahead"), tuple(head.column(c).to_numpy() for c in ("key", "own", "ahead")), float(np.log10(spare)), words)


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """One row per row of docs: id, the columns to keep, n_words, perplexity (null without words)."""
    shared, spare = docs.sparkSession.sparkContext.broadcast(model.head), model.spare
    kept = [id_col, *keep]
    kinds = [docs.schema[c].dataType for c in kept]

    def found(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Batches, and of each text: number of words, sum of the head's values, keys that are not in the head, and whether a word follows."""
        known, own, ahead = shared.value
        number = _Hashes()
        for b in pieces(batches, 64, give_back=True):
            ids = [np.array(list(map(number.__getitem__, words_of(x.as_py()))), np.int64) for x in b.column(at)]
            both = [keys_of(x) for x in ids]
            keys, follows = (np.concatenate(x) for x in zip(*both, strict=True)) if both else (np.empty(0, np.int64), np.empty(0, bool))
            text = np.repeat(np.arange(len(ids)), [len(x) for x, _ in both])
            place = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            total = np.bincount(text[hit], own[place[hit]] + ahead[place[hit]] * follows[hit], len(ids))
            yield b, [np.array([len(x) for x in ids], np.int64), total, text[~hit], keys[~hit], follows[~hit]]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (n, total, *_) in found(batches, len(kept) + 1):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept) + 1], pa.array(n), pa.array(total + n * spare)], [*kept, "_h", "n_words", "_lp"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (_, _, text, keys, follows) in found(batches, 1):
            h = b.column(0).to_numpy()[text]
            for at in range(0, len(h), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (h, keys, follows)], ["_h", "key", "follows"])

    schema = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(kept, kinds, strict=True))
    hashed, text = text_hash(F.col(text_col)).alias("_h"), F.col(text_col).cast("binary").alias("_t")
    rows = materialise(docs.select(*kept, hashed, text).mapInArrow(heads, f"{schema}, _h long, n_words long, _lp double"), "quality-heads")
    asked = docs.select(hashed, text).mapInArrow(tails, "_h long, key long, follows boolean")
    met = asked.join(model.table, "key").groupBy("_h").agg(F.sum(F.col("own") + F.when(F.col("follows"), F.col("ahead")).otherwise(0.0)).alias("_tail"))
    times = rows.groupBy("_h").agg(F.count("*").alias("_w"))  # rows of equal texts have met the table as often
    tail = materialise(times.join(met, "_h").select("_h", "_w", (F.col("_tail") / F.col("_w")).alias("_tail")), "quality-tails")
    both = look_up(rows, tail, ["_h"], "_w", rows.count(), F.xxhash64("n_words", "_lp", *kept))
    mean = (F.col("_lp") + F.coalesce("_tail", F.lit(0.0))) / F.col("n_words")
    perplexity = F.when(F.col("n_words") > 0, F.pow(F.lit(10.0), F.least(F.lit(300.0), -mean)))
    return both.select(*kept, "n_words", perplexity.alias("perplexity"))


def _limits(judged: DataFrame, by: list[str], quantile: float, name: str) -> DataFrame:
    """own: the exact quantile of a group's perplexities; n: its rows."""
    n = judged.groupBy(*by).agg(F.count("*").alias("n"))
    ranked = placed(judged.select(*by, "perplexity"), by, [F.col("perplexity").asc()], name)
    ranked = ranked.join(of_checked_size(materialise(n, name + "-sizes")), by) if by else ranked.withColumn("n", F.lit(judged.count()))
    return ranked.filter(F.col("_place") == F.greatest(F.ceil(F.lit(quantile) * F.col("n")) - 1, F.lit(0))).select(*by, "n", F.col("perplexity").alias("own"))


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: id, lang, n_words, perplexity, limit, kept. trusted_ids: ids of trusted documents."""
    trusted_ids = materialise(trusted_ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct(), "quality-trusted")
    held = F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT)) == 0
    ids = of_checked_size(trusted_ids.filter(~held))
    model = train(_once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(ids.select(F.col(id_col).alias("id")), "id", "left_semi")))
    if not model.words and not ids.isEmpty():
        log.warning("no trusted document has words: all texts are equally likely")
    scored = materialise(perplexities(docs, model, id_col, text_col, (lang_col,)), "quality-scores")
    judged = scored.filter("perplexity is not null").join(trusted_ids.filter(held), id_col, "left_semi")
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("_lang")
    judged = materialise(judged.select(lang, "perplexity"), "quality-judged")
    limits = _limits(judged, ["_lang"], quantile, "quality-limits-own")
    general = next((r.own for r in _limits(judged, [], quantile, "quality-limits-all").collect()), None)  # a row
    rows = scored.groupBy(lang).agg(F.count("*").alias("w"))
    limits = materialise(limits.filter(F.col("n") >= MIN_TRUSTED).join(rows, "_lang").select("_lang", "own", "w"), "quality-limits")
    found = look_up(scored.withColumn("_lang", lang), limits, ["_lang"], "w", scored.count(), F.col("perplexity"))
    limit = F.coalesce("own", F.lit(general).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return found.select(id_col, lang_col, "n_words", "perplexity", limit.alias("limit"), kept.alias("kept"))
