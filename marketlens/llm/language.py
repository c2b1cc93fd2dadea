"""Language identification by compression: the language whose dictionary makes a text smallest is the text's.

Each language's dictionary is raw zstandard content: whole labelled texts, each once however many rows have it, in the order of
a hash, until DICTIONARY_BYTES of them are taken; a text that doesn't fit in what is left is passed over. It is a bounded sample:
DOCS_PER_LANGUAGE texts of a language at most, none longer than a dictionary unless the language has no other, in which
case its shortest is taken whole. Dictionaries are made by the tasks that hold a language's sample. Texts are lower-cased, reduced to
letters, cut into pieces of CHUNK bytes and compressed whole, piece by piece, with every dictionary; the sizes are summed. The
score is the margin, one minus the smallest size over the second smallest. Equal sizes go to the language with more
training documents. Texts that are null or have no letters are `und` with score 0; so is everything if no label was learned
from. Rows are judged one by one, so null, repeated and clashing rows and columns don't matter. Every label is learned;
more than MAX_LANGUAGES labels, whose dictionaries a task could not hold, are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import kept_rows, materialise, pieces, small_table

#: The sample's bound: rows of a language, and bytes of its dictionary; and how many languages tasks can hold.
DOCS_PER_LANGUAGE, DICTIONARY_BYTES, MAX_LANGUAGES = 800, 256 << 10, 1024
CHUNK, LEVEL = 4096, 3
#: Below this margin a prediction counts as rejected.
MIN_MARGIN = 0.01
LETTER = re.compile(r"[^\W\d_]")
_ONLY_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower case, ASCII letters and all of the other characters beyond ASCII; the rest is one space."""
    return b" ".join(text.lower().encode(errors="replace").translate(_ONLY_LETTERS).split())


@dataclass
class Model:
    """Dictionaries by language, the most frequent language first."""

    dictionaries: dict[str, bytes]


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of docs for which `where` holds and id, text and label are not null."""
    known = docs.filter(where & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    key, size = F.xxhash64(text_col), F.octet_length(text_col)
    known = known.select(F.col(lang_col).alias("lang"), key.alias("key"), (size > DICTIONARY_BYTES).alias("long"), size.alias("size"), F.col(text_col).alias("text"))
    texts = F.approx_count_distinct(F.when(~F.col("long"), F.col("key")))
    by_size = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("long").alias("long"), texts.alias("texts")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(by_size) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not by_size:
        return Model({})
    # of a large language only texts with hashes low enough to be chosen, four times as many as are, are sorted at all
    shares = [(r.lang, r.long, 1.0 if r.long else min(1.0, 4 * DOCS_PER_LANGUAGE / max(1, r.texts))) for r in by_size]
    bounds = F.broadcast(small_table(docs.sparkSession, shares, "lang string, only_long boolean, share double"))
    place = (F.col("key") / F.lit(2.0**64)) + 0.5
    near = known.join(bounds, "lang").filter((F.col("long") == F.col("only_long")) & (place <= F.col("share")))
    near = near.groupBy("lang", "only_long", "key", "size").agg(F.any_value("text").alias("text"))  # copies are one text
    order = Window.partitionBy("lang").orderBy(F.when(F.col("only_long"), F.col("size")), "key")
    most = F.when(F.col("only_long"), 1).otherwise(DOCS_PER_LANGUAGE)
    ranked = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= DOCS_PER_LANGUAGE).filter(F.col("place") <= most)

    def fill(rows: pa.Table) -> pa.Table:
        content, left = [], DICTIONARY_BYTES
        for text in rows.sort_by("place").column("text"):
            data = normalise(text.as_py())
            if len(data) < left or not content:
                content.append(data)
                left -= len(data) + 1
        return pa.table({"lang": rows.column("lang").slice(0, 1), "content": pa.array([b"\n".join(content)], pa.binary())})

    made = ranked.select("lang", "place", "text").groupBy("lang").applyInArrow(fill, "lang string, content binary")
    found = {r.lang: bytes(r.content) for r in materialise(made, "language-dictionaries").collect()}  # MAX_LANGUAGES at most
    return Model({r.lang: found[r.lang] for r in by_size if r.lang in found})


class _Judge:
    """Holds the dictionaries ready for use."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.coders = list(dictionaries), []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))

    def sizes(self, text: str) -> list[int]:
        """Of the compressed text, by language."""
        data = normalise(text)
        parts = [data[at : at + CHUNK] for at in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.coders]

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        best = sorted((size, k) for k, size in enumerate(self.sizes(text)))
        return self.langs[best[0][1]], 1 - best[0][0] / best[1][0] if len(best) > 1 else 1.0


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, rejected (no letters, or a margin under min_margin)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for b in pieces(batches):
            found = [judge(x.as_py()) for x in b.column(1)]
            lang, score = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            rejected = pa.array([f[0] == "und" or f[1] < min_margin for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), lang, score, rejected], [id_col, "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs without the rows that classify() rejects, decided row by row where they lie."""
    shared, judges = docs.sparkSession.sparkContext.broadcast(model.dictionaries), []

    def keep(b: pa.RecordBatch) -> list[bool]:
        if not judges:
            judges.append(_Judge(shared.value))
        found = [judges[0](x.as_py()) for x in b.column(0)]
        return [lang != "und" and score >= min_margin for lang, score in found]

    return kept_rows(docs, [text_col], keep)
