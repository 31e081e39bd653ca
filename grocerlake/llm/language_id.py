"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample of
its texts.  A text is encoded with every dictionary; the language that needs the fewest
bytes wins, and a win by too small a margin is rejected.

Whole bytes are too coarse a measure for few of them.  A text is encoded behind a primer, some of the
language's own text, which also fills the encoder's tables; and as often, with other primers, as
gives RESOLUTION bytes of it in all (once, then, for most texts).  The sizes are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, table

#: Bound of the sample: rows of a language, one of each hash slot, and bytes of their whole texts.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 1 << 16
#: Bytes encoded at a time, zstandard's level, bytes of a primer, number of primers.
BLOCK, LEVEL, PRIMER, PRIMERS = 16384, 6, 512, 16
#: Bytes of a text to be encoded in all, if the primers suffice.
RESOLUTION = 512
#: Least share of bytes that the best language must save against the second.
MIN_MARGIN = 0.002

RESULT = "lang_pred string, score double, rejected boolean"


def fit_dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """``docs`` (doc_id, text, lang) to a dictionary for each non-null lang.

    The sample is whole texts: of each of ``sample_docs`` hash slots of a language the row with the smallest hash, and of these, by their
    hashes, as many as ``sample_bytes`` hold together; equal texts count once.  That bounds what reaches the driver.  Rows are
    chosen by hashes and sizes; only the texts of the chosen ones move.
    Empty and null texts, and those longer than ``sample_bytes``, are never sampled; of rows of one id the text with the smallest hash counts.
    No labelled rows: no dictionaries.
    """
    size = F.octet_length("text").cast("long")
    labelled = docs.where(F.col("lang").isNotNull() & size.between(1, sample_bytes))
    named = F.struct(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), size.alias("size"))
    slots = labelled.select("lang", named.alias("row")).groupBy("lang", F.pmod("row.h", F.lit(sample_docs)).alias("slot")).agg(F.min("row").alias("row"))
    once = slots.groupBy("lang", "row.t").agg(F.min("row").alias("row")).select("lang", "row.*")
    order = Window.partitionBy("lang").orderBy("h", "t")  # at most sample_docs rows a language
    chosen = once.withColumn("held", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("held") <= sample_bytes).select("lang", "h", "t")
    texts = labelled.select("lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text").join(F.broadcast(chosen), ["lang", "h", "t"])
    rows = texts.groupBy("lang", "h", "t").agg(F.min("text").alias("text")).collect()
    pieces: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, r.t)):
        pieces.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(p).lower().encode() for lang, p in sorted(pieces.items())}


class _Encoder:
    """Sizes behind the primers, which are the dictionary's first bytes (half of a small one) and left out of it."""

    def __init__(self, content: bytes):
        primer = min(PRIMER, len(content) // (2 * PRIMERS))
        shared = zstandard.ZstdCompressionDict(content[primer * PRIMERS :], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
        self._primers = [content[k * primer : (k + 1) * primer] for k in range(PRIMERS)]
        self._own = [len(self._zstd.compress(p)) for p in self._primers]

    def size(self, data: bytes) -> float:
        k = min(PRIMERS, -(-RESOLUTION // len(data)))
        pieces = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return sum(len(self._zstd.compress(p + piece)) - n for p, n in zip(self._primers[:k], self._own) for piece in pieces) / k


def _encoders(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, _Encoder]]:
    """An encoder of each language; kept by the worker."""
    return held(("languages", dictionaries), lambda: [(lang, _Encoder(content)) for lang, content in dictionaries])


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float = MIN_MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected) of one text; ties go to the smaller name.

    The score is the share of bytes saved against the second language (1.0
    when there is just one).  A null text, or one without a letter, is ``und`` with score 0, and rejected.
    """
    if text is None or not dictionaries or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = text.lower().encode()
    sizes = sorted((e.size(data), lang) for lang, e in _encoders(dictionaries))
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    best, second = max(sizes[0][0], 0.0), max(sizes[1][0], 1.0)
    score = min(1.0, max(0.0, 1 - best / second))
    return sizes[0][1], score, score < min_margin


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add lang_pred, score and rejected to each row, from ``text`` alone.

    See ``classify`` for null, empty and undecided texts.  Input columns with
    these names are replaced, all others stay.  The dictionaries' size is bounded by the sample.
    """
    model = tuple(sorted(dictionaries.items()))

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([classify(t, model, min_margin) for t in texts], columns=["lang_pred", "score", "rejected"])

    kept = docs.drop("lang_pred", "score", "rejected").columns
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    return docs.select(row, predict(F.col(text)).alias("predicted")).select("row.*", "predicted.*")


def held_out(doc_id: Column) -> Column:
    """Whether the id's CRC-32 leaves remainder 2 by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), dictionaries).drop("text")
