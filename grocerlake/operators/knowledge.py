"""Knowledge releases: sources, validation, chunks, embeddings, registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grocerlake.functions.text import content_hash, has_injection_risk, hash_lines, missing_metadata, tokenize
from grocerlake.sources.tables import store

#: Buckets of an embedding history.
HISTORY_BUCKETS = 256
BLOCKS = "array<struct<heading_path:array<string>,text:string>>"


def collect_sources(static: DataFrame, docs: DataFrame) -> DataFrame:
    """Static documents, replaced by approved table documents of the same filename."""
    approved = docs.where("status = 'approved'").select(*static.columns)
    return static.join(approved.select("filename"), "filename", "left_anti").unionByName(approved)


def validate_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``), by the first rule that fails."""
    reason = (
        F.when(F.size(missing_metadata(F.coalesce("metadata", F.create_map().cast("map<string,string>")))) > 0, "missing_metadata")
        .when(has_injection_risk(F.coalesce("body", F.lit(""))), "prompt_injection_risk")
        .when(F.length(F.trim(F.coalesce("body", F.lit("")))) == 0, "empty_content")
    )
    judged = docs.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def split_blocks(body: str | None) -> list[dict]:
    """Paragraphs of a Markdown text with the headings above them.

    A heading of level n keeps n - 1 of those before it.
    """
    found, headings, lines = [], [], []
    for line in [*(body or "").splitlines(), ""]:
        line = line.strip()
        if line and not line.startswith("#"):
            lines.append(line)
            continue
        if lines:
            found.append({"heading_path": list(headings), "text": " ".join(lines)})
            lines = []
        if line:
            title = line.lstrip("#")
            del headings[max(0, len(line) - len(title) - 1) :]
            headings.append(title.strip())
    return found


def markdown_blocks(body: Column) -> Column:
    """Array of (heading_path, text) of each Markdown body."""

    @F.pandas_udf(BLOCKS)
    def split(bodies: pd.Series) -> pd.Series:
        return bodies.map(split_blocks)

    return split(body)


def chunk_documents(docs: DataFrame, max_tokens: int = 140, overlap: int = 24) -> DataFrame:
    """Documents (filename, title, body, ...) to chunks of at most ``max_tokens`` words.

    A block's first chunk begins with the last ``overlap`` words of the block before, each further one
    with those of the chunk before.  Starts follow from the word counts, so all chunks of a
    document are made in its own row; no window and no shuffle.
    """
    if max_tokens < 16 or not 0 <= overlap <= max_tokens // 2:
        raise ValueError("max_tokens must be at least 16 and overlap at most half of it")
    step = max_tokens - overlap
    split = docs.withColumn("_blocks", markdown_blocks(F.coalesce("body", F.lit("")))).withColumn(
        "_blocks", F.transform("_blocks", lambda b: F.struct(b["heading_path"].alias("heading_path"), F.split(b["text"], r"\s+").alias("words")))
    )

    def of_block(block: Column, i: Column) -> Column:
        words, before = block["words"], F.get(F.col("_blocks"), i - 1)["words"]
        size = F.coalesce(F.size(before), F.lit(0))
        tail = F.when((i > 0) & (F.lit(overlap) > 0), F.slice(before, F.greatest(size - overlap + 1, F.lit(1)), F.lit(max(overlap, 1)))).otherwise(F.array().cast("array<string>"))
        first = max_tokens - F.size(tail)
        more = F.greatest(F.lit(0), F.ceil((F.size(words) - first) / step)).cast("int")
        later = F.transform(
            F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: F.slice(words, first + (k - 1) * step - overlap + 1, F.lit(max_tokens))
        )
        chunks = F.concat(F.array(F.concat(tail, F.slice(words, F.lit(1), first))), F.when(more > 0, later).otherwise(F.array().cast("array<array<string>>")))
        return F.transform(chunks, lambda c: F.struct(block["heading_path"].alias("heading_path"), F.array_join(c, " ").alias("content")))

    made = split.withColumn("_chunks", F.flatten(F.transform("_blocks", of_block))).drop("_blocks")
    out = made.select("*", F.posexplode_outer("_chunks").alias("chunk_index", "_chunk")).where("_chunk is not null").drop("_chunks", "body")
    return out.select("*", "_chunk.*").drop("_chunk").withColumns({"content_hash": content_hash(F.col("content")), "token_count": F.size(tokenize(F.col("content")))})


def hash_features(tokens: pa.ListArray, dims: int) -> np.ndarray:
    """A unit vector of each list: signed log counts of tokens and of neighbouring pairs, hashed to ``dims`` places.

    For one place the signs of features that occur once are counted, then the other values are added in ascending order, so that a text's vector does not depend on its batch.
    """
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    words, word = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    inside = row[1:] == row[:-1]
    pairs, pair = np.unique((word[:-1] * len(words) + word[1:])[inside], return_inverse=True)
    names = words + [f"{words[p // len(words)]}::{words[p % len(words)]}" for p in pairs.tolist()]
    if not names:
        return np.zeros((len(n), dims))
    digests = np.frombuffer(b"".join(blake2b(x.encode(), digest_size=8).digest() for x in names), np.uint8).reshape(-1, 8)
    place = digests[:, :4].copy().view(">u4").ravel().astype(np.int64) % dims
    sign = np.where(digests[:, 4] % 2, 1.0, -1.0)
    feature = np.concatenate((row * len(names) + word, row[1:][inside] * len(names) + len(words) + pair))
    feature, count = np.unique(feature, return_counts=True)
    row, feature = np.divmod(feature, len(names))
    at, sign, more = row * dims + place[feature], sign[feature], count > 1
    out = np.bincount(at[~more], weights=sign[~more], minlength=len(n) * dims) * np.log1p(1)
    at, value = at[more], sign[more] * np.log1p(count[more])
    order = np.lexsort((value, at))
    np.add.at(out, at[order], value[order])
    out = out.reshape(-1, dims)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def model_name(dims: int = 256) -> str:
    return f"feature-hash-v3-{dims}d"


def feature_hash_embed(df: DataFrame, dims: int = 256, text: str = "content") -> DataFrame:
    """Add ``embedding`` and ``embedding_model``.  Texts without a word give the zero vector."""
    if dims < 32:
        raise ValueError("dimensions must be at least 32")

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = hash_features(batch, dims)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dims, pa.int32()), pa.array(vectors.ravel()))

    return df.withColumn("embedding", embed(tokenize(F.col(text), True, True))).withColumn("embedding_model", F.lit(model_name(dims)))


def embed_with_reuse(chunks: DataFrame, history: DataFrame, model: str, embed: Callable[[DataFrame], DataFrame] = feature_hash_embed) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, one row of counts reused and generated).

    An embedding is known by content hash and model.  Each missing content is embedded once; the
    counts are of chunks, so equal contents count each.
    """
    known = history.where(F.col("embedding_model") == model).groupBy("content_hash").agg(F.first("embedding").alias("_known"))
    looked = chunks.join(known, "content_hash", "left")
    missing = looked.where("_known is null").groupBy("content_hash").agg(F.first("content").alias("content"))
    made = embed(missing).select("content_hash", F.col("embedding").alias("_made"))
    out = looked.join(made, "content_hash", "left")
    out = out.withColumns({"embedding": F.coalesce("_known", "_made"), "embedding_model": F.lit(model), "reused": F.col("_known").isNotNull()}).drop("_known", "_made")
    return out, looked.agg(F.count_if(F.col("_known").isNotNull()).alias("reused"), F.count_if(F.col("_known").isNull()).alias("generated"))


def store_history(chunks: DataFrame, table: str, buckets: int = HISTORY_BUCKETS) -> None:
    """Keep the embeddings of past releases as a table dealt by content hash into ``buckets``.

    ``embed_with_reuse`` then joins with it where it lies: only the new chunks are shuffled, to the table's buckets.  Take at least as many buckets as
    ``spark.sql.shuffle.partitions``; with fewer, Spark deals both sides anew.
    """
    embedding_history(chunks).write.mode("overwrite").bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(table)


def append_history(chunks: DataFrame, table: str, buckets: int = HISTORY_BUCKETS) -> None:
    """Add the contents that the history lacks, after a release; what it has is not rewritten."""
    fresh = embedding_history(chunks).join(chunks.sparkSession.table(table).select("content_hash", "embedding_model"), ["content_hash", "embedding_model"], "left_anti")
    store(fresh).write.mode("append").bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(table)


def manifest_hash(docs: DataFrame, config: dict) -> DataFrame:
    """One row: hash of ``filename:sha256(body)`` lines in order and of the sorted settings.

    The lines, some 100 bytes a document, are sorted and hashed in one task, batch by batch.
    """
    settings = "\n".join(f"{k}={config[k]}" for k in sorted(config))
    line = F.concat(F.col("filename"), F.lit(":"), F.sha2("body", 256))
    return hash_lines(docs.select("filename", line.alias("line")), "filename", name="manifest_hash", tail="\n" + settings)


def build_release(chunks: DataFrame, docs: DataFrame, version: str, as_of: Column, releases: DataFrame | None = None) -> DataFrame:
    """One draft release row; a version that exists is an error."""
    if releases is not None and not releases.where(F.col("version") == version).isEmpty():
        raise ValueError(f"release {version} exists")
    c = chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.coalesce(F.round(F.avg("token_count"), 2), F.lit(0.0)).alias("average_tokens"))
    return docs.agg(F.count(F.lit(1)).alias("document_count")).crossJoin(c).select(F.lit(version).alias("version"), F.lit("draft").alias("status"), "*", as_of.alias("created_at"))


def activate_release(releases: DataFrame, release_id: str, as_of: Column) -> DataFrame:
    """The registry with a draft or retired release published, and the published one retired."""
    if releases.where((F.col("id") == release_id) & F.col("status").isin("draft", "retired")).isEmpty():
        raise ValueError("only a draft or retired release can be activated")
    chosen = F.col("id") == release_id
    return releases.withColumns(
        {"published_at": F.when(chosen, as_of).otherwise(F.col("published_at")), "status": F.when(chosen, "published").when(F.col("status") == "published", "retired").otherwise(F.col("status"))}
    )


def rollback_release(releases: DataFrame, as_of: Column) -> DataFrame:
    """The retired release published last takes the place of the published one."""
    last = releases.where("status = 'retired'").orderBy(F.desc_nulls_last("published_at"), F.desc("created_at"), "id").limit(1).collect()
    if not last:
        raise ValueError("there is no release to go back to")
    return activate_release(releases, last[0]["id"], as_of)


def pipeline_run(spark, run_id: str, pipeline: str, status: str, counts: tuple[int, int, int], started_at, finished_at) -> DataFrame:
    """One row of the run log: input, output and rejected counts."""
    if status not in ("running", "succeeded", "failed", "blocked"):
        raise ValueError(f"unknown status {status}")
    schema = "id string, pipeline string, status string, input_count long, output_count long, rejected_count long, started_at timestamp, finished_at timestamp"
    return spark.createDataFrame([(run_id, pipeline, status, *counts, started_at, finished_at)], schema)


def release_chunks(chunks: DataFrame, release_id: str) -> DataFrame:
    return chunks.where(F.col("release_id") == release_id).orderBy("source_filename", "chunk_index")


def publish_if_passed(releases: DataFrame, release_id: str, decision: DataFrame, as_of: Column) -> tuple[DataFrame, str]:
    """(registry, status of the run): published when the gate's one row says so, else left a draft and blocked."""
    passed = decision.select("passed").head()[0]
    return (activate_release(releases, release_id, as_of), "succeeded") if passed else (releases, "blocked")


def export_release(chunks: DataFrame, evaluations: DataFrame, manifest: DataFrame, version: str, out: str) -> None:
    """Chunks, evaluations and manifest as JSON lines, each below ``knowledge_release=<version>``."""
    for df, layer in ((chunks, "bronze/chunks"), (evaluations, "silver/evaluations"), (manifest, "gold/manifest")):
        df.withColumn("knowledge_release", F.lit(version)).write.mode("overwrite").partitionBy("knowledge_release").json(f"{out}/{layer}")


def embedding_history(chunks: DataFrame) -> DataFrame:
    """One embedding of each content and model, the first release's."""
    w = Window.partitionBy("content_hash", "embedding_model").orderBy("release_id", "source_filename", "chunk_index")
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("content_hash", "embedding_model", "embedding")
