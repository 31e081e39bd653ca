"""Media columns: payloads in content-defined chunks, each different chunk stored once.

A payload is cut where a rolling gear hash of its last 32 bytes has ten high bits
zero.  Chunk digests are counted by Spark; chunks seen once are stored with their
payload, the others in a chunk store of one row per digest.  A media row holds the recipe (the ordered chunk
list); joins with the store rebuild the payload, which is verified by its SHA-256.

The stored form of a payload is its recipe, the frame of its own chunks, and the frames of the shared chunks in the
order of their first use, byte for byte as they lie in the two tables.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import CHUNK, chunks
from .common import head64, materialize, table

ALIGN = 64
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 256, 8192, 10
DIGEST = 16
#: Bits of the table that tells which digests may be shared: 8 MB at any size of data.
#: A chunk wrongly held for shared only takes the longer way.
SEEN_BITS = 26
#: Digests or keys that a task remembers to have written.
TOLD = 1 << 18
_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)

#: A digest with more than this share of all chunks is dealt over several tasks when chunks are joined.
HOT_SHARE = 1e-4

MEDIA = "key binary, recipe binary, shared array<binary>, data binary"

def payload_of(text: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    data = text or b""
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


def cut(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload; equal payloads, equal cuts.

    Cuts lie at least MIN_CHUNK bytes after a chunk's begin, farther than the
    hash looks back, so they depend on the payload alone.
    """
    data = np.frombuffer(b"".join(payloads), np.uint8)
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        later = h.copy()
        later[step:] += h[:-step] << np.uint32(step)
        h = later
    marks = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, begin = [], 0
    for p in payloads:
        ends, at, end = [], begin, begin + len(p)
        while at < end:
            k = bisect_left(marks, at + MIN_CHUNK)
            stop = min(end, at + MAX_CHUNK)
            at = min(stop, marks[k]) if k < len(marks) else stop
            ends.append(at - begin)
        out.append(ends)
        begin = end
    return out


def chunked(texts: list[bytes | None]) -> Iterator[tuple[bytes | None, bytes, list[tuple[bytes, bytes]]]]:
    """(text, payload, [(digest, chunk)]) of each text."""
    payloads = [payload_of(t) for t in texts]
    for first, group in chunks(payloads):
        for i, (p, ends) in enumerate(zip(group, cut(group))):
            parts = [p[a:b] for a, b in zip([0, *ends], ends)]
            yield texts[first + i], p, [(hashlib.blake2b(c, digest_size=DIGEST).digest(), c) for c in parts]


_HEAD, _PART = struct.Struct("<4sI"), struct.Struct(f"<{DIGEST}sI?")


def recipe_of(parts: list[tuple[bytes, int, bool]]) -> bytes:
    """Magic, number of chunks; digest, length and whether it is in the store, of each."""
    return _HEAD.pack(b"GLCD", len(parts)) + b"".join(_PART.pack(*p) for p in parts)


def read_recipe(recipe: bytes) -> list[tuple[bytes, int, bool]]:
    magic, n = _HEAD.unpack_from(recipe)
    if magic != b"GLCD" or len(recipe) != _HEAD.size + n * _PART.size:
        raise ValueError("not a recipe of this format")
    return list(_PART.iter_unpack(recipe[_HEAD.size :]))


def _seen_table(counts: DataFrame) -> np.ndarray:
    """Bit table of the digests that occur more than once."""
    slot = F.shiftrightunsigned("h", 64 - SEEN_BITS)
    words = (
        counts.where("n > 1").groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - SEEN_BITS}) & 63 as int))")).alias("bits"))
    ).toArrow()
    seen = np.zeros(1 << (SEEN_BITS - 6), np.int64)
    seen[words["word"].to_numpy()] = words["bits"].to_numpy()
    return seen


def _is_seen(seen: np.ndarray, digest: bytes) -> bool:
    slot = int.from_bytes(digest[:8], "big") >> (64 - SEEN_BITS)
    return bool(int(seen[slot >> 6]) >> (slot & 63) & 1)


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [d[:8] for _, _, parts in chunked(batch.column(0).cast(pa.binary()).to_pylist()) for d, _ in parts]
        kinds, n = np.unique(np.frombuffer(b"".join(h), ">i8").astype(np.int64), return_counts=True)
        yield pa.record_batch([pa.array(kinds), pa.array(n.astype(np.int64))], names=["h", "n"])


def _batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[bytes | None]]:
    for batch in batches:
        yield batch.column(at).cast(pa.binary()).to_pylist()


@dataclass
class MediaStore:
    """Stored media.  ``docs``: doc_id, n_bytes and key (SHA-256 of its payload) of each input row.
    ``media``: a row per payload.  ``chunks``: digest and data, a row per shared chunk.
    ``hot``: the few digests of very many chunks, with the number of tasks to deal them over."""

    docs: DataFrame
    media: DataFrame
    chunks: DataFrame
    hot: DataFrame


def store_media(docs: DataFrame, text: str = "text") -> MediaStore:
    """Chunk and store the texts of ``docs`` (doc_id, text); the tables are written in the shared folder and read back.

    Null texts count as empty.  Equal texts share one payload, repeated rows each have their row in ``docs``.
    Other columns are ignored.  Texts are chunked once more for each of the tables instead of writing them twice.
    """
    counts = materialize(docs.select(text).mapInArrow(_count_chunks, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    seen = docs.sparkSession.sparkContext.broadcast(_seen_table(counts))
    least = max(1.0, (counts.agg(F.sum("n")).head()[0] or 0) * HOT_SHARE)
    hot = materialize(counts.where(F.col("n") > least).select("h", F.ceil(F.col("n") / least).cast("int").alias("salts")))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys = [hashlib.sha256(payload_of(t)).digest() for t in texts]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_bytes", "key"])

    def shared_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, told = zstandard.ZstdCompressor(level=3), set()
        for texts in _batches(batches, 0):
            found = {d: c for _, _, parts in chunked(texts) for d, c in parts if d not in told and _is_seen(seen.value, d)}
            if len(told) < TOLD:
                told.update(found)
            yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([zstd.compress(c) for c in found.values()], pa.binary())], names=["digest", "data"])

    def media_rows(batches: Iterator[pa.RecordBatch], copies: bool) -> Iterator[pa.RecordBatch]:
        zstd, told = zstandard.ZstdCompressor(level=3), set()
        for texts in _batches(batches, 0):
            rows = []
            for _, payload, parts in chunked(texts):
                key = hashlib.sha256(payload).digest()
                if key in told:
                    continue
                listed = [(d, len(c), _is_seen(seen.value, d)) for d, c in parts]
                own = b"".join(c for (_, c), (_, _, shared) in zip(parts, listed) if not shared)
                if copies == bool(own):
                    continue
                if copies and len(told) < TOLD:
                    told.add(key)
                rows.append((key, recipe_of(listed), list(dict.fromkeys(d for d, _, shared in listed if shared)), zstd.compress(own) if own else None))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary()))], names=["key", "recipe", "shared", "data"])

    named = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(name, "doc_id long, n_bytes long, key binary"))
    texts = docs.select(text)
    store = materialize(texts.mapInArrow(shared_chunks, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data")))
    # a payload with a chunk of its own occurs once; those of shared chunks alone may come again, in any task
    once = materialize(texts.mapInArrow(partial(media_rows, copies=False), MEDIA))
    again = texts.mapInArrow(partial(media_rows, copies=True), MEDIA).groupBy("key").agg(*(F.first(c).alias(c) for c in ("recipe", "shared", "data")))
    return MediaStore(named, once.unionByName(materialize(again)), store, hot)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            frames = {c["digest"]: c["data"] for c in r["chunks"] or []}
            store = {d: unzip.decompress(f) for d, f in frames.items()}
            own, at, parts, plan = (unzip.decompress(r["data"]) if r["data"] else b""), 0, [], read_recipe(r["recipe"])
            for digest, n, is_shared in plan:
                if is_shared:
                    parts.append(store[digest])
                else:
                    parts.append(own[at : at + n])
                    at += n
            payload = b"".join(parts)
            if hashlib.sha256(payload).digest() != r["key"]:
                raise ValueError(f"stored chunks do not give back payload {r['key'].hex()}")
            stored = [r["recipe"], r["data"] or b"", *(frames[d] for d in r["shared"] or [])]
            media = hashlib.sha256()
            for part in stored:
                media.update(part)
            share = np.bincount(np.frombuffer(payload, np.uint8)) / len(payload)
            entropy = -float(np.sum(share[share > 0] * np.log2(share[share > 0])))
            feature = f"chunks={len(parts)};distinct={len({d for d, _, _ in plan})};mean={math.fsum(i * s for i, s in enumerate(share.tolist())):.3f};entropy={abs(entropy):.4f}"
            rows.append((r["key"], len(payload), r["key"].hex(), zlib.crc32(payload[-ALIGN:]), sum(map(len, stored)), media.hexdigest(), feature))
        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def read_media(stored: MediaStore) -> DataFrame:
    """doc_id, n_bytes, key, and size, hashes and features computed from the stored bytes, of each document.

    A chunk of very many payloads is dealt over as many tasks as its share of all chunks asks for; a
    task holds the chunks of one payload at a time.
    """
    none = F.lit(None).cast("array<struct<digest:binary,data:binary>>")
    whole = stored.media.where("size(shared) = 0").withColumn("chunks", none)
    mixed = stored.media.where("size(shared) > 0")
    hot = F.broadcast(stored.hot)  # at most 1 / HOT_SHARE rows
    refs = mixed.select("key", F.explode("shared").alias("digest")).withColumn("h", head64(F.col("digest"))).join(hot, "h", "left")
    refs = refs.select("key", "digest", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    dealt = stored.chunks.withColumn("h", head64(F.col("digest"))).join(hot, "h", "left")
    dealt = dealt.select("digest", "data", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    got = refs.join(dealt, ["digest", "salt"]).groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("chunks"))
    features = whole.unionByName(mixed.join(got, "key")).mapInArrow(
        _rebuild, "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return stored.docs.join(features, "key").select("doc_id", "n_bytes", *features.columns)


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_media(table(spark, sf_dir, "documents"))).drop("key")
