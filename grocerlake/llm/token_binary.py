"""Token ids in a binary file format, compressed by a Re-Pair grammar.

Documents in ascending id order are cut into shards of about ``SHARD_TOKENS`` ids.
In each shard frequent pairs of ids are replaced by nonterminals, again and again, until no pair
occurs ``MIN_USES`` times.  A shard stores its rules, how many ids each expands to, and where each
document begins, so that one document, or some ids of it, can be decoded alone.

Layout of a shard, little endian: ``GLRP``, version, vocabulary size, number of
rules, of symbols and of documents, bytes of a symbol (seven unsigned 32-bit
numbers, the magic included); rules as pairs of symbols; expansion lengths, unsigned 32 bit;
document begins in symbols, unsigned 64 bit, one more than documents; symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import CHUNK, LOWER, SPACE, chunks, runs, span_hashes
from .common import held, materialize, table, tidy

END = 1
SHARD_TOKENS = 1 << 19
#: Pair replacement: least uses of a rule, and how many pairs are replaced at a time.
MIN_USES, ROUND_RULES = 16, 2500
#: Words whose ids a worker remembers; some 60 bytes each.
CACHE_WORDS = 1 << 20
#: Bytes of text in a range of ids that one task encodes, on average.
RANGE_BYTES = 64 << 20

SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids array<bigint>, block binary"

# -- ids ---------------------------------------------------------------------

#: Bytes between which a text may be cut without changing its ids: an ASCII letter
#: beside ASCII punctuation.  The apostrophe (contractions) and the signs
#: of special tokens, bytes of other alphabets, digits and control bytes stay with their neighbours.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True


class WordEncoder:
    """Whole texts to ids by a tokenizer that lower-cases and never joins what white space parts.

    A text is cut at white space and between letters and punctuation; each different
    piece goes through the tokenizer once, and its ids are kept by the piece's hash in a table of fixed size.
    A tokenizer that does otherwise is refused.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self._tokenizer, self._limit = Tokenizer.from_file(path), cache_words
        one = lambda t: self._tokenizer.encode(t, add_special_tokens=False).ids
        if one("Ab \t c, D") != one("ab") + one("c") + one(",") + one("d"):
            raise ValueError(f"{path} keeps case or white space")
        special = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special}
        self._parter = max(special.items(), key=lambda x: x[1])
        vocabulary = self._tokenizer.get_vocab()
        # the id that ends a word of letters, if the tokenizer marks it
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._bits = max(4, (2 * cache_words - 1).bit_length())
        self._clear()

    def _clear(self):
        self._keys, self._entry, self._known = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int32), 0
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._from, self._n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 for those that are not known."""
        slot = (keys >> np.uint64(64 - self._bits)).astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            there = self._keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self._entry[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
        return out

    def _insert(self, keys: np.ndarray, entries: np.ndarray):
        """Add different keys that are not in the table."""
        slot, open_ = (keys >> np.uint64(64 - self._bits)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = open_[self._keys[slot[open_]] == 0]
            self._keys[slot[free]] = keys[free]  # of several for one slot the last stays
            here = self._keys[slot[free]] == keys[free]
            self._entry[slot[free[here]]] = entries[free[here]]
            open_ = np.setdiff1d(open_, free[here], assume_unique=True)
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)

    def _of_letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces of ASCII letters, encoded as one text of words; None if their ends do not show in it."""
        n = ends - starts
        begin = np.cumsum(n + 1) - (n + 1)
        text = np.full(int(begin[-1] + n[-1]), ord(" "), np.uint8)
        inside = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text[inside] = data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        flat = np.array(self._tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self._last[flat])
        return (flat, np.diff(last, prepend=-1).astype(np.int32)) if len(last) == len(n) and last[-1] == len(flat) - 1 else None

    def _of_any(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in one call, parted by a special token, whose id marks the pieces' ends."""
        whole = self._parter[0].join(pieces) + self._parter[0]
        flat = np.array(self._tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(flat == self._parter[1])
        if len(marks) == len(pieces):
            return np.delete(flat, marks), (np.diff(marks, prepend=-1) - 1).astype(np.int32)
        # a piece holds that token's text
        got = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        other = np.cumsum(~_LETTER[data])
        plain = other[ends - 1] - np.where(starts > 0, other[starts - 1], 0) == 0
        raw = data.tobytes()
        for group in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            if not len(group):
                continue
            got = self._of_letters(data, starts[group], ends[group]) if plain[group[0]] else None
            flat, n = got or self._of_any([raw[a:b].decode() for a, b in zip(starts[group].tolist(), ends[group].tolist())])
            first, total = self._known, self._used + len(flat)
            while len(self._ids) < total:
                self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
            while len(self._from) < first + len(n):
                self._from, self._n = np.concatenate((self._from, np.zeros_like(self._from))), np.concatenate((self._n, np.zeros_like(self._n)))
            self._ids[self._used : total] = flat
            self._n[first : first + len(n)] = n
            self._from[first : first + len(n)] = self._used + np.cumsum(n) - n
            self._used, self._known = total, first + len(n)
            self._insert(keys[group], np.arange(first, first + len(n)))

    def _encode(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the joined texts, and how many of them each text has."""
        inside = ~SPACE[data]
        starts, ends = runs(inside)
        letter, punct = _LETTER[data], _PUNCT[data]
        cut = np.flatnonzero((letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])) + 1
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(begins), np.int64)
        # special tokens are matched before letters become lower case: pieces that may hold one keep theirs
        raw, data = data, LOWER[data]
        opened = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        for k in np.unique(np.searchsorted(starts, opened, "right") - 1):
            data[starts[k] : ends[k]] = raw[starts[k] : ends[k]]
        keys = np.maximum(span_hashes(data, starts, ends), np.uint64(1))  # 0 is an empty slot
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, at = np.unique(keys[missing], return_index=True)
            if self._known + len(fresh) > self._limit:
                self._clear()
                missing = np.arange(len(keys))
                fresh, at = np.unique(keys, return_index=True)
                while len(fresh) > self._limit:  # more words than the table takes in one piece of text
                    self._limit, self._bits = 2 * self._limit, self._bits + 1
                    self._clear()
            at = missing[at]
            self._learn(fresh, data, starts[at], ends[at])
            entry[missing] = self._find(keys[missing])
        n = self._n[entry].astype(np.int64)
        upto = np.cumsum(n)
        ids = self._ids[np.repeat(self._from[entry] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        bounds = np.concatenate(([0], upto))[np.searchsorted(starts, np.append(begins, len(data)))]
        return ids, np.diff(bounds)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        all_ids, counts = [], np.zeros(len(texts), np.int64)
        # longer texts are cut at white space; each piece remembers its text
        pieces, owner = [], []
        for i, t in enumerate(texts):
            for piece in _pieces(t):
                pieces.append(piece)
                owner.append(i)
        for first, group in chunks(pieces):
            data = np.frombuffer(b"\n".join(group), np.uint8)
            begins = np.cumsum([0, *(len(g) + 1 for g in group[:-1])])
            ids, n = self._encode(data, begins)
            all_ids.append(ids)
            np.add.at(counts, owner[first : first + len(group)], n)
        return (np.concatenate(all_ids) if all_ids else np.zeros(0, np.uint32)), counts


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, or its parts of about CHUNK bytes cut at white space."""
    while len(text) > CHUNK:
        at = max(text.rfind(b" ", 0, CHUNK), text.rfind(b"\n", 0, CHUNK))
        if at <= 0:
            at = min((p for p in (text.find(b" ", CHUNK), text.find(b"\n", CHUNK)) if p > 0), default=len(text))
        yield text[:at]
        text = text[at:]
    yield text


def _encoder(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))


# -- grammar -----------------------------------------------------------------


def _spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, ascending, and how often each occurs."""
    code = np.sort(code)
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], np.diff(np.append(first, len(code)))


def _settle(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the occurrences ``at`` (ascending) are replaced: of two that overlap
    the one of the better rank, or the left one, until none is open.

    A run of overlapping ones of equal rank, as of one symbol repeated, is settled at once: every second one from its left end.
    """
    won, open_ = np.zeros(len(at), bool), np.arange(len(at))
    while len(open_):
        p, r = at[open_], rank[open_]
        touch = np.diff(p) == 1
        left_better = r[:-1] <= r[1:]
        by_right = np.append(touch & ~left_better, False)
        run = np.append(True, ~(touch & (r[:-1] == r[1:])))  # where a run of equal ones begins
        begin = np.flatnonzero(run)
        of = np.cumsum(run) - 1
        lost = by_right | np.append(False, touch & left_better)
        wins = ~lost[begin][of] & ((np.arange(len(p)) - begin[of]) % 2 == 0) & ~by_right
        won[open_[wins]] = True
        # a neighbour of a replaced one is gone
        gone = wins.copy()
        gone[1:] |= touch & wins[:-1]
        gone[:-1] |= touch & wins[1:]
        open_ = open_[~gone]
    return won


def compress(ids: np.ndarray, vocabulary: int, min_uses: int = MIN_USES, round_rules: int = ROUND_RULES):
    """(symbols, rules): pairs of symbols replaced by nonterminals until no pair occurs ``min_uses`` times.

    A round counts pairs and makes a rule of each of the most frequent; where two occurrences overlap, the more
    frequent pair is replaced.  A pair that once is too rare stays so, as only pairs with a new nonterminal gain
    occurrences; such places are not looked at again.  ``END`` is part of no rule, so documents begin at symbols.
    """
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.uint32)
    free = seq != END
    live = np.flatnonzero(free[:-1] & free[1:])
    # slots of hashes bound the counts from above
    slot = (seq[live] * np.uint32(0x9E3779B1) ^ seq[live + 1] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(12)
    live = live[np.bincount(slot, minlength=1 << 20)[slot] >= min_uses]
    while len(live):
        left, right = seq[live], seq[live + 1]
        code = left.astype(np.uint64) << np.uint64(32) | right
        # of a run of one symbol every second pair counts
        twin = np.flatnonzero(left == right)
        if len(twin):
            first = np.concatenate(([True], (np.diff(live[twin]) > 1)))
            place = np.arange(len(twin)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            pairs, n = _spans(np.delete(code, twin[place % 2 == 1]))
        else:
            pairs, n = _spans(code)
        pairs, n = pairs[n >= min_uses], n[n >= min_uses]
        if not len(pairs):
            break
        own = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        often = pairs[own] == code
        live, own = live[often], own[often]
        best = np.argsort(-n, kind="stable")[:round_rules]
        rank = np.full(len(pairs), len(pairs))
        rank[best] = np.arange(len(best))
        chosen = rank[own] < len(pairs)
        at, of = live[chosen], rank[own[chosen]]
        won = _settle(at, of)
        at, of = at[won], of[won]
        # the most frequent pair keeps all its uses; others may have lost too many
        uses = np.bincount(of, minlength=len(best))
        made = np.flatnonzero(uses >= min_uses)
        number = np.full(len(best), -1)
        number[made] = np.arange(len(made))
        at, of = at[number[of] >= 0], number[of[number[of] >= 0]]
        symbols = pairs[best[made]]
        seq[at] = (vocabulary + len(rules) + of).astype(np.uint32)
        rules = np.concatenate((rules, np.column_stack((symbols >> np.uint64(32), symbols & np.uint64(0xFFFFFFFF))).astype(np.uint32)))
        keep, look = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        keep[at + 1] = False
        look[live] = True
        look[at] = True
        seq, look = seq[keep], look[keep]
        new = np.flatnonzero(seq >= vocabulary + len(rules) - len(made))
        look[np.maximum(new - 1, 0)] = True
        free = seq != END
        live = np.flatnonzero(look[:-1] & free[:-1] & free[1:])
    return seq, rules


def expansions(rules: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rules in a row, where each rule's begin, and how many there are."""
    flat: list[list[int]] = []
    for a, b in rules.tolist():
        flat.append((flat[a - vocabulary] if a >= vocabulary else [a]) + (flat[b - vocabulary] if b >= vocabulary else [b]))
    n = np.array([len(x) for x in flat], np.int64)
    return np.array([i for x in flat for i in x], np.uint32), np.cumsum(n) - n, n


def pack(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """A shard of documents with ``counts`` ids each, the last of each being ``END``."""
    seq, rules = compress(ids, vocabulary)
    kind = np.dtype("<u2") if vocabulary + len(rules) <= 1 << 16 else np.dtype("<u4")
    _, _, n = expansions(rules, vocabulary)
    lengths = np.where(seq >= vocabulary, n[np.maximum(seq.astype(np.int64) - vocabulary, 0)] if len(n) else 1, 1)
    begins = np.searchsorted(np.cumsum(lengths) - lengths, np.concatenate(([0], np.cumsum(counts))))
    head = struct.pack("<4s6I", b"GLRP", 1, vocabulary, len(rules), len(seq), len(counts), kind.itemsize)
    return head + rules.astype(kind).tobytes() + n.astype("<u4").tobytes() + begins.astype("<u8").tobytes() + seq.astype(kind).tobytes()


class Shard:
    """A packed shard, decoded document by document."""

    def __init__(self, block: bytes):
        magic, version, self.vocabulary, n_rules, n_symbols, self.n_docs, width = struct.unpack_from("<4s6I", block)
        if magic != b"GLRP" or version != 1:
            raise ValueError("not a shard of this format")
        kind, at = np.dtype(f"<u{width}"), struct.calcsize("<4s6I")
        rules = np.frombuffer(block, kind, 2 * n_rules, at).reshape(-1, 2)
        at += 2 * n_rules * width
        self.lengths = np.frombuffer(block, "<u4", n_rules, at)
        at += 4 * n_rules
        self.begins = np.frombuffer(block, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.symbols = np.frombuffer(block, kind, n_symbols, at)
        self._flat, self._from, self._n = expansions(rules, self.vocabulary)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self._n) or not len(symbols):
            return symbols.astype(np.uint32)
        rule = symbols.astype(np.int64) - self.vocabulary
        is_rule = rule >= 0
        rule[~is_rule] = 0
        n = np.where(is_rule, self._n[rule], 1)
        upto = np.cumsum(n)
        begin = upto - n
        source = np.concatenate((self._flat, symbols.astype(np.uint32)))
        at = np.where(is_rule, self._from[rule], len(self._flat) + np.arange(len(symbols)))
        return source[np.repeat(at - begin, n) + np.arange(upto[-1])]

    def document(self, i: int) -> np.ndarray:
        """Ids of document i alone."""
        return self._expand(self.symbols[self.begins[i] : self.begins[i + 1]])

    def ids(self, i: int, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (not included) of document i; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.begins[i] : self.begins[i + 1]]
        rule = np.maximum(symbols.astype(np.int64) - self.vocabulary, 0)
        n = np.where(symbols >= self.vocabulary, self.lengths[rule] if len(self.lengths) else 1, 1).astype(np.int64)
        upto = np.cumsum(n)
        first, last = max(first, 0), min(last, int(upto[-1]) if len(upto) else 0)
        if first >= last:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(upto, first, "right"), np.searchsorted(upto, last, "left") + 1
        before = upto[a] - n[a]
        return self._expand(symbols[a:b])[first - before : last - before]

    def documents(self) -> list[np.ndarray]:
        """Ids of all documents; the end id also occurs inside texts, so begins bound them."""
        rule = np.maximum(self.symbols.astype(np.int64) - self.vocabulary, 0)
        n = np.where(self.symbols >= self.vocabulary, self._n[rule] if len(self._n) else 1, 1)
        upto = np.concatenate(([0], np.cumsum(n)))[self.begins]
        return np.split(self._expand(self.symbols), upto[1:-1]) if self.n_docs else []


# -- jobs --------------------------------------------------------------------


def write_token_shards(docs: DataFrame, tokenizer_path: str, vocabulary: int, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, in ascending doc_id order (null first), into shards.

    Null texts count as empty and yield the end id alone.  Rows of equal id lie
    side by side.  (part, seq) orders the shards.  The shards are written in the
    shared folder and read back; a text with more than ``shard_tokens`` ids ends its shard.  The number of id ranges
    grows with the texts' bytes.  Columns but doc_id and ``text`` are ignored; no rows, no shards.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, counts, names, size = [], [], [], 0

        def shard():
            nonlocal seq
            block = pack(np.concatenate(ids), np.concatenate(counts), vocabulary)
            row = [[part], [seq], [size], [pa.concat_arrays(names).to_pylist()], [block]]
            seq += 1
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=["part", "seq", "n_tokens", "doc_ids", "block"])

        for batch in batches:
            doc_ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.large_binary())
            sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in texts])
            # half a megabyte of text at a time, or a shard's worth
            for lo, hi in _slices(sizes, min(CHUNK, 4 * shard_tokens)):
                got, n = encoder.encode([t.as_py() or b"" for t in texts[lo:hi]])
                ids.append(np.insert(got, np.cumsum(n), END))
                counts.append(n + 1)
                names.append(doc_ids[lo:hi])
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard()
                    ids, counts, names, size = [], [], [], 0
        if counts:
            yield shard()

    whole = docs.agg(F.sum(F.octet_length(text)).alias("n")).head()["n"] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // RANGE_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(tidy(encode), SHARD_SCHEMA))


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(sizes):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield lo, hi
        lo = hi


def read_token_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards' bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = Shard(row["block"]).documents()
                n = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(np.ascontiguousarray(d, "<u4")) for d in docs]
                k = len(docs)
                yield pa.record_batch(
                    [pa.array([row["part"]] * k, pa.int32()), pa.array([row["seq"]] * k, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"],
                )

    docs = shards.mapInArrow(tidy(decode), "part int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_tokens")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_in", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("_start"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", vocabulary: int = 49408) -> DataFrame:
    import public_tokenizers

    return read_token_shards(write_token_shards(docs, public_tokenizers.path(tokenizer), vocabulary))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"))
