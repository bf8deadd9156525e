"""Token-id output as one wavelet matrix per shard.

Documents are put in ascending id order by a range shuffle; each task encodes its range and cuts it
into shards of about ``SHARD_TOKENS`` ids at document ends. A shard is one file: a Parquet file with
a single row ``(shard, n_tokens, payload)``, written and read by Spark, so any store that Spark
reaches will do. The payload is, little-endian:

    magic ``WVMX``, version u8, bits u8, reserved u16, documents u64, ids u64,
    zeros per plane (bits x u64),
    ones before each block of 65,536 bits, and in all (bits x (blocks + 1) x u64),
    place in the payload of each block, and of the end (bits x blocks + 1, u64),
    zstandard frames, each with its u64 length before it:
    document ids (i64), null flags of the ids (u8), ids per document (u64),
    and a zstandard frame for each block of each plane, highest bit first: ones of the block before
    every 512 bits (128 x u16), then the packed bits.

Plane k holds bit k of every id, in the order that a stable sort by the bits before it leaves (Claude
and Navarro's wavelet matrix). The ranks stand in the file: access, rank, count, select and occurrence
lookup read the directories and unpack those blocks only that they touch, two of a plane for a count.

Defined results: null texts count as empty; a document always ends with ``END_ID``; repeated ids keep
their rows, next to each other; null ids come first; an empty table gives no shards and an empty
result; further columns play no part.
"""

from __future__ import annotations

import itertools
import os
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import release_caches, shared_dir, table, worker_cache

SHARD_TOKENS = 1 << 23
END_ID = 0
VERSION = 2
BLOCK_BITS = 1 << 16
BLOCK_BYTES = BLOCK_BITS // 8
WORD_BITS = 512
KEPT_BLOCKS = 256
SEGMENT = 1 << 16
CACHE_WORDS = 400_000  # two workers of an executor hold so many each
KEPT_BYTES = 64  # longer parts of texts are not kept for the next ones
BULK = 500
ENCODE_BYTES = 1 << 22  # of text encoded at once
SHARD_SCHEMA = "shard long, n_tokens long, payload binary"


@dataclass
class Plane:
    """A bit-plane in blocks: ones before each block, and ``load(block)`` for the ones before every
    ``WORD_BITS`` bits of it and its bytes."""

    before: np.ndarray
    load: Callable[[int], tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, packed: np.ndarray) -> Plane:
        blocks = -(-len(packed) // BLOCK_BYTES)
        data = np.zeros((blocks, BLOCK_BYTES), np.uint8)
        data.reshape(-1)[: len(packed)] = packed
        ones = np.bitwise_count(data.reshape(-1, 8).view(np.uint64)).reshape(blocks, BLOCK_BITS // WORD_BITS, WORD_BITS // 64).sum(axis=2, dtype=np.int64)
        within = np.zeros(ones.shape, np.uint16)
        np.cumsum(ones[:, :-1], axis=1, dtype=np.uint16, out=within[:, 1:])
        return cls(np.concatenate([[0], np.cumsum(ones.sum(axis=1))]).astype(np.int64), lambda b: (within[b], data[b]))

    def bits(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit at it (0 past the end)."""
        i = np.asarray(i, np.int64)
        block, at = i // BLOCK_BITS, i % BLOCK_BITS
        ones, bit = self.before[block], np.zeros(len(i), np.int64)
        for b in np.unique(block[block < len(self.before) - 1]).tolist():
            mine = np.flatnonzero(block == b)
            within, data = self.load(b)
            p = at[mine]
            word = data.reshape(-1, WORD_BITS // 8)[p // WORD_BITS]
            inside = (p % WORD_BITS)[:, None] - 8 * np.arange(WORD_BITS // 8)
            keep = (np.left_shift(0xFF, 8 - np.clip(inside, 0, 8)) & 0xFF).astype(np.uint8)
            ones[mine] += within[p // WORD_BITS].astype(np.int64) + np.bitwise_count(word & keep).sum(axis=1, dtype=np.int64)
            bit[mine] = (data[p // 8] >> (7 - p % 8).astype(np.uint8)) & 1
        return ones, bit

    def select(self, one: bool, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        before = self.before if one else np.arange(len(self.before)) * BLOCK_BITS - self.before
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for b in np.unique(block).tolist():
            mine = np.flatnonzero(block == b)
            where = np.flatnonzero(np.unpackbits(self.load(b)[1]).view(np.bool_) == one)
            out[mine] = b * BLOCK_BITS + where[k[mine] - before[b]]
        return out

    def packed(self, n: int) -> np.ndarray:
        """All bits, as bytes."""
        parts = [self.load(b)[1] for b in range(len(self.before) - 1)]
        return (np.concatenate(parts) if parts else np.empty(0, np.uint8))[: -(-n // 8)]


class WaveletMatrix:
    """A sequence of ids below 2^bits as bit-planes with rank and select."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[Plane]):
        self.n, self.bits, self.zeros, self.planes = n, bits, zeros, planes

    @staticmethod
    def levels(ids: np.ndarray, bits: int) -> Iterator[tuple[int, Plane]]:
        """Zeros of each plane and the plane, highest bit first. Holds two orders of the ids beside ``ids``."""
        a, spare = ids, None
        mask = np.empty(len(ids), np.bool_)
        for k in range(bits - 1, -1, -1):
            for i in range(0, len(a), SEGMENT):  # pieces that stay in the processor's cache
                part = a[i : i + SEGMENT]
                np.not_equal(part & part.dtype.type(1 << k), 0, out=mask[i : i + SEGMENT])
            zeros = len(a) - int(np.count_nonzero(mask))
            yield zeros, Plane.of(np.packbits(mask))
            if k:
                after = np.empty_like(ids) if spare is None else spare
                low, high = 0, zeros
                for i in range(0, len(a), SEGMENT):
                    one = mask[i : i + SEGMENT]
                    part = a[i : i + SEGMENT]
                    z, o = np.flatnonzero(~one), np.flatnonzero(one)
                    part.take(z, out=after[low : low + len(z)], mode="clip")
                    part.take(o, out=after[high : high + len(o)], mode="clip")
                    low += len(z)
                    high += len(o)
                a, spare = after, None if a is ids else a

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        levels = list(cls.levels(ids, bits))
        return cls(len(ids), bits, [z for z, _ in levels], [p for _, p in levels])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            mask = np.unpackbits(self.planes[level].packed(self.n), count=self.n).view(np.bool_)
            above = np.empty_like(out)
            low, high = 0, self.zeros[level]
            out[high:] |= out.dtype.type(1 << (self.bits - 1 - level))
            for i in range(0, self.n, SEGMENT):
                one = mask[i : i + SEGMENT]
                part = above[i : i + SEGMENT]
                z, o = np.flatnonzero(~one), np.flatnonzero(one)
                part[z] = out[low : low + len(z)]
                part[o] = out[high : high + len(o)]
                low += len(z)
                high += len(o)
            out = above
        return out

    def access(self, i: np.ndarray | int) -> np.ndarray:
        """Ids at the given places."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        value = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            ones, bit = self.planes[level].bits(i)
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
            value = (value << 1) | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            ones, _ = self.planes[level].bits(np.array([low, high]))
            if token >> (self.bits - 1 - level) & 1:
                low, high = (self.zeros[level] + ones).tolist()
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token in ``[low, high)``."""
        if token >> self.bits or token < 0:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Places of a token in ``[low, high)``, ascending."""
        if token >> self.bits or token < 0:
            return np.empty(0, np.int64)
        a, b = self._range(token, low, self.n if high is None else high)
        return self._up(token, np.arange(a, b, dtype=np.int64))

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places in the sequence of places below the last plane."""
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            at = self.planes[level].select(one, at - (self.zeros[level] if one else 0))
        return at

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; -1 if there are fewer."""
        if token >> self.bits or token < 0:
            return -1
        a, b = self._range(token, 0, self.n)
        return int(self._up(token, np.array([a + k]))[0]) if 0 <= k < b - a else -1


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    z = zstandard.ZstdCompressor(level=1)
    zeros, before, blocks = [], [], []
    for count, p in WaveletMatrix.levels(ids, bits):  # a plane goes once it is compressed
        zeros.append(count)
        before.append(p.before.astype("<u8").tobytes())
        blocks += [z.compress(b"".join((within.astype("<u2").tobytes(), data.tobytes()))) for within, data in map(p.load, range(len(p.before) - 1))]
    frames = [z.compress(f) for f in (np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.asarray(lengths, "<u8").tobytes())]
    head = b"".join([b"WVMX", struct.pack("<BBHQQ", VERSION, bits, 0, len(doc_ids), len(ids)), struct.pack(f"<{bits}Q", *zeros), *before])
    tables = b"".join(x for f in frames for x in (struct.pack("<Q", len(f)), f))
    first = len(head) + 8 * (len(blocks) + 1) + len(tables)
    places = np.cumsum([first, *map(len, blocks)]).astype("<u8")
    return b"".join([head, places.tobytes(), tables, *blocks])


def unpack(payload: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, ids per document, and the matrix of a shard file, which unpacks blocks as they are
    asked for and keeps the last ``KEPT_BLOCKS``."""
    if payload[:4] != b"WVMX":
        raise ValueError("not a wavelet matrix shard")
    version, bits, _, docs, n = struct.unpack_from("<BBHQQ", payload, 4)
    if version != VERSION:
        raise ValueError(f"unknown shard version {version}")
    at = 4 + struct.calcsize("<BBHQQ")
    zeros = list(struct.unpack_from(f"<{bits}Q", payload, at))
    at += 8 * bits
    blocks = -(-n // BLOCK_BITS)
    before = np.frombuffer(payload, "<u8", bits * (blocks + 1), at).reshape(bits, -1).astype(np.int64)
    at += 8 * bits * (blocks + 1)
    places = np.frombuffer(payload, "<u8", bits * blocks + 1, at).tolist()
    at += 8 * (bits * blocks + 1)
    z = zstandard.ZstdDecompressor()
    tables = []
    for _ in range(3):
        (size,) = struct.unpack_from("<Q", payload, at)
        tables.append(z.decompress(payload[at + 8 : at + 8 + size]))
        at += 8 + size

    @lru_cache(maxsize=KEPT_BLOCKS)
    def load(k: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(z.decompress(payload[places[k] : places[k + 1]]), np.uint8)
        words = BLOCK_BITS // WORD_BITS
        return raw[: 2 * words].view("<u2"), raw[2 * words :]

    planes = [Plane(before[p], partial(lambda p, b: load(p * blocks + b), p)) for p in range(bits)]
    null = np.frombuffer(tables[1], np.uint8)
    owners = [None if v else d for d, v in zip(np.frombuffer(tables[0], "<i8").tolist(), null)]
    return owners, np.frombuffer(tables[2], "<u8").astype(np.int64), WaveletMatrix(n, bits, zeros, planes)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether each byte value is in one of the ranges, ends included."""
    return np.array([any(a <= b <= z for a, z in ranges) for b in range(256)])


PRINTED = _bytes((0x21, 0x7E))
MARK = np.isin(np.arange(256), list(string.punctuation.encode()))
WORDY = PRINTED & ~MARK  # ASCII letters and digits
LETTER_LEADS = _bytes((0xC3, 0xCA), (0xD0, 0xD1))  # two bytes, letters but for the signs of the next line
SIGNS = np.array([0xC397, 0xC3B7])
INKED = PRINTED | (_bytes((0xC3, 0xFF)) & ~_bytes((0xE1, 0xE3), (0xEF, 0xEF)))  # begins what is no white space
BLANKS = np.array([0xE19A80, 0xE1A08E, *range(0xE28080, 0xE28090), *range(0xE280A8, 0xE280B0), 0xE2819F, 0xE38080, 0xEFBBBF])  # three bytes


def _before(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return data.take(at - k, mode="wrap")


def _after_solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places that follow a character other than white space (where in doubt, not)."""
    last = _before(data, at, 1)
    ok = PRINTED[last]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        two = _before(data, at[wide], 2).astype(np.int64) << 8 | last[wide]
        ok[wide] = ~np.isin(two, [0xC285, 0xC2A0]) & ~np.isin(_before(data, at[wide], 3).astype(np.int64) << 16 | two, BLANKS)
    return at[ok]


def _after_word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places that follow a letter or digit (where in doubt, not)."""
    last = _before(data, at, 1)
    ok = WORDY[last]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        lead = _before(data, at[wide], 2)
        ok[wide] = LETTER_LEADS[lead] & ~np.isin(lead.astype(np.int64) << 8 | last[wide], SIGNS)
    return at[ok]


def cut_flags(data: np.ndarray) -> np.ndarray:
    """Flags the places of UTF-8 ``data`` at which a byte-level splitter always ends a piece, whatever
    stands around them: before a space or line end that follows no white space, after such a line end
    if no white space follows, and before an ASCII mark that follows a letter or digit. The splitter
    looks ahead at white space alone and never back, so parts between such places encode on their own."""
    flags = np.zeros(len(data) + 1, bool)
    flags[_after_solid(data, np.flatnonzero(data == 0x20))] = True
    line = _after_solid(data, np.flatnonzero(data == 0x0A))
    flags[line] = True
    flags[line[INKED[data.take(line + 1, mode="clip")]] + 1] = True
    flags[_after_word(data, np.flatnonzero(MARK[data]))] = True
    return flags[: len(data)]


class WordCache:
    """Encodes texts part by part, cut where the tokenizer's splitter always cuts (``cut_flags``). Parts
    repeat, so most are looked up; new ones go to the tokenizer many at once. Texts with the string of
    an added token go to it whole."""

    def __init__(self, path: str, kind: str = "<u2"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]  # found in a text as a whole
        self.kind = kind
        if len(self.ids("\n")) != 1:
            raise ValueError("the tokenizer has no id of its own for a line end")
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of text of each id, a character each in the vocabulary
        for token, i in vocab.items():
            self.width[i] = len(token)
        for i, t in added.items():
            self.width[i] = len(t.content.encode())
        self.known: dict[str, int] = {}  # the k-th part in it has slot k
        self.store = np.empty(0, kind)  # ids of slot k: n[k] from at[k] on
        self.at = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.uses = np.empty(0, np.float32)  # calls that met the part, old ones count less

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def bulk(self, parts: list[str], sizes: np.ndarray, between: str | None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Ids, and for each part where they start in all of them and their number: many parts in one
        call, as one text with ``between`` between them and told apart by the bytes that ids stand for."""
        found, at, n = [], [], []
        base = 0
        for i in range(0, len(parts), BULK):
            some, size = parts[i : i + BULK], sizes[i : i + BULK]
            cut = between is not None
            if cut:
                text = between.join(some)
                ids = np.array(self.ids(text), self.kind)
                ends = np.concatenate([[0], np.cumsum(self.width[ids])])
                stop = np.cumsum(size + len(between)) - len(between)
                first, last = np.searchsorted(ends, stop - size), np.searchsorted(ends, stop)
                cut = last[-1] == len(ids) and (ends[first] == stop - size).all() and (ends[last] == stop).all() and not any(t in text for t in self.added)
            if not cut:
                each = self.each(some)
                ids, last = np.concatenate(each), np.cumsum([len(x) for x in each])
                first = np.append(0, last[:-1])
            found.append(ids)
            at.append(first + base)
            n.append(last - first)
            base += len(ids)
        return found, at, n

    def each(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, parts: list[str], sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Gives new parts slots: returns them in the order of their slots, and the slot of each."""
        solid = np.array([not p[-1].isspace() for p in parts], bool)
        spaced = solid & np.array([p[0] == " " for p in parts], bool)
        bare = solid & ~np.array([p[0].isspace() for p in parts], bool)
        store, at, n, order = [self.store], [self.at], [self.n], []
        base = len(self.store)
        for which, between in ((spaced, ""), (bare, "\n"), (~spaced & ~bare, None)):
            mine = np.flatnonzero(which)
            order.append(mine)
            ids, first, count = self.bulk([parts[i] for i in mine.tolist()], sizes[mine], between)
            store += ids
            at += [f + base for f in first]
            n += count
            base += sum(map(len, ids))
        self.store, self.at, self.n = np.concatenate(store), np.concatenate(at), np.concatenate(n)
        order = np.concatenate(order)
        slots = np.empty(len(parts), np.int64)
        slots[order] = len(self.n) - len(parts) + np.arange(len(parts))
        return [parts[i] for i in order.tolist()], slots

    def trim(self) -> None:
        """Keeps the half of the parts that calls met most and last."""
        half = CACHE_WORDS // 2
        keep = np.sort(np.argpartition(self.uses, len(self.uses) - half)[len(self.uses) - half :])
        names = list(self.known)
        self.known = {names[s]: k for k, s in enumerate(keep.tolist())}
        self.store = self.store[self.places(self.at[keep], self.n[keep])]
        self.n, self.uses = self.n[keep], self.uses[keep]
        self.at = np.cumsum(self.n) - self.n

    @staticmethod
    def places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n`` places from each of ``at`` on, one after the other."""
        out = np.repeat(at - (np.cumsum(n) - n), n)
        out += np.arange(len(out))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text. Arrow numbers the
        distinct parts, so that Python sees each of those once."""
        texts = texts.cast(pa.large_string())
        _, offsets, raw = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = (np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8))[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.empty(0, self.kind), np.zeros(len(texts), np.int64)
        flags = cut_flags(data)
        for content in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist():
                flags[bounds[i] : bounds[i + 1]] = False
        flags[bounds[bounds < len(data)]] = True
        cuts = np.append(np.flatnonzero(flags), len(data))
        coded = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        index = coded.indices.to_numpy()
        sizes = pc.binary_length(coded.dictionary).to_numpy()
        slot = np.fromiter(map(self.known.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(slot < 0)
        passing = sizes[missing] > KEPT_BYTES
        short, long = missing[~passing], missing[passing]
        names, slot[short] = self.learn([parts[i] for i in short.tolist()], sizes[short])
        kept, kept_ids = len(self.n), len(self.store)
        self.known.update(zip(names, range(kept - len(names), kept)))
        if len(long):
            slot[long] = self.learn([parts[i] for i in long.tolist()], sizes[long])[1]
        n = self.n[slot][index]
        ids = self.store[self.places(self.at[slot][index], n)]
        if len(long):
            self.store, self.at, self.n = self.store[:kept_ids].copy(), self.at[:kept].copy(), self.n[:kept].copy()
        self.uses = np.append(self.uses * np.float32(0.8), np.zeros(len(names), np.float32))
        self.uses[slot[slot < kept]] += 1
        if len(self.known) > CACHE_WORDS:
            self.trim()
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(ends[np.searchsorted(cuts, bounds)])


def encoder(path: str, kind: str) -> WordCache:
    """One for each tokenizer file in a Python worker: words learned in a task serve the next."""
    return worker_cache(("words", path, kind), lambda: WordCache(path, kind))


def shard_rows(batches: Iterator[pa.RecordBatch], tokenizer: str, bits: int, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    """Shard files, as rows, of a task's ``(doc_id, text, part)``. Holds a shard's ids, one piece of
    ``ENCODE_BYTES`` or one longer text, and the parts of texts that the worker keeps."""
    kind = "<u2" if bits <= 16 else "<u4"
    encode = encoder(tokenizer, kind).encode
    held: list[np.ndarray] = []
    owners: list[int | None] = []
    lengths: list[np.ndarray] = []
    count = number = 0
    base = None

    def shard() -> pa.RecordBatch:
        ids = np.concatenate(held)
        held.clear()
        payload = pack(owners, np.concatenate(lengths), ids, bits)
        return pa.RecordBatch.from_arrays(
            [pa.array([base + number], pa.int64()), pa.array([count], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "n_tokens", "payload"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        if base is None:
            base = batch.column(2)[0].as_py() << 32
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // ENCODE_BYTES
        for a, b in zip(cuts := [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist()], [*cuts[1:], batch.num_rows]):
            ids, n = encode(batch.column(1).slice(a, b - a))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, END_ID)
            ends = ends + np.arange(1, len(n) + 1)
            names = batch.column(0).slice(a, b - a).to_pylist()
            i, done = 0, 0
            while i < len(n):
                j = int(np.searchsorted(ends, done + shard_tokens - count, side="right"))
                if j <= i and not count:
                    j = i + 1  # a document longer than a shard has one of its own
                if j > i:
                    held.append(ids[done : ends[j - 1]])
                    owners += names[i:j]
                    lengths.append(n[i:j] + 1)
                    count += int(ends[j - 1] - done)
                    i, done = j, int(ends[j - 1])
                if i < len(n):
                    yield shard()
                    held, owners, lengths, count, number = [], [], [], 0, number + 1
    if count:
        yield shard()


def write_shards(docs: DataFrame, path: str, tokenizer: str, bits: int = 16, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> None:
    """Encodes ``docs`` and writes the shard files under ``path``, by ``order_col`` if there is one, else by id."""
    order = [] if order_col is None else [F.col(order_col).alias("o")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *order).withColumn("h", F.xxhash64("text"))
    by = ["doc_id", "h"] if order_col is None else ["o", "doc_id", "h"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).select("doc_id", "text", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shard_rows(batches, tokenizer, bits, shard_tokens)

    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_documents(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_caches()  # of the words that writing learned
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                owners, lengths, wm = unpack(payload.as_py())
                raw = memoryview(wm.decode().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(owners), pa.int64()), pa.array(owners, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("shard", "payload").mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = shards.select("shard", F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each shard
    return rows.join(before, "shard").select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``(shard, token, n)``: occurrences of each asked token, from ranks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                wm = unpack(payload.as_py())[2]
                yield pa.RecordBatch.from_pydict({"shard": [number] * len(tokens), "token": tokens, "n": [wm.count(t) for t in tokens]})

    return shards.select("shard", "payload").mapInArrow(run, "shard long, token long, n long")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``(doc_id, place)``: every occurrence of a token and its place in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                owners, lengths, wm = unpack(payload.as_py())
                ends = np.cumsum(lengths)
                at = wm.occurrences(token)
                of = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([owners[i] for i in of], pa.int64()), pa.array(at - (ends - lengths)[of])], names=["doc_id", "place"])

    return shards.select("payload").mapInArrow(run, "doc_id long, place long")


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def tokenized(docs: DataFrame, tokenizer: str | None = None, order_col: str | None = None) -> DataFrame:
    """Writes the shards of ``docs`` to the shared folder and returns what they hold."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer or default_tokenizer(), order_col=order_col)
    return shard_documents(read_shards(spark, path))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
