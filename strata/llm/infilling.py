"""Fill-in-middle transformation over an index of distinct texts.

Identical texts are grouped by their content: copies in a batch are combined before the shuffle, then by digest
and whole text, so that two texts are one only if they are equal byte by byte. Each distinct text has one
Elias-Fano list of its code-point boundaries (byte offsets), about two bits for each code point, made once in
a batch that holds the text. The index is joined back to the documents on the digest, where it lies; each document's cuts, drawn from its id, are two
select operations on the list, which give byte offsets without decoding the text.

Texts travel compressed. A text of very many copies is given to several tasks: digests with more than
``max(CHUNK, rows / HEAVY_KEYS)`` documents, at most ``HEAVY_KEYS`` of them, are broadcast with their
number of parts, and documents of such a digest are spread by a hash of their id.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle, ``plain`` the text.

Defined results: a null text is empty, and an empty text is plain; a text that contains a mark is plain,
so that every output can be taken apart again; repeated rows each get their row; a null id draws as an
empty string; bytes that are no UTF-8 count as part of the code point before them; an empty table gives
an empty result; further columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
CHUNK = 1024
HEAVY_KEYS = 100_000
OUT_BYTES = 8 << 20
_HEAD = struct.Struct("<QQB")
_BLOCK = 512  # bits between two counts of the directory


def elias_fano(values: np.ndarray, universe: int) -> bytes:
    """A non-decreasing list of whole numbers up to ``universe``: low bits as they are, high parts in unary,
    and the ones before each block of the unary part."""
    n = len(values)
    low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
    values = values.astype(np.int64)
    bits = np.zeros(-(-(n + (universe >> low_bits) + 1) // _BLOCK) * _BLOCK, bool)
    bits[(values >> low_bits) + np.arange(n)] = True
    counts = bits.reshape(-1, _BLOCK).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")
    low = (values[:, None] >> np.arange(low_bits)) & 1
    return b"".join((_HEAD.pack(n, universe, low_bits), before.tobytes(), np.packbits(bits).tobytes(), np.packbits(low.astype(bool).ravel()).tobytes()))


class Boundaries:
    """Select on a stored list: the block of the i-th one is found in the directory, only that is unpacked."""

    def __init__(self, data: bytes) -> None:
        self.n, self.universe, self.low_bits = _HEAD.unpack_from(data)
        blocks = -(-(self.n + (self.universe >> self.low_bits) + 1) // _BLOCK)
        self.before = np.frombuffer(data, "<u8", blocks, _HEAD.size)
        at = _HEAD.size + 8 * blocks
        self.high = np.frombuffer(data, np.uint8, blocks * _BLOCK // 8, at)
        self.low = np.frombuffer(data, np.uint8, -1, at + len(self.high))

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        bits = np.unpackbits(self.high[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8])
        one = int(np.flatnonzero(bits)[i - int(self.before[block])]) + block * _BLOCK
        value = one - i
        if self.low_bits:
            first = i * self.low_bits
            part = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8])[first % 8 :][: self.low_bits]
            value = value << self.low_bits | int(part @ (1 << np.arange(self.low_bits)))
        return value


def code_point_starts(text: bytes) -> np.ndarray:
    """Byte offsets at which code points begin, and the end."""
    raw = np.frombuffer(text, np.uint8)
    begins = (raw & 0xC0) != 0x80
    begins[:1] = True
    return np.append(np.flatnonzero(begins), len(raw))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))


def distinct_index(docs: DataFrame) -> DataFrame:
    """``(digest, packed, chars, marked, bounds, copies)``: a row for each distinct text of ``docs``, dealt by
    digest. A batch packs and lists each of its texts once; that row goes through the only shuffle of texts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in slices(batches):
            rows = []
            for text, copies in Counter(batch.column(1).to_pylist()).items():
                starts = code_point_starts(text)
                rows.append((hashlib.sha256(text).digest(), press.compress(text), len(starts) - 1, any(m in text for m in marks), elias_fano(starts, len(text)), copies))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    names = ["digest", "packed", "chars", "marked", "bounds", "copies"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.int64()]
    rows = _texts(docs).mapInArrow(pack, "digest binary, packed binary, chars long, marked boolean, bounds binary, copies long")
    # packer and list are functions of the text, and the packer can be undone: equal packed texts are equal texts
    return rows.repartition("digest").groupBy(*names[:-1]).agg(F.sum("copies").alias("copies"))


def cuts(doc_id: Column, chars: Column, marked: Column, seed: str = SEED) -> tuple[Column, Column, Column]:
    """Form, and the code points before the first and the second cut."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when((chars == 0) | marked | (h[2] % 100 >= PLAIN_FROM), "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    a, b = h[0] % (chars + 1), h[1] % (chars + 1)
    return form, F.least(a, b), F.greatest(a, b)


def fill_in_middle(docs: DataFrame, seed: str = SEED, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row of ``docs(doc_id, text)``."""
    keys = materialize(_texts(docs).select("doc_id", F.unhex(F.sha2("bytes", 256)).alias("digest")), "infilling-keys")
    often = max(chunk, keys.count() // HEAVY_KEYS)
    parts = F.ceil(F.col("copies") / F.lit(chunk)).cast("int")
    heavy = keys.groupBy("digest").agg(F.count("*").alias("copies")).where(F.col("copies") > often)
    heavy = heavy.select("digest", parts.alias("parts"))  # fewer than HEAVY_KEYS rows: each stands for more than 1 / HEAVY_KEYS of all
    asked = keys.join(F.broadcast(heavy), "digest", "left").select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    index = distinct_index(docs)
    usual = asked.where("part is null").drop("part").join(index.where(F.col("copies") <= often), "digest")  # where the index already lies
    spread = index.where(F.col("copies") > often).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = usual.unionByName(asked.join(spread, ["digest", "part"]).drop("part"))
    form, first, second = cuts(F.col("doc_id"), F.col("chars"), F.col("marked"), seed)
    ready = met.select("doc_id", F.col("chars").alias("n"), form.alias("form"), first.alias("first"), second.alias("second"), "digest", "packed", "bounds")
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        last = text = bounds = None
        for batch in slices(batches):
            held: list[bytes] = []
            size = done = 0

            def flush(upto: int) -> pa.RecordBatch:
                part = batch.slice(done, upto - done)
                plain = np.array(part.column(2).to_pylist()) == "plain"
                first, second = part.column(3).to_numpy(), part.column(4).to_numpy()
                return pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(first, mask=plain), pa.array(second - first, mask=plain), pa.array(held, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

            rows = zip(*(batch.column(c).to_pylist() for c in range(2, 6)), batch.column(6), batch.column(7))
            for i, (form, a, b, digest, packed, listed) in enumerate(rows):
                if digest != last:  # the join leaves the documents of a text side by side
                    last, text, bounds = digest, unpress.decompress(packed.as_py()), Boundaries(listed.as_py())
                if form == "plain":
                    out = text
                else:
                    u, v = bounds.select(a), bounds.select(b)
                    out = b"".join((p, text[:u], s, text[v:], m, text[u:v]) if form == "psm" else (s, text[v:], p, text[:u], m, text[u:v]))
                held.append(out)
                size += len(out)
                if size >= OUT_BYTES:
                    yield flush(i + 1)
                    held, size, done = [], 0, i + 1
            if held:
                yield flush(batch.num_rows)

    got = ready.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return got.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form."""

    def between(text: Column, mark: str, k: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(k))

    rest = F.substring(output, 4, 2_147_483_647)
    middle = between(rest, MIDDLE, 2)
    psm = F.concat(between(rest, SUFFIX, 1), middle, between(between(rest, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(between(between(rest, PREFIX, 2), MIDDLE, 1), middle, between(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
  d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM t),
  c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256 FROM p"""
