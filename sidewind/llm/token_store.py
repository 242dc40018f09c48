"""Token ids as binary files: plane-shuffled, zstandard-compressed blocks with a chunk index.

Documents are dealt out by ranges of doc_id and sorted, each range is one part. Within a part,
documents are packed to chunks of whole documents. A chunk's ids are cut in blocks of a fixed size;
each block is transposed to byte planes (plane k holds byte k of all its ids) or bit planes, empty
top planes are left out, and each plane is compressed on its own. A chunk's row in the file also is its index
entry: part, number, ids before it in the part, the least and greatest doc_id, and the id and length of
each document in it. Documents are in order, so read_documents() skips row groups and chunks by the
index, and decodes only the blocks that the wanted documents lie in.

The files are Parquet containers written by Spark's committer, so a lost executor's half-written
files never show, and any store that Spark can write to will do. Compression of the container is
off, since the planes are compressed already.

Defined results: null text is the empty text and still gets the end id; null doc_ids come first;
rows that repeat a doc_id follow each other, ordered by their text's hash; an empty table gives no
chunks. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_chars
from .common import PLAIN, partitions, shared_dir, ship

#: The pattern by which byte-level BPE of this kind splits text before the merges, for the
#: characters of PLAIN, among which letters and numbers can be listed.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
PLAIN_PIECES = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^ \t-\r{_L}{_N}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall
#: Ids in a block.
BLOCK = 16384
#: A chunk closes at the first document that brings it to this many ids.
CHUNK = 1 << 20
#: Bytes of text in a part, at which more parts are made than the session sets.
PART_BYTES = 256 << 20
#: Pieces whose ids a worker remembers before it starts anew.
PIECES = 900_000

CHUNKS = "part int, chunk int, before long, n_ids long, first_doc long, last_doc long, kind string, doc_ids array<long>, lengths array<long>, blocks array<struct<n:int,planes:array<binary>>>"


class _Learns(dict):
    """A bounded dict that makes what it lacks."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class CachedEncoder:
    """Encodes by the tokenizers library's model, once per distinct piece between the merges' borders.

    Merges never cross the borders of the pre-tokenizer's pieces, so a text's ids are those of its
    pieces. A text that holds an added token's string, or characters on whose classes two Unicode versions can
    differ, is encoded by the library as a whole.
    """

    _kept: dict = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokenize, chars = self.tokenizer.model.tokenize, {b: c for b, c in byte_chars().items() if chr(b) != c}

        def piece(p: str) -> bytes:
            return pack([t.id for t in tokenize(p.encode().decode("latin-1").translate(chars))])

        self.pieces = _Learns(piece, PIECES)

    @classmethod
    def of(cls, path: str) -> CachedEncoder:
        if path not in cls._kept:
            cls._kept = {path: cls(path)}
        return cls._kept[path]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not PLAIN(text) or any(a in text for a in self.added):
            return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.pieces.__getitem__, PLAIN_PIECES(text)))


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def pack_block(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """Planes of up to BLOCK ids, lowest first, up to the highest in use: bit k, or byte k, of all ids."""
    press = zstandard.ZstdCompressor(level=3)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if planes == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: -(-top // 8)]
    else:
        rows = [np.packbits((ids >> k).astype(np.uint8) & 1, bitorder="little") for k in range(top)]
    return [press.compress(np.ascontiguousarray(row).tobytes()) for row in rows]


def unpack_block(n: int, packed: list[bytes], planes: str = "byte") -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(press.decompress(p), np.uint8) for p in packed]
    if planes == "byte":
        out = np.zeros((n, 4), np.uint8)
        for k, row in enumerate(rows):
            out[:, k] = row
        return out.view("<u4")[:, 0]
    out = np.zeros(n, np.uint32)
    for k, row in enumerate(rows):
        out |= np.unpackbits(row, count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def _write(path: str, end_id: int, planes: str):
    def run(batches):
        from pyspark import TaskContext

        encoder = CachedEncoder.of(path)
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0
        kinds = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("kind", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))])))])

        def close():
            ids = np.concatenate(parts)
            known = [i for i in doc_ids if i is not None]
            blocks = [{"n": len(b), "planes": pack_block(b, planes)} for b in (ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK))]
            return pa.RecordBatch.from_pylist([{"part": part, "chunk": chunk, "before": before, "n_ids": len(ids), "first_doc": min(known, default=None), "last_doc": max(known, default=None), "kind": planes, "doc_ids": doc_ids, "lengths": [len(p) for p in parts], "blocks": blocks}], kinds)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.frombuffer(encoder.encode(text or "") + pack([end_id]), np.uint32)
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= CHUNK:
                    yield close()
                    before, chunk = before + held, chunk + 1
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield close()

    return run


def _read(low: int | None, high: int | None):
    """The documents of each chunk, all of them, or those with low <= doc_id <= high from the blocks that hold them."""
    names = ("part", "place", "doc_id", "n_tokens", "ids")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths = row["doc_ids"], np.array(row["lengths"])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                want = [n for n, i in enumerate(doc_ids) if low is None or i is not None and low <= i <= high]
                if not want:
                    continue
                first = starts[want[0]] // BLOCK
                blocks = row["blocks"][first : -(-ends[want[-1]] // BLOCK)]
                ids = np.concatenate([unpack_block(b["n"], b["planes"], row["kind"]) for b in blocks])
                at = first * BLOCK
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(want), pa.int32()), pa.array(starts[want] + row["before"], pa.int64()), pa.array([doc_ids[n] for n in want], pa.int64()), pa.array(lengths[want], pa.int64()),
                        pa.array([ids[starts[n] - at : ends[n] - at].astype("<u4").tobytes() for n in want], pa.binary()),
                    ],
                    names,
                )

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, to: str | None = None, planes: str = "byte") -> str:
    """Encodes the texts and writes the files; returns their folder."""
    spark = docs.sparkSession
    ship(spark)
    to = to or shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = parts or partitions(spark, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], PART_BYTES)
    (
        rows.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_write(tokenizer_path, end_id, planes), CHUNKS)
        .write.option("compression", "none").parquet(f"{to}/chunks")
    )
    return to


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start counting all before."""
    return _tokens(spark, folder, None, None)


def read_documents(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """As read_tokens(), of the documents with low <= doc_id <= high, found by the index."""
    return _tokens(spark, folder, low, high)


def _tokens(spark: SparkSession, folder: str, low: int | None, high: int | None) -> DataFrame:
    ship(spark)
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    # One row per part: the ids before it. The parts are as many as the write had tasks.
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    if low is not None:
        chunks = chunks.where((F.col("last_doc") >= low) & (F.col("first_doc") <= high))
    out = chunks.select("part", "before", "kind", "doc_ids", "lengths", "blocks").mapInArrow(_read(low, high), "part int, place long, doc_id long, n_tokens long, ids binary")
    return out.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("place")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

