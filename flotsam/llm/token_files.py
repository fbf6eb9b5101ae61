"""Token ids in binary files: frequency ranks in one to four bytes, with the lengths in separate control bytes.

A folder holds a table of ranks, shard files, and a manifest.  The most frequent id has rank 0, so most ids take a byte.  A
shard has the ids of neighbouring documents in the order of doc_id:

    8 bytes  FLOTSAM1
    3 x u64  documents, ids, bytes of data
    u8       for each document: 1 if it has a doc_id
    i64      for each document: its doc_id
    u64      for each document: its ids
    u8       control: for each four ids, two bits an id, lowest first: bytes of its rank, less one
    u8       data: the ranks' bytes, lowest first
    u32      crc32 of all before

All numbers are little-endian.  A task writes shards under names of its own attempt and returns their names; only those that
Spark takes as its result stand in the manifest, so what a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, doc_bytes, new_folder, small_batches
from .packing import default_tokenizer, packed_ids

MAGIC = b"FLOTSAM1"
#: Ids after which a shard is closed, ids that are coded at a time, and ids of a partition that is sorted and written.
SHARD_IDS, BLOCK_IDS, TASK_IDS = 8_000_000, 1 << 20, 6_000_000
#: Bytes of a rank for each of the four ids of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2^32."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    wide = int(code.max(initial=0)) + 1
    data = ranks.view(np.uint8).reshape(-1, 4)[:, :wide][np.arange(wide) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The ranks of n ids, and how many bytes of the data they take; lengths come from the table of control bytes."""
    lengths = LENGTHS[control].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    used = int(ends[-1]) if n else 0
    at = ends - lengths
    ranks = data[:used][at].astype(np.uint32)
    for k in (1, 2, 3):  # ever fewer ids have a next byte
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks, used


def _open(uri: str):
    """(file system, path) of a place that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _tokenised(docs: DataFrame, path: str, end_id: int, wide: bool) -> DataFrame:
    """(doc_id, n, ids): the ids of each document with the end id, two bytes each or four."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column("data").to_pylist()]
            packed = [np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype(kind) for ids in packed_ids(texts, path)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(p) for p in packed], pa.int64()), pa.array([p.tobytes() for p in packed], pa.binary())], names=["doc_id", "n", "ids"])

    return doc_bytes(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "data").mapInArrow(run, "doc_id long, n long, ids binary")


def _id_counts(tokens: DataFrame, size: int, kind: str) -> np.ndarray:
    """How often each id stands in all documents; the driver gets at most a row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), kind) for x in batch.column("ids")]
            total += np.bincount(np.concatenate(ids or [np.zeros(0, kind)]), minlength=size)
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


class _Shard:
    """Documents in the order of their ids, until they are written."""

    def __init__(self) -> None:
        self.docs, self.counts, self.control, self.data, self.open, self.n, self.n_open = [], [], [], [], [], 0, 0

    def add(self, doc_id: int | None, ranks: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ranks))
        self.open.append(ranks)
        self.n += len(ranks)
        self.n_open += len(ranks)
        if self.n_open >= BLOCK_IDS:
            self._code(whole=False)

    def _code(self, whole: bool) -> None:
        """Codes what is open, but for up to three ids whose control byte is not full yet."""
        ranks = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        full = len(ranks) if whole else len(ranks) // 4 * 4
        for at in range(0, full, BLOCK_IDS):
            control, data = encode_ranks(ranks[at : min(full, at + BLOCK_IDS)])
            self.control.append(control)
            self.data.append(data)
        self.open, self.n_open = [ranks[full:]], len(ranks) - full

    def write(self, uri: str) -> None:
        self._code(whole=True)
        head = [len(self.docs), self.n, sum(map(len, self.data))]
        has = np.array([d is not None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        parts = [MAGIC, np.array(head, "<u8").tobytes(), has.tobytes(), ids.tobytes(), np.array(self.counts, "<u8").tobytes(), *self.control, *self.data]
        where, path = _open(uri)
        crc = 0
        with where.open_output_stream(path) as out:
            for part in parts:
                crc = zlib.crc32(part, crc)
                out.write(part)
            out.write(np.array([crc], "<u4").tobytes())


def _write_table(uri: str, values: np.ndarray) -> None:
    where, path = _open(uri)
    body = MAGIC + values.astype("<u4").tobytes()
    with where.open_output_stream(path) as out:
        out.write(body + np.array([zlib.crc32(body)], "<u4").tobytes())


def _read(uri: str) -> bytes:
    """A file's bytes without its checksum, which must be right."""
    where, path = _open(uri)
    with where.open_input_stream(path) as f:
        content = f.read()
    if content[:8] != MAGIC or zlib.crc32(memoryview(content)[:-4]) != int.from_bytes(content[-4:], "little"):
        raise ValueError(f"{uri} is damaged")
    return content[:-4]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents to a new folder, ascending by doc_id, and returns its manifest.

    Null and empty texts are the end id alone.  Null doc_ids come first.  Rows of one doc_id follow each other by a hash of
    their ids; repeated rows are written as often as they stand there.  An empty table gives a folder without shards.
    Extra columns are ignored.
    """
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, tokenizer_path or default_tokenizer()
    small_batches(spark)
    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    kind = "<u4" if size > 1 << 16 else "<u2"
    scratch = Scratch(spark)
    tokens, seen = scratch.measured("tokens", _tokenised(docs, path, end_id, size > 1 << 16), n=F.coalesce(F.sum("n"), F.lit(0)))
    counts = _id_counts(tokens, size, kind)
    by_rank = np.lexsort((np.arange(size), -counts))[: np.count_nonzero(counts)].astype(np.uint32)
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    _write_table(f"{folder}/ranks", by_rank)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, rows, shard = TaskContext.get().partitionId(), uuid.uuid4().hex, [], _Shard()

        def close() -> None:
            name = f"shard-{part:06d}-{len(rows):04d}-{attempt}"
            shard.write(f"{folder}/{name}")
            rows.append((part, len(rows), name, len(shard.docs), shard.n))

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                shard.add(doc_id, rank_of[np.frombuffer(ids.as_buffer(), kind)])
                if shard.n >= SHARD_IDS:
                    close()
                    shard = _Shard()
        if shard.docs:
            close()
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "name", "docs", "ids"])

    # the last key parts rows that are equal in all others, so that no group of copies is one task's
    keys = ["doc_id", "h", "k"]
    ordered = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("k")).repartitionByRange(1 + seen["n"] // TASK_IDS, *keys).sortWithinPartitions(*keys)
    shards = scratch.table("shards", ordered.select("doc_id", "ids").mapInArrow(write, "part int, file int, name string, docs long, ids long"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each shard
    shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    scratch.delete()
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder's shards, with its ids as four bytes each if asked for."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    by_rank = np.frombuffer(_read(f"{folder}/ranks"), "<u4", offset=len(MAGIC))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                content = memoryview(_read(f"{folder}/{name}"))
                n_docs, n_ids, n_data = (int(v) for v in np.frombuffer(content, "<u8", 3, 8))
                at = 32
                has, at = np.frombuffer(content, np.uint8, n_docs, at), at + n_docs
                doc_ids, at = np.frombuffer(content, "<i8", n_docs, at), at + 8 * n_docs
                counts, at = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64), at + 8 * n_docs
                n_control = -(-n_ids // 4)
                control, data = np.frombuffer(content, np.uint8, n_control, at), np.frombuffer(content, np.uint8, n_data, at + n_control)
                ends = np.cumsum(counts)
                crcs, kept, doc, used = np.zeros(n_docs, np.int64), [[] for _ in range(n_docs)] if with_ids else None, 0, 0
                for first in range(0, n_ids, BLOCK_IDS):
                    n = min(BLOCK_IDS, n_ids - first)
                    ranks, more = decode_ranks(control[first // 4 : -(-(first + n) // 4)], data[used:], n)
                    used, ids, done = used + more, by_rank[ranks], 0
                    while done < n:
                        take = min(n, int(ends[doc]) - first) - done
                        some = ids[done : done + take].tobytes()
                        crcs[doc] = zlib.crc32(some, int(crcs[doc]))
                        if with_ids:
                            kept[doc].append(some)
                        done += take
                        doc += first + done == ends[doc]
                columns = {"doc_id": pa.array(doc_ids, mask=has == 0), "start": pa.array(start + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs)}
                if with_ids:
                    columns["ids"] = pa.array([b"".join(k) for k in kept], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    files = manifest.select("name", "start")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.repartition(max(1, min(files.count(), 4096))).mapInArrow(read, schema)


def token_digests(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """The documents of ``docs`` as ``read_token_files`` finds them in files written for the purpose, which then go."""
    scratch = Scratch(docs.sparkSession)
    folder = new_folder(docs.sparkSession, "flotsam-token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    out = scratch.last(read_token_files(docs.sparkSession, folder))
    scratch.delete(folder)
    return out
