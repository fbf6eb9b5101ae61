"""Best-fit packing of tokenised documents into sequences under several capacities.

Tokenising runs where the rows are.  The packing itself only needs the number of pieces of each length: pieces of one
length are interchangeable, so the plan is made on a histogram of at most ``capacity`` rows, whatever the corpus holds,
and then every piece looks up its own place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, doc_bytes, small_batches

#: Chunks of text whose ids a worker keeps at most, the longest chunk that it keeps, and bytes of text taken at a time.
CACHE_CHUNKS, CACHE_CHUNK_BYTES, BLOCK_BYTES = 900_000, 64, 2_000_000
#: Letters below this are composed already and lower-case one by one (but for U+0130).
PLAIN = "\u0180"


@dataclass(frozen=True)
class Limits:
    """Capacities of one sequence: tokens, documents, and attention cost (the sum of squared piece lengths)."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def fits(self, length: int) -> int:
        """How many pieces of this length one empty sequence takes."""
        return min(self.tokens // length, self.documents, self.attention // (length * length))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _ChunkIds(dict):
    """Packed ids of chunks without ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]
        self.marks = {m: np.array(self.tokenizer.encode(m.decode(), add_special_tokens=False).ids, "<u4").tobytes() for m in (b"", b".", b",")}
        self.letters = [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]
        # what ``learn`` takes for granted is tried on words of every kind, as another tokenizer would give wrong ids
        words = "Hello, World. don't U.S. na\u00efve \u00c0\u00c9 12.5 x_y (a) <|b|> \u00c9T\u00c9. ABC \u65e5\u672c".split()
        self.learn({w.encode() for w in words})
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        if b"".join(self[w.encode()] for w in words) != np.array(whole, "<u4").tobytes():
            raise ValueError(f"{path} is no lower-casing byte-level tokenizer that parts words at white space")
        self.clear()

    def learn(self, chunks: set[bytes]) -> None:
        """Adds the ids of chunks that are not known yet.

        The tokenizer lower-cases, and parts letters from what follows them.  So an ASCII chunk has the ids of its
        lower-case form, and letters before one full stop or comma have theirs, then the mark's.  Words of letters below
        U+0180, which normalisation leaves alone, go to the merges directly.
        """
        later = []
        for chunk in chunks:
            base, mark = chunk, b""
            if chunk.isascii():
                if b"<|" not in chunk:
                    base = chunk.lower()
                if base[-1] in b".," and base[-2:-1].isalpha():
                    base, mark = base[:-1], base[-1:]
            packed = self.get(base)
            if packed is None:
                if base.isalpha():
                    text = base.decode()
                else:
                    text = base.decode("utf-8", "replace")
                    if not text.isalpha() or max(text) >= PLAIN or "\u0130" in text:
                        later.append((chunk, text, base, mark))
                        continue
                    text = "".join([self.letters[b] for b in text.lower().encode()])
                ids = [t.id for t in self.merge(text)]
                packed = self[base] = self.pack[len(ids)](*ids) if len(ids) < 16 else np.array(ids, "<u4").tobytes()
            self[chunk] = packed + self.marks[mark] if mark else packed
        for (chunk, _, base, mark), e in zip(later, self.tokenizer.encode_batch_fast([x[1] for x in later], add_special_tokens=False), strict=True):
            self[base] = np.array(e.ids, "<u4").tobytes()
            self[chunk] = self[base] + self.marks[mark]

    def forget(self) -> None:
        """Keeps the table within bounds; long chunks are never kept."""
        if len(self) > CACHE_CHUNKS:
            self.clear()
        for chunk in [c for c in self if len(c) > CACHE_CHUNK_BYTES]:
            del self[chunk]


#: One table for each tokenizer and worker process: a worker that is used again keeps what it has learnt.
_KNOWN: dict[str, _ChunkIds] = {}


def _chunk_ids(path: str) -> _ChunkIds:
    if path not in _KNOWN:
        _KNOWN[path] = _ChunkIds(path)
    return _KNOWN[path]


def packed_ids(texts: list[bytes], path: str) -> Iterator[bytes]:
    """The ids of each text, four bytes each."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
    ids_of = _chunk_ids(path)
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= BLOCK_BYTES):
            some.append(texts[at].split())
            size += len(texts[at])
            at += 1
        new = {c for c in set().union(*some) if c not in ids_of}
        ids_of.learn(new)
        for chunks in some:
            yield b"".join(map(ids_of.__getitem__, chunks))
        if len(ids_of) > CACHE_CHUNKS or any(len(c) > CACHE_CHUNK_BYTES for c in new):
            ids_of.forget()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, piece_tokens: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut every ``piece_tokens`` ids.

    The tokenizer drops white space and never joins across it, so a text is the chain of its chunks between ASCII white
    space, and frequent chunks are encoded once a task.  A null or empty text has the end id alone.
    """
    path = tokenizer_path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * piece_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for doc_id, packed in zip(batch.column(0).to_pylist(), packed_ids(texts, path), strict=True):
                packed += end
                for at in range(0, len(packed), step):
                    part = packed[at : at + step]
                    doc.append(doc_id)
                    piece.append(at // step)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], limits: Limits, weights=(1.0, 0.05, 0.05), select: str = "norm"):
    """Vector best-fit decreasing over {length: pieces}.

    Returns arrays (length, rank_from, sequence_from, offset), sorted by length and rank, and the number of sequences:
    the pieces of a length with ranks from rank_from on take the sequences from sequence_from on, one each, at offset.
    A length opens new sequences only when no open one has room in every capacity.  Among those with room,
    ``select="norm"`` takes the least weighted norm of the residuals that would remain, ``"dot"`` the largest weighted
    product of demand and residuals; ties take the sequence opened first.
    """
    caps = np.array([limits.tokens, limits.documents, limits.attention], float)
    w = np.array(weights, float)
    base, many, free = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, 3))
    groups, opened, rows = 0, 0, []

    def add(first: int, n: int, left: np.ndarray) -> None:
        nonlocal base, many, free, groups
        if groups == len(base):
            base, many, free = np.resize(base, 2 * groups), np.resize(many, 2 * groups), np.resize(free, (2 * groups, 3))
        base[groups], many[groups], free[groups] = first, n, left
        groups += 1

    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        rank, left = 0, counts[length]
        if limits.fits(length) < 1:
            raise ValueError(f"a piece of {length} tokens fits no sequence of {limits}")
        while left:
            room = (free[:groups] >= need).all(axis=1)
            if room.any():
                which = np.flatnonzero(room)
                score = np.round((((free[which] - need) / caps) ** 2) @ w, 12) if select == "norm" else -np.round((free[which] / caps * (need / caps)) @ w, 12)
                g = which[np.lexsort((base[which], score))[0]]
            else:
                each = limits.fits(length)
                n = max(1, left // each)
                add(opened, n, caps.copy())
                opened += n
                g = groups - 1
            each = int(np.min(free[g] // need))
            n, each = (min(int(many[g]), left // each), each) if left >= each else (1, left)
            first, spare = int(base[g]), int(many[g]) - n
            used = limits.tokens - int(free[g][0])
            for k in range(each):
                rows.append((length, rank, first, used + k * length))
                rank += n
            left -= n * each
            after = free[g] - each * need
            if spare:
                base[g], many[g] = first + n, spare
                add(first, n, after)
            else:
                free[g] = after
        if groups > 512:  # forget what has no room for any length
            keep = np.flatnonzero((free[:groups] >= 1).all(axis=1))
            base[: len(keep)], many[: len(keep)], free[: len(keep)] = base[keep], many[keep], free[keep]
            groups = len(keep)
    out = np.array(rows, np.int64).reshape(-1, 4)
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3], opened


def _ranked(pieces: DataFrame) -> DataFrame:
    """Adds rank, 0 and up within a length.

    A length may be that of a third of all pieces.  Each length is dealt over about the square root of its count in
    buckets, numbered on their own, and the buckets' counts are summed before.
    """
    per_length = pieces.groupBy("length").agg(F.count("*").alias("n"))
    wide = per_length.select("length", F.ceil(F.col("n") / F.greatest(F.lit(256.0), F.sqrt("n"))).alias("buckets"))
    key = F.xxhash64("doc_id", "piece")
    # one row for each length, and no more lengths than tokens in a sequence: a bounded broadcast
    salted = pieces.join(F.broadcast(wide), "length").withColumn("bucket", F.pmod(key, F.col("buckets"))).drop("buckets")
    counts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(first, ["length", "bucket"]).withColumn("rank", F.col("at") + F.col("first")).drop("bucket", "at", "first")


def pack_pieces(pieces: DataFrame, limits: Limits = Limits(), weights=(1.0, 0.05, 0.05), select: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    The driver sees one row for each length (at most ``limits.tokens``), never pieces.  Repeated rows are packed as
    often as they stand there.
    """
    pieces = cut(pieces)
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths, ranks, sequences, offsets, _ = plan_bins(counts, limits, weights, select)
    keys = lengths * (1 << 42) + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(keys, length * (1 << 42) + rank, "right") - 1
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return _ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, limits: Limits = Limits(), end_id: int = 1, weights=(1.0, 0.05, 0.05), select: str = "norm") -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id; only documents longer than a sequence are cut.  An empty table
    gives an empty result.  Extra columns of ``docs`` are ignored.
    """
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, end_id, limits.tokens), limits, weights, select)
