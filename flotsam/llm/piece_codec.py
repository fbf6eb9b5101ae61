"""SentencePiece vocabularies: encoding by an Aho-Corasick automaton that drives a Viterbi search, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_bytes, small_batches

#: The mark that stands for a space; chunks whose ids a worker keeps at most, and their length.
MARK, CACHE_CHUNKS, CACHE_CHARS = "▁", 700_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec(dict):
    """A vocabulary of scored pieces; as a mapping, the packed ids of text chunks.

    The best segmentation has the largest sum of scores; ties take the longer last piece.  A character without a piece
    becomes its UTF-8 bytes' pieces at a score below all others.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], skip: set[int]):
        import ahocorasick

        super().__init__()
        self.table = [p.replace(MARK, " ").encode() for p, _ in pieces]
        self.byte_ids = byte_ids
        for b, i in byte_ids.items():
            self.table[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        usable = {p: (len(p), s, i) for i, (p, s) in enumerate(pieces) if i not in skip and i not in byte_ids.values() and p}
        for p, value in usable.items():
            self.automaton.add_word(p, value)
        self.automaton.make_automaton()
        self.letters = {p for p in usable if len(p) == 1}
        self.floor = min((s for _, s, _ in usable.values()), default=0.0) - 10.0
        # where no piece runs over a space mark or a line end, texts may be cut there without changing the best path
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p and len(p) > 1 for p in usable)
        self.chunks = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if apart else r"(?s:.+)").findall

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        skip = {i for i in ids if m.is_unknown(i) or m.is_control(i) or m.is_unused(i)}
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in ids], byte_ids, skip)

    def best(self, text: str) -> list[int]:
        """One pass: matches come by their end, shorter ones along output links, and each relaxes the score there."""
        n = len(text)
        score, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
        done = 0
        for end, (length, gain, piece) in self.automaton.iter(text):
            end += 1
            while done < end:  # a place without a match can only be left by bytes
                done += 1
                if text[done - 1] not in self.letters:
                    score[done], back[done] = score[done - 1] + self.floor, (done - 1, -1)
            value = score[end - length] + gain
            if value > score[end]:
                score[end], back[end] = value, (end - length, piece)
        while done < n:
            done += 1
            score[done], back[done] = score[done - 1] + self.floor, (done - 1, -1)
        out, at = [], n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(text[start:at].encode())]
            at = start
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        packed = np.array(self.best(chunk), "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids, four bytes each, of a text with a space put before it; an empty text has none."""
        return b"".join(map(self.__getitem__, self.chunks(MARK + text.replace(" ", MARK)))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        """The UTF-8 text of packed ids, without the space put before it."""
        text = b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return text[1:] if text[:1] == b" " else text


_LOADED: dict[str, PieceCodec] = {}


def _codec(path: str) -> PieceCodec:
    if path not in _LOADED:
        _LOADED[path] = PieceCodec.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text; a null text has null ids, an empty one none."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            ids = [None if (x := d.as_py()) is None else np.frombuffer(codec.encode(x.decode("utf-8", "replace")), "<u4").astype(np.int32) for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text, bytes that are no UTF-8 the replacement character."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [None if not x.is_valid else codec.decode(np.asarray(x.values, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_crc32, round_trip) for every row of docs, each text encoded and decoded again.

    round_trip says that decoding gives the text back, with space marks as spaces.  Null texts count as empty: no ids,
    checksum 0.  Long texts are encoded whole, part by part between space marks and line ends.  Repeated rows give
    repeated results, an empty table an empty one; extra columns are ignored.
    """
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        is_byte = np.zeros(len(codec.table), bool)
        is_byte[list(codec.byte_ids.values())] = True
        mark = MARK.encode()
        for batch in batches:
            n, as_bytes, crc, same = [], [], [], []
            for d in batch.column(1):
                data = d.as_py() or b""
                packed = codec.encode(data.decode("utf-8", "replace"))
                n.append(len(packed) // 4)
                as_bytes.append(int(np.count_nonzero(is_byte[np.frombuffer(packed, "<u4")])))
                crc.append(zlib.crc32(packed))
                same.append(codec.decode(packed) == data.replace(mark, b" "))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, as_bytes, crc)), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    small_batches(docs.sparkSession)
    return doc_bytes(docs).mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
