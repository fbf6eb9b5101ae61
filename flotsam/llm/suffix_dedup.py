"""Removal of long byte strings that occur more than once, with suffix arrays over shards of the corpus.

Every window of ``length`` bytes picks one anchor: of the grams of ``gram`` bytes in it, the one with the least hash,
leftmost on ties.  Equal windows pick equal grams, so only windows under one anchor key can be equal.  Consecutive
windows with one anchor form a segment.  Segments are counted by key and content: contents that stand twice are repeated
throughout, keys with one content are done, and what is left - the rims of repeated passages - is dealt by key to
shards, each of which is sorted by induced sorting; permuted common prefixes of at least ``length`` mark the windows.

``remove_passages`` looks for passages of many words, however short the words: it runs the same over texts in which every
word is four bytes of its hash, where a passage of n words is a string of 4 n bytes.

A key under which very many contents meet is split: its windows reach either far to the left or far to the right of what
they are known to share, so they are keyed again by that longer shared part, until contents are few or all the same.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_bytes, fresh, small_batches, spread_join
from .suffix_array import permuted_lcp, suffix_array

#: Bytes whose windows are hashed at a time, at most 2^20: a position takes the low 20 bits of an order key.
BLOCK = 1 << 19
#: Bytes that a shard is given before it is sorted.
SHARD_BYTES = 2_000_000
#: Contents under one key that go to a shard as they are.
KEY_CONTENTS = 500
_BASE = 0x9E3779B97F4A7C15
#: Parts of a window, beside what a key's rows share, of which one may differ in rows that go to a shard.
PARTS = 8
#: Bytes that stand for a word, and those of a gram of words.
SYMBOL, WORD_GRAM = 4, 32
#: As SHARD_BYTES, for passages, where two kinds of shards are sorted.
PASSAGE_SHARD_BYTES = 750_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _segments(block: np.ndarray, starts: np.ndarray, length: int, gram: int, powers) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, key) of the segments of the windows at ``starts`` (ascending) of a block."""
    up, down = powers
    n = len(block)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(block.astype(np.uint64) * up[:n], dtype=np.uint64)))
    key = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << 20) - 1)
    least = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(new[1:], len(starts)) - 1
    return starts[new], starts[last], anchor[new], key[anchor[new]]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every run outside ASCII white space, and the byte after its last."""
    solid = _solid(np.frombuffer(data, np.uint8))
    edges = np.diff(np.concatenate((np.zeros(1, np.int8), solid.view(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _solid(data: np.ndarray) -> np.ndarray:
    return (data != 32) & ((data < 9) | (data > 13))


def word_symbols(data: bytes) -> bytes:
    """SYMBOL bytes of hash for each word."""
    return _symbols(data, *word_bounds(data))


def _symbols_of(texts: list[bytes]) -> list[bytes]:
    """``word_symbols`` of every text, worked out for about a block of texts at a time."""
    out, some, size = [], [], 0
    for n, text in enumerate(texts, 1):
        some.append(text)
        size += len(text) + 1
        if size >= BLOCK or n == len(texts):
            data = b" ".join(some)
            first, last = word_bounds(data)
            ends = (np.searchsorted(first, np.cumsum([len(x) + 1 for x in some])) * SYMBOL).tolist()
            symbols = _symbols(data, first, last)
            out += [symbols[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            some, size = [], 0
    return out


def _symbols(data: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
    symbols, n = np.empty(len(first), np.uint64), 0
    while n < len(first):
        at = first[n]
        to = int(np.searchsorted(last, at + BLOCK - 1, "right"))
        if to <= n:  # a word longer than a block
            symbols[n] = int.from_bytes(hashlib.sha256(data[at : last[n]]).digest()[:8], "little")
            n += 1
            continue
        up, down = _word_powers()
        part = np.frombuffer(data, np.uint8)[at : last[to - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
        symbols[n:to] = _mix((sums[last[n:to] - at] - sums[first[n:to] - at]) * down[first[n:to] - at])
        n = to
    return (symbols >> np.uint64(32)).astype("<u4").tobytes()


@functools.cache
def _word_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column that tells documents apart, and its name: doc_id, if that is one row's own throughout.

    Else it is a text of doc_id and the text's md5, so that rows which share a doc_id, or have none, are documents of their
    own, and only rows that are equal in both have one key.
    """
    name = fresh(docs, "document")
    shared = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1)
    if shared.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return docs.withColumn(name, F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))), name


def _id_kind(docs: DataFrame) -> tuple[str, pa.DataType]:
    return ("string", pa.string()) if dict(docs.dtypes)["doc_id"] == "string" else ("long", pa.int64())


def _scan(docs: DataFrame, length: int, gram: int, below_words: int | None = None, by_words: bool = False) -> DataFrame:
    """(key, content, doc_id, start, span, total, copies): the segments of every text, or of its word symbols.

    ``below_words`` leaves out windows with at least so many whole words.

    span packs the segment's bytes and its anchor's place; where a text repeats a segment over and over with one step,
    as in runs of one character, one row stands for all ``copies`` and ``total`` covers them.  Windows and grams of word
    symbols begin where a symbol does.
    """
    unit = SYMBOL if by_words else 1

    def blocks(ids: list, texts: list[bytes]):
        """Texts of at least ``length`` bytes, several to a block, long ones over several blocks that overlap."""
        parts, size = [], 0
        for doc_id, data in zip(ids, texts, strict=True):
            for at in range(0, len(data) - length + 1, BLOCK - length + unit):
                part = data[at : at + BLOCK]
                if size + len(part) > BLOCK:
                    yield parts
                    parts, size = [], 0
                parts.append((doc_id, at, part))
                size += len(part)
        if parts:
            yield parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        powers = _powers(BLOCK)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            if by_words:
                texts = _symbols_of(texts)
            for parts in blocks(batch.column(0).to_pylist(), texts):
                whole = b"".join(p[2] for p in parts)
                sizes = np.array([len(p[2]) // unit for p in parts])
                begin = np.cumsum(sizes) - sizes
                windows = sizes - length // unit + 1
                starts = np.arange(int(windows.sum())) + np.repeat(begin - (np.cumsum(windows) - windows), windows)
                if below_words is not None:
                    solid = _solid(np.frombuffer(whole, np.uint8))
                    # a word begins where white space ends; all but the last of those in a window end there too
                    begun = np.concatenate((np.zeros(2, np.int64), np.cumsum(solid[1:] & ~solid[:-1])))
                    starts = starts[begun[starts + length] - begun[starts + 1] <= below_words]
                    if not len(starts):
                        continue
                block = np.frombuffer(whole, "<u4" if by_words else np.uint8)
                first, last, anchor, key = _segments(block, starts, length // unit, gram // unit, powers)
                view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
                content = np.fromiter((digest(view[a : b + length]) for a, b in zip((first * unit).tolist(), (last * unit).tolist(), strict=True)), np.uint64, len(first))
                owner = np.searchsorted(begin, first, "right") - 1
                again = np.append(False, (key[1:] == key[:-1]) & (content[1:] == content[:-1]) & (owner[1:] == owner[:-1]) & (first[1:] == last[:-1] + 1))
                head = np.flatnonzero(~again)
                copies = np.diff(np.append(head, len(first)))
                tail = head + copies - 1
                size = (last - first) * unit + length
                place = np.array([p[1] for p in parts], np.int64) - begin * unit
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[head].view(np.int64)),
                        pa.array(content[head].view(np.int64)),
                        pa.array([p[0] for p in parts], id_type).take(pa.array(owner[head])),
                        pa.array((first * unit + place[owner])[head]),
                        pa.array((size * 4096 + (anchor - first) * unit)[head]),
                        pa.array((last[tail] - first[head]) * unit + length),
                        pa.array(copies.astype(np.int64)),
                    ],
                    names=["key", "content", "doc_id", "start", "span", "total", "copies"],
                )

    small_batches(docs.sparkSession)
    kind, id_type = _id_kind(docs)
    schema = f"key long, content long, doc_id {kind}, start long, span long, total long, copies long"
    least = 2 * (length // SYMBOL) - 1 if by_words else length
    return doc_bytes(docs).where(F.octet_length("data") >= least).mapInArrow(run, schema)


def _row(kind: str) -> str:
    return f"key long, content long, doc_id {kind}, start long, shared_from int, shared_to int, data binary"


def _fetch(docs: DataFrame, wanted: DataFrame, gram: int, by_words: bool = False) -> DataFrame:
    """The bytes of wanted segments (key, content, doc_id, start, span), one row each."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "content", "start", "span")).alias("parts"))
    kind, id_type = _id_kind(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            texts = [x.as_py() or b"" for x in batch.column(1)]
            if by_words:
                texts = _symbols_of(texts)
            for doc_id, data, parts in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                for p in parts:
                    size, at = divmod(p["span"], 4096)
                    part = data[p["start"] : p["start"] + size]
                    if len(part) == size:
                        for column, value in zip(rows, (p["key"], p["content"], doc_id, p["start"], at, at + gram, part), strict=True):
                            column.append(value)
            yield _record(rows, id_type)

    # rows of one key have one text
    texts = doc_bytes(docs) if kind == "long" else doc_bytes(docs).dropDuplicates(["doc_id"])
    return texts.join(lists.hint("merge"), "doc_id").select("doc_id", "data", "parts").mapInArrow(run, _row(kind))


def _record(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), id_type, pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["key", "content", "doc_id", "start", "shared_from", "shared_to", "data"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)


def _split(rows: DataFrame, length: int) -> DataFrame:
    """Each row's windows under two new keys: those that reach further left, and those that reach further right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, _, doc_id, start, lo, hi, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reach = -(-(length - (hi - lo)) // 2)
                cut_at = min(lo - reach, len(data) - length)
                for side, a, b, new_lo, new_hi in ((b"l", 0, cut_at, lo - reach, hi), (b"r", max(0, lo - reach + 1), min(lo, len(data) - length), lo, hi + length - (hi - lo) - reach + 1)):
                    if a > b:
                        continue
                    part = data[a : b + length]
                    new_key = xxhash.xxh3_64_intdigest(data[new_lo:new_hi] + side, key & ((1 << 64) - 1))
                    for column, value in zip(out, (signed(new_key), signed(xxhash.xxh3_64_intdigest(part)), doc_id, start + a, new_lo - a, new_hi - a, part), strict=True):
                        column.append(value)
            yield _record(out, id_type)

    kind, id_type = _id_kind(rows)
    return rows.mapInArrow(run, _row(kind))


def _alike(rows: list[tuple], length: int) -> list[tuple]:
    """Those of one key's rows (doc_id, start, lo, hi, data), alike from lo to hi, that may share a window with another.

    Equal windows hold lo to hi at one place, so of what they have besides they share at least all but one of PARTS parts
    around it, so many on the left and the others on the right.
    """
    around, seen = [], Counter()
    for _, _, lo, hi, data in rows:
        more = length - (hi - lo)
        if more <= 0:
            return rows
        sides = ((k, k * more // PARTS, (PARTS - 1 - k) * more // PARTS) for k in range(PARTS))
        around.append([(k, data[lo - left : hi + right]) for k, left, right in sides if left <= lo and right <= len(data) - hi])
        seen.update(around[-1])
    return [row for row, own in zip(rows, around, strict=True) if any(seen[x] > 1 for x in own)]


def _shards(rows: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(doc_id, start, total): the repeated ranges within the rows of each key, by suffix arrays of whole keys."""

    def mark(ids: list, starts: list, parts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts])
        joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 2
        end = np.cumsum(sizes + 1) - 1
        joined[end] = 1
        text = np.append(joined, 0)
        left = np.append(np.repeat(end, sizes + 1) - np.arange(len(joined)), 0)
        plcp, before = permuted_lcp(text, suffix_array(text), left)
        hit = np.flatnonzero(plcp >= length)
        marked = np.zeros(len(text), bool)
        marked[hit] = True
        marked[before[hit]] = True
        at = np.flatnonzero(marked)
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else np.empty(0, np.int64)
        first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        owner = np.searchsorted(end, first)
        own_start = np.array(starts, np.int64)[owner] + first - (end[owner] - sizes[owner])
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(owner)), pa.array(own_start), pa.array(last - first + length)], names=["doc_id", "start", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, parts, size = [], [], [], 0
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, of_key in itertools.groupby(each, key=lambda row: row[0]):
            for doc_id, start, _, _, data in _alike([row[1:] for row in of_key], length):
                ids.append(doc_id)
                starts.append(start)
                parts.append(data)
                size += len(data)
            if size >= shard_bytes:
                yield mark(ids, starts, parts)
                ids, starts, parts, size = [], [], [], 0
        if parts:
            yield mark(ids, starts, parts)

    kind, id_type = _id_kind(rows)
    # by a hash of their own: where a join dealt the rows by key, Spark leaves out repartition("key"), and may then read the
    # join's shuffle by its writers or in parts, which takes a key apart
    if "shared_from" not in rows.columns:  # nothing is known of what a key's rows share, so all are sorted
        rows = rows.withColumns({"shared_from": F.lit(0), "shared_to": F.lit(length)})
    dealt = rows.select("key", "doc_id", "start", "shared_from", "shared_to", "data").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"doc_id {kind}, start long, total long")


def repeated_ranges(docs: DataFrame, length: int = 400, gram: int = 200, below_words: int | None = None, by_words: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start, total): byte ranges whose union is every byte covered by a repeated string of ``length`` bytes.

    doc_id is a long or a text, and rows that share it have one text.  ``below_words`` counts only strings with fewer whole
    words; ``by_words`` takes the texts' word symbols for their bytes.
    """
    scratch = Scratch(docs.sparkSession)
    found, n = scratch.counted("found", _scan(docs, length, gram, below_words, by_words))
    contents = _counted_contents(found, n, F.sum("copies"), ["doc_id", "start", "span"], scratch)
    ranges = [_twice(found, n, contents).select("doc_id", "start", "total")]
    rows = scratch.table("rows", _fetch(docs, contents.where("contents > 1").select("key", "content", "doc_id", "start", "span"), gram, by_words))
    hot = contents.where(F.col("contents") > KEY_CONTENTS).select("key").distinct()
    ranges.append(_shards(rows.join(hot, "key", "left_anti"), length, shard_bytes))
    rows, step = rows.join(hot, "key", "left_semi"), 0
    while True:
        rows, n = scratch.counted(f"split{step}", _split(rows, length))
        if not n:
            break
        groups = _counted_contents(rows, n, F.count("*"), ["doc_id", "start"], scratch, f"groups{step}")
        ranges.append(_twice(rows, n, groups).select("doc_id", "start", F.octet_length("data").cast("long").alias("total")))
        one_each = rows.join(groups.where("contents > 1").select("key", "content", "doc_id", "start", "contents"), ["key", "content", "doc_id", "start"])
        ranges.append(_shards(one_each.where(F.col("contents") <= KEY_CONTENTS).select(*rows.columns), length, shard_bytes))
        rows = one_each.where((F.col("contents") > KEY_CONTENTS) & (F.col("shared_to") - F.col("shared_from") < length)).select(*rows.columns)
        step += 1
    out = ranges[0]
    for more in ranges[1:]:
        out = out.unionByName(more)
    return scratch.last(out)


def _counted_contents(found: DataFrame, n: int, copies, first: list[str], scratch: Scratch, name: str = "contents") -> DataFrame:
    """(key, content, n, contents, *first) for keys with more than one row: the copies of each content, the number of
    contents of its key, and the least place of a copy.  ``found`` has ``n`` rows."""
    contents = scratch.table(f"{name}-all", found.groupBy("key", "content").agg(copies.alias("n"), F.min(F.struct(*first)).alias("at")))
    keys = scratch.table(f"{name}-keys", contents.groupBy("key").agg(F.count("*").alias("contents"), F.sum("n").alias("all")).where("all > 1").drop("all"))
    joined = spread_join(contents, keys, ["key"], ["content"], n, sizes=keys.select("key", F.col("contents").alias("n")))
    return scratch.table(name, joined.select("key", "content", "n", "contents", "at.*"))


def _twice(found: DataFrame, n: int, contents: DataFrame) -> DataFrame:
    """The rows of found, ``n`` of them, whose content stands twice; those of one frequent content are dealt over tasks."""
    sizes = contents.where("n > 1").select("key", "content", "n")
    return spread_join(found, sizes.drop("n"), ["key", "content"], ["doc_id", "start"], n, sizes=sizes)


def _merged(docs: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """docs with one more column: each document's ranges as one array, null where it has none."""
    name = fresh(docs, "ranges")
    lists = ranges.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "total")).alias(name))
    return docs.join(lists.hint("merge"), key, "left").select(*docs.columns, name)  # ranges grow with the corpus


def _texts(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), "text")


def kept_bytes(data: bytes, ranges: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and its maximal removed runs (from, to)."""
    spans: list[list[int]] = []
    for a, b in sorted((r["start"], min(len(data), r["start"] + r["total"])) for r in ranges or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        elif a < b:
            spans.append([a, b])
    left, at = [], 0
    for a, b in spans:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    return b"".join(left), [(a, b) for a, b in spans]


def repeat_digests(docs: DataFrame, length: int = 400, gram: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input.  Null and empty texts, and those under ``length`` bytes, lose nothing.  A repeated
    row is another document: with at least ``length`` bytes both lose all.  Rows that share a doc_id, or have none, are
    documents of their own.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha = [], [], [], []
            for data, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py() or b""
                kept, gone = kept_bytes(data, ranges)
                n.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(gone))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed, key = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ranges = repeated_ranges(_texts(keyed, key), length, gram)
    merged = _merged(keyed.select("doc_id", F.col("text").cast("binary").alias("text"), key), ranges, key).drop(key)
    return merged.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 200) -> DataFrame:
    """``docs`` without the repeated bytes in ``text``; a character that is cut through goes whole.

    Documents of which nothing is left are dropped; null and empty texts stay as they are.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for data, ranges in zip(batch.column(at), batch.column(len(columns)).to_pylist(), strict=True):
                data = data.as_py()
                texts.append(None if data is None else kept_bytes(data, ranges)[0].decode("utf-8", "ignore") if ranges else data.decode("utf-8", "replace"))
            arrays = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
            out = pa.RecordBatch.from_arrays(arrays, names=columns)
            gone = pa.array([bool(r) and not t for r, t in zip(batch.column(len(columns)).to_pylist(), texts, strict=True)], pa.bool_())
            yield out.filter(pa.compute.invert(gone))

    keyed, key = _keyed(docs)
    ranges = repeated_ranges(_texts(keyed, key), length, gram)
    merged = _merged(keyed.withColumn("text", F.col("text").cast("binary")), ranges, key).drop(key)
    return merged.mapInArrow(run, docs.schema)


def _word_spans(data: bytes, ranges: list[dict] | None, words: int) -> list[dict]:
    """The bytes from the first to the last of the whole words in each merged range of symbols, if there are ``words``."""
    if not ranges:
        return []
    first, last = word_bounds(data)
    spans = []
    for a, b in kept_bytes(bytes(SYMBOL * len(first)), ranges)[1]:
        a, b = -(-a // SYMBOL), b // SYMBOL
        if b - a >= words:
            spans.append({"start": int(first[a]), "total": int(last[b - 1] - first[a])})
    return spans


def remove_passages(docs: DataFrame, words: int = 51, length: int = 400, gram: int = 200) -> DataFrame:
    """``docs`` without passages of at least ``words`` words, or ``length`` bytes of fewer words, that stand elsewhere too.

    Words are runs outside ASCII white space; passages are the same words, whatever white space parts them, so of a
    repeated string of bytes parts of words may stay at its ends where it holds ``words`` whole ones.  All copies go, as
    in ``remove_repeats``, and so do documents of which no word is left; null and empty texts stay as they are.
    """
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, keep = [], []
            for data, ranges, symbols in zip(batch.column(at), *(batch.column(len(columns) + k).to_pylist() for k in (0, 1)), strict=True):
                data = data.as_py()
                spans = [*(ranges or []), *_word_spans(data or b"", symbols, words)]
                texts.append(None if data is None else kept_bytes(data, spans)[0].decode("utf-8", "ignore") if spans else data.decode("utf-8", "replace"))
                keep.append(not spans or bool(texts[-1].strip(" \t\n\v\f\r")))
            arrays = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep, pa.bool_()))

    keyed, key = _keyed(docs)
    by_words = repeated_ranges(_texts(keyed, key), SYMBOL * words, WORD_GRAM, by_words=True, shard_bytes=PASSAGE_SHARD_BYTES)
    by_bytes = repeated_ranges(_texts(keyed, key), length, gram, below_words=words, shard_bytes=PASSAGE_SHARD_BYTES)
    merged = _merged(keyed.withColumn("text", F.col("text").cast("binary")), by_bytes, key)
    return _merged(merged, by_words, key).drop(key).mapInArrow(run, docs.schema)
