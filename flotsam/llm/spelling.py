"""Grouping of spelling variants: words one edit apart, by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols.  Two words that are one edit apart have reduced words that are equal or one edit apart.
So every word gives the keys of its reduced word and of the reduced words around it, these meet the keys of the reduced
vocabulary in one join, and what meets is compared as it was written.  Of the two ends of a pair one gives the key: the
longer one, or for equal lengths the one with the lower symbol at the place that differs, so between them both ends cover
the whole neighbourhood and a pair comes up once.  Keys are polynomial hashes, each edit's worked out from prefix sums in
one step, so a word gives keys in proportion to its length however long it is, and words themselves are not copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Symbols of the reduced alphabet.  More of them part words better, and give more keys a word: about 3.5 a letter.
SYMBOLS = 8
#: Keys that a worker makes at a time.
BLOCK_KEYS = 2_000_000
#: Base of the polynomial, odd so that it has an inverse modulo 2^64, which serves to close the gap of a deletion.
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LETTERS = "A-Za-zÀ-ÿ"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dropped(word: Column, at: Column) -> Column:
    """The word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def noisy_words(docs: DataFrame, least: int = 6, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): every maximal run of letters with A-Z lower-cased, of ``least`` code points and more.

    The run loses one code point where ``every`` divides the crc32 of "<doc_id>:<run>", that at crc32 modulo its length; a
    null doc_id counts as no characters.  Null and empty texts have no words.
    """
    # a run shorter than ``least`` can't become a word, as code points are only taken away
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    lower = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _CAPITALS, _CAPITALS.lower())).otherwise(F.col("run")).alias("run"))
    hashed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    word = F.when(F.col("h") % every == 0, _dropped(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least)


def _symbols(points: np.ndarray) -> np.ndarray:
    """Code points hashed to symbols from 1."""
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(7)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1), BASE), dtype=np.uint64)])


def _block_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length: their own keys, and (index of the word, key) of the distinct keys that they give."""
    with np.errstate(over="ignore"):
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n)
        s, power = _symbols(points), _powers(n)[:n]
        before = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(s * power, axis=1, dtype=np.uint64)], axis=1)
        own = before[:, -1:]
        # taking one of a run of equal symbols away gives one key: that of its first
        first = np.concatenate([np.ones((len(words), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
        keys, of = [own[:, 0], (before[:, :-1] + (own - before[:, 1:]) * _INVERSE)[first]], [np.arange(len(words)), np.nonzero(first)[0]]
        for more in range(1, SYMBOLS):
            can = s + np.uint64(more) <= np.uint64(SYMBOLS)
            keys.append((own + np.uint64(more) * power)[can])
            of.append(np.nonzero(can)[0])
        return own[:, 0].astype(np.int64), np.concatenate(of), np.concatenate(keys).astype(np.int64)


def _grouped(words: list[str]) -> Iterator[list[int]]:
    """Indices of the words by length, in blocks of bounded keys."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        n = lengths[order[at]]
        most = max(1, BLOCK_KEYS // (SYMBOLS * n))
        end = min(at + most, int(np.searchsorted(lengths[order], n, "right")))
        yield order[at:end].tolist()
        at = end


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, keys = batch.column("word").to_pylist(), np.zeros(batch.num_rows, np.int64)
        for some in _grouped(words):
            keys[some] = _block_keys([words[i] for i in some])[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c) for c in ("id", "word", "n"))], names=["key", "b", "near", "near_n"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        for some in _grouped(words):
            _, of, keys = _block_keys([words[i] for i in some])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[some][of])], names=["key", "a"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, word, n, b, near, near_n): every pair of words (id, word, n) one inserted, deleted or replaced code point apart, once.

    ids are distinct longs and words distinct.  Either end may come first.
    """
    own = vocabulary.mapInArrow(_own, "key long, b long, near string, near_n long")
    around = vocabulary.select("id", "word").mapInArrow(_around, "key long, a long")
    # Spark sizes what a word gives as one row, and the words as their compressed file: neither may be broadcast by that
    met = around.join(own.hint("merge"), "key").where("a <> b").drop("key")
    both = met.join(vocabulary.withColumnRenamed("id", "a").hint("merge"), "a").where(F.levenshtein("word", "near", 1) == 1)
    # reduced words that are equal meet from both ends, and hashes of different ones may be equal
    once = both.groupBy(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.min(F.struct("a", "word", "n", "b", "near", "near_n")).alias("r"))
    return once.select("r.*")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root): the last of the forms (id, to) that follow each other; each round doubles how far they reach."""
    roots, left = scratch.measured("roots", forms.select("id", F.col("to").alias("root"), F.lit(True).alias("moved")), n=F.count(F.lit(1)))
    while left["n"]:
        ahead = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = roots.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        roots, left = scratch.measured("roots", step, n=F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)))
    return roots.select("id", "root")


def variants(words: DataFrame, least_n: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word of ``words`` (word) that occurs ``least_n`` times.

    form is the near word of largest n, the first in code-point order on ties, if that is at least ``times`` the word's own;
    root is where the forms end, the word itself if it has none.  Null words are left out; an empty table gives an empty
    result.
    """
    scratch = Scratch(words.sparkSession)
    counts = words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
    vocabulary = scratch.table("vocabulary", counts.withColumn("id", F.monotonically_increasing_id()))
    pairs = scratch.table("pairs", near_words(vocabulary))
    sides = pairs.select(F.col("a").alias("id"), "near", "near_n", F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("a").alias("other")))
    best = sides.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near", "other")).alias("best"))
    is_form = -F.col("best.o") >= times * F.col("n")
    formed = vocabulary.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(is_form, c).alias(k) for k, c in (("form", F.col("best.near")), ("form_n", -F.col("best.o")), ("to", F.col("best.other")))))
    formed = scratch.table("formed", formed)
    roots = _roots(formed.where("to IS NOT NULL").select("id", "to"), scratch)
    named = roots.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = formed.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    return scratch.last(out)


def spelling_sql() -> str:
    """DuckDB SQL for ``variants(noisy_words(documents))``: crc32 by its byte table, near words by what they are without one letter."""
    return """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (
  SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) + 1, 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM bytes, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
vocab AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN vocab b ON a.rest = b.word),
ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r FROM near),
formed AS (
  SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * v.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * v.n THEN r.other_n END AS form_n
  FROM vocab v LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.word = v.word),
chains AS (
  SELECT * FROM (WITH RECURSIVE chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
  SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL))
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN chains USING (word)
"""
