"""Language identification by a byte convolutional network trained in numpy on a bounded sample of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, small_batches

#: Bytes in a window, filter widths, filters of each width, size of a byte's vector.
WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4), 16, 8
#: Windows that pass through the network at a time.
BATCH_WINDOWS = 1024


@dataclass
class Model:
    """Byte vectors, one filter bank for each width, and the softmax layer over the pooled filters."""

    languages: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each filter tap what each byte adds: the byte vectors folded into the filters, two taps to a table."""
        out = []
        for bank in self.filters:
            taps = [(self.vectors @ bank[k]).astype(np.float32) for k in range(len(bank))]
            pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(1 << 16, -1) for k in range(0, len(taps) - 1, 2)]
            out.append((pairs, taps[-1] if len(taps) % 2 else None))
        return out

    def logits(self, windows: np.ndarray, tables) -> np.ndarray:
        """(n, languages) for n windows of bytes."""
        two = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        pooled = []
        for (pairs, single), bias, width in zip(tables, self.biases, WIDTHS, strict=True):
            n = WINDOW - width + 1
            total = pairs[0][two[:, :n]]
            for k, table in enumerate(pairs[1:], 1):
                total += table[two[:, 2 * k : 2 * k + n]]
            if single is not None:
                total += single[windows[:, width - 1 : width - 1 + n]]
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(pooled, axis=1) @ self.weights + self.offset


def windows_of(data: bytes) -> np.ndarray:
    """Windows that cover the whole text: side by side, the last one flush with the end; a short text is padded."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < WINDOW:
        return np.pad(raw, (0, WINDOW - len(raw)))[None]
    full = raw[: len(raw) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if len(raw) % WINDOW == 0 else np.concatenate((full, raw[None, -WINDOW:]))


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross entropy, every language weighted alike; gradients pass the maximum where it was taken."""
    rng = np.random.default_rng(seed)
    n_lang, n_feat = len(languages), FILTERS * len(WIDTHS)
    params = [rng.normal(0, 0.5, (256, VECTOR))]
    params += [rng.normal(0, (w * VECTOR) ** -0.5, (w * VECTOR, FILTERS)) for w in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, n_feat**-0.5, (n_feat, n_lang)), np.zeros(n_lang)]
    params = [p.astype(np.float32) for p in params]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = np.bincount(labels, minlength=n_lang) / max(1, len(labels))
    weight = (1 / (n_lang * np.maximum(share, 1e-9))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            x, y = windows[order[at : at + 64]], labels[order[at : at + 64]]
            vectors, filters, biases, dense, offset = params[0], params[1:4], params[4:7], params[7], params[8]
            e = vectors[x]
            pooled, picks = [], []
            for f, b, w in zip(filters, biases, WIDTHS, strict=True):
                n = WINDOW - w + 1
                patches = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), w * VECTOR, axis=1)[:, ::VECTOR][:, :n]
                conv = np.ascontiguousarray(patches).reshape(-1, w * VECTOR) @ f
                conv = conv.reshape(len(x), n, FILTERS)
                at_max = conv.argmax(axis=1)
                pooled.append(np.take_along_axis(conv, at_max[:, None], axis=1)[:, 0] + b)
                picks.append(at_max)
            z = np.concatenate(pooled, axis=1)
            h = np.maximum(z, 0)
            p = h @ dense + offset
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(y)), y] -= 1
            g *= (weight[y] / len(y))[:, None]
            back = (g @ dense.T) * (z > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[7], grads[8] = h.T @ g, g.sum(axis=0)
            for k, (f, w) in enumerate(zip(filters, WIDTHS, strict=True)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                where = picks[k][:, :, None] + np.arange(w)
                bytes_ = x[np.arange(len(x))[:, None, None], where]
                patch = vectors[bytes_].reshape(len(x), FILTERS, w * VECTOR)
                grads[1 + k] = np.einsum("bf,bfd->df", part, patch)
                grads[4 + k] = part.sum(axis=0)
                into = (part[:, :, None] * f.T[None]).reshape(-1, VECTOR)
                np.add.at(grads[0], bytes_.reshape(-1), into)
            step += 1
            for q, d, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(languages, params[0], [f.reshape(w, VECTOR, FILTERS) for f, w in zip(params[1:4], WIDTHS, strict=True)], list(params[4:7]), params[7], params[8])


def held_out() -> Column:
    """Rows that are never learnt from, by their doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, max_documents: int = 2400, windows_each: int = 4) -> Model | None:
    """A model from labelled rows that are not held out; None without any.

    Every language of such rows is learnt, from an equal part of ``max_documents`` rows, at least one: distinct texts, the
    lowest hashes first.  Of each text ``windows_each`` windows at hashed places are taken, so the driver gets a bounded
    number of bytes.  Only text and lang are used.
    """
    data = F.col("text").cast("binary")
    room = F.greatest(F.octet_length(data) - WINDOW, F.lit(0)) + 1
    windows = F.array(*(F.substring(data, F.pmod(F.xxhash64("doc_id", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(windows_each)))
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    texts = cut(known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id")))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"))
    each = max(1, max_documents // max(1, counts.count()))
    # hashes below a bound that lets half as many again pass, so that a language's task gets few rows
    low = F.pmod("h", F.lit(1 << 30))
    few = texts.join(F.broadcast(counts), "lang").where(low < (1.5 * each + 50) / F.col("n") * (1 << 30))
    chosen = few.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(low, "h"))).where(F.col("at") <= each).select("lang", "h", "doc_id")
    rows = known.join(F.broadcast(chosen), ["lang", "h", "doc_id"]).select("h", "doc_id", "lang", windows.alias("windows")).distinct().orderBy("h", "doc_id", "lang").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    x = np.concatenate([windows_of(bytes(w))[:1] for r in rows for w in r["windows"]])
    y = np.repeat([languages.index(r["lang"]) for r in rows], windows_each)
    return fit(x, y, languages)


def predict(docs: DataFrame, model: Model | None, columns: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``columns`` of docs, and columns named ``pred`` and ``score``: the language and the mean of the windows' logits over the whole text, as a softmax.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a model.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.select(*columns, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col("text").cast("binary").alias("_data"))
    schema = docs.select(*columns).schema.add(pred, "string").add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            n = len(columns)
            letters = batch.column(n).to_pylist()
            sums = np.zeros((batch.num_rows, len(model.languages) if model else 1))
            counts = np.zeros(batch.num_rows)
            owners, parts, size = [], [], 0

            def flush() -> None:
                nonlocal size
                windows, owner = np.concatenate(parts), np.concatenate(owners)
                for at in range(0, len(windows), BATCH_WINDOWS):
                    np.add.at(sums, owner[at : at + BATCH_WINDOWS], model.logits(windows[at : at + BATCH_WINDOWS], tables))
                np.add.at(counts, owner, 1)
                owners.clear()
                parts.clear()
                size = 0

            for k, (ok, data) in enumerate(zip(letters, batch.column(n + 1), strict=True)):
                if ok and model:
                    w = windows_of(data.as_py())
                    parts.append(w)
                    owners.append(np.full(len(w), k))
                    size += len(w)
                    if size >= BATCH_WINDOWS:
                        flush()
            if parts:
                flush()
            mean = sums / np.maximum(counts, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            said = [model.languages[b] if ok and model else "und" for ok, b in zip(letters, best, strict=True)]
            sure = np.where(np.array(letters, bool) & (model is not None), p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(said, pa.string()), pa.array(sure)], names=[*columns, pred, score])

    return kept.mapInArrow(run, schema)


def identify(docs: DataFrame, max_documents: int = 2400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, by a model learnt from the rows not held out.

    Texts that are null, empty or without letters are ``und`` with score 0; long texts are scored window by window to
    their end; repeated rows give repeated results, an empty table an empty one; without labelled rows all are ``und``.
    """
    model = train(docs, max_documents)
    return predict(docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least_score: float = 0.5, max_documents: int = 2400) -> DataFrame:
    """The rows of docs whose language is told with at least ``least_score``; columns as in docs.

    Null texts and those without letters go; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = train(docs, max_documents)
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = predict(docs, model, docs.columns, pred, score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= least_score)).select(*docs.columns)
