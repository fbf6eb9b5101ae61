"""Token files, whitening and spelling variants against plain versions."""

import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flotsam.llm import common, spelling, token_files, whitening

ODD = [
    (7, "Hello, World! naïve café", "a", 1),
    (3, None, "b", 2),
    (3, "", "c", 3),
    (9, "the cat sat on the mat " * 3000, "d", 4),
    (7, "Hello, World! naïve café", "e", 5),
    (7, "another text under the same id", "f", 6),
    (None, "no id", "g", 7),
    (1, "日本語 \U0001f600 \t\n x", "h", 8),
]


def odd_documents(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, ids string, n int").repartition(3)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_tokenizer())


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)
        got, used = token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data + b"next", np.uint8), n)
        assert (got == ranks).all() and used == len(data)


@pytest.mark.parametrize("shard, block", [(8_000_000, 1 << 20), (12, 8)])
def test_token_files_hold_the_tokenizers_ids(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    folder = f"{tmp_path}/out"
    manifest = token_files.write_token_files(odd_documents(spark), folder)
    assert (manifest.count() > 1) == (shard == 12)
    (tmp_path / "out" / "shard-000000-0000-left-behind").write_bytes(b"of a lost attempt")
    rows = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    t = tokenizer()
    want = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x, *_ in ODD]
    got = [(r["doc_id"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))) for r in rows]
    by = lambda p: (p[0] is not None, p[0] or 0, p[1])
    assert sorted(got, key=by) == sorted(want, key=by)
    assert [g[0] for g in got] == [None, 1, 3, 3, 7, 7, 7, 9]
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_frequent_ids_take_a_byte_and_damage_is_seen(spark, tmp_path):
    folder = f"{tmp_path}/out"
    docs = spark.createDataFrame([(i, "so it goes " * 50) for i in range(20)], "doc_id long, text string")
    name = token_files.write_token_files(docs.coalesce(1), folder).first()["name"]
    n_ids = 20 * 151
    assert os.path.getsize(f"{folder}/{name}") == 8 + 24 + 20 * 17 + -(-n_ids // 4) + n_ids + 4
    content = bytearray(open(f"{folder}/{name}", "rb").read())
    content[500] ^= 1
    open(f"{folder}/{name}", "wb").write(content)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, folder).collect()


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_digests(odd_documents(spark).limit(0)).collect() == []


def test_token_digests_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t, at = tokenizer(), 0
    got = {r["doc_id"]: r for r in token_files.token_digests(docs).collect()}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), crc)
        at += len(ids)
    assert len(got) == docs.count()


def plain_whitening(vectors, k, once=False):
    """(sums, covariance, eigenvalues) of whole vectors, every row on its own."""
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    fit = np.unique(x, axis=0) if once else x
    c = fit - fit.sum(0) / len(fit)
    v = c.T @ c / len(fit)
    return x, fit, v, np.linalg.eigh(v)[0][::-1][:k]


@pytest.mark.parametrize("weights", ["count", "one"])
@pytest.mark.parametrize("hot", [False, True])
def test_whitening_equals_plain(spark, monkeypatch, weights, hot):
    monkeypatch.setattr(common, "LEAST_HOT", 20 if hot else 1000)
    rng = np.random.default_rng(4)
    vectors = [rng.normal(0, [3, 2, 1, 0.5, 0.1]).tolist() for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500 + i, vectors[3]) for i in range(80)] + [(None, vectors[3]), (3, vectors[4])]
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] + [0.0] * 4), (904, [float("-inf")] + [0.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id long, embedding array<double>, x string, n int").repartition(4)
    got = whitening.component_rows(whitening.whiten(df, components=3, weights=weights)).collect()
    x, fit, v, values = plain_whitening([r[1] for r in rows], 3, weights == "one")
    assert len(got) == 3 * len(rows)
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in rows for _ in range(3))
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    found = defaultdict(list)
    for r in got:
        found[r["vec_id"]].append(r)
    deviation = {i: sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for (i, _), row in zip(rows, x) if i != 3}
    vectors3 = np.linalg.eigh(v)[1][:, ::-1][:, :3]
    z = (x - fit.sum(0) / n) @ vectors3 / np.sqrt(values)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        if r["vec_id"] != 3:
            assert r["deviation"] == deviation[r["vec_id"]]
    for c in (1, 2, 3):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c}
        for sign in (1, -1):
            if all(abs(mine[i] * sign - w) < 1e-8 for (i, _), w in zip(rows, z[:, c - 1]) if i != 3):
                break
        else:
            raise AssertionError(c)


def test_whitening_of_flat_equal_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    equal = whitening.component_rows(whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25]) for i in range(3)], schema))).collect()
    assert len(equal) == 6 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in equal} == {(0, None, None, None)}
    line = whitening.component_rows(whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], schema))).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert all(r["explained"] == pytest.approx(1.0) for r in line if r["component"] == 1) and max(r["identity_error"] for r in line) < 1e-9
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], schema))


def test_deviation_of_far_vectors_is_exact(spark):
    far = [[1e12, 0.0], [-1e12, 1.0], [5.0, 2.0]]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>")).collect()}
    x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for v in far]
    s = [sum(c) for c in zip(*x)]
    assert got == {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    rows = whitening.component_rows(whitening.whiten(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>"))).collect()
    assert {r["vec_id"]: r["deviation"] for r in rows}[0] is None


def plain_words(docs):
    import re

    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return out


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, least=5):
    counts = {w: n for w, n in counts.items() if n >= least}
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    best = {w: min(v, key=lambda o: (-counts[o], o)) for w, v in near.items() if v}
    form = {w: b if (b := best.get(w)) and counts[b] >= 5 * counts[w] else None for w in counts}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_equal_plain(spark):
    rng = random.Random(3)
    words = []
    for letters in ("ab", "abcdefgh", "aàÀé"):
        base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)]
        for w in base:
            k = rng.randrange(len(w))
            words += [w] * rng.choice([3, 5, 30, 200]) + [w[:k] + w[k + 1 :]] * rng.choice([0, 5, 7, 40]) + [w[:k] + rng.choice(letters) + w[k + 1 :]] * rng.choice([0, 6, 26])
    words += ["aaaaaaa"] * 5 + ["aaaaaaaa"] * 25 + ["aaaaaaaaa"] * 125 + ["aaaaaaaaaa"] * 625 + [None] * 9
    rng.shuffle(words)
    got = spelling.variants(spark.createDataFrame([(w,) for w in words], "word string").repartition(5))
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_variants(Counter(w for w in words if w))
    assert got.count() == len({w for w, n in Counter(words).items() if w and n >= 5})


def test_near_words_have_keys_in_common():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 12)
        a = "".join(rng.choice("abcdefghijàÿ") for _ in range(n))
        k = rng.randrange(n)
        for b in (a[:k] + a[k + 1 :], a[:k] + rng.choice("xyzß") + a[k + 1 :]):
            if b and is_near(a, b):
                keys = {w: spelling._block_keys([w]) for w in (a, b)}
                assert keys[b][0][0] in keys[a][2] or keys[a][0][0] in keys[b][2]
        _, of, keys = spelling._block_keys([a, a[::-1]])
        assert len(set(keys[of == 0].tolist())) == (of == 0).sum() <= 1 + n + n * (spelling.SYMBOLS - 1)


def test_words_of_odd_documents(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(20_000))
    docs = [(1, None), (2, ""), (None, "Straße straßE Ångström ångström ÷÷÷÷÷÷ x×xxxxx"), (3, "short 12345 ______"), (3, "short SHORTER"), (5, long + " " + long[:777] + "Z" + long[777:])]
    docs += [(k, f"colour colourful colors {'color' * (k % 3)} COLOUR {long}") for k in range(10, 900)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    words = spelling.noisy_words(df)
    want = plain_words(docs)
    assert {r["word"]: r["count"] for r in words.groupBy("word").count().collect()} == want
    assert {tuple(r[c] for c in COLUMNS) for r in spelling.variants(words).collect()} == plain_variants(want)
    assert spelling.variants(spelling.noisy_words(df.limit(0))).count() == 0


def test_keys_around_words_are_not_broadcast(spark, tmp_path):
    # a file has a size that Spark knows, unlike rows of the driver
    spark.createDataFrame([(1, "colour", 9), (2, "color", 5), (3, "colors", 5)], "id long, word string, n long").write.parquet(f"{tmp_path}/words")
    pairs = spelling.near_words(spark.read.parquet(f"{tmp_path}/words"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastExchange" not in plan
    assert {frozenset((r.word, r.near)) for r in pairs.collect()} == {frozenset(p) for p in (("colour", "color"), ("color", "colors"))}
