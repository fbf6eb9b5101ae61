"""Rows that share a doc_id in suffix dedup, hostile pages, and columns without an order in the pipeline."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from flotsam.llm import html_layout, suffix_array, suffix_dedup


def letters(seed, n):
    return "".join(random.Random(seed).choices("abcdefghij klmnop", k=n))


def test_rows_of_one_doc_id_are_documents_of_their_own(spark):
    a, b = letters(1, 900), letters(2, 900)
    rows = [(1, a + "zz"), (1, b), (2, "q" + a), (3, b + "w"), (None, "n" + b), (None, "short"), (4, letters(3, 500))]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, key int").repartition(3)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.repeat_digests(docs).collect()}
    assert got == {(1, 902): 900, (1, 900): 900, (2, 901): 900, (3, 901): 900, (None, 901): 900, (None, 5): 0, (4, 500): 0}
    left = {(r.key, r.text) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert left == {(0, "zz"), (2, "q"), (3, "w"), (4, "n"), (5, "short"), (6, rows[6][1])}
    words = [" ".join(letters(k, 9).replace(" ", "x") for k in range(s, s + 60)) for s in (1000, 2000)]
    passages = spark.createDataFrame([(1, words[0]), (1, "own start " + words[1]), (2, words[1] + " own end"), (3, "else")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text.strip()) for r in suffix_dedup.remove_passages(passages).collect()) == sorted([(1, "own start"), (1, words[0]), (2, "own end"), (3, "else")])


def test_equal_rows_of_one_doc_id_lose_all(spark):
    a = letters(1, 900)
    docs = spark.createDataFrame([(1, a), (1, a), (1, letters(5, 900))], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.repeat_digests(docs).collect()) == [0, 900, 900]


HOSTILE = {
    "script": "<script>" + "</script " * 20_000,
    "title": "<title>" + "</title " * 20_000,
    "quotes": "<blockquote>" * 500 + "<br>x" * 20_000,
    "lists": "<ol><li>" * 200 + "<br>x" * 20_000,
    "spans": "<table>" + ("<tr>" + "<td rowspan=300>y" * 200) * 200,
    "uneven spans": "<table>" + "".join("<tr>" + "".join(f"<td rowspan={2 + (r * k) % 300}>y" for k in range(60)) for r in range(200)),
}


def test_a_key_stays_whole_where_its_join_is_read_by_writers(spark, tmp_path):
    spark.range(0, 2000, 1, 2).selectExpr("id % 1000 AS key", "id AS doc_id", "0L AS start", "cast(concat(repeat(md5(cast(id % 1000 AS string)), 2), id) AS binary) AS data").write.parquet(f"{tmp_path}/rows")
    spark.range(0, 100000, 1, 8).selectExpr("id AS key", "id % 100 AS contents").write.parquet(f"{tmp_path}/contents")
    rows, hot = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/contents").where("contents > 98").select("key").distinct()
    # the list of hot keys looks larger before it is known; few bytes are not read by one task
    settings = {"spark.sql.autoBroadcastJoinThreshold": "40000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = {r.doc_id: r.total for r in suffix_dedup._shards(rows.join(hot, "key", "left_anti"), 40, 1000).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    # the two rows of a key were written by two tasks
    assert set(found) == {k for k in range(2000) if k % 100 != 99} and min(found.values()) >= 64


@pytest.mark.parametrize("page", HOSTILE)
def test_hostile_pages_take_little_time_and_give_little_text(page):
    began = time.perf_counter()
    text = html_layout.render(HOSTILE[page])
    assert time.perf_counter() - began < 2.5  # well under one second on an idle machine
    assert len(text) <= 12 * len(HOSTILE[page])


def test_deep_quotes_keep_their_lines():
    depth = html_layout.INDENT // 2
    got = html_layout.render("<blockquote>" * (depth + 5) + "a<br>b" + "</blockquote>" * (depth + 5)).split("\n")
    assert got == [" " * html_layout.INDENT + c for c in "ab"]
    assert html_layout.render("<script>x</script y<p>z") == "z" and html_layout.render("<title>t</title >z") == "z"


def plain_columns(rows):
    """The first column of every cell by a grid of taken places."""
    taken, out = set(), []
    for r, row in enumerate(rows):
        column, places = 0, []
        for _, across, down in row:
            while (r, column) in taken:
                column += 1
            places.append(column)
            taken |= {(r + i, column + j) for i in range(1, down) for j in range(across)}
            column += across
        out.append(places)
    return out


def test_cells_stand_beside_those_that_reach_down(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        rows = [[([f"{r}.{k}"], rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 3, 5])) for k in range(rng.randint(0, 4))] for r in range(7)]
        text = html_layout._aligned(rows)
        columns = plain_columns(rows)
        widths = {}
        for row, places in zip(rows, columns):
            for (lines, across, _), c in zip(row, places):
                widths[c] = max(widths.get(c, 0), len(lines[0]) if across == 1 else 0)
        starts, at = {}, 0
        for c in sorted(widths):
            starts[c] = at
            at += widths[c] + 2
        want = []
        for row, places in zip(rows, columns):
            line = ""
            for (lines, _, _), c in zip(row, places):
                if c:
                    line = line.ljust(starts[c]) if len(line) + 2 <= starts[c] else line + "  "
                line += lines[0]
            if row:
                want.append(line.rstrip())
        assert text == want


def test_pipeline_keeps_one_of_each_row_with_a_map(spark):
    rows = [(1, "a", {"k": 1}, None), (1, "a", {"k": 2}, "x"), (1, "b", None, "y"), (2, "a", {}, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, s string")
    got = corpus_pipeline.one_of_each(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a"), (1, "b"), (2, "a")] and all(tuple(r) in [(d, t, m, s) for d, t, m, s in rows] for r in got)


def test_rows_that_share_no_window_are_not_sorted():
    rng, length, gram, dropped = random.Random(7), 24, b"GRAMGRAM", 0
    for _ in range(300):
        pool = ["".join(rng.choices("ab", k=20)).encode() for _ in range(3)]
        cut = [(rng.choice(pool)[rng.randint(0, 20) :], rng.choice(pool)[: rng.randint(0, 20)]) for _ in range(5)]
        rows = [(k, 0, len(a), len(a) + len(gram), a + gram + b) for k, (a, b) in enumerate(cut) if len(a + b) + len(gram) >= length]
        windows = [{(lo - at, data[at : at + length]) for at in range(max(0, hi - length), min(lo, len(data) - length) + 1)} for _, _, lo, hi, data in rows]
        shared = {k for k, own in enumerate(windows) if any(own & other for j, other in enumerate(windows) if j != k)}
        kept = suffix_dedup._alike(rows, length)
        assert shared <= {rows.index(r) for r in kept}
        dropped += len(rows) - len(kept)
    assert dropped > 300 and suffix_dedup._alike([(1, 0, 0, 24, b"x" * 24)], 24)


def test_passages_are_looked_for_where_words_begin(spark):
    texts = [b" ".join(letters(s + k, 7).replace(" ", "x").encode() for k in range(300)) for s in (0, 5000)] + [b"", b" ", b"one", b"w" * (suffix_dedup.BLOCK + 9) + b" end"]
    assert suffix_dedup._symbols_of(texts) == [suffix_dedup.word_symbols(x) for x in texts]
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts[:2])], "doc_id long, text string")
    found = suffix_dedup._scan(docs, 4 * 51, 32, by_words=True).collect()
    assert found and all(r.start % 4 == 0 and r.total % 4 == 0 and r.span % 4 == 0 for r in found)
    # segments cover every window of words once
    assert sum(r.total // 4 - 50 for r in found) == 2 * (300 - 50)


def test_suffixes_of_few_and_many_symbols_with_long_repeats():
    rng = random.Random(3)
    for size in (1, 2, 30, 70_000) * 30:
        text = [rng.randint(1, size) for _ in range(rng.randint(0, 60))] * rng.randint(1, 5) + [0]
        assert suffix_array.suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    # names that repeat are ranked in few rounds of sorting, not one after another
    names = np.array([*([2, 1] * 40), 0])
    assert suffix_array._doubled(names).tolist() == sorted(range(len(names)), key=lambda i: names[i:].tolist())
