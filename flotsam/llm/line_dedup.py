"""Removal of repeated line runs with suffix order by prefix doubling.

Lines become ids, and ``rank_tables`` ranks the runs of 1, 2, 4, ... lines at every place where they stand twice: the pair
of a place's rank and of the rank as many lines on is the key of a class, and classes in the order of their keys get rising
ranks.  A class of a table is an interval of the suffix array in which so many lines are common.  Doubling ends when no
class has two places.  ``earlier_copies`` takes for each place the first place of its last class and walks back through
the tables, from long runs to short ones, for the exact common prefix of the two: the longest run there that goes on
being the same.  Later copies of such runs are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_KEYS, LEAST_HOT, Scratch, fresh, small_batches, spread_join

PLACE = ["doc_id", "at"]
#: Tables that are looked through between two written ones.
LEVELS = 4


def _ranked(rows: DataFrame, keys: list[str], n: int | None, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """(doc_id, at, rank, first_doc, first_at) of the places that share their keys with another one, and their number.

    Ranks rise with the keys: they are the row ids of the sorted classes.  first is the class's least place.  Counts are
    summed before the shuffle, and the places of one very frequent line are dealt over tasks in the join back.  ``n`` is
    the number of rows; where it is not known, rows are many: their classes are written out and count them.
    """
    classes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").orderBy(*keys)
    classes = classes.select(*keys, "n", F.monotonically_increasing_id().alias("rank"), F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))
    sizes = None
    if n is None:
        classes = scratch.table("classes", classes)
        n, sizes = classes.agg(F.sum("n")).first()[0] or 0, classes.select(*keys, "n")
    found = spread_join(rows, classes.drop("n"), keys, PLACE, n, sizes=sizes).select(*PLACE, "rank", "first_doc", "first_at")
    if sizes is not None:  # of lines, where rows may repeat a doc_id
        found = found.groupBy(*PLACE).agg(F.max(F.struct("rank", "first_doc", "first_at")).alias("of")).select(*PLACE, "of.*")
    return scratch.counted(name, found)


def _ahead(table: DataFrame, lines: int) -> DataFrame:
    """(doc_id, at, own, next): a place's rank and that of the place ``lines`` lines on, where both have one."""
    place = Window.partitionBy("doc_id").orderBy("at").rangeBetween(lines, lines)
    return table.select(*PLACE, F.col("rank").alias("own"), F.max("rank").over(place).alias("next")).where("next is not null")


def rank_tables(docs: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, int]]:
    """For runs of 1, 2, 4, ... non-blank lines: (doc_id, at, rank, first_doc, first_at) where a run stands that stands elsewhere too; and their numbers.

    Lines are numbered from 0 without blank ones.  Doubling ends when no run is left.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(line, F.lit(" \t\r\f\x0b")) != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("at", "line")).select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.reverse("line")).alias("h2"))
    table, n = _ranked(rows, ["h1", "h2"], None, scratch, "rank1")
    tables, depth = [], 1
    while n:
        tables.append((table, n))
        table, n = _ranked(_ahead(table, depth), ["own", "next"], n, scratch, f"rank{2 * depth}")
        depth *= 2
    return tables


def earlier_copies(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, at, lines, from_doc, from_at): places where a run of at least ``min_lines`` lines starts that stands earlier.

    lines is all that the place and the earlier one have in common.  Earlier means a smaller doc_id, or a smaller line in
    one document.  The first place of the longest class is the earlier one; the tables of shorter runs then add to the
    length, each at most once, as with twice as many lines in common the place would be in a class of longer runs.
    """
    scratch = Scratch(docs.sparkSession)
    tables, top = rank_tables(docs, scratch), min_lines.bit_length() - 1
    if len(tables) <= top:
        return docs.sparkSession.createDataFrame([], "doc_id long, at int, lines int, from_doc long, from_at int")
    rank_of_top = tables[top][0]
    if min_lines > 1 << top:  # a class of min_lines lines has the same ranks at its start and before its end
        table, n = tables[top]
        tables[top] = _ranked(_ahead(table, min_lines - (1 << top)), ["own", "next"], n, scratch, "least")
    found = None
    for level in range(top, len(tables)):
        copies = tables[level][0].where((F.col("doc_id") != F.col("first_doc")) | (F.col("at") != F.col("first_at")))
        copies = copies.select(*PLACE, F.lit(level).alias("level"), F.col("first_doc").alias("from_doc"), F.col("first_at").alias("from_at"))
        found = copies if found is None else found.unionByName(copies)
    found = found.groupBy(*PLACE).agg(F.max(F.struct("level", "from_doc", "from_at")).alias("of")).select(*PLACE, "of.*")
    lines = F.when(F.col("level") == top, min_lines).otherwise(F.expr("shiftleft(1, level)"))
    found, n = scratch.counted("found", found.select("*", lines.cast("int").alias("lines")))
    # many copies of one document look up its ranks: these are repeated for as many tasks
    least = max(LEAST_HOT, n // HOT_KEYS)
    hot = found.groupBy("from_doc").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot = F.broadcast(scratch.table("hot", hot.select("from_doc", F.ceil(F.col("n") / least).cast("long").alias("salts"))))
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
    found = found.join(hot, "from_doc", "left").withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.coalesce("salts", F.lit(1)))).drop("salts")
    for level in range(len(tables) - 2, -1, -1):
        table = tables[level][0] if level != top else rank_of_top
        own = table.select("doc_id", F.col("at").alias("end"), F.col("rank").alias("own"))
        theirs = table.select(F.col("doc_id").alias("from_doc"), F.col("at").alias("from_end"), F.col("rank").alias("theirs"))
        theirs = theirs.join(hot, "from_doc", "left").withColumn("salt", F.explode(salts)).drop("salts")
        found = found.withColumns({"end": F.col("at") + F.col("lines"), "from_end": F.col("from_at") + F.col("lines")})
        found = found.join(own, ["doc_id", "end"], "left").join(theirs, ["from_doc", "from_end", "salt"], "left")
        more = F.when((F.col("level") > level) & (F.col("own") == F.col("theirs")), 1 << level).otherwise(0)
        found = found.select(*PLACE, "level", "from_doc", "from_at", "salt", (F.col("lines") + more).alias("lines"))
        if level % LEVELS == 0:
            found = scratch.table("found", found)
    return scratch.last(found.select(*PLACE, "lines", "from_doc", "from_at"), n)


def maximal_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """The rows of ``earlier_copies`` that reach further than all that start before them in their document."""
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("lines")
    found = earlier_copies(docs, min_lines)
    return found.select("*", F.coalesce(F.max(end).over(before), F.lit(0)).alias("reach")).where(end > F.col("reach")).drop("reach")


def kept_lines(text: str, runs: list[dict] | None) -> tuple[str, int, int, int]:
    """What is left of a text, and its non-blank lines, removed lines and maximal removed runs."""
    gone = {r["at"] + k for r in runs or () for k in range(r["lines"])}
    left, n, spans, before = [], 0, 0, False
    for line in text.split("\n"):
        if line.strip(" \t\r\f\x0b"):
            spans += n in gone and not before
            before = n in gone
            if not before:
                left.append(line)
            n += 1
        else:
            left.append(line)
    return "\n".join(left), n, len(gone), spans


def _with_runs(docs: DataFrame, min_lines: int) -> DataFrame:
    """docs with one more column: each document's maximal runs that stand earlier, null where it has none."""
    name = fresh(docs, "runs")
    runs = maximal_runs(docs, min_lines).groupBy("doc_id").agg(F.collect_list(F.struct("at", "lines")).alias(name))
    small_batches(docs.sparkSession)
    return docs.join(runs.hint("merge"), "doc_id", "left").select(*docs.columns, name)  # runs grow with the corpus


def line_digests(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256) for every row of docs.

    n_lines counts non-blank lines.  Every line of a run of at least ``min_lines`` lines goes where that run stands
    earlier too; blank lines always stay and do not part a run.  Null texts count as empty; rows that repeat a doc_id
    count as one document; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines(t or "", r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sha = [hashlib.sha256(r[0].encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    return _with_runs(docs, min_lines).mapInArrow(run, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")


def remove_runs(docs: DataFrame, min_lines: int = 2) -> DataFrame:
    """docs without the later copies of line runs in ``text``; documents of which no line is left go.

    Texts without such runs stay as they are, null and empty ones with them; rows that repeat a doc_id count as one
    document and lose the same lines.
    """
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                left, n, gone, _ = kept_lines(text or "", runs)
                texts.append(left if runs else text)
                keep.append(not runs or gone < n)
            out = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    return _with_runs(docs, min_lines).mapInArrow(run, docs.schema)


def line_sql(min_lines: int = 2) -> str:
    """DuckDB SQL for ``line_digests`` over the table documents."""
    ahead = ", ".join(f"lead(line, {k}) OVER w AS l{k}" for k in range(1, min_lines))
    keys = ", ".join(["line", *(f"l{k}" for k in range(1, min_lines))])
    return rf"""
WITH parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
flagged AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '' AS solid FROM parts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS spot FROM flagged WHERE solid),
grams AS (SELECT doc_id, spot, {keys}, lead(spot, {min_lines - 1}) OVER w AS last FROM (SELECT *, {ahead or '1 AS none'} FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY spot)) WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
ranked AS (SELECT doc_id, spot, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, spot) AS k FROM grams WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, spot + unnest(range({min_lines})) AS spot FROM ranked WHERE k > 1),
marked AS (SELECT f.doc_id, f.pos, f.line, f.solid, g.spot IS NOT NULL AS removed, n.spot FROM flagged f LEFT JOIN numbered n USING (doc_id, pos) LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.spot = n.spot),
runs AS (SELECT doc_id, count(*) AS n_runs FROM (SELECT doc_id, spot, lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS before FROM gone) WHERE before IS NULL OR before < spot - 1 GROUP BY 1)
SELECT m.doc_id, CAST(count(*) FILTER (WHERE solid) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE removed) AS BIGINT) AS n_removed, CAST(coalesce(any_value(r.n_runs), 0) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM marked m LEFT JOIN runs r USING (doc_id) GROUP BY m.doc_id"""
