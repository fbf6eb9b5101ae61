"""Quality filtering by weak supervision, in DataFrame operations alone.

Rules vote good, bad or nothing on each document.  Expectation-maximisation over the counts of vote patterns estimates
how often each rule is right, and the posterior probability of good replaces a filter that every rule has to pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: ASCII white space between words, and the characters counted as symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Votes: (rule, good when, bad when) over the measures below; otherwise the rule abstains.  Rules that tell only of one
#: kind of damage never vote good, so that many silent rules can't outvote two that object.
RULES = (
    ("symbols", "n_words > 0 and 100 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    ("plain", "n_words > 0 and 10 * n_plain >= 9 * n_words", "10 * n_plain < 7 * n_words"),
    ("letters", "n_words > 0 and 10 * n_letters >= 9 * word_chars", "4 * n_letters < 3 * word_chars"),
    ("case", "false", "10 * n_upper > 3 * n_letters"),
    ("length", "false", "n_words < 25"),
    ("word_size", "false", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    ("lines", "false", "5 * n_dup_lines > n_lines"),
    ("repeats", "false", "10 * n_repeat_words > n_words"),
    ("variety", "false", "5 * n_distinct < n_words"),
)
#: The accuracy that rules start from and the least they can have (a guess), the pseudo-counts that hold rules with few
#: votes at their start, and the change of all estimates under which the steps end (the SQL writes out so many).
START, LEAST, PRIOR, TOLERANCE, SQL_STEPS = 0.8, 0.5, 10.0, 1e-9, 60
#: Documents with at least this posterior stay.
THRESHOLD = 0.5
#: A word of letters alone, or with one mark at its end.
PLAIN = r"\p{L}+[.,;:]?"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _joined(hashes: Column, by: int) -> Column:
    """Hashes of the pairs of entries that stand ``by`` places apart."""
    n = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + by), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, over whole texts; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    out = docs.select("doc_id", text.alias("text"))
    out = out.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.char_length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        lines.alias("lines"),
    )
    plain = F.size(F.filter("words", lambda w: w.rlike(f"^{PLAIN}$"))).cast("long")
    out = out.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), plain.alias("n_plain")).drop("words")
    out = out.select("*", F.size("h").alias("n"), F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("lines")).cast("long").alias("d_lines"))
    # windows of 2, 4 and 8 words, each from two of those before
    for name, of, by in (("w2", "h", 1), ("w4", "w2", 2), ("w", "w4", 4)):
        out = out.select("*", _joined(F.col(of), by).alias(name))
    numbered = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    # only where some window repeats are they sorted, with their places: one repeats if a neighbour in that order is the
    # same, and the places of repeated windows, in order, say how many words they cover together
    out = out.select("*", F.when(F.size(F.array_distinct("w")) < F.size("w"), numbered).alias("s"))
    near = lambda s, k: F.when((k >= 0) & (k < F.size(s)), F.get(s, k)["x"])
    same = F.filter("s", lambda p, k: (near(F.col("s"), k - 1) == p["x"]) | (near(F.col("s"), k + 1) == p["x"]))
    out = out.select("*", F.array_sort(F.transform(same, lambda p: p["i"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("d_lines")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_letters",
        "n_upper",
        "n_plain",
        "n_lines",
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )


def votes(measured: DataFrame) -> DataFrame:
    """Adds a column v_<rule> for each rule: 1 for good, 0 for bad, null where the rule abstains."""
    return measured.select("*", *(F.when(F.expr(bad), 0).when(F.expr(good), 1).alias(f"v_{name}") for name, good, bad in RULES))


def _posterior(share: Column, rates: list[Column]) -> Column:
    """Probability of good for a pattern of votes."""
    odds = F.log(share) - F.log(1 - share)
    for (name, _, _), p in zip(RULES, rates, strict=True):
        odds = odds + F.when(F.col(f"v_{name}") == 1, F.log(p) - F.log(1 - p)).when(F.col(f"v_{name}") == 0, F.log(1 - p) - F.log(p)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame) -> tuple[float, list[float]]:
    """The share of good documents and each rule's accuracy, by steps until they stand still.

    Documents enter as counts of vote patterns, at most 3 to the power of the number of rules, so a step's cost does
    not grow with the corpus; the driver gets one row of sums a step.
    """
    names = [f"v_{name}" for name, _, _ in RULES]
    patterns = cut(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    share, rates, change = 0.5, [START] * len(RULES), 1.0
    while change >= TOLERANCE:
        q = _posterior(F.lit(share), [F.lit(p) for p in rates])
        right = [F.sum(F.when(F.col(v) == 1, F.col("n") * F.col("q")).when(F.col(v) == 0, F.col("n") * (1 - F.col("q"))).otherwise(0.0)) for v in names]
        cast = [F.sum(F.when(F.col(v).isNotNull(), F.col("n")).otherwise(0)) for v in names]
        row = patterns.select("*", q.alias("q")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.array(*right).alias("right"), F.array(*cast).alias("cast")).first()
        if not row["n"]:
            break
        before = [share, *rates]
        share = (row["good"] + 1) / (row["n"] + 2)
        rates = [max((r + PRIOR * START) / (c + PRIOR), LEAST) for r, c in zip(row["right"], row["cast"], strict=True)]
        change = max(abs(x - y) for x, y in zip(before, [share, *rates], strict=True))
    return share, rates


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: the measures, base_failed, p_good and kept.

    base_failed says that the text has under 20 words or more than 30 in 100 of them in repeated windows of 8; kept
    asks besides for a posterior of at least ``threshold``.  Null texts count as empty (base_failed); repeated rows are
    counted and returned as often as they stand; an empty table gives an empty result; extra columns are ignored.
    """
    voted = cut(votes(measures(docs)))
    share, rates = estimate(voted)
    p = F.round(_posterior(F.lit(share), [F.lit(r) for r in rates]), 4)
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    out = voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), p.alias("p_good"))
    return out.select("*", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))


def judge_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``judge`` over the table documents, its steps written out."""
    names = [f"v_{n}" for n, _, _ in RULES]

    def posterior(of: str) -> str:
        odds = f"ln({of}.share) - ln(1 - {of}.share)"
        for v in names:
            odds += f" + CASE {v} WHEN 1 THEN ln({of}.{v}_p) - ln(1 - {of}.{v}_p) WHEN 0 THEN ln(1 - {of}.{v}_p) - ln({of}.{v}_p) ELSE 0.0 END"
        return f"1 / (1 + exp(-({odds})))"

    space = "[\\x20\\x09-\\x0D]"
    parts = [
        f"""words AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS w FROM documents)""",
        f"""lines AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS d_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_replace(line, '{space}+', '', 'g') <> '' GROUP BY 1)""",
        """grams AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM words WHERE len(w) >= 8)""",
        """hashed AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM grams)""",
        """twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM hashed) WHERE k > 1)""",
        """covered AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS n_repeat FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY 1)""",
        f"""measured AS MATERIALIZED (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*' || chr(36) || '%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines - d_lines, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
 len(list_filter(w, lambda x: regexp_full_match(x, '{PLAIN}'))) AS n_plain, coalesce(n_lines, 0) AS n_lines, len(list_distinct(w)) AS n_distinct
 FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))""",
        "voted AS MATERIALIZED (SELECT *, " + ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END AS v_{n}" for n, good, bad in RULES) + " FROM measured)",
        f"patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM voted GROUP BY ALL)",
        "e0 AS (SELECT 0.5::DOUBLE AS share, " + ", ".join(f"{START}::DOUBLE AS {v}_p" for v in names) + ")",
    ]
    for k in range(SQL_STEPS):
        rates = ", ".join(f"greatest((sum(CASE {v} WHEN 1 THEN n * q WHEN 0 THEN n * (1 - q) ELSE 0 END) + {PRIOR * START}) / (coalesce(sum(n) FILTER (WHERE {v} IS NOT NULL), 0) + {PRIOR}), {LEAST}::DOUBLE) AS {v}_p" for v in names)
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT (sum(n * q) + 1) / (sum(n) + 2) AS share, {rates} FROM (SELECT patterns.*, {posterior(f'e{k}')} AS q FROM patterns, e{k}))")
    last = f"e{SQL_STEPS}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, NOT base_failed AND p_good >= {threshold} AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, round({posterior(last)}, 4) AS p_good FROM voted, {last})"""
