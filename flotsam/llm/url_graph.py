"""URL filtering by rules and, where none fits, by trust that spreads over the host graph; DataFrame operations alone.

Trust starts at hosts with pages that rules allow and follows the edges; distrust starts at hosts with pages that rules
block and follows them backwards.  Edges are the absolute links between hosts and, in both directions, the steps between
a host and the domain that it belongs to.  Both are personalised PageRanks, run together until they stand still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, LEAST_HOT, PARTITION_ROWS, Scratch, spread_join

#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Rounds of propagation between looks at the scores, the share that moves on in each, the distrust share from which a host
#: is blocked, and the labels of a domain below which no parent is taken.  The SQL writes out SQL_ROUNDS rounds.
ROUNDS, DAMPING, THRESHOLD, LEAST_LABELS, SQL_ROUNDS = 8, 0.85, 0.5, 2, 64
#: Scores stand still when a look finds no new host, their summed change under the first, and none changed by more than
#: the second of itself.  A host's distrust must exceed its limit by LEAST_LEAD of the host's scores.
TOLERANCE, OWN_TOLERANCE, LEAST_LEAD = 1e-9, 1e-6, 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute link, or of one without a scheme.
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _rule(host: Column, path: Column, rules, value) -> Column:
    """``value(verdict, rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        out = F.when(fits, F.lit(value(verdict, rule))).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    return found.select("*", _rule(F.col("host"), F.col("path"), rules, lambda v, r: r).alias("rule"), _rule(F.col("host"), F.col("path"), rules, lambda v, r: v).alias("ruled"))


def host_edges(judged: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between different hosts: links, and host to parent domain and back."""
    links = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("to"))
    links = links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).distinct()
    hosts = judged.select(F.col("host").alias("h")).unionByName(links.select(F.col("dst").alias("h"))).where("h <> ''").distinct()
    labels = F.split("h", r"\.", -1)
    steps = F.sequence(F.lit(0), F.size(labels) - LEAST_LABELS - 1)
    name = lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")
    up = hosts.where(F.size(labels) > LEAST_LABELS).select(F.explode(F.transform(steps, lambda k: F.struct(name(k).alias("src"), name(k + 1).alias("dst")))).alias("e")).select("e.*")
    both = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def host_scores(judged: DataFrame) -> DataFrame:
    """(host, trust, distrust) for every host that either reaches."""
    scratch = Scratch(judged.sparkSession)
    edges, n = scratch.counted("edges", host_edges(judged))
    ruled = judged.where(F.col("ruled").isNotNull() & (F.col("host") != ""))
    totals = ruled.groupBy("ruled").agg(F.count("*").alias("all"))
    seeds = ruled.groupBy("host", "ruled").agg(F.count("*").alias("n")).join(totals, "ruled")
    kind = F.col("ruled") == "allow"
    seeds = scratch.table("seeds", seeds.select("host", kind.alias("trusts"), (F.col("n") / F.col("all")).alias("start")))
    out, into = edges.groupBy("src").agg(F.count("*").alias("n")), edges.groupBy("dst").agg(F.count("*").alias("n"))
    forward = spread_join(edges, out, ["src"], ["dst"], n, sizes=out).select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(True).alias("trusts"), (DAMPING / F.col("n")).alias("share"))
    back = spread_join(edges, into, ["dst"], ["src"], n, sizes=into).select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(False).alias("trusts"), (DAMPING / F.col("n")).alias("share"))
    flow, n = scratch.counted("flow", forward.unionByName(back))
    # the edges of a domain with very many hosts are dealt over tasks, and its score is sent to each
    least = max(LEAST_HOT, n // HOT_KEYS)
    hot = flow.groupBy("host", "trusts").agg(F.count("*").alias("n")).where(F.col("n") > least)
    hot, n_hot = scratch.counted("hot", hot.select("host", "trusts", F.ceil(F.col("n") / least).cast("long").alias("salts")))
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
    if n_hot:
        salt = F.pmod(F.xxhash64("to"), F.coalesce("salts", F.lit(1)))
        flow = scratch.table("dealt", flow.join(F.broadcast(hot), ["host", "trusts"], "left").withColumn("salt", salt).drop("salts"))
    dealt = lambda state: state.join(F.broadcast(hot), ["host", "trusts"], "left").withColumn("salt", F.explode(salts)).drop("salts") if n_hot else state
    few = 1 + n // PARTITION_ROWS  # a small graph takes its rounds without shuffles
    flow = flow.coalesce(few)
    teleport = seeds.select("host", "trusts", (F.col("start") * (1 - DAMPING)).alias("score"))
    state, still, looks = scratch.table("state", teleport), False, 0
    while not still:
        before = state
        for _ in range(ROUNDS):
            sent = flow.join(dealt(state), ["host", "trusts", *["salt"] * bool(n_hot)]).select(F.col("to").alias("host"), "trusts", (F.col("score") * F.col("share")).alias("score"))
            state = sent.unionByName(teleport).coalesce(few).groupBy("host", "trusts").agg(F.sum("score").alias("score"))
        state = scratch.table(f"state{looks % 2}", state)
        looks += 1
        change = F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))
        looked = state.join(before.withColumnRenamed("score", "old"), ["host", "trusts"], "left")
        total, own, new = looked.agg(F.sum(change), F.max(change / F.col("score")), F.count_if(F.col("old").isNull())).first()
        still = not new and (total or 0) < TOLERANCE and (own or 0) < OWN_TOLERANCE
    both = state.groupBy("host").agg(F.sum(F.when(F.col("trusts"), F.col("score"))).alias("trust"), F.sum(F.when(~F.col("trusts"), F.col("score"))).alias("distrust"))
    return scratch.last(both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html); other columns are ignored.

    The longest rule that fits decides.  Otherwise a host is blocked if distrust is more than ``threshold`` of its trust
    and distrust together; hosts that neither reaches, and urls without a host, are allowed.  Repeated rows count as
    often as they stand there; an empty table gives an empty result.
    """
    judged = judged_by_rules(pages, rules)
    scores = host_scores(judged)
    total = F.col("trust") + F.col("distrust")
    worse = F.col("distrust") - threshold * total > LEAST_LEAD * total
    verdicts = scores.select("host", F.when(worse, "block").otherwise("allow").alias("method"))
    out = judged.drop("html").join(verdicts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"))


def filter_sql(rules=RULES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``filter_urls`` over the table pages, its rounds written out."""
    cases = {"rule": "", "ruled": ""}
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{prefix}') THEN "
        cases["rule"] += f"{fits}'{rule}' "
        cases["ruled"] += f"{fits}'{verdict}' "
    link = _LINK.replace("(?i)", "").replace("'", "''")
    name = "array_to_string(list_slice(l, k, len(l)), '.')"
    parts = [
        "urls AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"hosts AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host FROM urls)",
        "split AS (SELECT page_id, html, host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts)",
        f"judged AS MATERIALIZED (SELECT *, CASE {cases['rule']} END AS rule, CASE {cases['ruled']} END AS ruled FROM split)",
        f"links AS (SELECT DISTINCT host AS src, translate(t, '{_UPPER}', '{_LOWER}') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1, 'i')) AS t FROM judged WHERE host <> ''))",
        "names AS (SELECT DISTINCT string_split(h, '.') AS l FROM (SELECT host AS h FROM judged UNION ALL SELECT dst FROM links) WHERE h <> '')",
        f"up AS (SELECT {name} AS src, {name.replace('k, len', 'k + 1, len')} AS dst FROM (SELECT l, unnest(range(1, len(l) - {LEAST_LABELS} + 1)) AS k FROM names))",
        "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT * FROM links UNION ALL SELECT * FROM up UNION ALL SELECT dst, src FROM up) WHERE src <> dst)",
        f"""flow AS MATERIALIZED (SELECT src AS host, dst AS dest, true AS trusts, {DAMPING}::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM edges
 UNION ALL SELECT dst, src, false, {DAMPING}::DOUBLE / count(*) OVER (PARTITION BY dst) FROM edges)""",
        f"""s0 AS MATERIALIZED (SELECT host, ruled = 'allow' AS trusts, {1 - DAMPING}::DOUBLE * n / sum(n) OVER (PARTITION BY ruled) AS score
 FROM (SELECT host, ruled, count(*) AS n FROM judged WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL))""",
    ]
    for k in range(SQL_ROUNDS):
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT host, trusts, sum(score) AS score FROM (SELECT f.dest AS host, f.trusts, s.score * f.share AS score FROM flow f JOIN s{k} s ON f.host = s.host AND f.trusts = s.trusts UNION ALL SELECT * FROM s0) GROUP BY ALL)")
    return "WITH " + ",\n".join(parts) + f""",
scores AS (SELECT host, coalesce(sum(score) FILTER (WHERE trusts), 0) AS t, coalesce(sum(score) FILTER (WHERE NOT trusts), 0) AS d FROM s{SQL_ROUNDS} GROUP BY 1)
SELECT page_id, judged.host, path, rule, coalesce(ruled, CASE WHEN round(d - {threshold}::DOUBLE * (t + d), 12) > 0 THEN 'block' WHEN t IS NOT NULL THEN 'allow' END, 'allow') AS verdict
FROM judged LEFT JOIN scores ON scores.host = judged.host"""
