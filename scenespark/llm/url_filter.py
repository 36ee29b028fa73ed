"""URL filters: host rules, and propagated trust for the hosts no rule decides.

Edges go from the host of a page to the hosts it links to, and between a host and the
hosts right above and below it in the name. Trust is a personalised PageRank from the
hosts that rules allow, distrust the same on reversed edges from the hosts that rules
block; a host is blocked where its distrust exceeds its trust by the threshold. Each round
is a join and a grouped sum over the edges, and equal edges are summed before any shuffle.
Rounds end once the ranks have settled and no further host is reached.

Ranks are whole numbers, and what an edge carries is rounded down before it is summed, so
neither the order of rows nor their partitions change a rank: the verdict is a function of
the pages. A host without edges of its own passes nothing on; its share ends there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

DAMPING = 0.85
# summed change of the ranks of a round (each starts with a sum of 1) from which they have settled
TOLERANCE = 1e-4
# ranks count parts of the whole
UNIT = 1 << 50
# rounds between two looks at the change
EVERY = 8
# of the comparison SQL, which has no loop; deeper links need more
ROUNDS = 96
# share of distrust in trust + distrust from which a host is blocked
BLOCK_FROM = 0.5
# targets with a scheme, and those that leave it to the page
LINK = r"""(?i:href|src)\x20*=\x20*["']?((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^"'\x20>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(verdict, text) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    # the longest is tried first, so it stands outermost
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.text).alias("rule"))).otherwise(out)
    return out


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b, w): links between different hosts, and a host with the one right above it in the name.

    ``pages``: host, html. A name of one label is no host above.
    """
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    target = F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))
    links = (
        pages.select(F.col("host").alias("a"), F.explode(targets).alias("url")).select("a", host_of(target).alias("b"))
        .where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    hosts = pages.select("host").union(links.select("b")).where("host <> ''").distinct()
    above = hosts.select(F.col("host").alias("a"), F.expr("substring(host, instr(host, '.') + 1)").alias("b")).where(
        "instr(a, '.') > 0 and instr(b, '.') > 0")
    named = above.unionAll(above.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return links.unionAll(named.withColumn("w", F.lit(1.0))).groupBy("a", "b").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRanks (kind, host, rank) along a -> b from ``seeds`` (kind, host, share).

    ``edges``: kind, a, b, w. The shares of a kind sum to 1, ranks to ``UNIT`` at most. The
    last rounds change them by ``tolerance`` of it at most and reach no new host.
    """
    weights = edges.join(edges.groupBy("kind", "a").agg(F.sum("w").alias("_sum")), ["kind", "a"]).select(
        F.col("kind").alias("of"), "a", "b", (F.col("w") / F.col("_sum")).alias("p"))
    weights = common.staged(weights, "weights")

    def units(value: Column) -> Column:
        return F.floor(value).cast("long").alias("rank")

    start = seeds.select("kind", "host", units(F.col("share") * (1 - damping) * UNIT))
    rank = common.staged(seeds.select("kind", "host", units(F.col("share") * UNIT)), "rank")
    nothing = F.lit(0).cast("long")
    while True:
        now = rank
        for _ in range(EVERY):
            moved = now.join(weights, (now.kind == weights.of) & (now.host == weights.a)).select(
                "kind", F.col("b").alias("host"), units(F.col("rank") * F.col("p") * damping))
            now = moved.unionAll(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        both = now.select("kind", "host", "rank", nothing.alias("before")).unionAll(
            rank.select("kind", "host", nothing.alias("rank"), F.col("rank").alias("before")))
        told = common.staged(
            both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "rank")
        change, fresh = told.agg(
            F.sum(F.abs(F.col("rank") - F.col("before"))), F.count_if((F.col("before") == 0) & (F.col("rank") > 0))).first()
        rank = told.select("kind", "host", "rank")
        if not fresh and (change or 0) <= tolerance * UNIT:
            return rank


def judged(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, tolerance: float = TOLERANCE, block_from: float = BLOCK_FROM,
    url: str = "url", html: str = "html",
) -> DataFrame:
    """Add host, path, rule and verdict to pages.

    A null url or one without ``://`` has an empty host and path, no rule and the verdict
    allow. Null html has no links. Hosts that neither trust nor distrust reaches are
    allowed, and so are those that both reach alike: a tie is no block. No pages give no
    rows. Repeated rows are judged alike (each counts as a page of its own in the
    seeds); input columns named like a result give way to it.
    """
    common.prepare(pages.sparkSession)
    names = {c: f"_in{i}" for i, c in enumerate(pages.columns)}
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    address = F.col(names[url]).cast("string")
    rows = rows.withColumns({"host": host_of(address), "path": path_of(address)}).withColumn(
        "_r", rule_of(F.col("host"), F.col("path"), rules))
    ruled = rows.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("_r.verdict") == "allow").alias("trusted"), F.count_if(F.col("_r.verdict") == "block").alias("blocked"))
    ruled = common.staged(ruled, "hosts")
    edges = common.staged(edges_of(rows.select("host", F.col(names[html]).cast("string").alias("html"))), "edges")

    def seeds(of: str) -> DataFrame:
        total = float(ruled.agg(F.sum(of)).first()[0] or 1)
        return ruled.where(F.col(of) > 0).select(F.lit(of).alias("kind"), "host", (F.col(of) / F.lit(total)).alias("share"))

    both = edges.select(F.lit("trusted").alias("kind"), "a", "b", "w").unionAll(
        edges.select(F.lit("blocked").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    ranks = spread(both, seeds("trusted").unionAll(seeds("blocked")), tolerance)
    scores = ranks.groupBy("host").agg(*[
        F.sum(F.when(F.col("kind") == of, F.col("rank")).otherwise(0)).alias(n) for n, of in (("good", "trusted"), ("bad", "blocked"))])
    blocked = common.staged(
        scores.where(F.col("bad") > F.lit(block_from) * (F.col("good") + F.col("bad"))).select("host", F.lit(True).alias("_bad")),
        "blocked")
    out = rows.join(blocked, "host", "left")
    results = {
        "host": F.col("host"), "path": F.col("path"), "rule": F.col("_r.rule"),
        "verdict": F.coalesce(F.col("_r.verdict"), F.when(F.col("_bad"), F.lit("block")), F.lit("allow")),
    }
    keep = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in results]
    return out.select(*keep, *[c.alias(n) for n, c in results.items()])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _host_sql(url: str) -> str:
    return (
        f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, instr({url}, '://') + 3), "
        "'^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '')"
    )


def _rank_sql(name: str, edges: str, verdict: str, rounds: int = ROUNDS) -> str:
    """Rounds of personalised PageRank as one statement after the other."""
    def units(x: str) -> str:
        return f"CAST(floor({x}) AS BIGINT)"

    steps = [
        f"{name}_p AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM ({edges}))",
        f"{name}_s AS MATERIALIZED (SELECT host, n / sum(n) OVER () AS share FROM "
        f"(SELECT host, count(*) AS n FROM ruled WHERE host <> '' AND rule_verdict = '{verdict}' GROUP BY host))",
        f"{name}_0 AS (SELECT host, {units(f'share * {UNIT}')} AS rank FROM {name}_s)",
    ]
    for k in range(rounds):
        steps.append(f"""{name}_{k + 1} AS MATERIALIZED (SELECT host, CAST(sum(rank) AS BIGINT) AS rank FROM (
          SELECT b AS host, {units(f"CAST(rank AS DOUBLE) * p * {DAMPING}")} AS rank FROM {name}_{k} JOIN {name}_p ON host = a
          UNION ALL SELECT host, {units(f"share * CAST({1 - DAMPING} AS DOUBLE) * {UNIT}")} FROM {name}_s) GROUP BY host)""")
    return ", ".join(steps)


_FITS = [
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN "
    for r in RULES
]
_LONGEST = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i].text), RULES[i].text))
_LINK_SQL = LINK.replace("'", "''")
SQL = f"""
WITH parsed AS (
  SELECT page_id, html, {_host_sql("url")} AS host,
         coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
ruled AS MATERIALIZED (
  SELECT *, CASE {" ".join(f"{_FITS[i]} '{RULES[i].text}'" for i in _LONGEST)} END AS rule,
         CASE {" ".join(f"{_FITS[i]} '{RULES[i].verdict}'" for i in _LONGEST)} END AS rule_verdict
  FROM parsed),
targets AS (
  SELECT a, {_host_sql("url")} AS b
  FROM (SELECT a, CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END AS url FROM (SELECT host AS a, unnest(regexp_extract_all(coalesce(html, ''), '{_LINK_SQL}', 1)) AS url FROM ruled))),
links AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS w FROM targets WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
hosts AS (SELECT host FROM ruled WHERE host <> '' UNION SELECT b FROM links),
above AS (
  SELECT host AS a, substr(host, instr(host, '.') + 1) AS b FROM hosts
  WHERE instr(host, '.') > 0 AND instr(substr(host, instr(host, '.') + 1), '.') > 0),
edges AS MATERIALIZED (
  SELECT a, b, sum(w) AS w FROM (
    SELECT a, b, w FROM links UNION ALL
    SELECT a, b, 1.0 FROM (SELECT a, b FROM above UNION SELECT b, a FROM above)) GROUP BY a, b),
{_rank_sql("trust", "SELECT a, b, w FROM edges", "allow")},
{_rank_sql("distrust", "SELECT b AS a, a AS b, w FROM edges", "block")},
blocked AS (
  SELECT host, true AS bad FROM trust_{ROUNDS} t FULL JOIN distrust_{ROUNDS} d USING (host)
  WHERE coalesce(d.rank, 0) > {BLOCK_FROM} * (coalesce(t.rank, 0) + coalesce(d.rank, 0)))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN bad THEN 'block' END, 'allow') AS verdict
FROM ruled LEFT JOIN blocked USING (host)
"""
