"""Secret scans: credentials in whole texts, and weak candidates linked by their other parts.

Three strong kinds count wherever they stand. Weak candidates (identifiers, secrets,
endpoints) are reported only where complementary parts start within ``SCOPE`` code points
of each other: a secret beside an identifier or endpoint, an identifier beside a secret,
an endpoint beside both. That interval join runs on cells of ``SCOPE`` code points: each
part meets the extremes of its own and the two neighbouring cells, so a text with very
many parts never makes pairs. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

SCOPE = 400
# summed in pieces of so many, so that sums up to each match stay cheap in texts with many
PIECE = 256

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = (
    r"""(?i:user(?:name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?"""
    r"""[A-Za-z0-9+/_.@=-]{3,}"""
)
SECRET = (
    r"""(?i:pwd|pass|passphrase|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
    r"""|[0-9a-f]{16,}"""
)
# a scheme has at most 32 letters, so that no long run is scanned from each of its letters
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{0,31}://[A-Za-z0-9][^\x20\x09-\x0D"'<>]{3,}|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?"""

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
PATTERNS = [ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT]
# what a match must also fulfil; the text of the match is given
KEEP: dict[str, Callable[[Column], Column]] = {
    "assign": lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6,
    # longer runs of hex digits are of the strong kind
    "secret": lambda m: ~m.rlike("^[0-9a-f]{24,}$"),
}
# quick tests, true wherever a match exists
HINTS = {"endpoint": r"://|[0-9]\.[0-9]", "access": "AKIA"}
SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _before(sizes: str) -> Column:
    """Sum of the elements ahead of each element: sums of whole pieces, then within the piece."""
    return F.expr(f"""
        CASE WHEN size({sizes}) = 0 THEN array() ELSE element_at(transform(
          array(transform(sequence(0, CAST(floor((size({sizes}) - 1) / {PIECE}) AS INT)), b ->
            aggregate(slice({sizes}, CAST(b * {PIECE} + 1 AS INT), {PIECE}), 0L, (s, x) -> s + x))),
          sums -> flatten(transform(
            transform(sums, (own, b) -> struct(
              aggregate(slice(sums, 1, b), 0L, (s, x) -> s + x) AS base,
              slice({sizes}, CAST(b * {PIECE} + 1 AS INT), {PIECE}) AS part)),
            p -> transform(p.part, (x, i) -> p.base + aggregate(slice(p.part, 1, i), 0L, (s, y) -> s + y))))), 1) END""")


def _spans(df: DataFrame, text: Column, kinds: list[str]) -> DataFrame:
    """Add ``_<kind>``: the kept matches as (start, kind, stop), leftmost and not overlapping."""
    for kind in kinds:
        k, pattern = KINDS.index(kind), PATTERNS[KINDS.index(kind)]
        there = text.rlike(HINTS.get(kind, pattern))
        none = F.expr("CAST(array() AS array<string>)")
        df = df.withColumns({
            "_m": F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            "_g": F.when(there, F.split(text, pattern, -1)).otherwise(none),
        })
        df = df.withColumn("_n", F.expr("zip_with(_m, slice(_g, 1, size(_m)), (m, g) -> CAST(length(m) + length(g) AS BIGINT))"))
        df = df.withColumn("_b", _before("_n"))
        df = df.withColumn("_all", F.expr(f"""transform(_m, (m, i) -> struct(
            _b[i] + length(_g[i]) AS start, {k} AS kind, _b[i] + length(_g[i]) + length(m) AS stop, m AS m))"""))
        keep = KEEP.get(kind)
        rows = F.filter("_all", lambda s: keep(s["m"])) if keep else F.col("_all")
        df = df.withColumn(f"_{kind}", F.transform(rows, lambda s: F.struct(s["start"], s["kind"], s["stop"])))
        df = df.drop("_m", "_g", "_n", "_b", "_all")
    return df


def joined(spans: Column) -> Column:
    """kind:start:stop, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with complementary parts in scope.

    ``parts``: key, start, stop, kind (index in ``KINDS``), role (identifier, secret or
    endpoint), weak. Every part meets three cells' extremes, whatever their sizes.
    """
    roles = ["identifier", "secret", "endpoint"]
    cell = F.floor(F.col("start") / scope)
    extremes = parts.groupBy("key", cell.alias("own")).agg(*[
        f(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{n}")
        for r in roles for n, f in (("first", F.min), ("last", F.max))
    ])
    near = (
        extremes.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
        .withColumn("cell", F.col("own") + F.col("step"))
        .groupBy("key", "cell").agg(*[
            c for r in roles for c in (
                F.max(F.when(F.col("step") == 0, F.col(f"{r}_first"))).alias(f"{r}_here"),
                F.max(F.when(F.col("step") == 1, F.col(f"{r}_last"))).alias(f"{r}_ahead"),
                F.min(F.when(F.col("step") == -1, F.col(f"{r}_first"))).alias(f"{r}_behind"),
            )
        ])
    )

    def beside(role: str) -> Column:
        return F.coalesce(
            F.col(f"{role}_here").isNotNull()
            | (F.col("start") - F.col(f"{role}_ahead") <= scope) | (F.col(f"{role}_behind") - F.col("start") <= scope),
            F.lit(False))

    complete = (
        F.when(F.col("role") == "secret", beside("identifier") | beside("endpoint"))
        .when(F.col("role") == "identifier", beside("secret"))
        .otherwise(beside("identifier") & beside("secret"))
    )
    weak = parts.where("weak").withColumn("cell", cell)
    return weak.join(near, ["key", "cell"]).where(complete).select("key", "start", "kind", "stop")


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """Add n_assign, n_access, n_hex, base_spans, spans (start, kind, stop) and n_linked.

    Positions are code points, ends exclusive. Null text counts as empty and has no span.
    Equal texts are linked once, by a digest of the text, and every repeated row gets the
    result; spans that start alike are ordered by kind; long texts are linked in cells, so
    without pairs; no rows give no rows. Input columns named like a result give way to it.
    Extra columns pass through.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    body = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    # every link needs a secret and another part
    secret = body.rlike(ASSIGN) | body.rlike(SECRET)
    other = body.rlike(IDENTIFIER) | body.rlike(HINTS["endpoint"]) | body.rlike(HINTS["access"])
    base = _spans(inner, body, KINDS[:3])
    alone = base.where(~(secret & other)).withColumn("_linked", F.expr(f"CAST(array() AS {SPAN})"))
    might = _spans(base.where(secret & other).withColumn("_key", F.sha2(body, 256)), body, KINDS[3:])

    roles = F.create_map(*[F.lit(x) for kind, role in (
        (0, "secret"), (1, "identifier"), (2, "secret"), (3, "identifier"), (4, "secret"), (5, "endpoint"),
    ) for x in (kind, role)])
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    parts = (
        might.groupBy("_key").agg(F.first(every).alias("p")).select(F.col("_key").alias("key"), F.explode("p").alias("p"))
        .select("key", "p.*").withColumn("role", roles[F.col("kind")]).withColumn("weak", F.col("kind") >= 3)
    )
    found = linked(parts, scope).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("_linked"))
    with_links = (
        might.drop(*[f"_{k}" for k in KINDS[3:]])
        .join(found.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
        .withColumn("_linked", F.coalesce("_linked", F.expr(f"CAST(array() AS {SPAN})")))
    )
    both = alone.unionByName(with_links)
    results = {
        "n_assign": F.size("_assign").cast("bigint"), "n_access": F.size("_access").cast("bigint"),
        "n_hex": F.size("_hex").cast("bigint"), "base_spans": F.sort_array(F.concat("_assign", "_access", "_hex")),
        "spans": F.sort_array(F.concat("_assign", "_access", "_hex", "_linked")),
        "n_linked": F.size("_linked").cast("bigint"),
    }
    keep = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in results]
    return both.select(*keep, *[c.alias(n) for n, c in results.items()])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "n_linked")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a credential, strong or linked, go; the others pass with the columns of
    ``documents``, any more are dropped."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    return scan(docs.select(*columns)).where(F.size("spans") == 0).select(*columns)


def _sql_kind(k: int, keep: str = "true") -> str:
    pattern = PATTERNS[k].replace("'", "''")
    return f"""
      SELECT doc_id, {k} AS kind, start, start + length(m) AS stop FROM (
        SELECT doc_id, m, coalesce(sum(length(m) + length(g)) OVER (
                 PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(g) AS start
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i
              FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS ms,
                           string_split_regex(coalesce(text, ''), '{pattern}') AS gs FROM documents)))
      WHERE {keep}"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
SQL = f"""
WITH parts AS (
  {_sql_kind(0, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 1)) >= 6")} UNION ALL {_sql_kind(1)} UNION ALL {_sql_kind(2)}
  UNION ALL {_sql_kind(3)} UNION ALL {_sql_kind(4, "NOT regexp_full_match(m, '[0-9a-f]{24,}')")} UNION ALL {_sql_kind(5)}),
near AS (
  SELECT a.doc_id, a.kind, a.start, a.stop, bool_or(b.kind IN (1, 3)) AS ident,
         bool_or(b.kind IN (0, 2, 4)) AS secr, bool_or(b.kind = 5) AS endp
  FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND abs(a.start - b.start) <= {SCOPE}
  WHERE a.kind >= 3 GROUP BY ALL),
spans AS (
  SELECT doc_id, kind, start, stop FROM parts WHERE kind < 3 UNION ALL
  SELECT doc_id, kind, start, stop FROM near
  WHERE CASE kind WHEN 4 THEN ident OR endp WHEN 3 THEN secr ELSE ident AND secr END),
named AS (
  SELECT doc_id, kind, start, {[*KINDS]}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS t FROM spans),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind >= 3) AS n_linked,
         string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(t, ',' ORDER BY start, kind) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM documents LEFT JOIN told USING (doc_id)
"""
