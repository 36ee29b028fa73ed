"""Quality rules as a bitmask ledger.

Every rule is evaluated once; the ledger keeps each document's measurements and one failure
bit per rule. Policies are versioned bit masks applied afterwards, and ablations (what a
policy would keep without one of its rules) are bitwise aggregations over the ledger.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import common

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    #: SQL condition over the measurements, true where a document fails
    fails: str


RULES = [
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "shouting", "10 * n_upper_words > 5 * n_words AND n_words >= 10"),
    Rule(4, "repeated_neighbours", "10 * n_same_neighbours > 3 * n_words"),
    Rule(5, "odd_word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words)"),
    Rule(6, "repeated_lines", "10 * n_dup_lines > 7 * n_lines AND n_lines >= 4"),
    Rule(7, "no_words", "n_words = 0"),
]
BASE = ("few_words", "repeated_windows")
# versions of policies: the rules whose failure rejects a document
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "shouting", "no_words"),
    "v2": tuple(r.name for r in RULES),
}
PRODUCTION = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_upper_words", "n_same_neighbours", "n_lines", "n_dup_lines",
            "n_repeat_words"]


def mask_of(policy: str, rules: list[Rule] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policies[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text, and ``fail_bits`` with one bit per rule.

    Null text has no words. Repeated windows compare the words themselves: a text whose
    window hashes all differ has none, the others are sorted by hash and words.
    A text is measured as a whole, however long; no rows give no rows. Repeated rows are
    measured alike; input columns named like a result give way to it.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    body = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    df = df.withColumn("_words", F.filter(F.split(body, SPACE), lambda w: w != ""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_h", F.expr("transform(_words, w -> xxhash64(w))"))
    at = ", ".join(f"_h[i + {k}]" for k in range(WINDOW))
    df = df.withColumn("_wins", F.expr(
        f"CASE WHEN size(_h) < {WINDOW} THEN CAST(array() AS array<bigint>) "
        f"ELSE transform(sequence(0, size(_h) - {WINDOW}), i -> xxhash64({at})) END"))
    # (hash, words, place) of all windows, only for texts where a hash occurs twice
    df = df.withColumn("_sorted", F.expr(f"""
        CASE WHEN size(array_distinct(_wins)) = size(_wins) THEN NULL
        ELSE sort_array(transform(_wins, (h, i) -> struct(h, array_join(slice(_words, i + 1, {WINDOW}), ' ') AS w, i AS i))) END"""))
    df = df.withColumn("_twice", F.expr("""sort_array(transform(filter(
        transform(_sorted, (x, k) -> struct(x.i AS i,
          (k > 0 AND _sorted[k - 1].h = x.h AND _sorted[k - 1].w = x.w)
          OR (k + 1 < size(_sorted) AND _sorted[k + 1].h = x.h AND _sorted[k + 1].w = x.w) AS twice)),
        x -> coalesce(x.twice, false)), x -> x.i))"""))
    measures = {
        "n_words": "CAST(size(_words) AS BIGINT)",
        "word_chars": "aggregate(_words, 0L, (s, w) -> s + length(w))",
        "n_symbols": "CAST(length(_body) - length(translate(_body, '#*$%&|<>', '')) AS BIGINT)",
        "n_upper_words": "CAST(size(filter(_words, w -> w <> lower(w) AND w = upper(w) AND length(w) > 1)) AS BIGINT)",
        "n_same_neighbours": "CAST(size(filter(_h, (h, i) -> i > 0 AND _h[i - 1] = h)) AS BIGINT)",
        "n_lines": "CAST(size(_lines) AS BIGINT)",
        "n_dup_lines": "CAST(size(_lines) - size(array_distinct(_lines)) AS BIGINT)",
        # each repeated window adds its words up to the start of the next
        "n_repeat_words": f"""coalesce(aggregate(transform(_twice, (x, k) ->
            IF(k + 1 < size(_twice), least({WINDOW}, _twice[k + 1] - x), {WINDOW})), 0L, (s, x) -> s + x), 0L)""",
    }
    df = df.withColumn("_body", body)
    keep = [F.col(n).alias(c) for c, n in names.items() if c.lower() not in {*measures, "fail_bits"}]
    df = df.select(*keep, *[F.expr(sql).alias(name) for name, sql in measures.items()])
    bits: Column = F.lit(0).cast("bigint")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return df.withColumn("fail_bits", bits)


def applied(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Add ``policy`` and ``kept``: no rule of the policy failed."""
    return ledger.withColumn("policy", F.lit(policy)).withColumn(
        "kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0)


def ablations(ledger: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents it fails, those only it fails, what the policy keeps with and without it.

    Rows collapse to one per failure mask before anything else, so the report costs one
    small shuffle.
    """
    mask = mask_of(policy)
    counts = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    per_rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                                   for r in rules]))
    none = F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0))
    only = F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0))
    return counts.withColumn("r", per_rule).groupBy("r.rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        only.alias("fails_alone"), none.alias("kept"), (none + only).alias("kept_without"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.lit(mask_of("base")).cast("bigint")
    return applied(measured(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits")


_FAILS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
wins AS (
  SELECT doc_id, i, words[i:i + {WINDOW - 1}] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM texts)),
twice AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM wins) WHERE n > 1),
reps AS (
  SELECT doc_id, CAST(sum(coalesce(least({WINDOW}, following - i), {WINDOW})) AS BIGINT) AS n_repeat_words
  FROM twice GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT), 0) AS word_chars,
         length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
         len(list_filter(words, lambda w: w <> lower(w) AND w = upper(w) AND length(w) > 1)) AS n_upper_words,
         len(list_filter(words, lambda w, i: i > 1 AND words[i - 1] = w)) AS n_same_neighbours,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts LEFT JOIN reps USING (doc_id)),
bits AS (SELECT *, CAST({_FAILS} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask_of('base')}) <> 0 AS base_failed, (fail_bits & {mask_of(PRODUCTION)}) = 0 AS kept, fail_bits
FROM bits
"""
