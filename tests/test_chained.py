"""Chunks that hand their state on: the log of rounds, and what each of them writes."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scenespark.operators.chained import CHUNK, run_chained

SCHEMA = "feed_id long, block long, part long, kind string, pos long, total long, carry long, tie boolean"


def stepper():
    """Running remainders: a state of 0 is forgotten, so most blocks do not depend on the one before."""
    def step(rows, state):
        rows = rows.sort_values("pos")
        carry = 0 if state is None or state.empty else int(state["carry"].iloc[0])
        totals = []
        for v in rows["value"]:
            carry = 0 if v == 0 else (carry + int(v)) % 7
            totals.append(carry)
        out = [{"kind": "obs", "pos": p, "total": t} for p, t in zip(rows["pos"], totals)]
        if carry:
            out.append({"kind": "out", "carry": carry})
        both = pd.DataFrame(out)
        for c in CHUNK:
            both[c] = rows[c].iloc[0]
        return both.reindex(columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return step


def chunks(spark, values, size):
    rows = [(f, i // size, 0, i, v) for f, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "feed_id long, block long, part long, pos long, value long")


def plain(values):
    out = {}
    for f, vs in values.items():
        carry = 0
        for i, v in enumerate(vs):
            carry = 0 if v == 0 else (carry + v) % 7
            out[f, i] = carry
    return out


def log_of(spark, run):
    return spark.read.schema(f"{SCHEMA}, round int").option("basePath", run.path).parquet(run.path)


def test_rounds_append_only_what_ran_again(spark):
    # feed 0 never forgets within its first five blocks; feed 1 forgets everywhere
    values = {0: [1] * 25 + [0] + [2] * 24, 1: [3, 0] * 25}
    run = run_chained(chunks(spark, values, 5), stepper(), SCHEMA, ["carry"])
    got = {(r["feed_id"], r["pos"]): r["total"] for r in run.result.filter("kind = 'obs'").collect()}
    assert got == plain(values)
    log = log_of(spark, run).filter("kind = 'obs'")
    per_round = {r["round"]: (r["chunks"], r["rows"]) for r in log.groupBy("round").agg(
        F.countDistinct(*CHUNK).alias("chunks"), F.count(F.lit(1)).alias("rows")).collect()}
    assert per_round[0] == (20, 100)
    # each further round has the rerun chunks and nothing else
    assert [per_round[n + 1] for n in range(len(run.reran))] == [(c, 5 * c) for c in run.reran]
    assert run.reran == sorted(run.reran, reverse=True) and sum(run.reran) < 5 * len(values[0]) // 5
    # a block behind one that came to rest is not looked at again
    assert log.filter("feed_id = 1 AND round > 1").count() == 0


def test_settled_at_once_writes_one_round(spark):
    values = {0: [3, 0] * 10, 1: [0] * 20}
    run = run_chained(chunks(spark, values, 4), stepper(), SCHEMA, ["carry"])
    assert run.reran == [] and log_of(spark, run).select("round").distinct().count() == 1
    assert {(r["feed_id"], r["pos"]): r["total"] for r in run.result.filter("kind = 'obs'").collect()} == plain(values)


@pytest.mark.parametrize("size", [3])
def test_worst_case_is_the_sequential_result(spark, size):
    values = {5: [2] * 12}
    run = run_chained(chunks(spark, values, size), stepper(), SCHEMA, ["carry"])
    assert {(r["feed_id"], r["pos"]): r["total"] for r in run.result.filter("kind = 'obs'").collect()} == plain(values)


def test_no_rows(spark):
    run = run_chained(chunks(spark, {0: [1]}, 5).limit(0), stepper(), SCHEMA, ["carry"])
    assert run.result.count() == 0


def test_chunks_without_a_state_run_together(spark):
    # 300 short chunks, one of them longer than an Arrow batch
    values = {f: [1, 0, 2] for f in range(299)} | {299: [1] * 50}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    one, calls = stepper(), spark.sparkContext.accumulator(0)

    def several(rows):
        calls.add(1)
        return pd.concat([one(part, None) for _, part in rows.groupby(CHUNK)], ignore_index=True)

    try:
        run = run_chained(chunks(spark, values, 1000).coalesce(2), one, SCHEMA, ["carry"], fresh=several)
        assert {(r["feed_id"], r["pos"]): r["total"] for r in run.result.filter("kind = 'obs'").collect()} == plain(values)
        assert not run.continues and 0 < calls.value < 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
