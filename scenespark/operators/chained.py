"""Sequential state over chunks that run in parallel.

Rows are cut into chunks ``(feed_id, block, part)``. ``part`` 0 continues the
previous block; higher parts are known to start without state. Round one runs
every chunk from an empty state. Each further round gives a continuing chunk the
state its predecessor actually left and reruns only chunks for which that state
differs from the one they used. When none differs, every chunk ran with the true
state, so the result equals one sequential pass, while no task ever holds more
than one chunk.

A chunk is often a handful of rows, so round one, which needs no states, hands a step the
whole chunks of an Arrow batch together; only reruns meet their state in a group each.

Results are a log: a round appends the rows of the chunks it ran and nothing
else, and a chunk's last round wins. A block is looked at again only if the chunk
in front of it ran in the round before; all others have come to rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.operators.checkpoints import cut, ensure_checkpoint_dir
from scenespark.operators.ordering import spread

CHUNK = ["feed_id", "block", "part"]


@dataclass
class Chained:
    """``result``: the rows of the last round of every chunk; ``tails``: the last part of every block;
    ``path``: the log, a folder of Parquet files per round; ``reran``: chunks run again in each further round;
    ``continues``: whether any chunk continues another."""

    result: DataFrame
    tails: DataFrame
    path: str
    reran: list[int] = field(default_factory=list)
    continues: bool = True


def run_chained(
    chunked: DataFrame,
    step: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame],
    schema: str,
    state_cols: list[str],
    order_col: str | None = None,
    fresh: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> Chained:
    """Run ``step(rows, start_state)`` over all chunks until states agree.

    ``step`` returns rows of ``schema``, which holds the chunk keys, ``kind``
    (``obs`` results, ``out`` state rows, ``end``) and ``tie``. When ``order_col``
    is given, its values only count in the comparison once some chunk reported a
    tie. ``fresh`` may run several whole chunks, all without a state, in one call.
    """
    spark = chunked.sparkSession
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    chunked = cut(chunked)
    heads = chunked.filter("part = 0 AND block > 0").select("feed_id", "block").distinct()
    tails = chunked.groupBy("feed_id", "block").agg(F.max("part").alias("part"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chained-{uuid.uuid4().hex[:12]}"

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([step(part, None) for _, part in rows.groupby(CHUNK, sort=False)], ignore_index=True)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (out[names] for out in map(fresh or each, _whole_chunks(batches)))

    def run(todo: DataFrame, start: DataFrame, number: int) -> None:
        def one(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            return step(rows, state) if len(rows) else pd.DataFrame(columns=names)

        keyed = start.withColumn("part", F.lit(0).cast("bigint"))
        pairs = spread(todo, *CHUNK).groupBy(*CHUNK).cogroup(spread(keyed, *CHUNK).groupBy(*CHUNK))
        pairs.applyInPandas(one, schema).write.parquet(f"{path}/round={number}")

    def logged(number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/round={number}")

    def signatures(start: DataFrame) -> DataFrame:
        """Per block its start state, with and without what counts only on ties; none for no state."""
        def packed(strict: bool):
            entry = F.struct(*[c for c in state_cols if strict or c != order_col])
            return F.to_json(F.array_sort(F.collect_list(entry)))

        return start.groupBy("feed_id", "block").agg(packed(True).alias("strict"), packed(False).alias("loose"))

    spread(chunked, *CHUNK).sortWithinPartitions(*CHUNK).mapInPandas(whole, schema).write.parquet(f"{path}/round=0")
    out = Chained(logged(0), tails, path)
    # without a chunk that continues another nothing can differ
    if not heads.head(1):
        out.continues = False
        return out
    used = _no_state(spark, schema, state_cols).select(
        "feed_id", "block", *[F.lit(None).cast("string").alias(c) for c in ("strict", "loose")])
    moved, strict, reruns = tails, False, None
    while True:
        number = len(out.reran)
        tied = order_col is not None and not strict and bool(logged(number).filter("kind = 'end' AND tie").head(1))
        counts = "strict" if strict or tied or order_col is None else "loose"
        # blocks behind a tail that ran just now; all of them when more than before has come to count
        behind = (tails if tied else moved).select("feed_id", (F.col("block") + 1).alias("block")).join(
            heads, ["feed_id", "block"], "left_semi")
        strict = strict or tied
        ends = _latest(spark, path, schema, reruns) if tied else logged(number)
        start = cut(
            ends.filter("kind = 'out'").join(tails, CHUNK).withColumn("block", F.col("block") + 1)
            .join(behind, ["feed_id", "block"], "left_semi").select("feed_id", "block", *state_cols))
        now = behind.join(signatures(start), ["feed_id", "block"], "left")
        was = used.select("feed_id", "block", *[F.col(c).alias(f"was_{c}") for c in ("strict", "loose")])
        wrong = cut(
            now.join(was, ["feed_id", "block"], "left").filter(~F.col(counts).eqNullSafe(F.col(f"was_{counts}")))
            .select("feed_id", "block", "strict", "loose", F.lit(0).cast("bigint").alias("part")))
        chunks = wrong.count()
        if not chunks:
            if reruns is not None:
                out.result = _latest(spark, path, schema, reruns)
            return out
        run(chunked.join(wrong.select(*CHUNK), CHUNK, "left_semi"),
            start.join(wrong.select("feed_id", "block"), ["feed_id", "block"], "left_semi"), number + 1)
        out.reran.append(chunks)
        again = wrong.select(*CHUNK, F.lit(number + 1).alias("round"))
        reruns = again if reruns is None else cut(
            reruns.unionAll(again).groupBy(*CHUNK).agg(F.max("round").alias("round")))
        fresh = wrong.select("feed_id", "block", "strict", "loose")
        used = cut(used.join(fresh, ["feed_id", "block"], "left_anti").unionAll(fresh))
        # a rerun chunk passes its state on only if it is the last of its block
        moved = tails.join(wrong.select(*CHUNK), CHUNK, "left_semi")


def _latest(spark, path: str, schema: str, reruns: DataFrame | None) -> DataFrame:
    """The rows of each chunk's last round; ``reruns`` names that of the chunks that ran again."""
    rows = spark.read.schema(f"{schema}, round int").option("basePath", path).parquet(path)
    if reruns is None:
        return rows.filter("round = 0").drop("round")
    last = reruns.withColumnRenamed("round", "_last")
    return rows.join(last, CHUNK, "left").filter("round = coalesce(_last, 0)").drop("round", "_last")


def _whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by chunk, cut anew so that none ends within a chunk."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[CHUNK].to_numpy()
        inner = np.flatnonzero((keys != keys[-1]).any(axis=1))
        last = int(inner[-1]) + 1 if len(inner) else 0
        if held and (last or (held[-1][CHUNK].to_numpy()[-1] != keys[0]).any()):
            yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            held = []
        elif last:
            yield batch.iloc[:last]
        held.append(batch.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _no_state(spark, schema: str, state_cols: list[str]) -> DataFrame:
    fields = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    return spark.range(0).select(*[F.lit(None).cast(fields[c]).alias(c) for c in ["feed_id", "block", *state_cols]])
