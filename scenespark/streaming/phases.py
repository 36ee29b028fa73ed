"""Baseline first, then scoring, on a stream.

A feed's first frames are kept in its state. Once there are enough, its forest is fitted
there, the frames are let go and the model stays, packed, in the state; every later frame is
scored with it. A micro-batch costs its own rows and the models of its feeds, however many
batches came before. Models fitted earlier can be given; their feeds are scored from the
first frame on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scenespark import constants as C
from scenespark.operators import iforest
from scenespark.streaming.held_rows import HELD_ROWS, HeldRows, in_chunks

SCORE_SCHEMA = "feed_id long, frame_id long, model_score double"
PACKED_SCHEMA = "trees int, sample_size int, n_train long, offset double, nodes binary"
_POINT = "frame_id long, " + ", ".join(f"{c} double" for c in C.FEATURES)
_NODE_COLUMNS = [f.split()[0] for f in iforest.NODE_SCHEMA.split(", ")]


def _packed(nodes: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(nodes[_NODE_COLUMNS], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(nodes: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(nodes).read_pandas()


class FeedScorer(StatefulProcessor):
    """Baseline frames of one feed until there are ``need``, its forest from then on.

    ``need`` is at most the sample of a tree: a longer baseline is fitted as a batch and
    given as a model. Frames of one micro-batch go by frame id. The frames of the baseline
    get no score.
    """

    def __init__(self, trees: int, need: int = C.BASELINE_FRAMES, seed: int = C.SEED, held: int = HELD_ROWS) -> None:
        if not 2 <= need <= C.FOREST_SAMPLE:
            raise ValueError(f"a baseline in the state holds 2 to {C.FOREST_SAMPLE} frames")
        self.trees, self.need, self.seed, self.held = trees, need, seed, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._baseline = handle.getListState("baseline", _POINT)
        self._model = handle.getValueState("model", PACKED_SCHEMA)
        self._rows = HeldRows(handle, ["frame_id"], self.held)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        one = initialState.iloc[0]
        nodes = iforest.unpacked(one["nodes"])
        self._model.update((int(one["trees"]), int(one["sample_size"]), int(one["n_train"]), float(one["offset"]), _packed(nodes)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._model.exists():
            model = self._read()
            for chunk in rows:
                yield self._scored(key[0], chunk, model)
            return
        early = [tuple(p) for p in self._baseline.get()]
        have, model = len(early), None
        for chunk in in_chunks(self._rows.ordered(rows)):
            if model is None:
                taken = self.need - len(early)
                early += [(int(r.frame_id), *(float(getattr(r, c)) for c in C.FEATURES)) for r in chunk[:taken]]
                chunk = chunk[taken:]
                if len(early) < self.need:
                    continue
                model = self._fit(int(key[0]), early)
            if chunk:
                yield self._scored(key[0], pd.DataFrame(chunk), model)
        if model is not None:
            self._baseline.clear()
        elif len(early) > have:
            self._baseline.appendList(early[have:])

    def _fit(self, feed: int, early: list[tuple]) -> tuple:
        points = pd.DataFrame(early, columns=["frame_id", *C.FEATURES]).sort_values("frame_id", kind="stable")
        forest = iforest.fit_whole(points, feed, self.trees, C.CONTAMINATION, self.seed)
        self._model.update((self.trees, forest.size, len(points), forest.offset, _packed(forest.nodes)))
        return forest.nodes, forest.size, forest.offset

    def _read(self) -> tuple:
        _, size, _, offset, nodes = self._model.get()
        return _unpacked(bytes(nodes)), size, offset

    def _scored(self, feed, rows: pd.DataFrame, model: tuple) -> pd.DataFrame:
        nodes, size, offset = model
        s = iforest.score_samples(rows[C.FEATURES].to_numpy(float), nodes, size)
        return pd.DataFrame({"feed_id": feed, "frame_id": rows["frame_id"], "model_score": s - offset})

    def close(self) -> None:
        pass


def scored_stream(
    features: DataFrame, trees: int = C.FOREST_TREES, need: int = C.BASELINE_FRAMES, models: DataFrame | None = None,
    held: int = HELD_ROWS,
) -> DataFrame:
    """``model_score`` of the frames after the baseline. ``features`` is ``feature_stream``,
    ``models`` a batch table of forests, one row per feed."""
    return features.select("feed_id", "frame_id", *C.FEATURES).groupBy("feed_id").transformWithStateInPandas(
        FeedScorer(trees, need, held=held), SCORE_SCHEMA, "Append", "None",
        initialState=models.groupBy("feed_id") if models is not None else None)


def start_scoring(
    features: DataFrame, path: str, checkpoint: str, trees: int = C.FOREST_TREES, need: int = C.BASELINE_FRAMES,
    models: DataFrame | None = None,
):
    """Scores as Parquet; the sink's log leaves out what a repeated batch wrote before."""
    return (
        scored_stream(features, trees, need, models).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).start()
    )


def scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE_SCHEMA).parquet(path)


def models(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The forests in the state of a scoring stream, as ``iforest.fit`` returns them."""
    packed = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "model").load()

    def opened(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["nodes"] = [_unpacked(n).to_dict("records") for n in part["nodes"]]
            yield part

    return packed.select(F.col("key.feed_id").alias("feed_id"), "value.*").mapInPandas(opened, iforest.FOREST_SCHEMA)
