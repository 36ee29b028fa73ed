"""The rows of one key in a micro-batch, in order and in bounded memory.

Spark hands a stateful processor the rows of a key in chunks that come in no particular
order. Few rows are sorted in memory; more are sorted run by run, the runs wait in slices in
the state store and are merged slice by slice.
"""

from __future__ import annotations

import heapq
import pickle
from collections import namedtuple
from collections.abc import Iterator
from itertools import islice
from operator import attrgetter

import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

# rows held before a run is put away, and rows of a slice
HELD_ROWS, SLICE_ROWS = 16_384, 256


class HeldRows:
    """Sorted access to a key's rows; the runs are gone from the state once they are read."""

    def __init__(self, handle: StatefulProcessorHandle, order: list[str], held: int = HELD_ROWS) -> None:
        self._slices = handle.getMapState("held_rows", "run int, slice int", "rows binary")
        self._order, self._held = order, held

    def ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Named tuples by the order columns."""
        kept, n, runs, make = [], 0, [], None
        for chunk in rows:
            make = make or namedtuple("Row", list(chunk.columns))
            kept.append(chunk)
            n += len(chunk)
            if n > self._held:
                runs.append(self._put_away(len(runs), self._sorted(kept)))
                kept, n = [], 0
        if make is None:
            return
        last = map(make._make, self._sorted(kept).itertuples(index=False, name=None)) if kept else iter(())
        waiting = [self._run(run, slices, make) for run, slices in enumerate(runs)]
        yield from heapq.merge(*waiting, last, key=attrgetter(*self._order))

    def _sorted(self, kept: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(kept, ignore_index=True).sort_values(self._order, kind="stable")

    def _put_away(self, run: int, rows: pd.DataFrame) -> int:
        starts = range(0, len(rows), SLICE_ROWS)
        for i, at in enumerate(starts):
            part = list(rows.iloc[at:at + SLICE_ROWS].itertuples(index=False, name=None))
            self._slices.updateValue((run, i), (pickle.dumps(part),))
        return len(starts)

    def _run(self, run: int, slices: int, make) -> Iterator[tuple]:
        for i in range(slices):
            part = pickle.loads(bytes(self._slices.getValue((run, i))[0]))
            self._slices.removeKey((run, i))
            yield from map(make._make, part)


def in_chunks(rows: Iterator, size: int = 1024) -> Iterator[list]:
    rows = iter(rows)
    while chunk := list(islice(rows, size)):
        yield chunk
