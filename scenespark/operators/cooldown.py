"""Notification cooldown per threat class.

An alert is notified when every class it mentions has been quiet for the
cooldown; only then are those classes marked. Time is event time. The state is
certainly cold after a gap of one cooldown between alerts of a feed, so alerts
split there into independent chunks; longer stretches are cut by position and
chained.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenespark import constants as C
from scenespark.operators.alerts import notifiable
from scenespark.operators.chained import CHUNK, run_chained
from scenespark.operators.checkpoints import cut
from scenespark.operators.ordering import BLOCK_ROWS, block_window, with_blocks, with_position

_SCHEMA = (
    "feed_id long, block long, part long, kind string, alert_id string, notify boolean, "
    "cool_key string, last_us long, tie boolean"
)


def cooldown_step(times: list[int], keys: list[list[str]], last: dict[str, int], wait: int) -> list[bool]:
    """Decide alerts in order; ``last`` is updated in place."""
    decisions = []
    for t, mentioned in zip(times, keys):
        ok = all(k not in last or t - last[k] >= wait for k in mentioned)
        if ok:
            last.update(dict.fromkeys(mentioned, t))
        decisions.append(ok)
    return decisions


def chunk_alerts(alerts: DataFrame, wait_us: int, block_rows: int) -> DataFrame:
    """Notifiable alerts with their chunk, in event-time order."""
    rows = alerts.select(
        "feed_id", "frame_id", "alert_id", F.unix_micros("ts").alias("at"), "cooldown_keys"
    )
    order = ["at", "frame_id", "alert_id"]
    placed = with_position(rows, ["feed_id"], order, F.floor(F.col("at") / 3_600_000_000))
    run = block_window(["feed_id"], "pos")
    quiet = F.coalesce(F.col("at") - F.lag("at").over(run) >= wait_us, F.lit(True))
    return (
        with_blocks(placed, "pos", 1, block_rows)
        .withColumn("_clean", quiet)
        .filter("_own")
        .withColumn("part", F.sum(F.col("_clean").cast("int")).over(run))
        .select("feed_id", F.col("_block").alias("block"), "part", "pos", "alert_id", "at", "cooldown_keys")
    )


def notifications(
    alerts: DataFrame, cooldown_seconds: float = C.COOLDOWN_SECONDS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """High and critical alerts with ``notify``: true when a message goes out.

    Alerts themselves are never dropped; the cooldown only mutes messages.
    """
    wait = int(cooldown_seconds * 1_000_000)
    # one small row per notifiable alert, used by several branches
    base = cut(notifiable(alerts))
    chunked = chunk_alerts(base, wait, block_rows)

    def decide(rows: pd.DataFrame, start: pd.DataFrame | None):
        rows = rows.sort_values("pos")
        last = {} if start is None or start.empty else dict(zip(start["cool_key"], start["last_us"]))
        keys = [list(k) for k in rows["cooldown_keys"]]
        return rows, cooldown_step(rows["at"].tolist(), keys, last, wait), last

    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def step(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows, notify, last = decide(rows, start)
        end = int(rows["at"].iloc[-1])
        hot = {k: t for k, t in last.items() if end - t < wait}
        both = pd.concat([
            pd.DataFrame({"kind": "obs", "alert_id": rows["alert_id"].to_numpy(), "notify": notify}),
            pd.DataFrame({"kind": "out", "cool_key": list(hot), "last_us": list(hot.values())}),
        ], ignore_index=True)
        for c in CHUNK:
            both[c] = rows[c].iloc[0]
        return both.reindex(columns=names)

    decided = run_chained(chunked, step, _SCHEMA, ["cool_key", "last_us"]).result.filter("kind = 'obs'").select("alert_id", "notify")
    return base.join(decided, "alert_id")
