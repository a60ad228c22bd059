"""Page-Hinkley over a stream, with four numbers of state per key.

``stream_page_hinkley`` is for keys whose rows of one batch fit into a task. ``scan_page_hinkley`` takes a batch of any size: it is
scanned in pieces, a bucket at a time, and the state of the keys it touches is a versioned table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DriftConfig
from ..operators.drift import PH_STATE, page_hinkley_scan
from ..session import materialise
from .versions import VersionedTable

STATE = "n bigint, total double, deviation double, lowest double"


def stream_page_hinkley(df: DataFrame, key: str, order: list[str], error: str,
                        cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Score per observation, in ``order`` within each batch; batches must come in time order.

    A batch's rows of one key are sorted in one task, so bound the batches at the source
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), or use ``scan_page_hinkley``.
    """
    delta, threshold, quiet = cfg.delta, cfg.threshold, cfg.min_instances
    types = dict(df.dtypes)
    schema = ", ".join([f"{key} {types[key]}", *[f"{o} {types[o]}" for o in order],
                        f"{error} double, ph_n bigint, ph_score double, is_drift boolean"])

    def update(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, dev, low = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(chunks)).sort_values(order, kind="stable")
        e = rows[error].astype(float)
        count = pd.Series(range(1, len(e) + 1), index=e.index) + n
        s = dev + (e - (e.cumsum() + total) / count - delta).cumsum()
        floor = s.cummin().clip(upper=low)
        score = s - floor
        state.update((int(count.iloc[-1]), float(total + e.sum()), float(s.iloc[-1]), float(floor.iloc[-1])))
        out = rows[[*order]].copy()
        out.insert(0, key, k[0])
        yield out.assign(**{error: e, "ph_n": count, "ph_score": score,
                            "is_drift": (count > quiet) & (score > threshold)})

    cols = [key, *order, error]
    return df.select(*cols).groupBy(key).applyInPandasWithState(
        update, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def scan_page_hinkley(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, bucket: str, root: str, checkpoint: str,
                      cfg: DriftConfig = DriftConfig(), buckets: int = 64) -> StreamingQuery:
    """Scores of every batch under ``root/scores``; batches come in time order, and ``bucket`` follows ``order`` within them.

    A batch that is run again reads the state before it and replaces its scores.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], PH_STATE])
    state = VersionedTable(df.sparkSession, f"{root}/state", schema, keys, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        scored, after = page_hinkley_scan(batch, keys, order, error, bucket, cfg, state.read(batch_id))
        scored.write.mode("overwrite").parquet(f"{root}/scores/batch_id={batch_id}")
        after = materialise(after, "ph-after")
        touched = state.touched(after)
        kept = state.read(batch_id, touched).join(after.select(*keys), keys, "left_anti")
        state.write(batch_id, kept.unionByName(after), touched)
        state.vacuum(batch_id)

    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
