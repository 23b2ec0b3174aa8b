"""Run a user's function over each batch of a plan, on the executors. A failure is recorded, never fatal."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockledger.schema import KEY
from blockledger.session import materialize

RESULT = "pool_id string, block_id bigint, length bigint, gen_stamp bigint, ok boolean, error string"


def _bounds(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    changed = np.zeros(max(len(frame) - 1, 0), dtype=bool)
    for column in by:
        values = frame[column].to_numpy()
        changed |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [len(frame)]])


def _whole_units(frames, by):
    """Frames that hold only whole units: a unit the transfer cut in two waits for its rest."""
    held = None
    for frame in frames:
        if frame.empty:
            continue
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = _bounds(frame, by)[-2]
        held = frame.iloc[last:]
        if last:
            yield frame.iloc[:last]
    if held is not None:
        yield held


def _call_each(rows: DataFrame, by: list[str], call) -> DataFrame:
    """One `call(address, blocks)` per unit. It fails by raising or by answering with a text."""
    spread = [c for c in by if c != "address"]

    def run(frames):
        for frame in _whole_units(frames, by):
            errors = np.full(len(frame), None, dtype=object)
            keys, cuts = frame[KEY], _bounds(frame, by).tolist()
            addresses = frame["address"].to_numpy() if "address" in by else None
            for a, b in zip(cuts[:-1], cuts[1:]):
                address = None if addresses is None else addresses[a]
                try:
                    answer = call(address, keys.iloc[a:b])
                    errors[a:b] = answer if isinstance(answer, str) else None
                except Exception as problem:
                    errors[a:b] = f"{type(problem).__name__}: {problem}"
            yield keys.assign(ok=[e is None for e in errors], error=errors)

    # Written once: whoever reads the outcomes reads these, and never calls the function again.
    return materialize(rows.repartition(*spread).sortWithinPartitions(*by, *KEY).mapInPandas(run, RESULT))


def apply_deletes_with(fn, plan: DataFrame, by=("pool_id", "action", "batch_no")) -> DataFrame:
    """Call `fn(blocks)` for each batch of deletes. The calls are made here, not when the result is read.

    A task that is run again after a failure repeats its batches: deletes allow that.
    """
    by = list(by)
    return _call_each(plan.select(*dict.fromkeys([*by, *KEY])), by, lambda _, blocks: fn(blocks))


def send_requests_with(fn, plan: DataFrame, by=("pool_id", "action", "batch_no")) -> DataFrame:
    """Call `fn(address, blocks)` once per batch and chosen replica; blocks without a replica are not sent."""

    def call(address, blocks):
        return fn(address, blocks) if address else "no replica"

    address = F.when(F.col("replica").isNotNull(), F.concat_ws(":", "replica.ip", "replica.port")).otherwise("")
    rows = plan.select(*dict.fromkeys([*by, *KEY]), address.alias("address"))
    return _call_each(rows, [*by, "address"], call)
