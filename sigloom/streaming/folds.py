"""Volume bars, recursive least squares and frequency inertia over streams, one state a series.

A micro-batch's rows of a series are taken in order of time and tie-break; state carries the open bar and the threshold, so
any split into micro-batches gives the bars of one batch. Rows that arrive after later ones of their series were taken are
taken late, in arrival order; `withWatermark` upstream bounds that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sigloom.config import Bars
from sigloom.operators.bars import BAR, STATE, new_state, take_tick
from sigloom.operators.detrend import rls_start, rls_step

BAR_STATE = "started boolean, open double, high double, low double, close double, volume double, pv double, threshold double, bars long"


def bar_stream(ticks: DataFrame, key: str, order: list[str], p: Bars | None = None) -> DataFrame:
    """ticks: key, price, volume, ts and the order columns, streaming; gives key and BAR columns, append mode."""
    p = (p or Bars()).validate()

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(STATE, state.get, strict=True)) if state.exists else new_state(p)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        out = []
        for price, volume, ts in zip(rows["price"], rows["volume"], rows["ts"], strict=True):
            out += [(group[0], *bar) for bar in take_tick(held, float(price), float(volume), ts, p)]
        state.update(tuple(held[k] for k in STATE))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    schema = StructType([ticks.schema[key], *StructType.fromDDL(BAR).fields])
    return ticks.groupBy(key).applyInPandasWithState(run, schema, BAR_STATE, "append", GroupStateTimeout.NoTimeout)


def rls_stream(samples: DataFrame, key: str, order: int = 1, forgetting: float = 0.99, scale: float = 100.0) -> DataFrame:
    """samples: key, i, y, streaming; gives key, i, trend, residual."""
    m = order + 1

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = rls_start(m)
        if state.exists:
            theta, cov = state.get
            held = {"theta": np.array(theta), "P": np.array(cov).reshape(m, m)}
        rows = pd.concat(list(parts)).sort_values("i")
        out = []
        for i, y in zip(rows["i"], rows["y"], strict=True):
            e = rls_step(held, (i / scale) ** np.arange(m), float(y), forgetting)
            out.append((group[0], i, float(y) - e, e))
        state.update((held["theta"].tolist(), held["P"].ravel().tolist()))
        yield pd.DataFrame(out, columns=[key, "i", "trend", "residual"])

    schema = StructType([samples.schema[key], *StructType.fromDDL("i long, trend double, residual double").fields])
    return samples.groupBy(key).applyInPandasWithState(run, schema, "theta array<double>, cov array<double>", "append", GroupStateTimeout.NoTimeout)


def inertia_stream(found: DataFrame, key: str, inertia: float = 0.5, low: float = 0.01, high: float = 0.49) -> DataFrame:
    """found: key, at, f, streaming; gives key, at and f pulled towards the one before."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0.0
        out = []
        for at, f in pd.concat(list(parts)).sort_values("at")[["at", "f"]].itertuples(index=False):
            before = min(max(inertia * f + (1 - inertia) * before if before > 0 else f, low), high)
            out.append((group[0], at, before))
        state.update((before,))
        yield pd.DataFrame(out, columns=[key, "at", "f"])

    schema = StructType([found.schema[key], found.schema["at"], *StructType.fromDDL("f double").fields])
    return found.groupBy(key).applyInPandasWithState(run, schema, "f double", "append", GroupStateTimeout.NoTimeout)
