"""Table functions for SQL: bars and pursuit over TABLE(...) arguments.

    SELECT * FROM volume_bars(500D, false, TABLE(ticks) PARTITION BY series ORDER BY ts)
    SELECT * FROM pursue(10, TABLE(frames) PARTITION BY frame_id)
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from sigloom.config import Bars, Pursuit


@udtf(returnType="bar_idx bigint, open double, high double, low double, close double, volume double, vwap double, ts timestamp")
class VolumeBars:
    """Threshold, whether it adapts, rows with price, volume and ts in order: the bars of a partition."""

    def __init__(self):
        self.state = None

    def eval(self, threshold: float, adaptive: bool, row: Row):
        from sigloom.operators.bars import new_state, take_tick

        p = Bars(threshold=threshold, adaptive=adaptive, sanitizer=False)
        self.state = self.state or new_state(p)
        yield from take_tick(self.state, row["price"], row["volume"], row["ts"], p)


@udtf(returnType="pick bigint, atom_index int, atom_type string, atom_params string, amplitude double, phase double, energy double")
class Pursue:
    """The most picks, rows with y (array) and sigma: events over the default dictionary of the frame's size."""

    def eval(self, picks: int, row: Row):
        from sigloom.operators.pursuit import events_of, pursue
        from sigloom.plans.dictionary import build, default_specs

        y = np.array(row["y"], dtype=float)
        if len(y) > 1:
            d = build(default_specs(), len(y))
            found, _ = pursue(y, d.atoms, d.gram, row["sigma"], Pursuit(max_iterations=picks))
            yield from events_of(found, d)


def register(spark: SparkSession) -> None:
    """Make the table functions and the block source known to a session."""
    from sigloom.sources.binary import BlockSource

    spark.udtf.register("volume_bars", VolumeBars)
    spark.udtf.register("pursue", Pursue)
    spark.dataSource.register(BlockSource)
