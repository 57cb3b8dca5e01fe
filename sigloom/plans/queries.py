"""The registered queries on the test tables, and their SQL. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.config import Bars, Basis, Config, Detrend, Frequency, Learning, Noise, Pursuit
from sigloom.functions import scalar, twofold
from sigloom.operators import bars as B
from sigloom.operators import basis as Q
from sigloom.operators import detrend, frequency, learning, linear, noise, pursuit, series, spectrum
from sigloom.plans import dictionary as D
from sigloom.plans import oracles as O
from sigloom.plans import pipeline
from sigloom.session import shared_path, table, written
from sigloom.sources import binary, generated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
USER, SUPPLIER = ["user_id"], ["l_suppkey"]
#: Well separated atoms of the default set, for queries whose picks must not hang on rounding.
SMALL = [70, 71, 94, 95, 118, 119, 243, 245, 277, 289, 301, 634]
TICK_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "price", "volume"]
WELCH = spectrum.Welch(segment=32, overlap=16, fft=32, taps=8)
S = f"WITH s AS ({O.EVENTS}) "


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.samples(table(spark, sf_dir, "events"), USER, ["ts", "event_id"], "value")


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"), F.col("l_shipdate").alias("ts"))


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", "ts", F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("y"), F.lit(0.0).alias("sigma"))


def small_dictionary() -> D.Dictionary:
    return D.subset(D.build(D.default_specs(), 64), SMALL)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


def bar_rows(df: DataFrame, key: str) -> DataFrame:
    # vwap stays as it is: both sides add the same terms in the same order, and its quotients by powers of two would be ties
    columns = df.select(key, "bar_idx", "open", "high", "low", "close", "volume", "vwap")
    return rounded(columns, open=8, high=8, low=8, close=8, volume=4)


# Samples and noise


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS y FROM events")
def signal_clean(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.clean("value").alias("y"))


@query(S + "SELECT user_id, i, n, y FROM s")
def signal_spread(spark, sf_dir):
    """Samples numbered over range partitions, as series too long for one task are."""
    return series.samples(table(spark, sf_dir, "events"), USER, ["ts", "event_id"], "value", spread=True)


@query(S + "SELECT user_id, round(median(y), 6) AS m FROM s GROUP BY user_id")
def signal_median(spark, sf_dir):
    return rounded(noise.exact_median(event_samples(spark, sf_dir).select("user_id", "y"), USER, "y", "m", spread=True), m=6)


@query(S + "SELECT user_id, round(CASE WHEN m < 1e-12 THEN 1e-9 ELSE m / (0.67448975 * sqrt(2.0)) END, 6) AS sigma FROM (SELECT user_id, median(d) AS m FROM (SELECT user_id, abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY i)) AS d FROM s) WHERE d IS NOT NULL GROUP BY user_id)")
def noise_diff(spark, sf_dir):
    return rounded(noise.difference_sigma(event_samples(spark, sf_dir), USER), sigma=6)


@query(S + "SELECT user_id, round(CASE WHEN count(*) < 2 THEN 1e-9 ELSE avg(abs(y - m)) / 0.6745 END, 6) AS sigma FROM s JOIN (SELECT user_id, median(y) AS m FROM s GROUP BY user_id) USING (user_id) GROUP BY user_id")
def noise_meanabs(spark, sf_dir):
    return rounded(noise.mean_deviation_sigma(event_samples(spark, sf_dir), USER), sigma=6)


@query(S + f"SELECT user_id, block, round(sigma, 6) AS sigma FROM ({O.block_sigma(8, 4, 0)})")
def noise_block_iqr(spark, sf_dir):
    return rounded(noise.block_sigmas(event_samples(spark, sf_dir), USER, 8, 4), sigma=6)


@query(S + f"SELECT user_id, block, round(sigma, 6) AS sigma FROM ({O.block_sigma(32, 16, 2)})")
def noise_block_refined(spark, sf_dir):
    return rounded(noise.block_sigmas(event_samples(spark, sf_dir), USER, 32, 16, 2), sigma=6)


@query(S + f"SELECT user_id, round(sigma, 6) AS sigma FROM ({O.multiscale()})")
def noise_multiscale(spark, sf_dir):
    return rounded(noise.multiscale_sigma(event_samples(spark, sf_dir), USER, Noise()), sigma=6)


@query(S + f"SELECT user_id, round(greatest(m.sigma, 0.01 * d.sd, 1e-9), 6) AS sigma FROM ({O.multiscale()}) m JOIN (SELECT user_id, stddev_pop(y) AS sd FROM s GROUP BY user_id) d USING (user_id)")
def noise_floor(spark, sf_dir):
    return rounded(noise.floored_sigma(event_samples(spark, sf_dir), USER, Noise()), sigma=6)


@query(S + "SELECT user_id, round(list_sort(list(y ORDER BY i))[len(list(y)) // 2 + 1], 6) AS m FROM s WHERE i < 9 GROUP BY user_id")
def median_first9(spark, sf_dir):
    head = event_samples(spark, sf_dir).where("i < 9").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("g"))
    return rounded(head.select("user_id", scalar.first9_median(F.col("g.y")).alias("m")), m=6)


@query(S + "SELECT user_id, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd FROM s GROUP BY user_id")
def reference_stats(spark, sf_dir):
    return event_samples(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.stddev_samp("y"), 6).alias("sd"))


# Bars


@query(O.bars(O.TICKS, "l_suppkey", 500) + O.bar_columns("l_suppkey"))
def volume_bars_fixed(spark, sf_dir):
    return bar_rows(B.volume_bars(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, Bars(threshold=500, sanitizer=False, adaptive=False)), "l_suppkey")


@query(O.bars(O.TICKS, "l_suppkey", 200, adaptive=True, spike=3.0, ewma=0.05) + O.bar_columns("l_suppkey"))
def volume_bars_adaptive(spark, sf_dir):
    return bar_rows(B.volume_bars(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, Bars(threshold=200, max_spike=3.0, ewma=0.05)), "l_suppkey")


@query(O.bars(O.TICKS, "l_suppkey", 500_000, dollar=True) + O.bar_columns("l_suppkey"))
def dollar_bars(spark, sf_dir):
    return bar_rows(B.volume_bars(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, Bars(threshold=500_000, dollar=True, sanitizer=False, adaptive=False)), "l_suppkey")


@query(O.bars(O.TICKS, "l_suppkey", 500) + O.bar_columns("l_suppkey", "(SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY bar_idx DESC) <= 5)"))
def bars_keep_last(spark, sf_dir):
    return bar_rows(B.volume_bars(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, Bars(threshold=500, sanitizer=False, adaptive=False, max_bars=5)), "l_suppkey")


_DAYS = """SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS o, max(o_totalprice) AS h, min(o_totalprice) AS l, arg_max(o_totalprice, o_orderkey) AS c, count(*)::DOUBLE AS v FROM orders GROUP BY ALL"""


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY d) AS i FROM ({_DAYS})), f AS (
  SELECT DISTINCT o_orderpriority AS s, CAST(0 AS BIGINT) AS i, FALSE AS op, 0.0::DOUBLE AS o, 0.0::DOUBLE AS h, 0.0::DOUBLE AS l, 0.0::DOUBLE AS c, 0.0::DOUBLE AS v, CAST(0 AS BIGINT) AS nb, FALSE AS shut FROM t
  UNION ALL
  SELECT s, i, v < 20, o, h, l, c, v, nb + CASE WHEN v >= 20 THEN 1 ELSE 0 END, v >= 20 FROM (
    SELECT f.s, t.i, f.nb, CASE WHEN f.op THEN f.o ELSE t.o END AS o, CASE WHEN f.op THEN greatest(f.h, t.h) ELSE t.h END AS h, CASE WHEN f.op THEN least(f.l, t.l) ELSE t.l END AS l, t.c AS c,
      CASE WHEN f.op THEN f.v ELSE 0 END + t.v AS v FROM f JOIN t ON t.o_orderpriority = f.s AND t.i = f.i + 1)),
ends AS (SELECT s, max(i) AS e FROM f GROUP BY s)
SELECT s AS o_orderpriority, CASE WHEN shut THEN nb - 1 ELSE nb END AS bar_idx, round(o, 4) AS open, round(h, 4) AS high, round(l, 4) AS low, round(c, 4) AS close, v AS volume, round((o + h + l + c) / 4, 4) AS vwap
FROM f JOIN ends USING (s) WHERE shut OR (i = e AND op)""")
def volume_bars_ohlcv(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("d")).agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return rounded(B.ohlcv_bars(days, ["o_orderpriority"], ["d"], Bars(threshold=20)), open=4, high=4, low=4, close=4, vwap=4)


def _bars(spark, sf_dir):
    return B.volume_bars(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, Bars(threshold=500, sanitizer=False, adaptive=False))


for _name, _make, _value in (("bar_close", B.closes, "close"), ("bar_log_close", B.log_closes, "CASE WHEN close > 0 THEN ln(close) ELSE 0.0 END"), ("bar_vwap", B.vwaps, "vwap")):
    QUERIES[_name] = lambda spark, sf_dir, make=_make: rounded(make(_bars(spark, sf_dir), SUPPLIER), y=6)
    SQL[_name] = O.bars(O.TICKS, "l_suppkey", 500) + f"SELECT l_suppkey, bar_idx, round({_value}, 6) AS y FROM bars"


@query(O.bars(O.EVENT_TICKS, "user_id", 500) + O.bar_columns("user_id"))
def bars_stream(spark, sf_dir):
    """The streaming builder over the events file, all that is there, into a table of the shared folder."""
    from sigloom.streaming.folds import bar_stream

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    usable = event_ticks(events).where((F.col("price") > 0) & F.col("volume").isNotNull())
    out = shared_path(spark, "bars-stream")
    bars = bar_stream(usable, "user_id", ["ts", "event_id"], Bars(threshold=500, sanitizer=False, adaptive=False))
    bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return bar_rows(spark.read.schema(bars.schema).parquet(out), "user_id")


def _streamed(spark: SparkSession, rows: DataFrame, fold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming fold makes of a written table, all that is there, read from its sink."""
    source = written(rows, "stream-source")
    found = fold(spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0]))
    out = shared_path(spark, "stream")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(O.rls())
def rls_streamed(spark, sf_dir):
    """Recursive least squares over a stream of samples."""
    from sigloom.streaming.folds import rls_stream

    return rounded(_streamed(spark, event_samples(spark, sf_dir).drop("n"), lambda x: rls_stream(x, "user_id")), trend=4, residual=4)


@query(f"""WITH RECURSIVE s AS (SELECT user_id, i, least(greatest(y / 200, 0.0), 0.6) AS g FROM ({O.EVENTS})), f AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS "at", 0.0::DOUBLE AS f FROM s
  UNION ALL SELECT s.user_id, s.i, least(greatest(CASE WHEN f > 0 THEN 0.5 * g + 0.5 * f ELSE g END, 0.01), 0.49) FROM f JOIN s ON s.user_id = f.user_id AND s.i = f."at" + 1)
  SELECT user_id, "at", f FROM f WHERE "at" >= 0""")
def inertia_streamed(spark, sf_dir):
    """Frequencies pulled towards the one before, over a stream."""
    from sigloom.streaming.folds import inertia_stream

    found = event_samples(spark, sf_dir).select("user_id", F.col("i").alias("at"), F.least(F.greatest(F.col("y") / 200, F.lit(0.0)), F.lit(0.6)).alias("f"))
    return _streamed(spark, found, lambda x: inertia_stream(x, "user_id"))


# Frames and frequencies


def _frame_rows(f: DataFrame) -> DataFrame:
    return rounded(f.select("user_id", "frame_start", F.posexplode("y").alias("pos", "y")).withColumn("pos", F.col("pos").cast("long")), y=6)


@query(S + f"SELECT user_id, frame_start, pos, round(y, 6) AS y FROM ({O.frames(32, 16)})")
def frames(spark, sf_dir):
    return _frame_rows(series.frames(event_samples(spark, sf_dir), USER, 32, 16))


@query(S + f"SELECT user_id, frame_start, pos, round(y * 0.5 * (1 - cos(2 * pi() * pos / (m - 1))), 6) + 0.0 AS y FROM ({O.frames(32, 16)})")
def frames_hann(spark, sf_dir):
    return _frame_rows(series.windowed(series.frames(event_samples(spark, sf_dir), USER, 32, 16), scalar.hann))


@query(S + f"SELECT user_id, frame_start, pos, round(y * (0.54 - 0.46 * cos(2 * pi() * pos / (m - 1))), 6) + 0.0 AS y FROM ({O.frames(32, 16)})")
def frames_hamming(spark, sf_dir):
    return _frame_rows(series.windowed(series.frames(event_samples(spark, sf_dir), USER, 32, 16), scalar.hamming))


_T = "CASE WHEN n > 1 THEN 30.0 * i / (n - 1) ELSE 0.0 END"
_SCAN = f"""WITH s AS (SELECT *, {_T} AS t FROM ({O.EVENTS})), g AS (SELECT unnest(range(50)) AS k, 0.01 + unnest(range(50)) * (0.49 - 0.01) / 50 AS w),
c AS (SELECT user_id, k, w, CASE WHEN ss <= 1e-12 OR cc <= 1e-12 THEN -1.0 ELSE ys * ys / ss + yc * yc / cc END AS e FROM (
  SELECT user_id, k, w, sum(y * sin(w * t)) AS ys, sum(y * cos(w * t)) AS yc, sum(pow(sin(w * t), 2)) AS ss, sum(pow(cos(w * t), 2)) AS cc FROM s, g GROUP BY ALL))"""


@query(_SCAN + " SELECT user_id, CAST(k AS INTEGER) AS k, round(w, 6) AS w, round(e, 3) AS energy FROM c")
def freq_scan(spark, sf_dir):
    return rounded(frequency.angular_scan(event_samples(spark, sf_dir), USER), w=6, energy=3)


@query(_SCAN + " SELECT user_id, round(w, 6) AS w FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY e DESC, k) = 1")
def freq_dominant(spark, sf_dir):
    return rounded(frequency.dominant_frequency(event_samples(spark, sf_dir), USER), w=6)


@query(f"""WITH s AS (SELECT *, {_T} AS t FROM ({O.EVENTS})), g AS (SELECT unnest(range(50)) AS k, 0.01 + (0.49 - 0.01) * unnest(range(50)) / 49 AS f)
SELECT user_id, CAST(k AS INTEGER) AS k, round(f, 6) AS f, round((pow(sum(y * sin(2 * pi() * f * t)), 2) + pow(sum(y * cos(2 * pi() * f * t)), 2)) / (max(n) * max(n) / 4.0), 4) AS energy FROM s, g GROUP BY user_id, k, f""")
def freq_coarse(spark, sf_dir):
    return rounded(frequency.cyclic_scan(event_samples(spark, sf_dir), USER), f=6, energy=4)


@query(O.golden(50, 5, 0.01, 0.49))
def freq_refined(spark, sf_dir):
    return rounded(frequency.refined_frequency(event_samples(spark, sf_dir), USER, Frequency()), f=6)


# Atoms and dictionaries


def _atoms_of(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = tuple(s for s in D.default_specs() if s.kind == kind)
        d = D.dictionary_frame(spark, D.build(chosen, 64))
        return rounded(d.select("atom_index", F.posexplode("atom").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=6)

    return run


for _kind, _, _ in D.GRIDS:
    QUERIES[f"atom_{_kind.lower()}"] = _atoms_of(_kind)
    SQL[f"atom_{_kind.lower()}"] = f"SELECT atom_index, i, round(v, 6) + 0.0 AS v FROM ({O.family_atoms(_kind, 64)})"


@query("SELECT k * 2 + m AS atom_index, i, round(CASE WHEN m = 0 THEN sin(2 * pi() * theta * i / 64.0) ELSE cos(2 * pi() * theta * i / 64.0) END / sqrt(32.0), 5) + 0.0 AS v FROM (SELECT unnest([2.0, 5.0]) AS theta, unnest([0, 1]) AS k), (SELECT unnest([0, 1]) AS m), (SELECT unnest(range(64)) AS i)")
def atom_quasi(spark, sf_dir):
    specs = tuple(D.Spec(k * 2 + m, "QUASI", True, (("theta", t), ("k", 1.0))) for k, t in enumerate((2.0, 5.0)) for m in (0, 1))
    d = D.dictionary_frame(spark, D.build(specs, 64))
    return rounded(d.select(F.col("atom_index").cast("long").alias("atom_index"), F.posexplode("atom").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=5)


@query("SELECT k AS atom_index, i, round(CASE WHEN i / 63.0 >= p THEN 1 / sqrt(c) ELSE 0.0 END, 6) AS v FROM (SELECT k, p, count(*) FILTER (WHERE i / 63.0 >= p) AS c FROM (SELECT unnest([0.25, 0.6]) AS p, unnest([0, 1]) AS k), (SELECT unnest(range(64)) AS i) GROUP BY ALL), (SELECT unnest(range(64)) AS i)")
def atom_step(spark, sf_dir):
    specs = tuple(D.Spec(k, "STEP", False, (("position", p),)) for k, p in enumerate((0.25, 0.6)))
    d = D.dictionary_frame(spark, D.build(specs, 64))
    return rounded(d.select(F.col("atom_index").cast("long").alias("atom_index"), F.posexplode("atom").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=6)


@query("SELECT CAST(vec_id AS INTEGER) AS atom_index, i, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 6) + 0.0 AS v FROM (" + O.EMBEDDED + ")")
def atom_learned(spark, sf_dir):
    """Vectors given as atoms: normalised where they are."""
    f = embedding_frames(spark, sf_dir)
    unit = F.transform("y", lambda x: x / F.sqrt(scalar.norm_sq(F.col("y"))))
    return rounded(f.select(F.col("vec_id").cast("int").alias("atom_index"), F.posexplode(unit).alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=6)


_SPEC_COLUMNS = [p for p in D.PARAMETERS if p != "theta"]


@query(O.all_specs())
def dict_specs(spark, sf_dir):
    return D.specs_frame(spark, D.default_specs()).select("atom_index", "atom_type", "use_sin", *_SPEC_COLUMNS)


@query(f"""WITH d AS (SELECT *, 0.2::DOUBLE AS chirp, greatest(2 * pi() * 0.2, 5.0) AS carrier FROM ({O.all_specs()}))
SELECT atom_index, round(CASE WHEN atom_type IN ('CHIRP', 'DAMPED_CHIRP') THEN CASE WHEN abs(chirp - f0) / (f0 + 1e-12) > 0.1 THEN chirp ELSE f0 END
  WHEN atom_type = 'SIGMOID_OSC' THEN CASE WHEN abs(chirp - f) / (f + 1e-12) > 0.1 THEN chirp ELSE f END WHEN atom_type = 'MORLET' THEN CASE WHEN abs(carrier - w) / (w + 1e-12) > 0.1 THEN carrier ELSE w END END, 6) AS tuned FROM d""")
def dict_retune(spark, sf_dir):
    f = D.specs_frame(spark, D.retuned(D.default_specs(), 0.2))
    kind = F.col("atom_type")
    return rounded(f.select("atom_index", F.when(kind.isin("CHIRP", "DAMPED_CHIRP"), F.col("f0")).when(kind == "SIGMOID_OSC", F.col("f")).when(kind == "MORLET", F.col("w")).alias("tuned")), tuned=6)


@query(" UNION ALL ".join(f"SELECT DISTINCT atom_index, round(ln(norm), 6) + 0.0 AS log_norm FROM ({O.family_atoms(k, 64)})" for k, _, _ in D.GRIDS))
def dict_norms(spark, sf_dir):
    return rounded(D.dictionary_frame(spark, D.build(D.default_specs(), 64)).select("atom_index", F.log("norm").alias("log_norm")), log_norm=6)


# Pursuit


@query(f"WITH a AS ({O.atoms(SMALL, 64)}), e AS ({O.EMBEDDED}) SELECT vec_id, atom_index, round(sum(y * v), 6) + 0.0 AS p FROM e JOIN a USING (i) GROUP BY ALL")
def pursuit_project(spark, sf_dir):
    return rounded(pursuit.projections(embedding_frames(spark, sf_dir), ["vec_id"], small_dictionary()), p=6)


def _picked(spark, sf_dir, n: int) -> DataFrame:
    events = pursuit.pursue_frames(embedding_frames(spark, sf_dir), ["vec_id"], small_dictionary(), Pursuit(max_iterations=n))
    return rounded(events.select("vec_id", "pick", "atom_index", "amplitude", "energy"), amplitude=6, energy=6)


def _picks_sql(n: int) -> str:
    return O.picks(SMALL, n) + " UNION ALL ".join(f" SELECT vec_id, {k - 1}::BIGINT AS pick, atom_index, round(amount, 6) + 0.0 AS amplitude, round(energy, 6) + 0.0 AS energy FROM b{k}" for k in range(1, n + 1))


QUERIES["pursuit_pick1"], SQL["pursuit_pick1"] = lambda spark, sf_dir: _picked(spark, sf_dir, 1), _picks_sql(1)
QUERIES["pursuit_pick3"], SQL["pursuit_pick3"] = lambda spark, sf_dir: _picked(spark, sf_dir, 3), _picks_sql(3)


@query()
def pursuit_events(spark, sf_dir):
    """The whole dictionary and all stops, sigma from each frame."""
    return pursuit.pursue_frames(embedding_frames(spark, sf_dir), ["vec_id"], D.build(D.default_specs(), 64), Pursuit(), noise=Noise())


@query(O.picks(SMALL, 3) + " SELECT vec_id, round(rr, 6) + 0.0 AS energy FROM r3")
def residual_energy(spark, sf_dir):
    return rounded(pursuit.residuals(embedding_frames(spark, sf_dir), ["vec_id"], small_dictionary(), Pursuit(max_iterations=3)).select("vec_id", "energy"), energy=6)


@query(f"WITH a AS ({O.atoms(SMALL, 64)}) SELECT j AS atom_index, round(sum(abs(g)), 6) + 0.0 AS coherence FROM (SELECT x.atom_index AS j, z.atom_index AS k, sum(x.v * z.v) AS g FROM a x JOIN a z ON x.i = z.i AND z.atom_index IN (70, 243, 634) GROUP BY ALL) GROUP BY j")
def coherence(spark, sf_dir):
    d = small_dictionary()
    c = pursuit.coherence(d, [SMALL.index(a) for a in (70, 243, 634)])
    return rounded(spark.createDataFrame([(s.index, float(v)) for s, v in zip(d.specs, c, strict=True)], "atom_index int, coherence double"), coherence=6)


# Learning


@query(O.picks(SMALL, 1) + """ SELECT atom_index, i, round(2 * (sum(amount * (y - amount * v)) + sum(amount * amount * v)), 4) + 0.0 AS g FROM b1 JOIN e USING (vec_id) JOIN a USING (atom_index, i) GROUP BY ALL""")
def learn_gradient(spark, sf_dir):
    d = small_dictionary()
    xr, xx, _, _ = learning.gradient_sums(embedding_frames(spark, sf_dir), d.atoms, Pursuit(max_iterations=1), 0.0)
    g = 2 * (xr + xx[:, None] * d.atoms)
    rows = [(s.index, i, float(v)) for s, row, x in zip(d.specs, g, xx, strict=True) if x > 0 for i, v in enumerate(row)]
    return rounded(spark.createDataFrame(rows, "atom_index int, i long, g double"), g=4)


@query(O.picks(SMALL, 1) + f""", x1 AS (SELECT atom_index, i, any_value(v) + 0.002 * (sum(amount * (y - amount * v)) + sum(amount * amount) * any_value(v)) - 0.001 * any_value(v) AS v FROM b1 JOIN e USING (vec_id) JOIN a USING (atom_index, i) GROUP BY ALL),
  d1 AS (SELECT atom_index, i, v / sqrt(sum(v * v) OVER (PARTITION BY atom_index)) AS v FROM (SELECT * FROM x1 UNION ALL SELECT atom_index, i, v FROM a WHERE atom_index NOT IN (SELECT atom_index FROM x1))),
  t1 AS (SELECT vec_id, max(p * p) AS best FROM (SELECT vec_id, atom_index, sum(y * v) AS p FROM e JOIN d1 USING (i) GROUP BY ALL) GROUP BY vec_id)
  SELECT CAST(0 AS INTEGER) AS iteration, round(sqrt(sum(rr) / (64 * count(*))), 6) AS rmse FROM r1 UNION ALL SELECT 1, round(sqrt(sum(rr - best) / (64 * count(*))), 6) FROM r0 JOIN t1 USING (vec_id)""")
def learn_two_rounds(spark, sf_dir):
    """The error before and after a step from known atoms, one pick a frame."""
    p = Learning(iterations=2, rate=1e-3, atoms_per_frame=1, tolerance=0.0)
    _, trace = learning.learn(embedding_frames(spark, sf_dir), small_dictionary().atoms, p)
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(trace)], "iteration int, rmse double"), rmse=6)


@query()
def learn_rmse(spark, sf_dir):
    f = embedding_frames(spark, sf_dir)
    _, trace = learning.learn(f, learning.initial_atoms(16, 64, seed=7), Learning(iterations=3, rate=1e-3, atoms_per_frame=3))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(trace)], "iteration int, rmse double")


# Spectra


@query(S + f"SELECT user_id, CAST(bin AS INTEGER) AS bin, round(psd, 4) + 0.0 AS psd FROM ({O.welch(32, 16, 32)})")
def psd_welch(spark, sf_dir):
    return rounded(spectrum.welch_psd(event_samples(spark, sf_dir), USER, WELCH), psd=4)


@query(S + f"SELECT user_id, CAST(bin AS INTEGER) AS bin, round(1 / sqrt(psd + 1e-12), 6) AS h FROM ({O.welch(32, 16, 32)})")
def whiten_response(spark, sf_dir):
    return rounded(spectrum.response(spectrum.welch_psd(event_samples(spark, sf_dir), USER, WELCH)).drop("psd"), h=6)


@query(S + ", k AS (SELECT unnest([0, 1, 2, 3]) AS k, unnest([0.4, 0.3, 0.2, 0.1]) AS h) SELECT o.user_id, o.i, round(sum(x.y * k.h), 6) + 0.0 AS y FROM s o, k JOIN s x ON x.user_id = o.user_id AND x.i = CASE WHEN o.i - k.k < 0 THEN least(k.k - o.i - 1, o.n - 1) ELSE o.i - k.k END GROUP BY o.user_id, o.i")
def fir_apply(spark, sf_dir):
    s = event_samples(spark, sf_dir)
    taps = s.select("user_id").distinct().withColumn("taps", F.array(*map(F.lit, (0.4, 0.3, 0.2, 0.1))))
    return rounded(spectrum.fir(s, USER, taps), y=6)


@query(S + f""", k AS ({O.taps(32, 16, 32, 8)}), w AS (
  SELECT o.user_id, o.i, sum(x.y * k.h) AS y FROM s o JOIN k USING (user_id) JOIN s x ON x.user_id = o.user_id AND x.i = CASE WHEN o.i - k.k < 0 THEN least(k.k - o.i - 1, o.n - 1) ELSE o.i - k.k END GROUP BY o.user_id, o.i
  UNION ALL SELECT user_id, i, y FROM s WHERE n < 32) SELECT user_id, i, round(y, 4) + 0.0 AS y FROM w""")
def whiten(spark, sf_dir):
    return rounded(spectrum.whiten(event_samples(spark, sf_dir), USER, WELCH), y=4)


@query(S + f"SELECT user_id, CAST(k AS INTEGER) AS k, round(h, 6) + 0.0 AS h FROM ({O.taps(32, 16, 32, 8)})")
def whiten_taps(spark, sf_dir):
    t = spectrum.whitening_taps(spectrum.welch_psd(event_samples(spark, sf_dir), USER, WELCH), USER, WELCH)
    return rounded(t.select("user_id", F.posexplode("taps").alias("k", "h")), h=6)


@query(S + f"SELECT user_id, round(f, 6) AS flatness, f < 0.3 AS coloured, round(greatest(0.0, 1 - f / 0.3), 5) + 0.0 AS confidence FROM (SELECT user_id, exp(avg(ln(psd + 1e-300))) / avg(psd + 1e-300) AS f FROM ({O.welch(32, 16, 32)}) GROUP BY user_id)")
def coloured_noise(spark, sf_dir):
    return rounded(noise.is_coloured(spectrum.welch_psd(event_samples(spark, sf_dir), USER, WELCH), USER), flatness=6, confidence=5)


# Bases and linear systems

BASIS = Basis(poly=4, harm=4, morlet=3)
_BASIS_SQL = O.basis(32, 4, 4, 3)


def _basis_frame(spark: SparkSession, q: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(b, i, float(v)) for b, row in enumerate(q) for i, v in enumerate(row)], "basis_index long, i long, v double")


@query(f"SELECT basis_index, i, round(v, 6) + 0.0 AS v FROM ({_BASIS_SQL})")
def basis_build(spark, sf_dir):
    return rounded(_basis_frame(spark, Q.build_basis(32, BASIS)), v=6)


@query(S + f", b AS ({_BASIS_SQL}) SELECT user_id, frame_start, basis_index, round(sum(y * v), 4) + 0.0 AS c FROM ({O.frames(32, 16)}) f JOIN b ON b.i = f.pos WHERE m = 32 GROUP BY ALL")
def basis_project(spark, sf_dir):
    c = Q.project(series.frames(event_samples(spark, sf_dir), USER, 32, 16), ["user_id", "frame_start"], Q.build_basis(32, BASIS))
    return rounded(c.select("user_id", "frame_start", F.posexplode("coeff").alias("basis_index", "c")).withColumn("basis_index", F.col("basis_index").cast("long")), c=4)


@query(f"WITH b AS ({_BASIS_SQL}) " + O.gram_schmidt("b", 11, [], "SELECT basis_index, i, round(v, 6) + 0.0 AS v FROM q"))
def orthonormalize(spark, sf_dir):
    q, _ = Q.orthonormalise(Q.build_basis(32, BASIS))
    return rounded(_basis_frame(spark, q), v=6)


@query(f"WITH b AS ({_BASIS_SQL}) " + O.gram_schmidt("b", 11, [], "SELECT q.basis_index AS j, b.basis_index AS k, round(sum(q.v * b.v), 6) + 0.0 AS r FROM q JOIN b USING (i) GROUP BY ALL"))
def orthonormalize_r(spark, sf_dir):
    """R = Q A', all of it."""
    _, r = Q.orthonormalise(Q.build_basis(32, BASIS))
    return rounded(_basis_frame(spark, r).select(F.col("basis_index").alias("j"), F.col("i").alias("k"), F.col("v").alias("r")), r=6)


@query(f"WITH b AS ({_BASIS_SQL}), u AS (SELECT basis_index, i, v / sqrt(sum(v * v) OVER (PARTITION BY basis_index)) AS v FROM b) SELECT round(max(abs(g - CASE WHEN j = k THEN 1 ELSE 0 END)), 6) AS error, 0.0::DOUBLE AS after FROM (SELECT x.basis_index AS j, z.basis_index AS k, sum(x.v * z.v) AS g FROM u x JOIN u z USING (i) GROUP BY ALL)")
def ortho_error(spark, sf_dir):
    """The operator's error measure on unit rows, before and after they are made orthonormal."""
    b = Q.build_basis(32, BASIS)
    unit = b / np.linalg.norm(b, axis=1, keepdims=True)
    return rounded(spark.createDataFrame([(Q.orthogonality_error(unit), Q.orthogonality_error(Q.orthonormalise(unit)[0]))], "error double, after double"), error=6, after=6)


@query(f"SELECT basis_index, i, round(v + 0.5 * (basis_index + 1) * (i + 1) * 1e-6, 8) + 0.0 AS v FROM ({_BASIS_SQL})")
def basis_regularised(spark, sf_dir):
    return rounded(_basis_frame(spark, Q.regularised(Q.build_basis(32, BASIS), 0.5)), v=8)


_USER_BASES = f"SELECT user_id, CAST(frame_start / 16 AS INTEGER) AS basis_index, pos AS i, y AS v FROM ({O.frames(32, 16)}) WHERE m = 32"


def user_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = series.frames(event_samples(spark, sf_dir).where("n >= 32"), USER, 32, 16)
    return f.select("user_id", (F.col("frame_start") / 16).cast("int").alias("basis_index"), "y")


@query(S + f"SELECT user_id, round(CASE WHEN min(l) > 1e-30 THEN max(l) / min(l) ELSE 1e15 END, 6) AS condition FROM (SELECT user_id, basis_index, sqrt(sum(v * v)) AS l FROM ({_USER_BASES}) GROUP BY ALL) GROUP BY user_id")
def basis_condition(spark, sf_dir):
    return rounded(Q.condition_estimates(user_bases(spark, sf_dir), USER), condition=6)


@query(S + f", b AS ({_USER_BASES}) " + O.gram_schmidt("b", 3, ["user_id"], "SELECT user_id, CAST(basis_index AS INTEGER) AS basis_index, i, round(v, 5) + 0.0 AS v FROM q"))
def orthonormalize_batch(spark, sf_dir):
    """Many bases at once: each series' first three frames."""
    q = Q.orthonormalise_groups(user_bases(spark, sf_dir), USER, [0, 1, 2])
    return rounded(q.select("user_id", "basis_index", F.posexplode("q").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=5)


@query(S + "SELECT user_id, round((sy * sii - si * siy) / (n * sii - si * si), 6) AS x0, round((n * siy - si * sy) / (n * sii - si * si), 6) + 0.0 AS x1 FROM (SELECT user_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS si, sum(i * i)::DOUBLE AS sii, sum(y) AS sy, sum(i * y) AS siy FROM s GROUP BY user_id) WHERE n >= 2")
def solve_dense(spark, sf_dir):
    x = linear.solve(linear.line_systems(event_samples(spark, sf_dir).where("n >= 2"), USER), USER)
    return rounded(x.select("user_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")), x0=6, x1=6)


_ROWS = "SELECT user_id, i, y FROM s WHERE i < 12 AND n >= 12"
_LINE = f"""SELECT user_id, (n * siy - si * sy) / (n * sii - si * si) AS x1, (sy - (n * siy - si * sy) / (n * sii - si * si) * si) / n AS x0 FROM (
  SELECT user_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS si, sum(i * i)::DOUBLE AS sii, sum(y) AS sy, sum(i * y) AS siy FROM ({_ROWS}) GROUP BY user_id)"""


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve samples of each series as observations of a line."""
    return linear.line_rows(event_samples(spark, sf_dir).where("n >= 12 and i < 12"), USER)


@query(S + f"SELECT user_id, round(x0, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, round(sqrt(sum(pow(x0 + x1 * i - y, 2))), 6) AS residual FROM ({_LINE}) JOIN ({_ROWS}) USING (user_id) GROUP BY user_id, x0, x1")
def solve_small_iter(spark, sf_dir):
    x = linear.solve(first_rows(spark, sf_dir), USER, linear.conjugate_gradients)
    return rounded(x.select("user_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "residual"), x0=6, x1=6, residual=6)


@query(SQL["solve_small_iter"])
def solve_least_squares(spark, sf_dir):
    """The rectangular branch of the direct solver."""
    x = linear.solve(first_rows(spark, sf_dir), USER)
    return rounded(x.select("user_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "residual"), x0=6, x1=6, residual=6)


@query(S + f"""SELECT user_id, round((sy * (sii + 0.5) - si * siy) / ((n + 0.5) * (sii + 0.5) - si * si), 6) + 0.0 AS x0, round(((n + 0.5) * siy - si * sy) / ((n + 0.5) * (sii + 0.5) - si * si), 6) + 0.0 AS x1 FROM (
  SELECT user_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS si, sum(i * i)::DOUBLE AS sii, sum(y) AS sy, sum(i * y) AS siy FROM ({_ROWS}) GROUP BY user_id)""")
def solve_ridge(spark, sf_dir):
    x = linear.solve(first_rows(spark, sf_dir), USER, lambda a, b: linear.ridge(a, b, 0.5))
    return rounded(x.select("user_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")), x0=6, x1=6)


_NORMAL = "SELECT user_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS si, sum(i * i)::DOUBLE AS sii, sum(y) AS sy, sum(i * y) AS siy FROM s WHERE n >= 2 GROUP BY user_id"


@query(S + f"SELECT user_id, round(si / n, 6) AS a01, round(si / sii, 6) AS a10, round(sy / n, 6) AS b0, round(siy / sii, 6) AS b1, round(1 + si / n * (si / n), 6) AS l0, round(si / sii * (si / sii) + 1, 6) AS l1 FROM ({_NORMAL})")
def solve_row_scaled(spark, sf_dir):
    """Systems over their diagonal; the transpose's columns and their squared lengths."""

    def one(a: np.ndarray, b: np.ndarray) -> tuple:
        scaled, right = linear.row_scaled(a, b)
        t, _ = linear.transposed_and_scaled(a)
        return (float(t[1, 0]), float(scaled[1, 0]), *map(float, right), *map(float, (t * t).sum(0)))

    x = linear.per_matrix(linear.line_systems(event_samples(spark, sf_dir).where("n >= 2"), USER), USER, "a01 double, a10 double, b0 double, b1 double, l0 double, l1 double", one)
    return rounded(x, a01=6, a10=6, b0=6, b1=6, l0=6, l1=6)


@query(S + f"""SELECT user_id, round(ln(hi / lo), 5) AS log_condition, round(sqrt(hi), 5) AS norm FROM (
  SELECT user_id, (n + sii + sqrt(pow(n - sii, 2) + 4 * si * si)) / 2 AS hi, (n * sii - si * si) / ((n + sii + sqrt(pow(n - sii, 2) + 4 * si * si)) / 2) AS lo FROM ({_NORMAL}))""")
def solve_condition(spark, sf_dir):
    """Condition of the normal matrix, and the greatest singular value of the observations by power iteration."""

    def one(a: np.ndarray, _: np.ndarray) -> tuple:
        return (float(np.log(linear.condition_number(a))), float(np.sqrt(linear.power_norm(a))))

    return rounded(linear.per_matrix(linear.line_systems(event_samples(spark, sf_dir).where("n >= 2"), USER), USER, "log_condition double, norm double", one), log_condition=5, norm=5)


_GRAM = f"SELECT user_id, count(*)::DOUBLE AS n, sum(i)::DOUBLE AS si, sum(i * i)::DOUBLE AS sii FROM ({_ROWS}) GROUP BY user_id"


@query(S + f"SELECT user_id, round(sqrt((n + sii + sqrt(pow(n - sii, 2) + 4 * si * si)) / 2), 6) AS s0, round(sqrt((n * sii - si * si) / ((n + sii + sqrt(pow(n - sii, 2) + 4 * si * si)) / 2)), 6) AS s1 FROM ({_GRAM})")
def solve_svd(spark, sf_dir):
    """Singular values of the observations by Jacobi rotations."""
    x = linear.per_matrix(first_rows(spark, sf_dir), USER, "s0 double, s1 double", lambda a, _: tuple(map(float, linear.jacobi_svd(a)[1])))
    return rounded(x, s0=6, s1=6)


@query(S + f"SELECT user_id, round(sqrt(n), 6) AS r00, round(si / sqrt(n), 6) AS r01, round(sqrt(sii - si * si / n), 6) AS r11 FROM ({_GRAM})")
def solve_qr(spark, sf_dir):
    """R of the observations by Householder reflections."""
    x = linear.per_matrix(first_rows(spark, sf_dir), USER, "r00 double, r01 double, r11 double", lambda a, _: tuple(float(v) for v in linear.householder_qr(a)[1][[0, 0, 1], [0, 1, 1]]))
    return rounded(x, r00=6, r01=6, r11=6)


def _embedded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("col", "v"))


def _ramp(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.col("id").cast("int").alias("col"), (1.0 / (1 + F.col("id"))).alias("x"))


@query(f"SELECT vec_id AS row, round(sum(y / (1 + i)), 6) + 0.0 AS y FROM ({O.EMBEDDED}) GROUP BY vec_id")
def matrix_product(spark, sf_dir):
    return rounded(linear.matvec(_embedded_entries(spark, sf_dir), _ramp(spark)), y=6)


@query(f"WITH e AS ({O.EMBEDDED}), p AS (SELECT vec_id, sum(y / (1 + i)) AS p FROM e GROUP BY vec_id) SELECT CAST(i AS INTEGER) AS col, round(sum(y * p), 5) + 0.0 AS x FROM e JOIN p USING (vec_id) GROUP BY i")
def matrix_normal_product(spark, sf_dir):
    """A'(A x): the step of power iteration, over a distributed matrix."""
    return rounded(linear.normal_matvec(_embedded_entries(spark, sf_dir), _ramp(spark)), x=5)


@query(f"SELECT round(max(abs(y)), 6) AS max_abs, CAST(0 AS BIGINT) AS nan, CAST(0 AS BIGINT) AS infinite FROM ({O.EMBEDDED})")
def matrix_stats(spark, sf_dir):
    return rounded(linear.matrix_stats(_embedded_entries(spark, sf_dir)), max_abs=6)


_LOG = "SELECT id AS run, (id % 11) / 10.0 AS rate, 0.6 + (id % 7) * 0.2 AS omega, pow(10.0, id % 15) AS cond, CASE WHEN id % 4 = 0 THEN 5.0 WHEN id % 4 = 1 THEN 50.0 WHEN id % 4 = 2 THEN 500.0 ELSE 5000.0 END AS avg_ms, CASE WHEN id % 5 = 0 THEN 1e-13 ELSE 1e-3 END AS final_residual FROM "


@query(f"""SELECT run, round(CASE WHEN rate > 0.9 THEN least(1.9, omega * 1.5) WHEN rate > 0.5 THEN least(1.9, omega * 1.2) WHEN rate < 0.1 THEN greatest(0.5, omega * 0.8) ELSE omega END, 6) AS omega,
  rate > 0.9 OR (avg_ms > 100 AND rate > 0.5) OR cond > 1e12 AS direct, cond > 1e8 AS regularise, round(1e12 * CASE WHEN cond > 1e12 THEN 1e-6 WHEN cond > 1e8 THEN greatest(1e-8 * cond / 1e8, 1e-12) ELSE 0.0 END, 3) AS lambda,
  cond > 1e12 AND final_residual >= 1e-12 AS refine, avg_ms > 1000 AS spread_out, avg_ms < 10 AS keep_local, CASE WHEN cond < 1e6 THEN 'well' WHEN cond > 1e12 THEN 'extreme' WHEN cond > 1e8 THEN 'ill' ELSE 'fair' END AS conditioning
FROM ({_LOG.replace('(id % 11) / 10.0', 'CAST(id % 11 AS DOUBLE) / 10.0')} (SELECT unnest(range(120)) AS id))""")
def solver_advice(spark, sf_dir):
    log = spark.range(120).selectExpr("id run", "cast(id % 11 as double) / 10.0D rate", "0.6D + (id % 7) * 0.2D omega", "pow(10.0D, id % 15) cond", "CASE WHEN id % 4 = 0 THEN 5.0D WHEN id % 4 = 1 THEN 50.0D WHEN id % 4 = 2 THEN 500.0D ELSE 5000.0D END avg_ms", "CASE WHEN id % 5 = 0 THEN 1e-13D ELSE 1e-3D END final_residual")
    return linear.solver_advice(log).withColumn("omega", F.round("omega", 6)).withColumn("lambda", F.round(1e12 * F.col("lambda"), 3))


# Trends


@query("SELECT event_id, round(CASE WHEN abs((value - 50) / 10) <= 1.345 THEN 1.0 ELSE 1.345 / (abs((value - 50) / 10) + 1e-30) END, 6) AS w FROM events")
def huber_weight(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rounded(e.select("event_id", scalar.huber_weight((F.col("value") - 50) / 10).alias("w")), w=6)


@query(O.rls())
def rls_fold(spark, sf_dir):
    return rounded(detrend.rls(event_samples(spark, sf_dir), USER).drop("y"), trend=4, residual=4)


_LINE_FIT = """, t AS (SELECT *, CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0.0 END AS t FROM s), f AS (SELECT user_id, count(*) AS m, avg(y) AS a0, covar_pop(y, t) / var_pop(t) AS b1, avg(y) - covar_pop(y, t) / var_pop(t) * avg(t) AS a1 FROM t WHERE n >= 4 GROUP BY user_id),
  r AS (SELECT user_id, abs(y - a0) AS e0, abs(y - a1 - b1 * t) AS e1 FROM t JOIN f USING (user_id)), c AS (SELECT user_id, median(e0) / 0.6745 + 1e-30 AS s0, median(e1) / 0.6745 + 1e-30 AS s1 FROM r GROUP BY user_id),
  q AS (SELECT user_id, sum(e0 * e0 * CASE WHEN e0 <= 1.345 * s0 THEN 1 ELSE 1.345 * s0 / (e0 + 1e-30) END) AS q0, sum(e1 * e1 * CASE WHEN e1 <= 1.345 * s1 THEN 1 ELSE 1.345 * s1 / (e1 + 1e-30) END) AS q1 FROM r JOIN c USING (user_id) GROUP BY user_id),
  o AS (SELECT f.*, q0, q1, m * ln(q1 / m + 1e-30) + 4 * ln(m) < m * ln(q0 / m + 1e-30) + 2 * ln(m) AS line FROM f JOIN q USING (user_id))"""
LINE = Detrend(min_length=16, max_segments=1, max_order=1, huber_iterations=1)


@query(S + _LINE_FIT + " SELECT user_id, i, round(trend, 9) + 0.0 AS trend, round(y - trend, 9) + 0.0 AS residual FROM (SELECT t.user_id, i, y, CASE WHEN m IS NULL THEN 0.0 WHEN line THEN a1 + b1 * t ELSE a0 END AS trend FROM t LEFT JOIN o USING (user_id))")
def detrend_line(spark, sf_dir):
    """A line or a constant a series, whichever the information criterion prefers."""
    return rounded(detrend.detrended(event_samples(spark, sf_dir), USER, LINE).drop("y"), trend=9, residual=9)


@query(S + _LINE_FIT + " SELECT user_id, CAST(1 AS BIGINT) AS segments, m AS samples, round(CASE WHEN line THEN q1 ELSE q0 END, 4) AS sse, CASE WHEN line THEN 1 ELSE 0 END AS highest_order, m AS shortest FROM o")
def detrend_stats(spark, sf_dir):
    return rounded(detrend.segment_stats(detrend.piecewise(event_samples(spark, sf_dir), USER, LINE), USER), sse=4)


@query(SQL["rls_fold"])
def detrend_causal(spark, sf_dir):
    """The trend predicted from earlier samples."""
    return rounded(detrend.detrended(event_samples(spark, sf_dir), USER, Detrend(causal=True)).drop("y"), trend=4, residual=4)


@query()
def detrend_piecewise(spark, sf_dir):
    return detrend.piecewise(event_samples(spark, sf_dir), USER, Detrend(min_length=16, max_segments=4))


@query()
def detrend_residual(spark, sf_dir):
    return detrend.detrended(event_samples(spark, sf_dir), USER, Detrend(min_length=16, max_segments=4))


@query("SELECT l_returnflag, round(fsum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_returnflag")
def dd_sum(spark, sf_dir):
    return rounded(twofold.compensated_sum(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice"), total=2)


@query("""SELECT event_id, round(value - 0.1, 9) AS difference, round(value / 3, 9) AS quotient, abs(value - 50) AS absolute, abs(value) <= 1e-9 AS small,
  round(CASE WHEN value - 50 > 0 THEN sqrt(value - 50) ELSE 0 END, 9) AS root, round(CASE WHEN value - 50 > 0 THEN ln(value - 50) ELSE 0 END, 9) AS logarithm, round(exp(value / 100), 9) AS exponential, round(sin(value), 9) + 0.0 AS sine, round(cos(value), 9) + 0.0 AS cosine
FROM events WHERE value IS NOT NULL AND NOT isnan(value)""")
def dd_functions(spark, sf_dir):
    v, e = F.col("value"), table(spark, sf_dir, "events").where("value is not null and not isnan(value)")
    x, shifted = twofold.make(v), twofold.make(v - 50)
    got = e.select(
        "event_id", twofold.value(twofold.sub(x, twofold.make(F.lit(0.1)))).alias("difference"), twofold.value(twofold.div(x, twofold.make(F.lit(3.0)))).alias("quotient"),
        twofold.value(twofold.absolute(shifted)).alias("absolute"), twofold.is_small(x).alias("small"), twofold.value(twofold.sqrt(shifted)).alias("root"), twofold.value(twofold.log(shifted)).alias("logarithm"),
        twofold.value(twofold.exp(twofold.make(v / 100))).alias("exponential"), twofold.value(twofold.sin(x)).alias("sine"), twofold.value(twofold.cos(x)).alias("cosine"),
    )
    return rounded(got, difference=9, quotient=9, root=9, logarithm=9, exponential=9, sine=9, cosine=9)


@query("""WITH v AS (SELECT user_id, floor(value) AS hi, CAST(event_id % 7 AS DOUBLE) / 1e17 AS lo FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND event_id % 3 = 0)
SELECT user_id, pos, hi, lo, coalesce(lead(hi) OVER w < hi OR (lead(hi) OVER w = hi AND lead(lo) OVER w < lo), FALSE) AS falls FROM (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY hi DESC, lo DESC) - 1 AS INTEGER) AS pos, hi, lo FROM v) WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def dd_order(spark, sf_dir):
    """Double-doubles that share high parts, in falling order, and whether each is above the next."""
    e = table(spark, sf_dir, "events").where("value is not null and not isnan(value) and event_id % 3 = 0")
    g = e.groupBy("user_id").agg(F.collect_list(twofold.make(F.floor("value"), (F.col("event_id") % 7).cast("double") / 1e17)).alias("a"))
    a = g.select("user_id", twofold.descending(F.col("a")).alias("a"))
    falls = F.transform("a", lambda x, i: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), F.coalesce(twofold.less(F.get("a", i + 1), x), F.lit(False)).alias("falls")))
    return a.select("user_id", F.posexplode(falls).alias("pos", "v")).select("user_id", "pos", "v.hi", "v.lo", "v.falls")


@query("SELECT event_id, round(least(greatest(pow(x, 1.5) * pow(1 - x, 2.0), 0.0), 1.0), 9) AS v FROM (SELECT event_id, least(greatest(value / 100, 0.0), 1.0) AS x FROM events WHERE value IS NOT NULL AND NOT isnan(value))")
def beta_kernel(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null and not isnan(value)")
    return rounded(e.select("event_id", scalar.incomplete_beta_kernel(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)), 1.5, 2.0).alias("v")), v=9)


@query("SELECT event_id, round(value * value + value, 6) AS v FROM events")
def dd_arithmetic(spark, sf_dir):
    x = twofold.make(F.col("value"))
    return rounded(table(spark, sf_dir, "events").select("event_id", twofold.value(twofold.add(twofold.mul(x, x), x)).alias("v")), v=6)


# Formats


def _folder(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


@query(S + "SELECT user_id, i, round(y, 9) AS y FROM s")
def format_blocks(spark, sf_dir):
    """Samples into block files of several blocks a series, and back through the block source."""
    from sigloom.functions.sql import register

    register(spark)
    path = _folder(spark, "blocks")
    listed = binary.write_blocks(event_samples(spark, sf_dir), USER, path, size=25, scale=4.0)
    read = spark.read.format("signal_blocks").option("path", path).load().withColumn("file", F.element_at(F.split("path", "/"), -1))
    return rounded(read.join(listed, ["file", "block_id"]).select("user_id", (F.col("chunk") * 25 + F.col("i")).alias("i"), "y"), y=9)


@query(SQL["format_blocks"])
def format_blocks_binary(spark, sf_dir):
    """The same through Spark's own file reader."""
    path = _folder(spark, "blocks")
    listed = binary.write_blocks(event_samples(spark, sf_dir), USER, path, size=40)
    read = binary.read_blocks(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return rounded(read.join(listed, ["file", "block_id"]).select("user_id", (F.col("chunk") * 40 + F.col("i")).alias("i"), "y"), y=9)


def _files(spark: SparkSession, name: str, **contents: bytes) -> str:
    path = _folder(spark, name)
    binary.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "name string, data binary"), path)
    return path


@query(" UNION ALL ".join(f"SELECT '{f}' AS name, CAST(row_number() OVER (PARTITION BY i ORDER BY atom_index) - 1 AS INTEGER) AS atom_index, i, round(v, 6) + 0.0 AS v FROM (SELECT * FROM ({O.atoms(SMALL, 64)}))" for f in ("low", "short")))
def format_dictionary(spark, sf_dir):
    """A dictionary into files of both layouts and back."""
    d = small_dictionary()
    path = _files(spark, "dictionaries", low=binary.encode_dictionary(d.atoms, d.norms), short=binary.encode_dictionary(d.atoms, d.norms, with_low=False))
    read = binary.read_dictionary_files(spark, path)
    return rounded(read.select("name", "atom_index", F.posexplode("atom").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=6)


@query(f"WITH b AS ({_BASIS_SQL}) " + O.gram_schmidt("b", 11, [], "SELECT f.name, batch, CAST(basis_index AS INTEGER) AS basis_index, i, round(v, 6) + 0.0 AS v FROM q, (SELECT 'one' AS name, 0 AS batch UNION ALL SELECT 'two', 0 UNION ALL SELECT 'two', 1) f"))
def format_basis(spark, sf_dir):
    """An orthonormal basis into a file of one and a file of two, and back."""
    q, r = Q.orthonormalise(Q.build_basis(32, BASIS))
    path = _files(spark, "bases", one=binary.encode_basis(q, r), two=binary.encode_basis(np.stack((q, q)), np.stack((r, r))))
    read = binary.read_basis_files(spark, path)
    return rounded(read.select("name", "batch", "basis_index", F.posexplode("q").alias("i", "v")).withColumn("i", F.col("i").cast("long")), v=6)


# Pipelines

#: Sine members of the pairs in SMALL.
PAIRS = [70, 94, 118]


def event_rows(events: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(events.select(*keys, "pick", "atom_index", "amplitude", "phase", "energy"), amplitude=4, phase=4, energy=2)


def sample_events(spark: SparkSession, sf_dir: str, p: Pursuit, **changes) -> DataFrame:
    d = D.subset(D.build(D.default_specs(), 32), SMALL)
    return pipeline.decompose(event_samples(spark, sf_dir).where("n >= 32"), USER, Config(frame_size=32, hop=16, pursuit=p, **changes), d)


_FOUND = S + O.decomposed(32, 16, SMALL, PAIRS, 3)


@query(_FOUND + f"SELECT vec_id.u AS user_id, vec_id.f AS frame_start, {O.EVENT_COLUMNS} FROM found")
def decompose_samples(spark, sf_dir):
    """Samples to frames to noise to events with their phases, three picks of twelve atoms."""
    return event_rows(sample_events(spark, sf_dir, Pursuit(max_iterations=3)), ["user_id", "frame_start"])


@query(S + O.decomposed(32, 16, SMALL, PAIRS, 4, gamma=0.4, theta=0.01) + f"SELECT vec_id.u AS user_id, vec_id.f AS frame_start, {O.EVENT_COLUMNS} FROM found")
def decompose_stopped(spark, sf_dir):
    """The same with higher floors, so that both rules stop frames before their fourth pick."""
    return event_rows(sample_events(spark, sf_dir, Pursuit(max_iterations=4, gamma=0.4, theta=0.01)), ["user_id", "frame_start"])


# 2 pi times any scanned frequency lies below the least carrier, 5, so that is what all Morlet waves are tuned to
@query(_FOUND.replace('least(greatest("w", 1), 50) AS "w"', '5.0::DOUBLE AS "w"') + f"SELECT vec_id.u AS user_id, vec_id.f AS frame_start, {O.EVENT_COLUMNS} FROM found")
def decompose_retuned(spark, sf_dir):
    """Each frame's atoms follow its dominant frequency."""
    return event_rows(sample_events(spark, sf_dir, Pursuit(max_iterations=3), frequency=Frequency(enable=True)), ["user_id", "frame_start"])


@query(O.bars(O.TICKS, "l_suppkey", 100) + ", s AS (SELECT l_suppkey AS user_id, bar_idx AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, close AS y FROM bars)" + O.decomposed(16, 8, SMALL, PAIRS, 2) + f"SELECT vec_id.u AS l_suppkey, vec_id.f AS frame_start, {O.EVENT_COLUMNS} FROM found")
def decompose_bars(spark, sf_dir):
    """Ticks to volume bars to frames to noise to events."""
    d = D.subset(D.build(D.default_specs(), 16), SMALL)
    s = pipeline.bar_samples(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, tick_config())
    return event_rows(pipeline.decompose(s.where("n >= 16"), SUPPLIER, tick_config(pursuit=Pursuit(max_iterations=2)), d), ["l_suppkey", "frame_start"])


@query(_FOUND + "SELECT vec_id.u AS user_id, count(*) OVER (PARTITION BY vec_id.u) AS num_events, vec_id.f AS frame_start, CAST(pick AS BIGINT) AS pick, atom_index, round(abs(amplitude), 4) + 0.0 AS amplitude, round(phase, 4) + 0.0 AS phase, round(energy, 2) + 0.0 AS energy FROM found")
def export_json(spark, sf_dir):
    """Each series' JSON document, read back."""
    schema = "num_events long, events array<struct<frame_start: long, pick: long, atom_index: int, amplitude: double, phase: double, energy: double>>"
    j = pipeline.events_json(sample_events(spark, sf_dir, Pursuit(max_iterations=3)), USER).select("user_id", F.from_json("json", schema).alias("j"))
    rows = j.select("user_id", "j.num_events", F.inline("j.events"))
    return rounded(rows, amplitude=4, phase=4, energy=2)


@query(_FOUND + f", r AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id.u ORDER BY vec_id.f, pick) - 1 AS BIGINT) AS pick, vec_id.f AS frame_start, atom_index, amplitude, phase, energy FROM found) SELECT vec_id.u AS user_id, frame_start, {O.EVENT_COLUMNS} FROM r")
def export_binary(spark, sf_dir):
    """Each series' event file, written and read back."""
    path = _folder(spark, "events")
    data = binary.events_binary(sample_events(spark, sf_dir, Pursuit(max_iterations=3)), USER, 32)
    binary.write_files(data.select(F.concat("user_id", F.lit(".events")).alias("name"), "data"), path)
    read = binary.read_event_files(spark, path).withColumn("user_id", F.split("name", "[.]")[0].cast("long"))
    return event_rows(read, ["user_id", "frame_start"])


_COEFFICIENTS = f", b AS ({_BASIS_SQL}) " + O.gram_schmidt("b", 11, [], f"SELECT user_id, frame_start, CAST(basis_index AS BIGINT) AS basis_index, round(sum(y * v), 4) + 0.0 AS c FROM ({O.frames(32, 16)}) f JOIN q ON q.i = f.pos WHERE m = 32 GROUP BY ALL")


@query(S + _COEFFICIENTS)
def decompose_coefficients(spark, sf_dir):
    """Frames on the orthonormal basis."""
    c = pipeline.coefficients(event_samples(spark, sf_dir), USER, Config(frame_size=32, hop=16, basis=BASIS))
    return rounded(c.select("user_id", "frame_start", F.posexplode("coeff").alias("basis_index", "c")).withColumn("basis_index", F.col("basis_index").cast("long")), c=4)


@query(f"SELECT user_id, CAST(frame_start / 16 AS BIGINT) AS frame, basis_index, c FROM ({S + _COEFFICIENTS})")
def export_coefficients(spark, sf_dir):
    """The tails of the event files."""
    path, cfg = _folder(spark, "coefficients"), Config(frame_size=32, hop=16, basis=BASIS)
    c = pipeline.coefficients(event_samples(spark, sf_dir).where("n >= 32"), USER, cfg)
    data = binary.events_binary(sample_events(spark, sf_dir, Pursuit(max_iterations=1)), USER, 32, c)
    binary.write_files(data.select(F.concat("user_id", F.lit(".events")).alias("name"), "data"), path)
    read = binary.read_coefficient_files(spark, path).withColumn("user_id", F.split("name", "[.]")[0].cast("long"))
    return rounded(read.select("user_id", "frame", F.posexplode("coeff").alias("basis_index", "c")).withColumn("basis_index", F.col("basis_index").cast("long")), c=4)


@query()
def pipeline_samples(spark, sf_dir):
    return pipeline.decompose(event_samples(spark, sf_dir), USER, Config(frame_size=32, hop=16))


@query()
def pipeline_coefficients(spark, sf_dir):
    return pipeline.coefficients(event_samples(spark, sf_dir), USER, Config(frame_size=32, hop=16, basis=BASIS))


def tick_config(**changes) -> Config:
    return Config(frame_size=16, hop=8, bars=Bars(threshold=100, sanitizer=False, adaptive=False), **changes)


@query()
def pipeline_ticks(spark, sf_dir):
    return pipeline.decompose_ticks(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, tick_config())


@query()
def pipeline_json(spark, sf_dir):
    return pipeline.events_json(pipeline.decompose(event_samples(spark, sf_dir), USER, Config(frame_size=32, hop=16)), USER)


@query()
def pipeline_retuned(spark, sf_dir):
    return pipeline.decompose(event_samples(spark, sf_dir), USER, Config(frame_size=32, hop=16, frequency=Frequency(enable=True)))


@query()
def demo_noise(spark, sf_dir):
    """Noise level found in a generated tone, and its ratio to the true one."""
    x = generated.tone(spark, 4096, seed=11).withColumn("series", F.lit(1))
    return noise.multiscale_sigma(x, ["series"]).withColumn("ratio", F.col("sigma") / 0.05)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to volume bars to frames to noise to the best atom of each frame."""
    return pipeline.decompose_ticks(line_ticks(spark, sf_dir), SUPPLIER, TICK_ORDER, tick_config(pursuit=Pursuit(max_iterations=1)))
