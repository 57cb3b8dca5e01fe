"""Command line: decompose block files and write events, residuals and dictionaries.

    python -m sigloom.cli --input DIR --frame-size 256 --hop-size 128 --output-events OUT
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.config import Bars, Config, Noise, Pursuit
from sigloom.operators import pursuit, series
from sigloom.plans import dictionary, pipeline
from sigloom.sources import binary

KEYS = ["path", "block_id"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sigloom", description=__doc__.splitlines()[0])
    p.add_argument("--input", help="block files: a path that Spark reads")
    for name, kind, default in (("frame-size", int, 1024), ("hop-size", int, 512), ("max-iter", int, 10), ("gamma-global", float, 1e-3), ("fixed-sigma", float, None)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("gamma-local", "gamma-coherence"):
        p.add_argument(f"--{name}", type=float, help="accepted; it changes nothing")
    p.add_argument("--no-final-regression", action="store_true", help="keep the amplitudes of the picks")
    p.add_argument("--learn", type=int, default=0, metavar="ATOMS", help="decompose with so many atoms learnt from the input")
    p.add_argument("--residual-mode", choices=("table", "binary"), default="table", help="residuals as a table or as files of doubles")
    for name in ("test-dict", "test-decomp", "test-pipeline"):
        p.add_argument(f"--{name}", action="store_true", help="check the engine on a small case of its own and stop")
    for name in ("load-dictionary", "save-dictionary", "output-json", "output-binary", "output-events", "output-residual"):
        p.add_argument(f"--{name}", help="a path that Spark reads or writes")
    return p


def loaded(spark: SparkSession, path: str) -> dictionary.Dictionary:
    import numpy as np

    rows = binary.read_dictionary(spark, path).orderBy("atom_index").collect()
    atoms = np.array([r["atom"] for r in rows])
    return dictionary.Dictionary(atoms, np.array([r["norm"] for r in rows]), dictionary.learned_specs(atoms))


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Events, which are also written where asked; the run's summary stands beside the JSON documents."""
    began = time.time()
    cfg = Config(frame_size=args.frame_size, hop=args.hop_size, noise=Noise(fixed_sigma=args.fixed_sigma),
                 pursuit=Pursuit(max_iterations=args.max_iter, refit=not args.no_final_regression, gamma_global=args.gamma_global)).validate()
    s = binary.read_blocks(spark, args.input)
    if args.load_dictionary:
        d = loaded(spark, args.load_dictionary)
    else:
        d = pipeline.trained(s, KEYS, cfg, args.learn) if args.learn else dictionary.build(dictionary.default_specs(), cfg.frame_size)
    if args.save_dictionary:
        binary.write_dictionary(spark, dictionary.dictionary_frame(spark, d), args.save_dictionary)
    events = pipeline.decompose(s, KEYS, cfg, d)
    if args.output_events:
        events.write.mode("overwrite").parquet(args.output_events)
    if args.output_json:
        pipeline.events_json(events, KEYS).write.mode("overwrite").json(args.output_json)
        about = {"version": 1, "frame_size": cfg.frame_size, "hop_size": cfg.hop, "max_iterations": cfg.pursuit.max_iterations, "execution_time_ms": int(1000 * (time.time() - began))}
        spark.createDataFrame([tuple(about.values())], ", ".join(f"{k} long" for k in about)).write.mode("overwrite").json(args.output_json + "-run")
    if args.output_binary:
        name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("-"), "block_id", F.lit(".events")).alias("name")
        binary.write_files(binary.events_binary(events, KEYS, cfg.frame_size).select(name, "data"), args.output_binary)
    if args.output_residual:
        columns = [*KEYS, "frame_start"]
        left = pursuit.residuals(series.frames(s, KEYS, cfg.frame_size, cfg.hop), columns, d, cfg.pursuit, cfg.noise)
        if args.residual_mode == "binary":
            name = F.concat(F.element_at(F.split("path", "/"), -1), F.lit("-"), "block_id", F.lit("-"), "frame_start", F.lit(".residual")).alias("name")
            binary.write_files(left.select(name, binary.doubles("residual").alias("data")), args.output_residual)
        else:
            left.write.mode("overwrite").parquet(args.output_residual)
    return events


def checks(spark: SparkSession, args: argparse.Namespace) -> list[tuple[str, bool]]:
    """What --test-dict, --test-decomp and --test-pipeline ask for: name and whether it holds."""
    import numpy as np

    found: list[tuple[str, bool]] = []
    specs = dictionary.default_specs()
    if args.test_dict:
        d = dictionary.build(specs, 256)
        found += [("atoms have length before they are scaled", bool((d.norms > 1e-10).all())), ("atoms are unit vectors", bool(np.allclose((d.atoms**2).sum(1), 1, atol=1e-6)))]
    if args.test_decomp:
        d = dictionary.build(specs, 256)
        y = 3 * d.atoms[243] + 2 * d.atoms[118]
        picks, left = pursuit.pursue(y, d.atoms, d.gram, 1e-3, Pursuit(max_iterations=20))
        found += [("the strongest planted atom is picked first", bool(picks) and abs(float(d.atoms[picks[0][0]] @ d.atoms[243])) > 0.9), ("most of the energy is explained", float(left @ left) < 0.2 * float(y @ y))]
    if args.test_pipeline:
        t = spark.range(4000).select(F.lit(0).alias("series"), F.col("id"), (100 + 3 * F.sin(F.col("id") / 40.0)).alias("price"), F.lit(50.0).alias("volume"), F.timestamp_seconds("id").alias("ts"))
        cfg = Config(frame_size=64, hop=32, bars=Bars(threshold=500.0, adaptive=False, sanitizer=False))
        events = pipeline.decompose_ticks(t, ["series"], ["id"], cfg)
        found += [("ticks give events", events.count() > 0), ("events are finite", events.where("isnan(amplitude) OR isnan(energy)").isEmpty())]
    return found


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sigloom").getOrCreate()
    if args.test_dict or args.test_decomp or args.test_pipeline:
        results = checks(spark, args)
        for name, holds in results:
            print(("ok    " if holds else "FAILED ") + name)
        return int(not all(holds for _, holds in results))
    if not args.input:
        raise SystemExit("--input is needed")
    run(spark, args).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events")).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
