import numpy as np

from sigloom import cli
from sigloom.config import Bars
from sigloom.functions import sql
from sigloom.operators import bars
from sigloom.plans import dictionary
from sigloom.sources import binary


def test_command_line(spark, tmp_path):
    d = dictionary.build(dictionary.default_specs(), 64)
    y = np.concatenate([5 * d.atoms[118], 3 * d.atoms[243]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(binary.encode_block(2 * y, 2.0))
    out = {k: str(tmp_path / k) for k in ("events", "json", "residual", "dictionary")}
    base = ["--input", str(tmp_path / "in"), "--frame-size", "64", "--hop-size", "64", "--max-iter", "3", "--fixed-sigma", "0.01"]
    args = cli.parser().parse_args([*base, "--output-events", out["events"], "--output-json", out["json"], "--output-residual", out["residual"], "--save-dictionary", out["dictionary"]])
    cli.run(spark, args)
    first = spark.read.parquet(out["events"]).where("pick = 0").orderBy("frame_start").collect()
    assert [r["frame_start"] for r in first] == [0, 64] and spark.read.json(out["json"]).count() == 1
    assert spark.read.parquet(out["residual"]).selectExpr("max(energy)").first()[0] < 0.1
    again = cli.run(spark, cli.parser().parse_args([*base, "--load-dictionary", out["dictionary"]]))
    assert again.count() > 0


def test_command_line_formats_and_checks(spark, tmp_path):
    y = np.sin(np.arange(300) / 5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(binary.encode_block(y))
    base = ["--input", str(tmp_path / "in"), "--frame-size", "32", "--hop-size", "32", "--max-iter", "2", "--learn", "6"]
    args = cli.parser().parse_args([*base, "--output-binary", f"file://{tmp_path}/events", "--output-residual", f"file://{tmp_path}/left", "--residual-mode", "binary"])
    events = cli.run(spark, args)
    assert binary.read_event_files(spark, f"file://{tmp_path}/events").count() == events.count() > 0
    files = [p for p in (tmp_path / "left").iterdir() if p.suffix == ".residual"]
    assert len(files) == 9 and all(p.stat().st_size == 2 * 8 * 32 for p in files)
    assert all(holds for _, holds in cli.checks(spark, cli.parser().parse_args(["--test-dict", "--test-decomp", "--test-pipeline"])))


def test_table_functions(spark):
    sql.register(spark)
    rng = np.random.default_rng(0)
    rows = [(k, i, 100 + float(rng.standard_normal()), float(rng.integers(1, 40))) for k in range(2) for i in range(100)]
    t = spark.createDataFrame(rows, "s int, t long, price double, volume double").selectExpr("*", "timestamp_seconds(t) ts")
    t.createOrReplaceTempView("ticks")
    got = spark.sql("SELECT close FROM volume_bars(150D, false, TABLE(ticks) PARTITION BY s ORDER BY t)").collect()
    want = bars.volume_bars(t, ["s"], ["t"], Bars(threshold=150, adaptive=False, sanitizer=False)).collect()
    assert sorted(r["close"] for r in got) == sorted(r["close"] for r in want)
    d = dictionary.build(dictionary.default_specs(), 32)
    spark.createDataFrame([(1, (4 * d.atoms[243]).tolist(), 0.01)], "f int, y array<double>, sigma double").createOrReplaceTempView("frames_")
    assert spark.sql("SELECT * FROM pursue(2, TABLE(frames_) PARTITION BY f)").first()["amplitude"] > 3.9
