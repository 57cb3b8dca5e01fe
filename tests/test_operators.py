import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sigloom.config import Bars, Basis, Config, Detrend, Frequency, Learning, Noise, Pursuit
from sigloom.functions import atoms, twofold
from sigloom.operators import bars, basis, detrend, frequency, learning, linear, noise, pursuit, series, spectrum
from sigloom.plans import dictionary, pipeline
from sigloom.sources import binary


def samples(spark, *signals):
    rows = [(k, i, float(v)) for k, y in enumerate(signals) for i, v in enumerate(y)]
    return series.samples(spark.createDataFrame(rows, "s int, t long, v double"), ["s"], ["t"], "v")


def test_config_names_the_field_out_of_range():
    with pytest.raises(ValueError, match="Noise.min_block"):
        Config(noise=Noise(min_block=1)).validate()
    assert Config().validate().frame_size == 1024


def test_default_dictionary_has_641_unit_atoms():
    for n in (64, 256):
        d = dictionary.build(dictionary.default_specs(), n)
        assert d.atoms.shape == (641, n) and np.allclose((d.atoms**2).sum(1), 1, atol=1e-6) and (d.norms > 1e-10).all()
    aliased = dictionary.default_specs(True)
    assert all(dict(s.params)["alpha"] == dict(s.params)["f0"] for s in aliased if s.kind == "DAMPED_CHIRP")


def test_degenerate_and_unknown_atoms():
    v, norm = atoms.normalised(np.zeros(8))
    assert norm == 1.0 and v.tolist() == [1.0] + [0.0] * 7
    with pytest.raises(ValueError):
        atoms.raw_atom("NOTHING", {}, 8)
    assert atoms.clamp(float("nan"), 0, 1) == 0.5


def test_two_term_bessel_is_a_polynomial():
    x = 20 * np.arange(16) / 15
    assert np.allclose(atoms.raw_atom("BESSEL", {"order": 1.0}, 16, two_term_bessel=True), (x / 2) * (1 - x * x / 8))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 640), st.floats(0.5, 50), st.integers(0, 9))
def test_pursuit_finds_a_planted_atom_and_never_adds_energy(index, amount, seed):
    d = dictionary.build(dictionary.default_specs(), 64)
    picks, residual = pursuit.pursue(amount * d.atoms[index], d.atoms, d.gram, 1e-6, Pursuit(max_iterations=3))
    assert abs(picks[0][1] - amount) < 1e-6 * amount and abs(d.atoms[picks[0][0]] @ d.atoms[index]) > 0.999999
    y = np.random.default_rng(seed).standard_normal(64)
    left = y @ y
    for k in range(1, 5):
        _, r = pursuit.pursue(y, d.atoms, d.gram, 0.0, Pursuit(max_iterations=k))
        assert r @ r <= left + 1e-9
        left = r @ r


def test_pursuit_with_gram_equals_the_plain_recursion():
    d = dictionary.build(dictionary.default_specs(), 64)
    y = np.random.default_rng(3).standard_normal(64)
    picks, _ = pursuit.pursue(y, d.atoms, d.gram, 0.0, Pursuit(max_iterations=12))
    r, selected = y.copy(), []
    for atom, amount, _ in picks:
        p = d.atoms @ r
        c = np.abs(d.atoms @ d.atoms[selected].T).sum(1) if selected else np.zeros(641)
        e = p * p / (1 + 0.1 * c)
        assert e[atom] >= e.max() * (1 - 1e-9) and amount == pytest.approx(p[atom] / (1 + 0.1 * c[atom]), rel=1e-9)
        r -= amount * d.atoms[atom]
        selected.append(atom)


def test_refit_and_phase(spark):
    d = dictionary.build(dictionary.default_specs(), 64)
    y = 3 * d.atoms[118] + 4 * d.atoms[119]
    f = spark.createDataFrame([(1, y.tolist(), 1e-3)], "k int, y array<double>, sigma double")
    rows = pursuit.pursue_frames(f, ["k"], d, Pursuit(max_iterations=4)).collect()
    assert any(r["phase"] != 0 for r in rows)
    picks, left = pursuit.pursue(y, d.atoms, d.gram, 1e-3, Pursuit(max_iterations=4, refit=True, gamma_global=1e-9))
    assert left @ left < 1e-6 and len({a for a, _, _ in picks}) == len(picks)


def test_noise_scales_and_edges(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal(2000)
    s = samples(spark, y, 10 * y, [1.0, 2.0, 3.0], [5.0] * 50)
    found = {r["s"]: r["sigma"] for r in noise.multiscale_sigma(s, ["s"]).collect()}
    assert 0.6 < found[0] < 1.2 and found[1] == pytest.approx(10 * found[0], rel=1e-3) and found[2] == 1e-9 and found[3] == pytest.approx(1e-9, rel=1e-3)
    diff = {r["s"]: r["sigma"] for r in noise.difference_sigma(s, ["s"]).collect()}
    assert diff[0] == pytest.approx(1, rel=0.1) and diff[3] == 1e-9


def test_series_clean_values_and_empty(spark):
    rows = [(0, 0, None), (0, 1, float("nan")), (0, 2, float("inf")), (0, 3, 2.0)]
    s = series.samples(spark.createDataFrame(rows, "s int, t long, v double"), ["s"], ["t"], "v")
    assert [r["y"] for r in s.orderBy("i").collect()] == [0.0, 0.0, 0.0, 2.0]
    none = s.where("false")
    assert series.frames(none, ["s"], 4, 2).count() == 0 and noise.multiscale_sigma(none, ["s"]).count() == 0


def test_one_long_series_spreads_over_tasks(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 100 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("s"), (F.col("id") * 7919 % 300_007).alias("t"), F.rand(1).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 2, 1.0), (None, 1, 3.0)], "s string, t long, v double"))
    spread, plain = (series.samples(df, ["s"], ["t"], "v", spread=x) for x in (True, False))
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("s", "i", "n", "y").cast("decimal(38,0)"))).first()
    assert total(spread) == total(plain) and spread.where("s is null").count() == 2
    held = spread.where("s = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= 2 and max(r["count"] for r in held) < 0.7 * 297_000


def test_frames_clip_and_drop_tails(spark):
    f = series.frames(samples(spark, range(10), range(3)), ["s"], 4, 3).orderBy("s", "frame_start").collect()
    assert [(r["s"], r["frame_start"], r["y"]) for r in f] == [(0, 0, [0, 1, 2, 3]), (0, 3, [3, 4, 5, 6]), (0, 6, [6, 7, 8, 9]), (1, 0, [0, 1, 2])]


def plain_bars(ticks, p):
    state, out = bars.new_state(p), []
    for price, volume in ticks:
        out += bars.take_tick(state, price, volume, None, p)
    return out, state


def test_bars_conserve_volume_and_lock_out_level_shifts():
    rng = np.random.default_rng(5)
    ticks = [(100 + rng.standard_normal(), float(rng.integers(1, 50))) for _ in range(500)]
    p = Bars(threshold=200, adaptive=False)
    out, state = plain_bars(ticks, p)
    assert sum(b[5] for b in out) + state["volume"] == pytest.approx(sum(v for _, v in ticks))
    shifted, state = plain_bars([(100.0, 1.0)] + [(120.0, 300.0)] * 5, p)
    assert not shifted and state["close"] == 100.0
    assert len(plain_bars([(100.0, 1000.0)], p)[0]) == 1


def test_bars_over_partitions_equal_the_plain_fold(spark):
    rng = np.random.default_rng(6)
    ticks = [(k, i, 100 + float(rng.standard_normal()), float(rng.integers(0, 40))) for k in range(3) for i in range(300)]
    df = spark.createDataFrame(ticks, "s int, t long, price double, volume double").selectExpr("*", "timestamp_seconds(t) ts")
    p = Bars(threshold=150, ewma=0.1)
    got = sorted((r["s"], r["bar_idx"], r["close"], r["volume"]) for r in bars.volume_bars(df, ["s"], ["t"], p).collect())
    want = sorted((k, b[0], b[4], b[5]) for k in range(3) for b in plain_bars([(x[2], x[3]) for x in ticks if x[0] == k], p)[0])
    assert got == want


def test_streamed_bars_equal_batch_for_any_split(spark, tmp_path):
    from sigloom.streaming.folds import bar_stream

    rng = np.random.default_rng(8)
    rows = [(i % 2, i, 100 + float(rng.standard_normal()), float(rng.integers(1, 40))) for i in range(200)]
    schema = "s int, t long, price double, volume double"
    p = Bars(threshold=150, ewma=0.1)
    whole = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(t) ts")
    want = sorted((r["s"], r["bar_idx"], r["close"]) for r in bars.volume_bars(whole, ["s"], ["t"], p).collect())
    for cuts in ([200], [50, 200], [1, 99, 150, 200]):
        src, out = str(tmp_path / f"in{len(cuts)}"), str(tmp_path / f"out{len(cuts)}")
        start = 0
        for k, cut in enumerate(cuts):
            spark.createDataFrame(rows[start:cut], schema).selectExpr("*", "timestamp_seconds(t) ts").coalesce(1).write.mode("append").parquet(src)
            start = cut
            stream = bar_stream(spark.readStream.schema(whole.schema).parquet(src), "s", ["t"], p)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "c").trigger(availableNow=True).start().awaitTermination()
        assert sorted((r["s"], r["bar_idx"], r["close"]) for r in spark.read.parquet(out).collect()) == want


def test_golden_section_lies_near_the_fine_maximum(spark):
    n, f = 256, 0.213
    t = 30 * np.arange(n) / (n - 1)
    y = np.sin(2 * np.pi * f * t)
    got = frequency.refined_frequency(samples(spark, y), ["s"], Frequency(refine=6, points=25)).first()["f"]
    fine = np.arange(0.15, 0.3, 1e-4)
    best = fine[np.argmax([np.abs(y @ np.exp(2j * np.pi * v * t)) for v in fine])]
    assert abs(got - best) < 2 * 0.02 * 0.618**6


def test_welch_keeps_power_and_whitening_flattens(spark):
    rng = np.random.default_rng(1)
    w = rng.standard_normal(4096)
    c = np.zeros(4096)
    for i in range(1, 4096):
        c[i] = 0.9 * c[i - 1] + w[i]
    p = spectrum.Welch(segment=64, overlap=32, fft=64, taps=32)
    s = samples(spark, w, c)
    flat = {r["s"]: r["flatness"] for r in noise.flatness(spectrum.welch_psd(s, ["s"], p), ["s"]).collect()}
    assert flat[0] > 0.9 > flat[1]
    done = series.samples(spectrum.whiten(s, ["s"], p), ["s"], ["i"], "y")
    after = {r["s"]: r["flatness"] for r in noise.flatness(spectrum.welch_psd(done, ["s"], p), ["s"]).collect()}
    assert after[1] > flat[1] + 0.2
    with pytest.raises(ValueError):
        spectrum.Welch(segment=64, fft=32).validate()


def test_fir_mirrors_short_series(spark):
    y, taps = [1.0, 2.0, 4.0], [0.5, 0.25, 0.125, 0.0625, 0.03]
    s = samples(spark, y)
    t = spark.createDataFrame([(0, taps)], "s int, taps array<double>")
    got = [r["y"] for r in spectrum.fir(s, ["s"], t).orderBy("i").collect()]
    want = []
    for i in range(3):
        total = 0.0
        for k, h in enumerate(taps):
            at = i - k
            at = min(-at - 1, 2) if at < 0 else at
            total += y[at] * h
        want.append(total)
    assert got == pytest.approx(want)


def test_bases_and_orthonormalisation(spark):
    a = basis.build_basis(128, Basis())
    assert a.shape == (30, 128)
    q, r = basis.orthonormalise(a)
    assert basis.orthogonality_error(q) < 1e-12 and np.allclose(r.T @ q, a, atol=1e-8)
    twice, _ = basis.orthonormalise(np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]))
    assert np.allclose(twice[1], 0)
    rows = spark.createDataFrame([(1, b, v.tolist()) for b, v in enumerate(a[:5])], "g int, basis_index int, y array<double>")
    got = np.array([x["q"] for x in basis.orthonormalise_groups(rows, ["g"]).orderBy("basis_index").collect()])
    assert np.allclose(got @ got.T, np.eye(5), atol=1e-12)
    assert basis.condition_estimate(np.zeros((2, 2))) == 1e15 and basis.regularised(np.zeros((1, 1)), 1.0)[0, 0] == 1e-6


def test_linear_solvers():
    rng = np.random.default_rng(2)
    a, x = rng.standard_normal((4, 4)) + 4 * np.eye(4), rng.standard_normal(4)
    assert np.allclose(linear.gauss(a, a @ x), x) and linear.gauss(np.zeros((2, 2)), np.ones(2)) is None
    assert linear.gauss(np.full((2, 2), np.nan), np.ones(2)) is None and linear.gauss(np.zeros((0, 0)), np.zeros(0)).size == 0
    assert np.allclose(linear.conjugate_gradients(a, a @ x), x, atol=1e-6)
    tall = rng.standard_normal((6, 2))
    assert np.allclose(linear.gauss(tall, tall @ [1.0, 2.0]), [1, 2])
    assert np.allclose(linear.ridge(a, a @ x, 0.0), x) and linear.condition_number(np.eye(3)) == pytest.approx(1)
    s, t = linear.row_scaled(a, a @ x)
    assert np.allclose(np.linalg.solve(s, t), x)


def test_factorisations():
    rng = np.random.default_rng(8)
    for shape, block in (((7, 4), 2), ((5, 5), 32), ((40, 33), 8), ((3, 1), 1)):
        a = rng.standard_normal(shape)
        q, r = linear.householder_qr(a, block)
        assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(shape[1])) and np.allclose(np.tril(r, -1), 0) and (np.diag(r) >= 0).all()
        u, s, vt = linear.jacobi_svd(a)
        assert np.allclose(u * s @ vt, a) and np.allclose(s, np.linalg.svd(a)[1]) and linear.power_norm(a, 5000) == pytest.approx(s[0], rel=1e-4)
    assert linear.jacobi_svd(np.zeros((3, 2)))[1].tolist() == [0, 0] and linear.normalised(np.zeros(2)).tolist() == [0, 0]
    wide = rng.standard_normal((12, 5)) * np.logspace(0, 5, 5)
    x = linear.conjugate_gradients(wide, np.arange(12.0))
    assert np.allclose(x, np.linalg.lstsq(wide, np.arange(12.0), rcond=None)[0], rtol=1e-6) and linear.conjugate_gradients(np.full((2, 2), np.inf), np.ones(2)) is None
    assert linear.conjugate_gradients(np.array([[1.0, 0.0], [0.0, 0.0]]), np.array([2.0, 1.0])).tolist() == [2.0, 0.0]


def test_frames_in_place_equal_series(spark):
    """Noise and dominant frequency of frames, in the batch, equal those of series."""
    rng = np.random.default_rng(12)
    for n in (3, 4, 9, 40, 70, 200):
        ys = [rng.standard_normal(n).cumsum(), np.zeros(n), rng.integers(0, 3, n).astype(float), rng.standard_normal(n)]
        s = samples(spark, *ys)
        for p in (Noise(), Noise(refine=0, scales=1), Noise(min_block=5, max_block=33, scales=2, refine=3)):
            want = {r["s"]: r["sigma"] for r in noise.multiscale_sigma(s, ["s"], p).collect()}
            assert noise.array_sigmas(np.array(ys), p) == pytest.approx([want[k] for k in range(4)], rel=1e-9)
        want = {r["s"]: r["w"] for r in frequency.dominant_frequency(s.where("s in (0, 3)"), ["s"]).collect()}
        assert frequency.array_dominant(np.array(ys)[[0, 3]], Frequency()) == pytest.approx([want[0], want[3]])


def test_bar_builder_hands_out_each_bar_once():
    b = bars.BarBuilder(Bars(threshold=10, sanitizer=False, adaptive=False, max_bars=2))
    assert b.pop() is None and not b.add(1.0, 6.0) and b.add(2.0, 6.0) and b.ready
    assert b.pop()[1:5] == (1.0, 2.0, 1.0, 2.0) and b.pop() is None
    for _ in range(6):
        b.add(3.0, 10.0)
    assert len(b.bars) == 2 and b.pop()[0] == 6
    b.reset()
    assert not b.bars and b.pop() is None


def test_filters_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(spectrum, "BLOCK", 16)
    rng = np.random.default_rng(3)
    for n, k in ((50, 5), (16, 16), (17, 3), (3, 9), (64, 20)):
        y, h = rng.standard_normal(n), rng.standard_normal(k)
        got = [r["y"] for r in spectrum.fir(samples(spark, y), ["s"], spark.createDataFrame([(0, h.tolist())], "s int, taps array<double>")).orderBy("i").collect()]
        at = np.arange(n)[:, None] - np.arange(k)
        assert got == pytest.approx((y[np.where(at < 0, np.minimum(-at - 1, n - 1), at)] * h).sum(1))


def test_retuned_coefficients_and_trained_dictionaries(spark):
    t = 30 * np.arange(128) / 127
    s = samples(spark, np.sin(0.3 * t), np.zeros(128))
    cfg = Config(frame_size=64, hop=64, basis=Basis(poly=2, harm=2, morlet=0), frequency=Frequency(enable=True))
    got = pipeline.coefficients(s, ["s"], cfg).orderBy("s", "frame_start").collect()
    assert len(got) == 4 and np.abs(got[0]["coeff"]).max() > 1 and not np.any(got[2]["coeff"])
    d = pipeline.trained(s, ["s"], Config(frame_size=64, hop=64, learning=Learning(iterations=2, rate=0.01, hop=32, atoms_per_frame=2)), 4)
    assert d.atoms.shape == (4, 64) and pipeline.decompose(s, ["s"], Config(frame_size=64, hop=64), d).count() > 0
    short = pipeline.trained(samples(spark, [1.0, 2.0]), ["s"], Config(frame_size=64, hop=64), 3)
    assert np.allclose(short.atoms, learning.initial_atoms(3, 64))


def test_learning_lowers_the_error(spark):
    rng = np.random.default_rng(4)
    d = learning.initial_atoms(2, 32, seed=1)
    frames = spark.createDataFrame([((rng.standard_normal(2) @ d).tolist(),) for _ in range(60)], "y array<double>")
    start = learning.initial_atoms(4, 32, seed=9)
    best, trace = learning.learn(frames, start, Learning(iterations=6, rate=0.005, atoms_per_frame=2))
    assert trace[-1] < trace[0] and np.allclose((best**2).sum(1), 1)


def test_piecewise_trend_finds_a_planted_break(spark):
    rng = np.random.default_rng(7)
    y = np.concatenate([np.linspace(0, 5, 100), np.linspace(20, 10, 120)]) + 0.05 * rng.standard_normal(220)
    rows = detrend.piecewise(samples(spark, y), ["s"], Detrend(min_length=16)).orderBy("start").collect()
    assert min(abs(r["start"] - 100) for r in rows[1:]) <= 2
    left = detrend.detrended(samples(spark, y, [1.0, 2.0]), ["s"], Detrend(min_length=16))
    assert left.where("s = 0").selectExpr("max(abs(residual))").first()[0] < 1 and left.where("s = 1").count() == 2


def test_long_series_are_segmented_whole(spark):
    long = spark.range(500_002).selectExpr("'a' AS s", "id AS i", "0.5 * id AS y")
    rows = detrend.piecewise(long, ["s"], Detrend(max_segments=1)).collect()
    assert [(r["start"], r["stop"]) for r in rows] == [(0, 500_002)]


def test_block_source_packs_small_blocks_and_cuts_long_ones(tmp_path):
    """Partitions follow the bytes, not the number of blocks or files, and give each sample once."""
    rng = np.random.default_rng(5)
    small = [binary.encode_block(4 * rng.standard_normal(25), 4.0) for _ in range(400)]
    (tmp_path / "a.alw").write_bytes(b"".join(small))
    (tmp_path / "b.alw").write_bytes(b"".join(small[:40]) + binary.encode_block(rng.standard_normal(5000), 2.0, 1e-9 * rng.standard_normal(5000)) + binary.encode_block(np.zeros(0)) + small[0] + binary.encode_block(rng.standard_normal(7))[:-24])
    (tmp_path / "c.alw").write_bytes(b"")
    for k in range(60):
        (tmp_path / f"d{k:02}.alw").write_bytes(small[k])
    files = sorted(tmp_path.iterdir())
    expected = [(str(f), number, len(y), i, v) for f in files for number, _, y in binary.decode_blocks(f.read_bytes()) for i, v in enumerate(y)]
    for split in (binary.SPLIT, 1 << 14, 500, 100):
        reader = binary._BlockReader(str(tmp_path), split)
        reader.PIECE = 700
        parts = reader.partitions()
        batches = [b for p in parts for b in reader.read(p)]
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == expected and max(b.num_rows for b in batches) <= 700
        assert split < 1000 or len(parts) <= 2 * sum(f.stat().st_size for f in files) // split + 1
    assert len(binary._BlockReader(str(tmp_path)).partitions()) == 1
    (tmp_path / "e.alw").write_bytes(small[0] + b"XXX" + small[1])
    reader = binary._BlockReader(str(tmp_path / "e.alw"))
    with pytest.raises(ValueError, match="no block"):
        list(reader.read(reader.partitions()[0]))


def test_block_files_are_cut_at_a_size(spark, tmp_path):
    listed = binary.write_blocks(samples(spark, list(map(float, range(400)))), ["s"], "file://" + str(tmp_path / "blocks"), size=25, file_bytes=1000)
    got = binary.read_blocks(spark, "file://" + str(tmp_path / "blocks")).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, ["file", "block_id"])
    assert sorted((r["chunk"] * 25 + r["i"], r["y"]) for r in got.collect()) == [(i, float(i)) for i in range(400)]
    assert listed.select("file", "block_id").distinct().count() == listed.count() == 16
    assert all(f.stat().st_size <= 1000 for f in (tmp_path / "blocks").glob("*.alw"))


def test_rls_follows_a_line(spark):
    rows = detrend.rls(samples(spark, [2.0 + 0.5 * i for i in range(100)]), ["s"]).orderBy("i").collect()
    assert abs(rows[-1]["residual"]) < 1e-3


def test_formats_round_trip(spark, tmp_path):
    y = np.arange(5.0)
    data = binary.encode_block(4 * y, 2.0) + binary.encode_block(y)[:-16]
    blocks = list(binary.decode_blocks(data))
    assert np.allclose(blocks[0][2], 2 * y) and np.allclose(blocks[1][2], y)
    for bad in (b"XXX" + data, data[: 22 + 16]):
        with pytest.raises(ValueError):
            list(binary.decode_blocks(bad))
    (tmp_path / "a.bin").write_bytes(data)
    spark.dataSource.register(binary.BlockSource)
    for df in (binary.read_blocks(spark, str(tmp_path)), spark.read.format("signal_blocks").load(str(tmp_path))):
        assert [r["y"] for r in df.where("block_id = 0").orderBy("i").collect()] == [0, 2, 4, 6, 8] and df.count() == 10
    a = np.random.default_rng(0).standard_normal((3, 4))
    for low in (True, False):
        got, norms = binary.decode_dictionary(binary.encode_dictionary(a, [1, 2, 3], low))
        assert np.allclose(got, a) and norms.tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        binary.decode_dictionary(binary.encode_dictionary(a)[:-1])
    q, r = binary.decode_basis(binary.encode_basis(a, np.eye(3)))
    assert np.allclose(q, a) and np.allclose(r, np.eye(3))
    q, r = binary.decode_basis(binary.encode_basis(np.stack([a, a]), np.stack([np.eye(3)] * 2)))
    assert q.shape == (2, 3, 4)
    events = [{"frame_start": 3, "atom_index": 7, "atom_type": "CHIRP", "amplitude": 1.5, "phase": 0.0, "energy": 2.25}]
    assert binary.decode_events(binary.encode_events(events, 64)) == events
    assert '"num_events": 1' in binary.events_document(events, mode="x")
    with pytest.raises((ValueError, struct.error)):
        binary.decode_events(b"1234567890123456")


def test_double_double_keeps_what_doubles_lose(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1e16), (1, 1.0), (1, -1e16), (1, 1.0), (2, None)], "k int, v double")
    got = {r["k"]: r["total"] for r in twofold.compensated_sum(df, ["k"], "v").collect()}
    assert got == {1: 2.0, 2: 0.0}
    x, y = twofold.make(F.lit(1.0)), twofold.make(F.lit(3.0))
    q = twofold.div(x, y)
    row = spark.range(1).select(twofold.value(twofold.sub(twofold.mul(q, y), x)).alias("e"), q.alias("q"), twofold.is_small(twofold.absolute(twofold.make(F.lit(-1e-12)))).alias("s")).first()
    assert abs(row["e"]) < 1e-30 and row["q"]["lo"] != 0 and row["s"]


def test_whole_decomposition_places_events(spark):
    d = dictionary.build(dictionary.default_specs(), 64)
    y = np.zeros(256)
    y[64:128] += 5 * d.atoms[118]
    y += 0.01 * np.random.default_rng(42).standard_normal(256)
    cfg = Config(frame_size=64, hop=64, noise=Noise(fixed_sigma=0.5))
    events = pipeline.decompose(samples(spark, y), ["s"], cfg).collect()
    assert {e["frame_start"] for e in events if abs(e["amplitude"]) > 1} == {64}
    json = pipeline.events_json(pipeline.decompose(samples(spark, y), ["s"], cfg), ["s"]).first()["json"]
    assert '"num_events":' in json


def test_every_frame_length_has_its_dictionary(spark):
    y = np.random.default_rng(0).standard_normal(20)
    assert pipeline.decompose(samples(spark, y), ["s"], Config(frame_size=64, hop=32)).count() > 0


def test_double_double_functions(spark):
    """The low part carries what a double of the whole cannot: the functions keep it to first order."""
    x = spark.range(1).select(twofold.make(F.lit(2.0), F.lit(1e-17)).alias("x"), twofold.make(F.lit(-1.0)).alias("m"))
    r = x.select(twofold.sqrt(F.col("x")).alias("s"), twofold.exp(F.col("x")).alias("e"), twofold.log(F.col("x")).alias("l"), twofold.sin(F.col("x")).alias("si"), twofold.cos(F.col("x")).alias("c"), twofold.sqrt(F.col("m")).alias("z"), twofold.log(F.col("m")).alias("w"),
                 twofold.less(F.col("m"), F.col("x")).alias("lt"), twofold.less(twofold.make(F.lit(2.0)), F.col("x")).alias("low")).first()
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    root = Decimal(2) + Decimal("1e-17")
    assert abs(Decimal(r["s"]["hi"]) + Decimal(r["s"]["lo"]) - root.sqrt()) < Decimal("1e-30")
    assert r["e"]["lo"] == pytest.approx(np.exp(2) * 1e-17) and r["l"]["lo"] == pytest.approx(0.5e-17) and r["si"]["lo"] == pytest.approx(np.cos(2) * 1e-17) and r["c"]["lo"] == pytest.approx(-np.sin(2) * 1e-17)
    assert r["z"]["hi"] == r["w"]["hi"] == 0 and r["lt"] and r["low"]


def test_erf_and_huber(spark):
    from pyspark.sql import functions as F

    from sigloom.functions.scalar import erf, huber_weight

    r = spark.range(1).select(erf(F.lit(0.5)).alias("e"), huber_weight(F.lit(2.69)).alias("w")).first()
    assert abs(r["e"] - math.erf(0.5)) < 3e-4 and r["w"] == pytest.approx(0.5)
