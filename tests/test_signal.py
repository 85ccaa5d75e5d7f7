"""Numerics against plain numpy, and independence of block sizes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked_spark.operators import artifacts, averages, epochs, ica, markers, signal, tfr
from evoked_spark.params import Ica, Rejection, Tfr, Window
from evoked_spark.plans import jobs
from evoked_spark.sources import recordings, sinks

RNG = np.random.default_rng(7)


def as_blocks(spark, x, size, names, eog=(), sfreq=100.0, recording="1"):
    rows = [(recording, c, "eog" if c in eog else "eeg", sfreq, at // size, at, x[i, at : at + size].tolist()) for i, c in enumerate(names) for at in range(0, x.shape[1], size)]
    return spark.createDataFrame(rows, "recording string, channel string, kind string, sfreq double, block long, start long, values array<double>")


def as_matrix(blocks, names):
    rows = {}
    for r in sorted(blocks.collect(), key=lambda r: r.start):
        rows.setdefault(r.channel, []).extend(r["values"])
    return np.array([rows[c] for c in names])


def as_epochs(spark, x, sfreq=100.0, rel0=-20, conditions=None, channel="Cz", kind="eeg"):
    rows = [("1", i, (conditions or ["Standard"] * len(x))[i], channel, kind, sfreq, rel0, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording string, epoch_id long, condition string, channel string, kind string, sfreq double, rel0 int, values array<double>")


@pytest.mark.parametrize("size", [16, 64, 1000])
def test_fir_does_not_depend_on_blocks(spark, size):
    x = RNG.normal(size=(2, 230))
    taps = signal.lowpass_taps(10, 8, 100.0)
    half = len(taps) // 2
    want = []
    for row in x:
        padded = np.concatenate([2 * row[0] - row[half:0:-1], row, 2 * row[-1] - row[-2 : -2 - half : -1]])
        want.append(np.convolve(padded, taps, "valid"))
    got = as_matrix(signal.fir(as_blocks(spark, x, size, ["a", "b"]), taps), ["a", "b"])
    assert np.allclose(got, want)


def test_filters_pass_and_stop():
    t = np.arange(4000) / 250
    gain = lambda taps, f: np.abs(np.sum(taps * np.exp(-2j * np.pi * f / 250 * np.arange(len(taps)))))
    band, notch = signal.band_pass_taps(0.1, 30.0, 250.0), signal.notch_taps(60.0, 250.0)
    assert gain(band, 10) == pytest.approx(1, abs=0.01) and gain(band, 50) < 0.01 and gain(band, 0) < 0.01
    assert gain(notch, 60) < 0.6 and gain(notch, 50) == pytest.approx(1, abs=0.01) and len(t)


def test_average_reference(spark):
    x = RNG.normal(size=(4, 50))
    b = as_blocks(spark, x, 20, ["a", "b", "c", "VEOG"], eog=["VEOG"])
    got = as_matrix(signal.average_reference(b), ["a", "b", "c", "VEOG"])
    assert np.allclose(got[:3].sum(0), 0) and np.allclose(got[3], x[3])


def test_blocks_without_a_reference(spark):
    x = RNG.normal(size=(3, 60))
    b = as_blocks(spark, x, 20, ["a", "b", "VEOG"], eog=["VEOG"]).where("block < 2 or channel = 'VEOG'")
    got = signal.average_reference(b)
    assert got.columns == b.columns and {(r.channel, r.block) for r in got.collect()} == {(c, k) for c in ("a", "b", "VEOG") for k in (0, 1)}
    assert {(r.channel, r.block) for r in signal.average_reference(b, "known").where("not known").collect()} == {("VEOG", 2)}


def test_cut_does_not_depend_on_blocks(spark):
    x = RNG.normal(size=(1, 300))
    ev = spark.createDataFrame([("1", 1, 10), ("1", 2, 100), ("1", 3, 130), ("1", 4, 295)], "recording string, seq long, pos long")
    for size in (32, 100, 400):
        got = {r.epoch_id: r for r in epochs.cut(as_blocks(spark, x, size, ["a"]), ev, -0.2, 0.3, size).collect()}
        assert set(got) == {2, 3}
        assert np.allclose(got[3]["values"], x[0, 110:161]) and got[3].rel0 == -20


def test_bad_spans(spark):
    e = as_epochs(spark, RNG.normal(size=(2, 30))).withColumn("pos", F.col("epoch_id") * 100 + 50)
    bad = spark.createDataFrame([("1", "Bad x", 59, 5), ("1", "good", 150, 5)], "recording string, desc string, pos long, size long")
    assert [r.epoch_id for r in epochs.drop_bad_spans(e, bad).collect()] == [1]


@pytest.mark.parametrize(
    "values, width, step, bad",
    [([0, 0, 80, 0, 0], 2, 1, True), ([0, 75, 0], 2, 1, True), ([0, 74, 0], 2, 1, False), ([0, 0, 0, 0, 80, 80], 2, 3, True), ([0, 0, 80, 80, 80, 80], 2, 3, False), ([0, 80], 9, 1, True), ((np.arange(400) * 0.25).tolist(), 200, 1, False)],
)
def test_moving_ptp(spark, values, width, step, bad):
    e = as_epochs(spark, np.array([values]) * 1e-6, sfreq=1000.0, rel0=0)
    got = artifacts.moving_ptp(e, Rejection(ptp=75, width_ms=width, step_ms=step, tmin=0, tmax=9))
    assert got.count() == int(bad)


@pytest.mark.parametrize("v, bad", [(150.0, True), (149.9, False), (-150.0, True)])
def test_voltage(spark, v, bad):
    assert artifacts.voltage(as_epochs(spark, np.array([[0, v, 0]]) * 1e-6), Rejection()).count() == int(bad)


def test_clusters(spark):
    for flags, want in (([0, 1, 1, 0, 1], 2), ([1], 1), ([0], 0)):
        df = spark.createDataFrame([("1", i, bool(f)) for i, f in enumerate(flags)], "recording string, i long, flag boolean")
        assert artifacts.clusters(df, ["recording"], "i").first().clusters == want


def test_continuous_ptp_follows_the_global_grid(spark):
    x = np.zeros((1, 200))
    x[0, [39, 120, 121]] = 1e-4
    limits = Rejection(ptp=75, width_ms=100, step_ms=20)
    found = [artifacts.continuous_ptp(as_blocks(spark, x, size, ["VEOG"], eog=["VEOG"]), limits).where("flag").orderBy("i").collect() for size in (3, 7, 20, 50, 200)]
    want = [i for i in range(0, 96) if np.ptp(x[0, 2 * i : 2 * i + 10]) >= 75e-6]
    assert all([r.i for r in f] == want for f in found)


def test_averages(spark):
    x = RNG.normal(size=(6, 40)) * 1e-6
    e = as_epochs(spark, x, conditions=["Standard"] * 4 + ["Deviant"] * 2)
    waves = averages.evoked(e)
    std, dev = x[:4].mean(0), x[4:].mean(0)
    diff = {r.rel: r for r in averages.difference(waves).collect()}
    assert all(diff[i - 20].value == pytest.approx(dev[i] - std[i]) for i in range(40)) and diff[0].n_epochs == 2
    m = {(r.condition, r.window): r for r in averages.erp_metrics(e, [Window("w", 0.05, 0.15)], conditions=("Standard", "Deviant", "Other")).collect()}
    assert m["Standard", "w"].mean_uV == pytest.approx(std[25:36].mean() * 1e6)
    assert m["MMN_DEV_MINUS_STD", "w"].n_epochs == 6 and m["Other", None].status == "MISSING_OR_EMPTY"
    same = averages.evoked(as_epochs(spark, np.repeat(x[:1], 3, 0)))
    assert np.allclose([r.value for r in same.orderBy("rel").collect()], x[0])


def test_baseline_and_crop(spark):
    x = RNG.normal(size=(1, 40))
    r = epochs.baseline(epochs.crop(as_epochs(spark, x), -0.1, 0.1), -0.1, 0).first()
    assert r.rel0 == -10 and np.allclose(r["values"], x[0, 10:31] - x[0, 10:21].mean())


def test_morlet_against_direct_sum(spark):
    x = RNG.normal(size=(3, 50))
    p = Tfr(5, 10, 5, method="morlet")
    w = tfr.morlet(5.0, 0.5, 100.0)
    assert np.sum(np.abs(w) ** 2) == pytest.approx(2)
    z = np.array([np.convolve(v, w, "same") for v in x])
    got = {r.rel: r for r in tfr.sums(as_epochs(spark, x), p).where("frequency = 5").collect()}
    assert all(got[i - 20].power == pytest.approx(np.mean(np.abs(z[:, i]) ** 2)) and got[i - 20].itc == pytest.approx(abs(np.mean(z[:, i] / abs(z[:, i])))) for i in range(50))


def test_coherence_of_identical_epochs_is_one(spark):
    x = np.repeat(RNG.normal(size=(1, 100)), 3, 0)
    for method in ("morlet", "multitaper"):
        rows = tfr.sums(as_epochs(spark, x), Tfr(10, 10, 1, cycles_divisor=2), method).collect()
        assert all(r.itc == pytest.approx(1) for r in rows)


def test_tapers_are_orthonormal():
    ws = tfr.tapers(10.0, 5.0, 200.0)
    assert len(ws) == 3 and all(np.sum(np.abs(w) ** 2) == pytest.approx(2) for w in ws)
    assert Tfr(1, 2, 0.1).freqs[-1] == pytest.approx(2.0)


def test_ica_recovers_sources(spark):
    t = np.arange(3000) / 100
    s = np.stack([np.sign(np.sin(2 * math.pi * 1.3 * t)), (t * 0.7) % 1 - 0.5])
    x = np.array([[1.0, 0.5], [0.3, 1.0], [0.7, -0.4]]) @ s
    b = as_blocks(spark, np.vstack([x, s[:1] * 2]), 500, ["a", "b", "c", "VEOG"], eog=["VEOG"])
    p = Ica(decimate=1, variance=0.9999)
    model = ica.fit(b, p)
    model = spark.createDataFrame(model.collect(), model.schema)
    eeg = b.where("kind = 'eeg'")
    scores = ica.proxy_scores(ica.sources(eeg, model), b.where("kind = 'eog'"))
    best = ica.rank(scores, Ica(threshold=0.9))
    assert len(best.first().exclude) == 1 and abs(best.first().top_scores[0]) > 0.99
    clean = as_matrix(ica.remove(b, model, best), ["a", "b", "c"])
    assert np.abs([np.corrcoef(row, s[0])[0, 1] for row in clean]).max() < 0.1
    none = best.select("recording", F.array().cast("array<int>").alias("exclude"))
    assert np.allclose(as_matrix(ica.remove(b, model, none), ["a", "b", "c"]), x)


def test_eog_outliers(spark):
    rows = [("1", i, 0.01 * (-1) ** i) for i in range(19)] + [("1", 19, -0.9)]
    got = ica.eog_outliers(spark.createDataFrame(rows, "recording string, component int, r double"))
    assert got.first().exclude == [19]


def test_preprocessing_with_component_removal(spark):
    """Blinks in the EOG channel that leak into the scalp are removed where the gate is on."""
    t = np.arange(6000)
    blink = 2e-4 * np.exp(-(((t % 400) - 200) / 25.0) ** 2)
    other = RNG.normal(size=(16, 6000)) * 1e-5
    x = np.vstack([other + np.linspace(0.2, 0.9, 16)[:, None] * blink, blink])
    names = [f"c{i}" for i in range(16)] + ["VEOG"]
    b = as_blocks(spark, x, 1000, names, eog=["VEOG"])
    m = spark.createDataFrame([("1", i, "S", 300 + 100 * i, 1, 100.0) for i in range(50)], "recording string, mk int, desc string, pos long, size long, sfreq double")
    codes = spark.createDataFrame([("1", i, 111 if i % 4 == 0 else 110) for i in range(50)], "recording string, row_id long, code int")
    given = {"notch": (), "low": None, "high": 30.0}
    for mode, bound in (("on", 0.25), ("off", 1.0)):
        out = jobs.preprocess(b, m, codes, 100.0, jobs.Preprocessing(jobs.Contrast((110,), (111,)), 1000, ica=Ica(mode=mode, decimate=1), **given))
        row = out["qc"].first()
        assert row.ica_mode == mode and row.ica_applied == (mode == "on") == bool(row.ica_exclude) and ((row.ica_fit_n_components or 0) > 0) == (mode == "on")
        clean = as_matrix(out["signal"], names[:16])
        r = max(abs(np.corrcoef(row, blink)[0, 1]) for row in clean)
        assert (r < bound) if mode == "on" else (r > 0.5)


def test_recommendation(spark):
    for given, want in (((0.2, 0.3, 20.0, None), ""), ((0.21, None, None, 21.0), "blink_proxy>20/min+epoch_loss>0.20"), ((0.5, 0.4, 25.0, None), "blink_rate>20/min+epoch_loss>0.20+eog_corr>0.30+blink_rate>20/min")):
        yes, why = ica.recommendation(*[F.lit(g).cast("double") for g in given])
        assert tuple(spark.range(1).select(yes, why).first()) == (want != "", want)


def write_recording(folder, name, x, kind, vectorized):
    head = f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile={name}.eeg\nMarkerFile={name}.vmrk\nDataFormat=BINARY\nDataOrientation={'VECTORIZED' if vectorized else 'MULTIPLEXED'}\nNumberOfChannels={len(x)}\nSamplingInterval=10000\n[Binary Infos]\nBinaryFormat={kind}\n[Channel Infos]\n"
    head += "".join(f"Ch{i + 1}={c},,0.5,µV\n" for i, c in enumerate(("Fz", "Cz", "VEOG")))
    (folder / f"{name}.vhdr").write_text(head)
    raw = np.rint(x / 0.5e-6)
    raw = raw.astype("<i2" if kind == "INT_16" else "<f4")
    (folder / f"{name}.eeg").write_bytes((raw if vectorized else raw.T).tobytes())


@pytest.mark.parametrize("kind", ["INT_16", "IEEE_FLOAT_32"])
@pytest.mark.parametrize("vectorized", [False, True])
def test_read_frames(spark, tmp_path, kind, vectorized):
    x = np.rint(RNG.normal(size=(3, 95)) * 100) * 0.5e-6
    write_recording(tmp_path, "s1", x, kind, vectorized)
    frames = recordings.read_frames(spark, str(tmp_path), 40)
    b = signal.blocks_of(frames, 40, eog=["VEOG"])
    assert np.allclose(as_matrix(b, ["Fz", "Cz", "VEOG"]), x) and b.where("kind = 'eog'").count() == 3
    ref = as_matrix(signal.blocks_of(signal.reference_frames(frames, ["Fz", "Cz"]), 40), ["Fz", "Cz", "VEOG"])
    assert np.allclose(ref[:2].sum(0), 0) and np.allclose(ref[2], x[2])
    assert [r.recording for r in recordings.discover(spark, str(tmp_path)).collect()] == ["s1"]


def test_workload_from_files(spark, tmp_path):
    """Three recordings end to end: one aligns, one has a code too many, one ends without deviants."""
    t = np.arange(3000)
    for name in ("s1", "s2", "s3"):
        x = np.stack([np.sin(t / 9) * 1e-5, np.cos(t / 7) * 1e-5, RNG.normal(size=3000) * 1e-6])
        write_recording(tmp_path, name, x, "IEEE_FLOAT_32", False)
        (tmp_path / f"{name}.vmrk").write_text("[Marker Infos]\n" + "".join(f"Mk{i + 1}=Stimulus,S  1,{300 + 100 * i},1,0\n" for i in range(20)))
        n = 21 if name == "s2" else 20
        rows = "".join(f"x,{110.0 if name == 's3' or i % 4 else 111.0}\r\n" for i in range(n))
        (tmp_path / f"subject-{name[1:]}.csv").write_text("other,EventCode\r\n" + rows)
    number = recordings.recording_number(F.col("recording"))
    b = signal.blocks_of(recordings.read_frames(spark, str(tmp_path), 500), 500, eog=["VEOG"]).withColumn("recording", number)
    m = recordings.read_markers(spark, str(tmp_path)).withColumn("recording", number).withColumn("sfreq", F.lit(100.0))
    codes = recordings.read_codes(spark, str(tmp_path))
    assert codes.count() == 61
    with pytest.raises(Exception, match="column Missing missing"):
        recordings.read_codes(spark, str(tmp_path), column="Missing").collect()
    p = jobs.Preprocessing(jobs.Contrast((110,), (111,)), 500, notch=(), low=None, high=30.0, ica=Ica(mode="off"))
    out = jobs.preprocess(b, m, codes, 100.0, p)
    rows = {r.subject: r for r in out["qc"].collect()}
    assert {k: r.status for k, r in rows.items()} == {"1": "OK", "2": "SKIP_ALIGNMENT_FAILED", "3": "SKIP_EMPTY_CONDITION"}
    one = rows["1"]
    assert (one.raw_file, one.subject_csv, one.sfreq, one.error, one.ica_mode, one.ica_applied, one.ica_exclude) == ("1.vhdr", "subject-1.csv", 100.0, "", "off", False, "")
    assert (one.behavioral_codes_total, one.behavioral_codes_used, one.markers_original, one.markers_dropped_by_auto, one.n_events_used, one.n_events_kept_stddev) == (20, 20, 20, 0, 20, 20)
    assert rows["2"].error == "markers can't be aligned with codes" and rows["2"].markers_original == 20 and rows["3"].n_deviant_final == 0
    assert {r.recording for r in out["evoked"].select("recording").distinct().collect()} == {"1"}
    path = sinks.save_stage(out["epochs"], str(tmp_path / "out"), "3_epochs")
    again = recordings.read_epochs(spark, path)
    assert again.count() == out["epochs"].count() > 0
    sinks.save_csv(out["qc"], str(tmp_path / "qc"))
    assert spark.read.option("header", True).csv(str(tmp_path / "qc")).count() == 3
    metric = jobs.metrics(again.withColumn("recording", F.col("recording").cast("string")), grid=Tfr(5, 10, 5), channels=("Fz", "Cz"))
    assert metric["erp_metrics"].where("status = 'OK'").count() > 0
    sinks.save_timeseries(metric["erp_timeseries"], str(tmp_path / "ts"))


def test_job_ignores_spans_counts_from_zero_and_prefers_eog(spark, tmp_path):
    """A BAD span in the file aligns with no code; VEOG is flat while Fp1 blinks; an epoch starts where its marker says."""
    t = np.arange(3000)
    for name in ("s1", "s2"):
        x = np.stack([(t % 500 < 20) * 2e-4, np.sin(t / 9) * 1e-5, t * 0.5e-6])
        write_recording(tmp_path, name, x, "IEEE_FLOAT_32", False)
        lines = [f"Stimulus,S  1,{301 + 100 * i},1,0" for i in range(20)] + ["Bad Interval,BAD_move,1351,20,0"]
        (tmp_path / f"{name}.vmrk").write_text("[Marker Infos]\n" + "".join(f"Mk{i + 1}={line}\n" for i, line in enumerate(lines)))
    (tmp_path / "subject-1.csv").write_text("EventCode\r\n" + "".join(f"{110 if i % 2 else 111}\r\n" for i in range(20)))
    number = recordings.recording_number(F.col("recording"))
    frames = recordings.read_frames(spark, str(tmp_path), 500)
    b = signal.blocks_of(frames, 500, eog=["VEOG"]).withColumn("recording", number).replace("Fz", "Fp1", "channel")
    m = recordings.read_markers(spark, str(tmp_path)).withColumn("recording", number).withColumn("sfreq", F.lit(100.0))
    codes = recordings.read_codes(spark, str(tmp_path))
    p = jobs.Preprocessing(jobs.Contrast((110,), (111,)), 500, notch=(), low=None, high=None, baseline=None, ica=Ica(mode="off"))
    out = jobs.preprocess(b, m, codes, 100.0, p)
    status = {r.subject: r for r in out["qc"].collect()}
    assert status["1"].status == "OK" and status["2"].status == "SKIP_MISSING_SUBJECT_CSV"
    assert status["1"].blink_source == "eog" and status["1"].blinks_per_min == 0
    cut = epochs.cut(b, markers.events(markers.without_spans(m).where("recording = '1'"), codes).withColumn("condition", F.lit("x")), -0.2, 0.6, 500)
    first = [r.values[0] / 0.5e-6 for r in cut.where("channel = 'VEOG'").collect()]
    assert sorted(map(round, first))[:3] == [280, 380, 480]


def test_errors_of_wrong_wishes(spark):
    e = spark.createDataFrame([("1", 0, "Standard", "Fz", "eeg", 100.0, -20, [1.0] * 60)], "recording string, epoch_id int, condition string, channel string, kind string, sfreq double, rel0 int, values array<double>")
    with pytest.raises(ValueError, match="none of the channels"):
        jobs.metrics(e, channels=("Pz",))
    m = spark.createDataFrame([("1", i, 10 * i, 100.0) for i in range(3)], "recording string, mk int, pos long, sfreq double")
    assert markers.densest(m, F.lit(3)).count() == 3
    with pytest.raises(Exception, match="fewer markers"):
        markers.densest(m, F.lit(4)).collect()


def test_number_of_components_and_decimated_powers(spark):
    b = as_blocks(spark, RNG.laplace(size=(5, 2000)), 300, list("abcde"))
    model = ica.fit(b, Ica(components=2, decimate=1)).toPandas()
    assert len(model) == 10 and set(model["component"]) == {0, 1}
    e = spark.createDataFrame([("1", i, "Standard", "Fz", "eeg", 100.0, -20, RNG.normal(size=81).tolist()) for i in range(3)], "recording string, epoch_id int, condition string, channel string, kind string, sfreq double, rel0 int, values array<double>")
    every, some = (tfr.sums(e, Tfr(5, 10, 5, decim=k, method="morlet")).orderBy("frequency", "rel").collect() for k in (1, 4))
    assert [r for r in every if (r.rel + 20) % 4 == 0] == some
