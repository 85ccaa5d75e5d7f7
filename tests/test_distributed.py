"""Operators whose work is split differently from run to run give the same results: vectors, windows, filters, fits, sources, stages."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evoked_spark import catalog
from evoked_spark.functions.windows import peak_to_peak, sliding
from evoked_spark.operators import artifacts, averages, epochs, ica, markers, signal, streams
from evoked_spark.operators import vectors as vector_module
from evoked_spark.operators.vectors import vector_sums
from evoked_spark.params import Contrast, Ica, Rejection, Tfr
from evoked_spark.plans import jobs
from evoked_spark.sources import recordings, sinks
from evoked_spark.sources.binary_frames import FrameReader, frame_ranges
from tests.test_signal import as_blocks, as_epochs, as_matrix, write_recording

RNG = np.random.default_rng(11)


def test_vector_sums_against_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_module, "MOST_HELD", 40)  # tables are given out again and again
    rows, want = [], {}
    for i in range(300):
        key, first, n = (None, "a", "b")[i % 3], int(RNG.integers(-4, 5)), int(RNG.integers(0, 7))
        values = [None if RNG.random() < 0.1 else float("nan") if RNG.random() < 0.05 else float(v) for v in RNG.normal(size=n)]
        rows.append((key, i, first, values if i % 50 else None))
        for j, v in enumerate(values if i % 50 else []):
            n_rows, n_values, total = want.get((key, first + j), (0, 0, 0.0))
            there = v is not None and not math.isnan(v)
            want[key, first + j] = (n_rows + 1, n_values + there, total + (v if there else 0.0))
    df = spark.createDataFrame(rows, "k string, i int, at int, v array<double>").repartition(9)
    got = {}
    for r in vector_sums(df, ["k"], ["v"], "at").collect():
        got |= {(r.k, r["first"] + j): (int(n), int(m), s) for j, (n, m, s) in enumerate(zip(r.rows, r.v_n, r.v)) if n}
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2]) for k in want)
    assert vector_sums(df.where("false"), ["k"], ["v"]).count() == 0


def test_averages_of_epochs_that_begin_at_different_places(spark):
    x = RNG.normal(size=(4, 10))
    e = as_epochs(spark, x[:2], rel0=-5).union(as_epochs(spark, x[2:], rel0=-3))
    got = {r.rel: (r.value, r.n_epochs) for r in averages.evoked(e).collect()}
    for rel in range(-5, 7):
        v = [x[i, rel - r0] for i, r0 in enumerate((-5, -5, -3, -3)) if 0 <= rel - r0 < 10]
        assert got[rel][1] == len(v) and got[rel][0] == pytest.approx(np.mean(v))


def test_sliding_windows():
    for shape in ((23,), (3, 17)):
        x = RNG.normal(size=shape)
        for width in (1, 2, 5, 16, 17):
            n = shape[-1] - width + 1
            want = np.stack([x[..., i : i + width].max(-1) - x[..., i : i + width].min(-1) for i in range(n)], -1)
            assert np.allclose(peak_to_peak(x, width), want)
    assert sliding(np.arange(3.0), 4, np.maximum).size == 0


def ragged(spark, x, names, sizes, eog=(), sfreq=100.0):
    """Blocks of different lengths, in turn; some are empty."""
    rows, at, block = [], 0, 0
    while at < x.shape[1]:
        n = sizes[block % len(sizes)]
        rows += [("1", c, "eog" if c in eog else "eeg", sfreq, block, at, x[i, at : at + n].tolist()) for i, c in enumerate(names)]
        at, block = at + n, block + 1
    return spark.createDataFrame(rows, "recording string, channel string, kind string, sfreq double, block long, start long, values array<double>")


@pytest.mark.parametrize("width, step", [(400, 30), (70, 30), (10, 250), (5000, 10)])
def test_window_flags_for_any_blocks(spark, width, step):
    x = RNG.normal(size=(2, 333)).cumsum(1) * 2e-5
    limits = Rejection(ptp=80, width_ms=width, step_ms=step)
    w, s = max(1, round(width / 10)), max(1, round(step / 10))
    starts = range(0, 333 - w + 1, s) if w <= 333 else [0]
    want = [(i, any(np.ptp(row[a : a + w]) >= 80e-6 for row in x)) for i, a in enumerate(starts)]
    for sizes in ([1000], [50], [35, 1, 7], [3, 0, 200]):
        got = artifacts.continuous_ptp(ragged(spark, x, ["a", "b"], sizes), limits).orderBy("i").collect()
        assert [(r.i, r.flag) for r in got] == want, sizes


def test_chains_of_filters_for_any_blocks(spark, monkeypatch):
    monkeypatch.setattr(streams, "LEAST_TOGETHER", 16)
    x = RNG.normal(size=(2, 700)) + 3
    one, two = signal.lowpass_taps(10, 8, 100.0), signal.notch_taps(20.0, 100.0, 5.0)

    def plain(row, taps):
        half = len(taps) // 2
        return np.convolve(np.concatenate([2 * row[0] - row[half:0:-1], row, 2 * row[-1] - row[-2 : -2 - half : -1]]), taps, "valid")

    want = [plain(plain(row, one), two) for row in x]
    other = [plain(row, two) for row in x]
    for sizes in ([700], [40], [3, 0, 90, 1]):
        b = signal.filtered(ragged(spark, x, ["a", "b"], sizes), {"values": [one, two], "other": [two]})
        assert np.allclose(as_matrix(b, ["a", "b"]), want)
        assert np.allclose(as_matrix(b.drop("values").withColumnRenamed("other", "values"), ["a", "b"]), other)
    short = signal.fir(as_blocks(spark, x[:, :5], 2, ["a", "b"]), one)  # shorter than half a kernel
    assert np.isfinite(as_matrix(short, ["a", "b"])).all() and short.count() == 6


def test_correlation_with_a_large_offset(spark):
    s = RNG.normal(size=(2, 900))
    s[1] += 0.6 * s[0]
    x = np.vstack([s + 1e6, np.full(900, 0.1)])
    b = as_blocks(spark, x, 64, ["a", "VEOG", "flat"], eog=["VEOG"])
    got = {r.b: r.r for r in artifacts.pair_correlations(b.where("kind = 'eog'"), b.where("kind = 'eeg'")).collect()}
    exact = np.corrcoef(x[0].astype(np.longdouble) - 1e6, x[1].astype(np.longdouble) - 1e6)[0, 1]
    assert got["a"] == pytest.approx(float(exact), abs=1e-9) and got["flat"] is None


def test_fit_does_not_depend_on_partitions(spark):
    t = np.arange(4000) / 100
    s = np.stack([np.sign(np.sin(2 * math.pi * 1.3 * t)), (t * 0.7) % 1 - 0.5, RNG.laplace(size=4000)])
    x = RNG.normal(size=(5, 3)) @ s + RNG.normal(size=(5, 4000)) * 0.01
    p = Ica(decimate=2, components=3)
    models = []
    for size, parts in ((80, 50), (4000, 1), (333, 3)):
        b = as_blocks(spark, x, size, list("abcde")).union(as_blocks(spark, x[::-1].copy(), size, list("abcde"), recording="2"))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            models.append(ica.fit(b, p, wave=1 if parts == 3 else 256).toPandas().sort_values(["recording", "component", "channel"]))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for m in models[1:]:
        assert np.allclose(m["unmix"], models[0]["unmix"], atol=1e-6) and np.allclose(m["mix"], models[0]["mix"], atol=1e-6)
    one = models[0][models[0]["recording"] == "1"].pivot(index="component", columns="channel", values="unmix").to_numpy()
    r = np.abs(np.corrcoef(one @ x, s)[:3, 3:])
    assert (r.max(0) > 0.99).all() and (r.max(1) > 0.99).all()


def test_fit_of_noise_settles_and_flat_recordings_have_no_components(spark):
    x = RNG.normal(size=(4, 600))
    b = as_blocks(spark, x, 100, list("abcd")).union(as_blocks(spark, np.zeros((2, 100)), 100, list("ab"), recording="flat"))
    m = ica.fit(b, Ica(decimate=1)).toPandas()
    assert set(m["recording"]) == {"1"} and len(m) == 16
    step, w = ica.Step(), np.eye(2)
    for _ in range(9):  # rounds that circle
        w, off = step.taken(w, np.array([[0.0, 1.0], [1.0, 0.0]]) @ w)
    assert step.size < 1
    assert ica.fit(b.where("false")).count() == 0


def test_fit_with_an_end_that_some_channels_lack(spark):
    names, p = list("abcd"), Ica(decimate=1, components=2)
    x = RNG.normal(size=(4, 2)) @ RNG.laplace(size=(2, 900)) + RNG.normal(size=(4, 900)) * 0.01
    b = as_blocks(spark, x, 100, names)
    ragged = b.where("block < 8 or channel = 'b'").withColumn("values", F.when(F.col("block") == 7, F.slice("values", 1, F.when(F.col("channel") == "c", 40).otherwise(100))).otherwise(F.col("values")))
    alone = as_blocks(spark, x, 100, names, recording="none whole").where("block % 4 = array_position(array('a', 'b', 'c', 'd'), channel) - 1")
    with pytest.warns(UserWarning, match="2 recordings have samples that some of their channels lack"):
        got = ica.fit(ragged.unionAll(alone), p).toPandas()
    want = ica.fit(as_blocks(spark, x[:, :740], 100, names), p).toPandas()
    assert set(got["recording"]) == {"1"} and got["channel"].tolist() == want["channel"].tolist()
    assert np.allclose(got["unmix"], want["unmix"], atol=1e-6) and np.allclose(got["mix"], want["mix"], atol=1e-6)


def test_clean_query_where_the_last_block_lacks_channels(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 252")  # the second recording begins with two channels of five
    given.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    given.where("vec_id < 238").coalesce(1).write.parquet(str(tmp_path / "short" / "embeddings.parquet"))
    assert catalog.QUERIES["ica2_to_4_clean"](spark, str(tmp_path)).count() == 252 * 64
    with pytest.warns(UserWarning, match="1 recordings have samples"):
        got = catalog.QUERIES["ica2_to_4_clean"](spark, str(tmp_path / "short"))
    assert got.count() == 238 * 64 and got.where("uv is null or isnan(uv)").count() == 0


def test_clean_query_where_vectors_have_other_lengths(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 250")
    n = F.when(F.col("vec_id") % 31 == 7, 40).when(F.col("vec_id") == 248, 0).otherwise(64)  # of each channel, Fp1 too, some are shorter
    given.withColumn("embedding", F.slice("embedding", 1, n)).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.warns(UserWarning, match="1 recordings have samples"):
        got = catalog.QUERIES["ica2_to_4_clean"](spark, str(tmp_path))
    assert got.count() == 249 * 64 - 8 * 24 and got.where("uv is null or isnan(uv)").count() == 0


@pytest.mark.parametrize("name", ["agg11_eog_correlation", "ica2_sources", "ica3_component_outliers", "ica4_removed"])
def test_queries_on_vectors_of_other_lengths_give_what_their_sql_gives(spark, tmp_path, name):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = F.when(F.col("vec_id") % 31 == 7, 40).otherwise(64)
    given.withColumn("embedding", F.slice("embedding", 1, n)).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        want = db.sql(catalog.ORACLE[name]).df().dropna()  # the SQL counts 64 samples a vector, NULL where there is none
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    keys = [c for c in ("recording", "channel", "component", "s") if c in want]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    for c in want:
        assert np.allclose(got[c], want[c], atol=2e-6, equal_nan=True) if want[c].dtype.kind == "f" else got[c].tolist() == want[c].tolist()


def test_eog_channel_in_the_given_order(spark):
    t = np.arange(3000)
    blink, saccade = np.sin(t / 40.0), np.sign(np.sin(t / 77.0))
    x = np.vstack([blink, saccade, saccade, blink])
    b = as_blocks(spark, x, 500, ["a", "b", "HEOG", "VEOG"], eog=["HEOG", "VEOG"])
    model = spark.createDataFrame([("1", k, c, float(k == i), float(k == i)) for k in range(2) for i, c in enumerate("ab")], ica.MODEL)
    for order, want in ((["VEOG", "HEOG"], 0), (["HEOG", "VEOG"], 1), ([], 1), (["X", "VEOG"], 0)):
        r = {s.component: abs(s.r) for s in ica.eog_scores(b, model, order).collect()}
        assert r[want] == pytest.approx(1) and r[1 - want] < 0.5
    assert ica.first_channel(b.where("kind = 'eog'"), ["VEOG"]).first().channel == "VEOG"


def test_outliers_in_rounds(spark):
    r = [0.01 * (-1) ** i for i in range(30)] + [0.95, 0.2]
    scores = spark.createDataFrame([("1", i, v) for i, v in enumerate(r)] + [("2", 0, None), ("2", 1, 0.1)], "recording string, component int, r double")
    once, twice = (ica.eog_outliers(scores, rounds=k).collect() for k in (1, 2))
    assert [x.exclude for x in once] == [[30]] and [x.exclude for x in twice] == [[30, 31]]
    few = ica.eog_outliers(scores, most=1).first()
    assert few.exclude == [30] and few.candidates == [30, 31]


def test_two_components_are_never_more_than_a_deviation_off(spark):
    rows = [(str(i), k, float(v)) for i in range(200) for k, v in enumerate(RNG.normal(size=2))]
    assert ica.eog_outliers(spark.createDataFrame(rows, "recording string, component int, r double"), z=1.0).count() == 0


def test_bad_spans_of_events(spark):
    ev = spark.createDataFrame([("1", i, 100 * i) for i in range(1, 60)] + [("2", 1, 100)], "recording string, seq long, pos long")
    bad = spark.createDataFrame([("1", "Bad x", 490, 20), ("1", "good", 700, 5), ("1", "BAD", 3000, 2500), ("1", "bad", 110, 0)], "recording string, desc string, pos long, size long")
    for bucket in (16, 1000, 10**6):
        kept = {(r.recording, r.seq) for r in epochs.events_without_bad_spans(ev, bad, 100.0, -0.2, 0.3, bucket).collect()}
        gone = {i for i in range(1, 60) for f, n in ((490, 20), (3000, 2500), (110, 0)) if f <= 100 * i + 30 and f + n > 100 * i - 20}
        assert {("1", i) for i in range(1, 60)} - kept == {("1", i) for i in gone} and ("2", 1) in kept


def test_gap_sketch(spark):
    m = spark.createDataFrame([("1", i, int(p), 1.0) for i, p in enumerate(np.cumsum(RNG.integers(1, 10**6, 5000)))], "recording string, mk int, pos long, sfreq double")
    exact, sketch = markers.gap_stats(m).first(), markers.gap_stats(m, 200).first()
    gaps = np.sort([r.previous for r in markers.with_gaps(m).where("previous is not null").collect()])
    assert sketch.n == exact.n and sketch.gap_max == exact.gap_max
    for p in markers.PERCENTILES:
        assert abs(np.searchsorted(gaps, sketch[f"gap_p{p}"]) - p / 100 * len(gaps)) <= len(gaps) / 200 + 1


@pytest.mark.parametrize("kind", ["INT_16", "IEEE_FLOAT_32"])
@pytest.mark.parametrize("vectorized", [False, True])
def test_frames_for_any_number_of_partitions(spark, tmp_path, kind, vectorized):
    x = np.rint(RNG.normal(size=(3, 950)) * 100) * 0.5e-6
    write_recording(tmp_path, "s1", x, kind, vectorized)
    write_recording(tmp_path, "s2", x[:, :7], kind, vectorized)
    (tmp_path / "s3.vhdr").write_text((tmp_path / "s1.vhdr").read_text().replace("s1.eeg", "none.eeg"))
    rows = lambda **given: sorted(map(tuple, recordings.read_frames(spark, str(tmp_path), 40, **given).collect()))
    one = rows(partitions=1)
    assert len(one) == 25 and one[0][2] == 0 and {r[0] for r in one} == {"s1", "s2"}
    assert one == rows(partitions=7) == rows(partition_bytes=1) == rows()
    many = FrameReader({"path": str(tmp_path), "blocksize": "40", "partitions": "7"}).partitions()
    assert len([p for p in many if p.recording == "s1"]) == 6 and max(p.stop - p.start for p in many) == 160
    assert recordings.read_frames(spark, "file://" + str(tmp_path), 40).count() == 25
    b = signal.blocks_of(recordings.read_frames(spark, str(tmp_path), 40, partitions=5).where("recording = 's1'"), 40)
    assert np.allclose(as_matrix(b, ["Fz", "Cz", "VEOG"]), x)


def test_frame_ranges(spark, tmp_path):
    for total, block, per in ((100, 10, 35), (7, 10, 1), (0, 10, 5), (101, 1, 50)):
        ranges = frame_ranges(total, block, per)
        assert [i for a, b in ranges for i in range(a, b)] == list(range(total)) and all(a % block == 0 for a, _ in ranges)
    assert recordings.read_frames(spark, str(tmp_path), 10).count() == 0


def test_rerun_of_one_recording_leaves_the_others(spark, tmp_path):
    folder = str(tmp_path)
    rows = lambda *of: spark.createDataFrame([(r, i, float(v)) for r, n, v in of for i in range(n)], "recording string, i int, v double")
    names = lambda *of: spark.createDataFrame([(r,) for r in of], "recording string")
    sinks.save_stage(rows(("1", 3, 0), ("2", 4, 0), ("3", 2, 0)), folder, "3_epochs", names("1", "2", "3", "4"), "a")
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("recording=1/*.parquet")}
    assert {r.recording: r.rows for r in sinks.finished(spark, folder, "3_epochs").collect()} == {"1": 3, "2": 4, "3": 2, "4": 0}
    assert [r.recording for r in sinks.pending(names("1", "4", "9"), folder, "3_epochs").collect()] == ["9"]
    sinks.save_stage(rows(("2", 5, 7)), folder, "3_epochs", names("2", "3"), "b")
    got = sorted((r.recording, r.v) for r in sinks.read_stage(spark, folder, "3_epochs").collect())
    assert got == [("1", 0.0)] * 3 + [("2", 7.0)] * 5  # 3 has no rows any more
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("recording=1/*.parquet")} == files
    assert sinks.pending(names("1", "2"), folder, "4_evoked").count() == 2
    series = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "subject string, v double")
    sinks.save_timeseries(series, folder + "/ts")
    sinks.save_timeseries(series.where("subject = '2'"), folder + "/ts")
    assert spark.read.parquet(folder + "/ts").count() == 2


@pytest.mark.parametrize(
    "wrong, text",
    [({"on_missing_codes": "warn"}, "on_missing_codes"), ({"on_missing_markers": "x"}, "on_missing_markers"), ({"tmin": 0.6}, "tmin"), ({"baseline": (0.0,)}, "baseline"), ({"baseline": (-0.5, 0.0)}, "baseline"), ({"block_size": 0}, "block_size"), ({"low": 40.0}, "low"), ({"notch": (-1.0,)}, "notch"), ({"gap_s": 0.0}, "gap_s"), ({"tokens": ("a",)}, "tokens")],
)
def test_parameters_are_checked_by_name(wrong, text):
    given = {"contrast": Contrast((110,), (111,)), "block_size": 500}
    with pytest.raises(ValueError, match=text):
        jobs.Preprocessing(**(given | wrong))


def test_codes_and_grid_parameters():
    with pytest.raises(ValueError, match="standard and deviant"):
        Contrast((110,), (110,))
    with pytest.raises(ValueError, match="kept"):
        Contrast((110,), (111,), (110,))
    with pytest.raises(ValueError, match="method"):
        Tfr(method="wavelet")
    with pytest.raises(ValueError, match="variance"):
        Ica(variance=2.0)


def test_data_are_checked_during_the_job(spark):
    b = as_blocks(spark, RNG.normal(size=(2, 100)), 25, ["a", "b"])
    assert jobs.checked_blocks(b, 100.0, 25).select("values").collect() == b.select("values").collect()
    for bad, rate, size, text in ((b, 200.0, 25, "sfreq"), (b, 100.0, 20, "start|more than"), (b.withColumn("block", F.col("start") / 10).withColumn("block", F.col("block").cast("long")), 100.0, 10, "more than block_size|start")):
        with pytest.raises(Exception, match=text):
            jobs.checked_blocks(bad, rate, size).select("values").collect()
    codes = spark.createDataFrame([("1", 0, 110), ("1", 1, 111), ("2", 0, 110), ("2", 1, 999), ("2", 2, 500)], "recording string, row_id long, code int")
    facts = {r.recording: (r.unknown_codes, r.missing_codes) for r in jobs.code_facts(codes, Contrast((110,), (111, 112), (110, 111, 112, 500))).collect()}
    assert facts == {"1": ("", "112"), "2": ("999", "111 112")}


def test_job_computes_the_codes_once(spark):
    b = as_blocks(spark, RNG.normal(size=(3, 600)) * 1e-6, 100, ["Fz", "Cz", "VEOG"], eog=["VEOG"])
    m = spark.createDataFrame([("1", i, "S  1", 60 + 100 * i, 1, 100.0) for i in range(5)], "recording string, mk long, desc string, pos long, size long, sfreq double")
    codes = spark.createDataFrame([("1", i, 110 + i % 2) for i in range(5)], "recording string, row_id long, code int")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    p = jobs.Preprocessing(Contrast((110,), (111,)), 100, notch=(), low=None, high=None, tmin=-0.2, tmax=0.3, ica=Ica(mode="off"))
    assert jobs.preprocess(b, m, codes.mapInPandas(counted, codes.schema), 100.0, p)["qc"].count() == 1
    assert read.value == 5


def test_metrics_job_with_missing_and_extra_conditions(spark):
    x = RNG.normal(size=(9, 81))
    e = as_epochs(spark, x, conditions=["Standard"] * 4 + ["Deviant"] * 3 + ["Other"] * 2)
    other = as_epochs(spark, x[:2], conditions=["Other"] * 2).withColumn("recording", F.lit("2"))
    names = spark.createDataFrame([("1",), ("2",), ("3",)], "recording string")
    out = jobs.metrics(e.union(other), grid=Tfr(10, 20, 10, cycles_divisor=4), channels=("Cz",), recordings=names)
    series = out["erp_timeseries"]
    assert {(r.subject, r.condition, r.status) for r in series.collect()} == {("1", "Standard", "OK"), ("1", "Deviant", "OK"), ("1", averages.MMN, "OK"), ("2", None, "NO_CONDITIONS"), ("3", None, "EMPTY_EPOCHS")}
    power = {(r.frequency, round(r.time * 100)): r.total_power for r in out["tfr_metrics"].where("condition = 'Standard' and status = 'OK'").collect()}
    morlet = jobs.metrics(e, grid=Tfr(10, 20, 10, cycles_divisor=4, method="morlet"), channels=("Cz",))["tfr_metrics"].where("condition = 'Standard' and status = 'OK'")
    assert len(power) == 2 * 81 and any(abs(r.total_power - power[r.frequency, round(r.time * 100)]) > 1e-3 for r in morlet.collect())
    only = averages.erp_timeseries(e, -0.2, 0.6, conditions=("Standard", "Missing"))
    assert {r.condition for r in only.collect()} == {"Standard"}


def test_run_is_saved_with_its_model(spark, tmp_path):
    t = np.arange(4000)
    blink = 2e-4 * np.exp(-(((t % 400) - 200) / 25.0) ** 2)

    x = np.vstack([RNG.normal(size=(12, 4000)) * 1e-5 + np.linspace(0.2, 0.9, 12)[:, None] * blink, 0.3 * np.sin(t / 90.0) * 1e-4, blink])
    b = as_blocks(spark, x, 1000, [f"c{i}" for i in range(12)] + ["HEOG", "VEOG"], eog=["HEOG", "VEOG"])
    m = spark.createDataFrame([("1", i, "S", 300 + 100 * i, 1, 100.0) for i in range(30)] + [("1", 99, "BAD_move", 700, 250, 100.0)], "recording string, mk int, desc string, pos long, size long, sfreq double")
    codes = spark.createDataFrame([("1", i, 111 if i % 4 == 0 else 110) for i in range(30)], "recording string, row_id long, code int")
    p = jobs.Preprocessing(Contrast((110,), (111,)), 1000, notch=(), low=None, high=None, eog=("VEOG", "HEOG"), ica=Ica(mode="on", decimate=1))
    out = jobs.preprocess(b, m, codes, 100.0, p)
    names = b.select("recording").distinct()
    jobs.save_run(out, str(tmp_path), names, run="1")
    saved = {k: sinks.read_stage(spark, str(tmp_path), v) for k, v in jobs.STAGES.items()} | {"qc": spark.read.option("header", True).csv(f"{tmp_path}/qc-1")}
    other = {k: spark.createDataFrame(df.toPandas(), df.schema).withColumn("recording" if k != "qc" else "subject", F.lit("2")) for k, df in saved.items() if k != "signal"} | {"signal": saved["signal"].limit(0)}
    jobs.save_run(other, str(tmp_path), names.select(F.lit("2").alias("recording")), run="2")
    model = sinks.read_stage(spark, str(tmp_path), jobs.STAGES["ica_model"])
    assert {r.recording for r in model.select("recording").distinct().collect()} == {"1", "2"}
    assert {r.n_recordings for r in sinks.read_stage(spark, str(tmp_path), jobs.GRAND_AVERAGE).collect()} == {2}
    qc = spark.read.option("header", True).csv(f"{tmp_path}/qc-2").first()
    assert qc.ica_find_eog_channel_used == "VEOG" and qc.ica_applied == "true" and qc.status == "OK" and not qc.missing_codes
    assert int(qc.n_epochs_before_artifact) < 30  # a BAD span lies over some events
