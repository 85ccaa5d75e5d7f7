"""Markers, codes and their alignment on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from evoked_spark.operators import labels, markers
from evoked_spark.params import Contrast
from evoked_spark.sources.recordings import parse_markers


def table(spark, positions, recording="1"):
    rows = [(recording, i, float(p), p) for i, p in enumerate(positions)]
    return spark.createDataFrame(rows, "recording string, mk int, x double, pos long").select("recording", "mk", "pos", F.lit(1.0).alias("sfreq"), F.lit("S").alias("desc"))


def codes(spark, n, recording="1"):
    return spark.createDataFrame([(recording, i, 110 + i % 2) for i in range(n)], "recording string, row_id long, code int")


@pytest.mark.parametrize(
    "positions, gap, n, auto, want, dropped",
    [
        ([0, 1, 2, 3], None, 4, True, [0, 1, 2, 3], (0, 0)),
        ([0, 10, 11, 12, 13], None, 3, True, [10, 11, 12], (0, 2)),
        ([0, 1, 2, 3], None, 3, True, [0, 1, 2], (0, 1)),
        ([0, 1, 2, 9, 10, 11], 2, 2, True, [1, 10], (4, 0)),
        ([5], 2, 1, True, None, None),
        ([0, 1, 2], None, 2, False, None, None),
        ([0, 1], None, 3, True, None, None),
        ([0, 1, 1], None, 3, True, None, None),
    ],
)
def test_alignment(spark, positions, gap, n, auto, want, dropped):
    kept, status = markers.alignment(table(spark, positions), codes(spark, n), gap, auto)
    row = status.first()
    if want is None:
        assert row.status == "SKIP_ALIGNMENT_FAILED" and kept.count() == 0
    else:
        assert [r.pos for r in kept.orderBy("pos").collect()] == want
        assert row.status == "OK" and (row.markers_dropped_by_gap, row.markers_dropped_by_auto) == dropped
        assert markers.events(kept, codes(spark, n)).count() == n


def test_gap_stats(spark):
    g = markers.gap_stats(table(spark, [0, 1, 3, 7])).first()
    want = {"gap_min": 1, "gap_p25": 1.5, "gap_p50": 2, "gap_p75": 3, "gap_p90": 3.6, "gap_p95": 3.8, "gap_p99": 3.96, "gap_max": 4}
    assert all(g[k] == pytest.approx(v) for k, v in want.items())
    one = markers.gap_stats(table(spark, [5])).first()
    assert one.n == 1 and one.gap_p50 is None


def test_marker_file(spark):
    text = "[Marker Infos]\n; a comment\nMk1=New Segment,,1,1,0,2024\nMk2=Stimulus,S  1,501,1,0\nMk3= Stimulus ,S  1,1001,1,0\nMk4=Stimulus,S  2\nMk5=Response,R  1,1200.0,1,0"
    rows = parse_markers(spark.createDataFrame([("a", line) for line in text.split("\n")], "recording string, value string")).orderBy("mk").collect()
    assert [r.mk for r in rows] == [1, 2, 3, 5] and rows[0].desc == "" and rows[2].mtype == "Stimulus" and rows[3].pos == 1200


def test_trial_labels(spark):
    df = spark.createDataFrame([(c,) for c in (110, 111, 211, 300, 412, 910, 520)], "code int")
    got = {r.code: r for r in labels.with_trial_labels(df, {"token1": "EH", "token2": "IH"}).collect()}
    want = {110: ("full", "token1", "token2", "token1"), 111: ("full", "token1", "token2", "token2"), 211: ("full", "token2", "token1", "token1"), 300: ("reduced", "token1", "token2", "token1"), 412: ("reduced", "token2", "token1", "token1"), 910: ("full", "NA", "NA", "NA"), 520: ("other", "NA", "NA", "NA")}
    for code, w in want.items():
        r = got[code]
        assert (r.variant, r.standard_role, r.deviant_role, r.trial_role) == w
    assert got[910].is_practice and not got[110].is_practice and got[300].is_buffer and not got[520].is_true
    assert got[110].trial_label == "EH" and got[910].trial_label == "NA"


def test_contrast_checks():
    for bad in ({"standard": (), "deviant": (1,)}, {"standard": (1,), "deviant": (1,)}, {"standard": (1,), "deviant": (2,), "keep": (1,)}):
        with pytest.raises(ValueError):
            Contrast(**bad)


def test_missing_files(spark):
    names = spark.createDataFrame([("1",), ("2",), ("3",)], "recording string")
    got = markers.missing_files(names, names.where("recording <> '1'"), names.where("recording <> '2'"), "skip", "skip")
    assert {r.recording: r.status for r in got.collect()} == {"1": "SKIP_MISSING_SUBJECT_CSV", "2": "SKIP_MISSING_VMRK", "3": "OK"}
    with pytest.raises(Exception, match="no codes for recording"):
        markers.missing_files(names, names.where("recording <> '1'"), names, "fail").collect()


def test_descriptions(spark):
    df = table(spark, [1, 2, 3, 4]).withColumn("desc", F.expr("element_at(array('b', 'a', 'b', 'c'), cast(pos as int))"))
    r = markers.first_descriptions(df, 2).first()
    assert r.n_descriptions == 3 and r.descriptions == ["b", "a"]
    assert [x.desc for x in markers.top_descriptions(df, 2).orderBy("rank").collect()] == ["b", "a"]
