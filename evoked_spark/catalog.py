"""Queries over the given tables, one per operator, with equivalent SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import codes as C

from .operators import artifacts, averages, epochs, ica, labels, markers, qc, signal, tfr
from .params import Contrast, Ica, Rejection, Tfr, Window
from .plans import jobs
from .sources import recordings, sinks
from .sources import tables as T
from .sources.lineage import shared_folder, work_table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

KEEP = (110, 111, 210, 211)
CONTRAST = Contrast(standard=(110, 210), deviant=(111, 211), keep=KEEP)
#: Thresholds that suit these tables: vectors of unit length read as microvolts times 100.
LIMITS = Rejection(ptp=60.0, width_ms=200.0, step_ms=12.5, positive=40.0, negative=-40.0)
HOURS12 = 43_200.0
GAPS = (3600.0, 7200.0, 21600.0, 43200.0, 86400.0)
TAPS = signal.lowpass_taps(10.0, 33.0, T.SFREQ)
GRID = Tfr(fmin=4.0, fmax=12.0, fstep=4.0, method="morlet")
MORE = (Window("early", 0.05, 0.15), Window())


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def fixed(c: Column | str, places: int = 6) -> Column:
    """Rounded, without a negative zero: sums differ in their last digits from plan to plan."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


MK = """mk AS (SELECT CAST(user_id AS VARCHAR) AS recording, event_id AS mk, event_type AS d,
  epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS pos, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t FROM events),
gp AS (SELECT *, t - lag(t) OVER w AS previous, lead(t) OVER w - t AS next FROM mk WINDOW w AS (PARTITION BY recording ORDER BY pos, mk))"""
CD = """cd AS (SELECT CAST(o_custkey AS VARCHAR) AS recording, l_orderkey * 10 + l_linenumber AS row_id,
  CAST(100 * (1 + (l_linenumber - 1) % 4) + CASE WHEN CAST(l_quantity AS INT) % 10 = 0 THEN 0 ELSE 10 END + CASE WHEN CAST(l_quantity AS INT) % 5 = 1 THEN 1 ELSE 0 END AS INT) AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EP = """vec AS (SELECT vec_id // 5 AS e, ['Fp1', 'Fz', 'F3', 'Cz', 'F4'][vec_id % 5 + 1] AS channel, embedding FROM embeddings),
sm AS (SELECT CAST((e // 2) % 10 AS VARCHAR) AS recording, e AS epoch_id, CASE e % 2 WHEN 0 THEN 'Standard' ELSE 'Deviant' END AS condition,
  channel, unnest(range(64)) - 16 AS rel, CAST(unnest(embedding) AS DOUBLE) * 1e-4 AS v FROM vec)"""
BL = """vec AS (SELECT vec_id // 5 AS e, ['Fp1', 'Fz', 'F3', 'Cz', 'F4'][vec_id % 5 + 1] AS channel, embedding FROM embeddings),
sg AS (SELECT CAST(e // 50 AS VARCHAR) AS recording, channel, e % 50 AS block, (e % 50) * 64 + unnest(range(64)) AS s, CAST(unnest(embedding) AS DOUBLE) * 1e-4 AS v FROM vec)"""
EV = EP + """,
ev AS (SELECT recording, condition, channel, rel, avg(v) AS value, count(*) AS n_epochs FROM sm GROUP BY ALL)"""
DF = EV + """,
dv AS (SELECT a.recording, 'MMN_DEV_MINUS_STD' AS condition, a.channel, a.rel, a.value - b.value AS value, least(a.n_epochs, b.n_epochs) AS n_epochs, a.n_epochs + b.n_epochs AS n_sum
  FROM ev a JOIN ev b USING (recording, channel, rel) WHERE a.condition = 'Deviant' AND b.condition = 'Standard')"""
R = "round({}, 6) + 0.0".format


# 2.2 projections and predicates


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS recording FROM events")
def prj1_recording_number(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    u, shape = F.col("user_id").cast("string"), F.col("event_id") % 3
    name = F.when(shape == 0, F.concat(F.lit(" S"), u)).when(shape == 1, F.concat(u, F.lit("_run "))).otherwise(F.concat(F.substring(u, 1, 1), F.lit("-x"), F.expr("substring(cast(user_id as string), 2)")))
    return e.select("event_id", C.recording_number(name).alias("recording"))


@query(f"WITH {MK} SELECT recording, mk FROM mk WHERE recording IN ('7', '11', '42')")
def prj2_requested_recordings(spark, d):
    return labels.only_recordings(T.markers(spark, d), ["7", "11", "42"]).select("recording", "mk")


@query(f"WITH {CD} SELECT recording, row_id, code FROM cd WHERE code IN (110, 111, 210, 211)")
def prj3_keep_codes(spark, d):
    return labels.only_codes(T.codes(spark, d), KEEP)


@query(f"""WITH {CD}, x AS (SELECT *, code // 100 AS a, code // 10 % 10 AS b, code % 10 AS c FROM cd),
y AS (SELECT *, CASE WHEN a IN (1, 3) THEN 'token1' WHEN a IN (2, 4) THEN 'token2' ELSE 'NA' END AS standard_role,
  CASE WHEN a IN (1, 3) THEN 'token2' WHEN a IN (2, 4) THEN 'token1' ELSE 'NA' END AS deviant_role FROM x),
z AS (SELECT *, CASE WHEN c = 0 THEN standard_role ELSE deviant_role END AS trial_role FROM y)
SELECT recording, row_id, code, CAST(a AS INT) AS digit_a, CAST(b AS INT) AS digit_b, CAST(c AS INT) AS digit_c, b = 1 AS is_true, b = 0 AS is_buffer, c = 0 AS is_standard, c = 1 AS is_deviant,
  a IN (8, 9) AS is_practice, a NOT IN (8, 9) AS is_main, CASE WHEN a IN (3, 4, 8) THEN 'reduced' WHEN a IN (1, 2, 9) THEN 'full' ELSE 'other' END AS variant,
  standard_role, deviant_role, trial_role, CASE standard_role WHEN 'token1' THEN 'EH' WHEN 'token2' THEN 'IH' ELSE standard_role END AS standard_label,
  CASE deviant_role WHEN 'token1' THEN 'EH' WHEN 'token2' THEN 'IH' ELSE deviant_role END AS deviant_label,
  CASE trial_role WHEN 'token1' THEN 'EH' WHEN 'token2' THEN 'IH' ELSE trial_role END AS trial_label FROM z""")
def prj4_to_8_trial_labels(spark, d):
    return labels.with_trial_labels(T.codes(spark, d), {"token1": "EH", "token2": "IH"})


@query(f"""WITH {CD} SELECT recording, row_id, code, CAST(CASE WHEN code IN (110, 210) THEN 1 ELSE 2 END AS INT) AS condition_id,
CASE WHEN code IN (110, 210) THEN 'Standard' ELSE 'Deviant' END AS condition FROM cd WHERE code IN (110, 111, 210, 211)""")
def prj9_conditions(spark, d):
    return labels.conditions(T.codes(spark, d), CONTRAST)


@query(f"WITH {EP} SELECT DISTINCT recording, epoch_id, channel, CASE channel WHEN 'Fp1' THEN 'eog' ELSE 'eeg' END AS kind FROM sm WHERE channel IN ('Fp1', 'Fz', 'Cz')")
def prj10_pick_channels(spark, d):
    picked = labels.pick_channels(T.epochs(spark, d), wanted=["Fp1", "Fz", "Cz", "Pz"], aux=["F4"], eog=["Fp1"])
    return picked.select("recording", "epoch_id", "channel", "kind")


@query(f"WITH {EP} SELECT epoch_id, channel, CAST(rel AS INT) AS rel, {R('v * 1e6')} AS uv FROM sm WHERE rel BETWEEN -16 AND 24 AND rel % 2 = 0")
def prj11_to_13_crop_decimate(spark, d):
    long = epochs.decimate(epochs.samples(epochs.in_microvolts(epochs.crop(T.epochs(spark, d), -0.2, 0.3))), 2)
    return long.select("epoch_id", "channel", "rel", fixed("v").alias("uv"))


# 2.3 joins


@query(f"""WITH {CD}, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS recording FROM customer)
SELECT recording, CASE WHEN recording NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events) THEN 'SKIP_MISSING_VMRK'
  WHEN recording NOT IN (SELECT recording FROM cd) THEN 'SKIP_MISSING_SUBJECT_CSV' ELSE 'OK' END AS status FROM c""")
def join1_missing_files(spark, d):
    recordings = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("recording"))
    return markers.missing_files(recordings, T.codes(spark, d), T.markers(spark, d), "skip", "skip")


ALIGNED = f"""{MK}, {CD}, k AS (SELECT * FROM cd WHERE code IN (110, 111, 210, 211)),
nm AS (SELECT recording, count(*) AS m, count(DISTINCT pos) AS u FROM mk GROUP BY 1), nc AS (SELECT recording, count(*) AS n FROM k GROUP BY 1),
st AS (SELECT recording, coalesce(m, 0) AS markers_original, coalesce(n, 0) AS n_codes, coalesce(m, 0) >= coalesce(n, 0) AND coalesce(n, 0) > 0 AND coalesce(m = u, true) AS ok FROM nm FULL JOIN nc USING (recording)),
rk AS (SELECT gp.*, row_number() OVER (PARTITION BY recording ORDER BY greatest(coalesce(previous, 'inf'::DOUBLE), coalesce(next, 'inf'::DOUBLE)), pos, mk) AS rank FROM gp),
kept AS (SELECT rk.recording, pos, mk, row_number() OVER (PARTITION BY rk.recording ORDER BY pos, mk) AS seq FROM rk JOIN st USING (recording) WHERE ok AND rank <= n_codes)"""


def _aligned(spark, d):
    codes = labels.only_codes(T.codes(spark, d), KEEP)
    return codes, *markers.alignment(T.markers(spark, d), codes)


@query(f"""WITH {ALIGNED}, ks AS (SELECT recording, code, row_number() OVER (PARTITION BY recording ORDER BY row_id, code) AS seq FROM k)
SELECT recording, CAST(seq AS INT) AS seq, pos, code FROM kept JOIN ks USING (recording, seq)""")
def join2_events(spark, d):
    codes, kept, _ = _aligned(spark, d)
    return markers.events(kept, codes)


CUT = """ev0 AS (SELECT DISTINCT recording, block * 64 + 40 + block % 7 AS pos, block AS seq FROM sg)"""


def _cut_events(spark, d):
    b = T.blocks(spark, d)
    return b, b.select("recording", F.col("block").alias("seq"), (F.col("block") * T.BLOCK + 40 + F.col("block") % 7).alias("pos")).distinct()


@query(f"""WITH {BL}, {CUT}, x AS (SELECT e.recording, seq AS epoch_id, pos, channel, s - pos AS rel, v, count(*) OVER (PARTITION BY e.recording, seq, channel) AS n
FROM ev0 e JOIN sg g ON e.recording = g.recording AND g.s BETWEEN pos - 16 AND pos + 48)
SELECT recording, epoch_id, channel, CAST(rel AS INT) AS rel, {R('v * 1e6')} AS uv FROM x WHERE n = 65""")
def join3_cut_epochs(spark, d):
    cut = epochs.cut(*_cut_events(spark, d), -0.2, 0.6, T.BLOCK)
    return epochs.samples(cut).select("recording", "epoch_id", "channel", "rel", fixed(F.col("v") * 1e6).alias("uv"))


@query(f"WITH {DF} SELECT recording, channel, CAST(rel AS INT) AS rel, {R('value * 1e6')} AS uv, n_epochs FROM dv")
def join4_difference_wave(spark, d):
    w = averages.difference(averages.evoked(T.epochs(spark, d)))
    return w.select("recording", "channel", "rel", fixed(F.col("value") * 1e6).alias("uv"), "n_epochs")


BAD = "b AS (SELECT epoch_id FROM (SELECT epoch_id, max(v) OVER (PARTITION BY epoch_id, channel ORDER BY rel ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) - min(v) OVER (PARTITION BY epoch_id, channel ORDER BY rel ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS p, rel FROM sm WHERE channel = 'Fp1' AND rel BETWEEN -16 AND 24) WHERE rel <= 9 AND p * 1e6 >= 60 GROUP BY 1), m AS (SELECT DISTINCT epoch_id FROM sm WHERE rel BETWEEN -16 AND 24 AND abs(v) * 1e6 >= 40)"


def _masks(spark, d):
    e = T.epochs(spark, d)
    return e, artifacts.blinks(e, LIMITS), artifacts.voltage(e, LIMITS)


@query(f"WITH {EP}, {BAD} SELECT DISTINCT recording, epoch_id, channel FROM sm WHERE epoch_id NOT IN (SELECT epoch_id FROM b) AND epoch_id NOT IN (SELECT epoch_id FROM m)")
def join7_reject_epochs(spark, d):
    e, blink, muscle = _masks(spark, d)
    return epochs.reject(epochs.reject(e, blink), muscle).select("recording", "epoch_id", "channel")


@query(f"""WITH {BL}, {CUT}, x AS (SELECT e.recording, seq, pos, channel, count(*) AS n FROM ev0 e JOIN sg g ON e.recording = g.recording AND g.s BETWEEN pos - 16 AND pos + 48 GROUP BY ALL),
bad AS (SELECT recording, seq * 64 AS f, seq * 64 + 30 AS t FROM ev0 WHERE seq % 5 = 2)
SELECT recording, seq AS epoch_id, channel FROM x WHERE n = 65 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.recording = x.recording AND f <= pos + 48 AND t > pos - 16)""")
def join8_bad_spans(spark, d):
    blocks, events = _cut_events(spark, d)
    spans = events.where("seq % 5 = 2").select("recording", F.lit("Bad_segment").alias("desc"), (F.col("seq") * T.BLOCK).alias("pos"), F.lit(30).alias("size"))
    return epochs.drop_bad_spans(epochs.cut(blocks, events, -0.2, 0.6, T.BLOCK), spans).select("recording", "epoch_id", "channel")


# 2.4 aggregations


@query(f"""WITH {MK} SELECT recording, count(*) AS n, {R('min(previous)')} AS gap_min, {', '.join(f"{R(f'quantile_cont(previous, {p / 100})')} AS gap_p{p}" for p in markers.PERCENTILES)}, {R('max(previous)')} AS gap_max FROM gp GROUP BY 1""")
def agg1_gap_stats(spark, d):
    g = markers.gap_stats(T.markers(spark, d))
    return g.select("recording", "n", *[fixed(c).alias(c) for c in g.columns[2:]])


@query(f"""WITH {MK}, n AS (SELECT recording, count(*) AS n FROM mk GROUP BY 1)
SELECT recording, n, CAST(p AS INT) AS p, true AS within FROM n, (VALUES {', '.join(f'({p})' for p in markers.PERCENTILES)}) AS v(p)""")
def agg1_gap_sketch(spark, d):
    """Whether each quantile of the sketch is a gap whose rank is off by n / accuracy at most, counted over all gaps."""
    accuracy = 50
    m = T.markers(spark, d)
    q = markers.gap_stats(m, accuracy)
    asked = q.select("recording", "n", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"gap_p{p}").alias("value")) for p in markers.PERCENTILES])).alias("q")).select("recording", "n", "q.*")
    gaps = markers.with_gaps(m).select("recording", "previous").where("previous is not null")
    counted = asked.join(gaps, "recording", "left").groupBy("recording", "n", "p").agg(F.count("previous").alias("gaps"), F.count_if(F.col("previous") < F.col("value")).alias("below"), F.count_if(F.col("previous") <= F.col("value")).alias("upto"))
    rank, off = F.ceil(F.col("p") / 100 * F.col("gaps")), F.ceil(F.col("gaps") / accuracy)
    return counted.select("recording", "n", "p", ((F.col("gaps") == 0) | ((F.col("below") < rank + off) & (F.col("upto") >= rank - off))).alias("within"))


@query(f"WITH {MK} SELECT recording, gap_s, count(*) FILTER (previous <= gap_s AND next <= gap_s) AS kept FROM gp, (VALUES {', '.join(f'({g}::DOUBLE)' for g in GAPS)}) AS g(gap_s) GROUP BY ALL")
def agg2_candidate_gaps(spark, d):
    return markers.candidate_gaps(T.markers(spark, d), GAPS)


@query(f"WITH {CD} SELECT recording, code, count(*) AS n FROM cd GROUP BY ALL")
def agg3_value_counts(spark, d):
    return markers.value_counts(T.codes(spark, d), "code")


@query(f"""WITH {MK}, f AS (SELECT recording, d, min(ROW(pos, mk)) AS fst FROM mk GROUP BY ALL)
SELECT recording, count(*) AS n_descriptions, string_agg(d, ',' ORDER BY fst) AS descriptions FROM f GROUP BY 1""")
def agg4_first_descriptions(spark, d):
    return markers.first_descriptions(T.markers(spark, d)).withColumn("descriptions", F.concat_ws(",", "descriptions"))


@query(f"""WITH {BL}, m AS (SELECT recording, s, avg(v) AS m FROM sg WHERE channel <> 'Fp1' GROUP BY ALL)
SELECT recording, channel, s, {R('(CASE channel WHEN $$Fp1$$ THEN v ELSE v - m END) * 1e6')} AS uv FROM sg JOIN m USING (recording, s)""")
def agg5_average_reference(spark, d):
    b = signal.average_reference(T.blocks(spark, d))
    long = b.select("recording", "channel", "start", F.posexplode("values").alias("i", "v"))
    return long.select("recording", "channel", (F.col("start") + F.col("i")).alias("s"), fixed(F.col("v") * 1e6).alias("uv"))


@query(f"WITH {EP} SELECT epoch_id, channel, CAST(rel AS INT) AS rel, {R('(v - avg(v) FILTER (rel BETWEEN -16 AND 0) OVER (PARTITION BY epoch_id, channel)) * 1e6')} AS uv FROM sm")
def agg6_baseline(spark, d):
    long = epochs.samples(epochs.baseline(T.epochs(spark, d), -0.2, 0.0))
    return long.select("epoch_id", "channel", "rel", fixed(F.col("v") * 1e6).alias("uv"))


@query(f"WITH {EV} SELECT recording, condition, channel, CAST(rel AS INT) AS rel, {R('value * 1e6')} AS uv, n_epochs FROM ev")
def agg7_condition_average(spark, d):
    w = averages.evoked(T.epochs(spark, d))
    return w.select("recording", "condition", "channel", "rel", fixed(F.col("value") * 1e6).alias("uv"), "n_epochs")


@query(f"WITH {EV} SELECT condition, channel, CAST(rel AS INT) AS rel, {R('avg(value) * 1e6')} AS uv, count(*) AS n_recordings FROM ev GROUP BY ALL")
def agg8_grand_average(spark, d):
    g = averages.grand_average(averages.evoked(T.epochs(spark, d)))
    return g.select("condition", "channel", "rel", fixed(F.col("value") * 1e6).alias("uv"), "n_recordings")


@query(f"""WITH {DF}, w(window_name, lo, hi, tmin, tmax) AS (VALUES ('early', 4, 12, 0.05::DOUBLE, 0.15::DOUBLE), ('MMN_150_250', 12, 20, 0.15::DOUBLE, 0.25::DOUBLE)),
a AS (SELECT recording, condition, channel, rel, value, n_epochs FROM ev UNION ALL SELECT recording, condition, channel, rel, value, n_sum FROM dv)
SELECT recording AS subject, condition, channel, window_name AS "window", tmin, tmax, {R('avg(value) * 1e6')} AS "mean_uV", max(n_epochs) AS n_epochs, 'OK' AS status
FROM a JOIN w ON rel BETWEEN lo AND hi GROUP BY ALL""")
def agg9_window_amplitude(spark, d):
    m = averages.erp_metrics(T.epochs(spark, d), MORE)
    return m.withColumn("mean_uV", fixed("mean_uV"))


@query(f"WITH {EP}, {BAD} SELECT DISTINCT recording, epoch_id FROM sm JOIN m USING (epoch_id)")
def agg10_voltage(spark, d):
    return artifacts.voltage(T.epochs(spark, d), LIMITS)


@query(f"""WITH {BL}, r AS (SELECT a.recording, abs(corr(a.v, b.v)) AS r FROM sg a JOIN sg b ON a.recording = b.recording AND a.s = b.s WHERE a.channel = 'Fp1' AND b.channel <> 'Fp1' GROUP BY a.recording, b.channel)
SELECT recording, {R('max(r)')} AS eog_corr_max, {R('avg(r)')} AS eog_corr_mean FROM r GROUP BY 1""")
def agg11_eog_correlation(spark, d):
    c = artifacts.eog_correlation(T.blocks(spark, d))
    return c.select("recording", fixed("eog_corr_max").alias("eog_corr_max"), fixed("eog_corr_mean").alias("eog_corr_mean"))


COUNTS = f"""{EP}, {BAD}, e AS (SELECT DISTINCT recording, epoch_id, condition FROM sm),
f AS (SELECT *, epoch_id IN (SELECT epoch_id FROM b) AS bl, epoch_id IN (SELECT epoch_id FROM m) AS mu FROM e),
q AS (SELECT recording, count(*) AS n_epochs_before_artifact, count(*) FILTER (bl) AS n_blink_bad, count(*) FILTER (mu) AS n_muscle_bad, count(*) FILTER (bl OR mu) AS n_epochs_dropped,
  count(*) FILTER (NOT (bl OR mu)) AS n_epochs_final, count(*) FILTER (NOT (bl OR mu) AND condition = 'Standard') AS n_standard_final, count(*) FILTER (NOT (bl OR mu) AND condition = 'Deviant') AS n_deviant_final,
  {R('count(*) FILTER (bl OR mu) / count(*)')} AS epoch_reject_rate FROM f GROUP BY 1),
qs AS (SELECT *, CASE WHEN n_epochs_final = 0 THEN 'SKIP_EMPTY_EPOCHS' WHEN n_standard_final = 0 OR n_deviant_final = 0 THEN 'SKIP_EMPTY_CONDITION' ELSE 'OK' END AS status FROM q)"""


@query(f"WITH {COUNTS} SELECT * FROM qs")
def agg12_epoch_counts(spark, d):
    e, blink, muscle = _masks(spark, d)
    return qc.with_epoch_status(qc.epoch_counts(e, blink, muscle)).withColumn("epoch_reject_rate", fixed("epoch_reject_rate"))


PTP = """w AS (SELECT recording, channel, s, max(v) OVER x - min(v) OVER x AS p, count(*) OVER x AS n FROM sg WHERE channel = 'Fp1' WINDOW x AS (PARTITION BY recording, channel ORDER BY s ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
fl AS (SELECT recording, s AS i, p * 1e6 >= 60 AS flag FROM w WHERE n = 16),
cl AS (SELECT recording, count(*) FILTER (flag AND NOT coalesce(before, false)) AS clusters FROM (SELECT *, lag(flag) OVER (PARTITION BY recording ORDER BY i) AS before FROM fl) GROUP BY 1)"""


def _blink_flags(spark, d):
    b = T.blocks(spark, d)
    return b, artifacts.continuous_ptp(b.where("kind = 'eog'"), LIMITS)


@query(f"WITH {BL}, {PTP} SELECT recording, {R('clusters / ((SELECT max(s) FROM sg g WHERE g.recording = cl.recording) / 80.0 / 60)')} AS blinks_per_min FROM cl")
def agg13_blink_rate(spark, d):
    b, flags = _blink_flags(spark, d)
    return artifacts.blink_rate(flags, b).select("recording", fixed("blinks_per_min").alias("blinks_per_min"))


def _taps_sql() -> str:
    rows = []
    for f in GRID.freqs:
        w = tfr.morlet(f, f / GRID.cycles_divisor, T.SFREQ)
        rows += [f"({f}::DOUBLE, {k - len(w) // 2}, {z.real:.17g}::DOUBLE, {z.imag:.17g}::DOUBLE)" for k, z in enumerate(w)]
    return f"wl(f, k, re, im) AS (VALUES {', '.join(rows)})"


TF = f"""{_taps_sql()},
z AS (SELECT recording, condition, channel, epoch_id, f, rel + k AS rel, sum(v * re) AS re, sum(v * im) AS im FROM sm, wl WHERE rel + k BETWEEN -16 AND 47 GROUP BY ALL),
tf AS (SELECT recording, condition, channel, f AS frequency, rel, avg(re * re + im * im) AS power, sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2) AS itc, count(*) AS n_epochs FROM z GROUP BY ALL)"""


@query(f"WITH {EP}, {TF} SELECT recording, condition, channel, frequency, CAST(rel AS INT) AS rel, {R('power * 1e12')} AS power, {R('itc')} AS itc, n_epochs FROM tf")
def agg14_total_power_and_coherence(spark, d):
    t = tfr.sums(T.epochs(spark, d), GRID)
    return t.select("recording", "condition", "channel", "frequency", "rel", fixed(F.col("power") * 1e12).alias("power"), fixed("itc").alias("itc"), "n_epochs")


def _tapers_sql() -> str:
    rows = []
    for f in GRID.freqs:
        for t, w in enumerate(tfr.tapers(f, f / GRID.cycles_divisor, T.SFREQ)):
            rows += [f"({f}::DOUBLE, {t}, {k - (len(w) - 1) // 2}, {z.real:.17g}::DOUBLE, {z.imag:.17g}::DOUBLE)" for k, z in enumerate(w)]
    return f"wl(f, t, k, re, im) AS (VALUES {', '.join(rows)})"


@query(f"""WITH {EP}, {_tapers_sql()},
z AS (SELECT recording, condition, channel, epoch_id, f, t, rel + k AS rel, sum(v * re) AS re, sum(v * im) AS im FROM sm, wl WHERE rel + k BETWEEN -16 AND 47 GROUP BY ALL),
tt AS (SELECT recording, condition, channel, f AS frequency, t, rel, avg(re * re + im * im) AS power, sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2) AS itc, count(*) AS n_epochs FROM z GROUP BY ALL)
SELECT recording, condition, channel, frequency, CAST(rel AS INT) AS rel, {R('avg(power) * 1e12')} AS power, {R('avg(itc)')} AS itc, max(n_epochs) AS n_epochs FROM tt WHERE (rel + 16) % 2 = 0 GROUP BY ALL""")
def agg14_multitaper(spark, d):
    t = tfr.sums(T.epochs(spark, d), Tfr(fmin=GRID.fmin, fmax=GRID.fmax, fstep=GRID.fstep, decim=2), "multitaper")
    return t.select("recording", "condition", "channel", "frequency", "rel", fixed(F.col("power") * 1e12).alias("power"), fixed("itc").alias("itc"), "n_epochs")


EPW = """ze AS (SELECT recording, condition, channel, f AS frequency, rel + k AS rel, sum(value * re) AS re, sum(value * im) AS im FROM ev, wl WHERE rel + k BETWEEN -16 AND 47 GROUP BY ALL)"""


@query(f"WITH {EV}, {_taps_sql()}, {EPW} SELECT recording, condition, channel, frequency, CAST(rel AS INT) AS rel, {R('(re * re + im * im) * 1e12')} AS power FROM ze")
def agg15_evoked_power(spark, d):
    t = tfr.evoked_power(averages.evoked(T.epochs(spark, d)), GRID)
    return t.select("recording", "condition", "channel", "frequency", "rel", fixed(F.col("evoked") * 1e12).alias("power"))


# 2.5 windows


@query(f"WITH {MK} SELECT recording, mk FROM gp WHERE previous <= {HOURS12} AND next <= {HOURS12}")
def win1_gap_filter(spark, d):
    return markers.keep_by_gap(T.markers(spark, d), HOURS12).select("recording", "mk")


@query(f"WITH {MK} SELECT recording, mk FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY greatest(coalesce(previous, 'inf'::DOUBLE), coalesce(next, 'inf'::DOUBLE)), pos, mk) AS rank FROM gp) WHERE rank <= 40")
def win2_trim_to_count(spark, d):
    m = T.markers(spark, d).withColumn("have", F.count("*").over(W.partitionBy("recording")))
    return markers.densest(m, F.least(F.lit(40), F.col("have"))).select("recording", "mk")


@query(f"WITH {ALIGNED} SELECT recording, markers_original, CAST(0 AS BIGINT) AS markers_dropped_by_gap, CASE WHEN ok THEN markers_original - n_codes ELSE 0 END AS markers_dropped_by_auto, n_codes, CASE WHEN ok THEN 'OK' ELSE 'SKIP_ALIGNMENT_FAILED' END AS status FROM st")
def win3_alignment(spark, d):
    return _aligned(spark, d)[2]


@query(f"""WITH {ALIGNED}, f AS (SELECT recording, count(*) FILTER (previous <= {HOURS12} AND next <= {HOURS12}) AS f FROM gp GROUP BY 1),
x AS (SELECT recording, coalesce(m, 0) AS m, coalesce(f, 0) AS f, coalesce(n, 0) AS n, coalesce(f, 0) >= coalesce(n, 0) AND coalesce(n, 0) > 0 AND coalesce(m = u, true) AS ok FROM nm LEFT JOIN f USING (recording) FULL JOIN nc USING (recording))
SELECT recording, m AS markers_original, m - f AS markers_dropped_by_gap, CASE WHEN ok THEN f - n ELSE 0 END AS markers_dropped_by_auto, n AS n_codes, CASE WHEN ok THEN 'OK' ELSE 'SKIP_ALIGNMENT_FAILED' END AS status FROM x""")
def win3_alignment_after_gaps(spark, d):
    return markers.alignment(T.markers(spark, d), labels.only_codes(T.codes(spark, d), KEEP), HOURS12)[1]


@query(f"WITH {EP}, {BAD} SELECT DISTINCT recording, epoch_id FROM sm JOIN b USING (epoch_id)")
def win4_moving_ptp(spark, d):
    return artifacts.blinks(T.epochs(spark, d), LIMITS)


@query(f"WITH {BL}, {PTP} SELECT recording, clusters FROM cl")
def win5_clusters(spark, d):
    return artifacts.clusters(_blink_flags(spark, d)[1], ["recording"], "i")


@query(f"""WITH {BL}, h(k, c) AS (VALUES {', '.join(f'({k - len(TAPS) // 2}, {c:.17g}::DOUBLE)' for k, c in enumerate(TAPS))}),
n AS (SELECT recording, channel, max(s) AS last FROM sg GROUP BY ALL),
x AS (SELECT recording, channel, s, v FROM sg
  UNION ALL SELECT a.recording, a.channel, -a.s, 2 * b.v - a.v FROM sg a JOIN sg b ON a.recording = b.recording AND a.channel = b.channel AND b.s = 0 WHERE a.s BETWEEN 1 AND {len(TAPS) // 2}
  UNION ALL SELECT a.recording, a.channel, 2 * last - a.s, 2 * b.v - a.v FROM sg a JOIN n USING (recording, channel) JOIN sg b ON a.recording = b.recording AND a.channel = b.channel AND b.s = last WHERE a.s BETWEEN last - {len(TAPS) // 2} AND last - 1)
SELECT x.recording, x.channel, s + k AS s, {R('sum(v * c) * 1e6')} AS uv FROM x CROSS JOIN h JOIN n ON x.recording = n.recording AND x.channel = n.channel WHERE s + k BETWEEN 0 AND last GROUP BY ALL""")
def win6_zero_phase_filter(spark, d):
    b = signal.fir(T.blocks(spark, d), TAPS)
    long = b.select("recording", "channel", "start", F.posexplode("values").alias("i", "v"))
    return long.select("recording", "channel", (F.col("start") + F.col("i")).alias("s"), fixed(F.col("v") * 1e6).alias("uv"))


RANKED = f"""{BL}, r AS (SELECT b.recording, CASE b.channel WHEN 'Fz' THEN 0 WHEN 'F3' THEN 1 WHEN 'Cz' THEN 2 ELSE 3 END AS component, corr(a.v, b.v) AS r FROM sg a JOIN sg b ON a.recording = b.recording AND a.s = b.s
  WHERE a.channel = 'Fp1' AND b.channel <> 'Fp1' GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY abs(r) DESC, component) AS rank FROM r)"""


def _channel_scores(spark, d):
    b = T.blocks(spark, d)
    order = F.when(F.col("b") == "Fz", 0).when(F.col("b") == "F3", 1).when(F.col("b") == "Cz", 2).otherwise(3)
    return artifacts.pair_correlations(b.where("kind = 'eog'"), b.where("kind = 'eeg'")).select("recording", order.alias("component"), "r")


def text(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""WITH {RANKED} SELECT recording, coalesce(string_agg(CAST(component AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 3 AND abs(r) >= 0.01), '') AS exclude,
string_agg(CAST(component AS VARCHAR), ',' ORDER BY rank) AS ranked FROM rk GROUP BY 1""")
def win7_rank_components(spark, d):
    r = _channel_scores(spark, d)
    few, many = ica.rank(r, Ica(threshold=0.01)), ica.rank(r, Ica(threshold=0.0, most=10))
    return few.select("recording", text("exclude").alias("exclude")).join(many.select("recording", text("exclude").alias("ranked")), "recording")


# 2.6 sorts and sets


@query(f"""WITH {MK}, c AS (SELECT recording, d, count(*) AS n FROM mk GROUP BY ALL)
SELECT recording, d AS "desc", n, CAST(row_number() OVER (PARTITION BY recording ORDER BY n DESC, d) AS INT) AS rank FROM c QUALIFY rank <= 10""")
def sort1_top_descriptions(spark, d):
    return markers.top_descriptions(T.markers(spark, d))


@query(f"""WITH {CD} SELECT recording, row_id, code FROM cd QUALIFY row_number() OVER (PARTITION BY recording ORDER BY row_id, code) <= 5""")
def sort2_preview(spark, d):
    return jobs.preview(T.codes(spark, d), "row_id", "code")


@query(f"""WITH {EP}, c(condition) AS (VALUES ('Standard'), ('Deviant'), ('Novel')),
g AS (SELECT recording, condition, count(*) AS n_samples FROM sm GROUP BY ALL)
SELECT r.recording, c.condition, n_samples, CASE WHEN n_samples IS NULL THEN 'MISSING_OR_EMPTY' ELSE 'OK' END AS status FROM (SELECT DISTINCT recording FROM sm) r CROSS JOIN c LEFT JOIN g ON g.recording = r.recording AND g.condition = c.condition""")
def set2_status_rows(spark, d):
    e = T.epochs(spark, d)
    some = epochs.samples(e).groupBy("recording", "condition").agg(F.count("*").alias("n_samples"))
    return averages.with_status_rows(some, e, ["Standard", "Deviant", "Novel"], "MISSING_OR_EMPTY")


@query(f"""WITH {COUNTS}, {ALIGNED}, c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS recording FROM customer),
fl AS (SELECT recording, CASE WHEN recording NOT IN (SELECT recording FROM nm) THEN 'SKIP_MISSING_VMRK' WHEN recording NOT IN (SELECT recording FROM cd) THEN 'SKIP_MISSING_SUBJECT_CSV' ELSE 'OK' END AS files FROM c),
s AS (SELECT recording, markers_original, CASE WHEN files <> 'OK' THEN files WHEN ok THEN 'OK' ELSE 'SKIP_ALIGNMENT_FAILED' END AS status FROM fl FULL JOIN st USING (recording))
SELECT recording, n_epochs_final, NULL AS markers_original, status, CASE status WHEN 'OK' THEN '' WHEN 'SKIP_EMPTY_EPOCHS' THEN 'every epoch was rejected' ELSE 'a condition has no epoch left' END AS error FROM qs
UNION ALL SELECT recording, NULL, markers_original, status, CASE status WHEN 'SKIP_MISSING_VMRK' THEN 'no marker file' WHEN 'SKIP_MISSING_SUBJECT_CSV' THEN 'no file of behavioural codes' ELSE 'markers can''t be aligned with codes' END FROM s WHERE status <> 'OK'""")
def set3_stacked_status(spark, d):
    e, blink, muscle = _masks(spark, d)
    done = qc.with_epoch_status(qc.epoch_counts(e, blink, muscle)).select("recording", "n_epochs_final", "status")
    recordings = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("recording"))
    files = markers.missing_files(recordings, T.codes(spark, d), T.markers(spark, d), "skip", "skip")
    rows = qc.stacked(done, qc.skipped(files, _aligned(spark, d)[2]).select("recording", "markers_original", "status"))
    return rows.withColumn("error", qc.error(F.col("status")))


# 2.7 decisions


BASE = "avg(power) FILTER (rel BETWEEN -8 AND 0) OVER (PARTITION BY recording, condition, channel, frequency)"


@query(f"WITH {EP}, {TF} SELECT recording, condition, channel, frequency, CAST(rel AS INT) AS rel, {R(f'power / {BASE}')} AS ratio FROM tf")
def scl2_tf_baseline(spark, d):
    t = tfr.rescaled(tfr.sums(T.epochs(spark, d), GRID), ["power"], (-0.1, 0.0), "ratio")
    return t.select("recording", "condition", "channel", "frequency", "rel", fixed("power").alias("ratio"))


@query(f"""WITH {COUNTS}, r AS (SELECT recording, epoch_reject_rate, concat_ws('+', CASE WHEN n_blink_bad > 1 THEN 'blink_rate>1/min' END, CASE WHEN n_muscle_bad > 1 THEN 'blink_proxy>1/min' END,
  CASE WHEN epoch_reject_rate > 0.2 THEN 'epoch_loss>0.20' END, CASE WHEN n_blink_bad > 1 THEN 'blink_rate>1/min' END) AS reasons FROM q)
SELECT recording, reasons <> '' AS recommended, reasons FROM r""")
def scl3_recommendation(spark, d):
    e, blink, muscle = _masks(spark, d)
    c = qc.epoch_counts(e, blink, muscle)
    yes, why = ica.recommendation(F.col("epoch_reject_rate"), F.lit(None).cast("double"), F.col("n_blink_bad"), F.col("n_muscle_bad"), per_min=1)
    return c.select("recording", yes.alias("recommended"), why.alias("reasons"))


@query(f"WITH {COUNTS} SELECT recording, coalesce(nullif(n_blink_bad, 0), n_muscle_bad) >= 2 AS fit FROM q")
def scl4_gate(spark, d):
    e, blink, muscle = _masks(spark, d)
    c = qc.epoch_counts(e, blink, muscle)
    return c.select("recording", ica.gate("auto", F.col("n_blink_bad").cast("double"), F.col("n_muscle_bad").cast("double"), 2.0).alias("fit"))


@query(f"""WITH {EP}, r AS (SELECT DISTINCT recording FROM sm), b AS (SELECT DISTINCT CAST(vec_id // 250 AS VARCHAR) AS recording FROM embeddings)
SELECT recording, 'proxy:Fp1' AS source FROM r UNION ALL SELECT 'eog-' || recording, 'eog' FROM b UNION ALL SELECT 'none-' || recording, 'none' FROM r""")
def scl5_blink_channels(spark, d):
    keys = ("recording", "channel", "kind")
    e, b = T.epochs(spark, d).select(*keys), T.blocks(spark, d).select(*keys)
    named = lambda df, prefix: df.withColumn("recording", F.concat(F.lit(prefix), "recording"))
    return artifacts.blink_channels(e.union(named(b, "eog-")).union(named(e.where("channel <> 'Fp1'"), "none-"))).select("recording", "source")


# 2.8 components; the fit has no SQL form, so what follows it is also shown on a model given by a rule


@query(f"""WITH {RANKED}, o AS (SELECT *, abs(r - avg(r) OVER w) > stddev_pop(r) OVER w AS far FROM r WINDOW w AS (PARTITION BY recording)),
n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY abs(r) DESC, component) AS rank FROM o WHERE far)
SELECT recording, string_agg(CAST(component AS VARCHAR), ',' ORDER BY rank) AS exclude, {R('max(r) FILTER (rank = 1)')} AS top_score FROM n WHERE rank <= 3 GROUP BY 1""")
def ica3_eog_outliers(spark, d):
    found = ica.eog_outliers(_channel_scores(spark, d), z=1.0, rounds=1)
    return found.select("recording", text("exclude").alias("exclude"), fixed(F.get("top_scores", F.lit(0))).alias("top_score"))


def _weights(k: int, c: int) -> tuple[float, float]:
    """Unmixing and mixing weight of component k and channel c of the model given by a rule."""
    return math.cos(k * (c + 1)), math.sin(k + c + 1) / 10


EEG = [c for c in T.CHANNELS if c != "Fp1"]
MODEL = [(k, c, *_weights(k, i)) for k in range(12) for i, c in enumerate(EEG)]


def _model(spark, d):
    rows = spark.createDataFrame(MODEL, "component int, channel string, unmix double, mix double")
    return T.blocks(spark, d).select("recording").distinct().join(F.broadcast(rows))  # 48 rows


COMPONENTS = f"""{BL}, md(component, channel, unmix, mix) AS (VALUES {', '.join(f"({k}, '{c}', {u:.17g}::DOUBLE, {m:.17g}::DOUBLE)" for k, c, u, m in MODEL)}),
src AS (SELECT recording, component, s, sum(unmix * v) AS y FROM sg JOIN md USING (channel) GROUP BY ALL),
sc AS (SELECT a.recording, component, corr(y, v) AS r FROM src a JOIN sg b ON a.recording = b.recording AND a.s = b.s WHERE b.channel = 'Fp1' GROUP BY ALL),
o1 AS (SELECT *, abs(r - avg(r) OVER w) > 1.5 * stddev_pop(r) OVER w AS far FROM sc WINDOW w AS (PARTITION BY recording)),
o2 AS (SELECT *, far OR coalesce(abs(r - avg(r) FILTER (NOT far) OVER w) > 1.5 * stddev_pop(r) FILTER (NOT far) OVER w, false) AS bad FROM o1 WINDOW w AS (PARTITION BY recording)),
ol AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY abs(r) DESC, component) AS rank FROM o2 WHERE bad)"""


def _component_outliers(spark, d, model):
    b = T.blocks(spark, d)
    return ica.eog_outliers(ica.eog_scores(b, model, ["Fp1"]), z=1.5)


@query(f"WITH {COMPONENTS} SELECT recording, CAST(component AS INT) AS component, s, {R('y * 1e6')} AS uv FROM src")
def ica2_sources(spark, d):
    parts = ica.sources(T.blocks(spark, d).where("kind = 'eeg'"), _model(spark, d))
    long = parts.select("recording", "component", "start", F.posexplode("values").alias("i", "v"))
    return long.select("recording", "component", (F.col("start") + F.col("i")).alias("s"), fixed(F.col("v") * 1e6).alias("uv"))


@query(f"""WITH {COMPONENTS} SELECT recording, string_agg(CAST(component AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 3) AS exclude,
string_agg(CAST(component AS VARCHAR), ',' ORDER BY rank) AS candidates, {R('max(r) FILTER (rank = 1)')} AS top_score FROM ol GROUP BY 1""")
def ica3_component_outliers(spark, d):
    found = _component_outliers(spark, d, _model(spark, d))
    return found.select("recording", text("exclude").alias("exclude"), text("candidates").alias("candidates"), fixed(F.get("top_scores", F.lit(0))).alias("top_score"))


@query(f"""WITH {COMPONENTS}, g AS (SELECT src.recording, channel, s, sum(mix * y) AS gone FROM src JOIN ol USING (recording, component) JOIN md USING (component) WHERE rank <= 3 GROUP BY ALL)
SELECT recording, channel, s, {R('(v - coalesce(gone, 0)) * 1e6')} AS uv FROM sg LEFT JOIN g USING (recording, channel, s)""")
def ica4_removed(spark, d):
    model = _model(spark, d)
    clean = ica.remove(T.blocks(spark, d), model, _component_outliers(spark, d, model))
    long = clean.select("recording", "channel", "start", F.posexplode("values").alias("i", "v"))
    return long.select("recording", "channel", (F.col("start") + F.col("i")).alias("s"), fixed(F.col("v") * 1e6).alias("uv"))


def _filtered_for_fit(spark, d):
    """The blocks with what the fit takes and what the EOG scores take, from one pass."""
    p = Ica()
    both = signal.filtered(T.blocks(spark, d), {"fit": [signal.band_pass_taps(p.high_pass, p.low_pass, T.SFREQ)], "eye": [signal.band_pass_taps(*p.eog_band, T.SFREQ)]})
    return [both.withColumn("values", F.col(c)).drop("fit", "eye") for c in ("fit", "eye")]


@query()
def ica1_fit(spark, d):
    return ica.fit(_filtered_for_fit(spark, d)[0])


@query()
def ica2_to_4_clean(spark, d):
    """Fit on the high-passed signal, EOG branch on the band-passed one, removal from the signal itself."""
    fit, eye = _filtered_for_fit(spark, d)
    model = ica.fit(fit)
    clean = ica.remove(T.blocks(spark, d), model, ica.eog_outliers(ica.eog_scores(eye, model, ["Fp1"]), z=1.0))
    long = clean.select("recording", "channel", "start", F.posexplode("values").alias("i", "v"))
    return long.select("recording", "channel", (F.col("start") + F.col("i")).alias("s"), fixed(F.col("v") * 1e6).alias("uv"))


# 2.9 composite tables


@query(f"""WITH {EP}, c AS (SELECT * FROM sm WHERE rel BETWEEN -16 AND 32), bs AS (SELECT *, v - avg(v) FILTER (rel BETWEEN -16 AND 0) OVER (PARTITION BY epoch_id, channel) AS u FROM c),
ev AS (SELECT recording, condition, channel, rel, avg(u) AS value, count(*) AS n_epochs FROM bs GROUP BY ALL),
a AS (SELECT * FROM ev UNION ALL SELECT x.recording, 'MMN_DEV_MINUS_STD', x.channel, x.rel, x.value - y.value, least(x.n_epochs, y.n_epochs) FROM ev x JOIN ev y USING (recording, channel, rel) WHERE x.condition = 'Deviant' AND y.condition = 'Standard')
SELECT recording AS subject, condition, n_epochs, channel, rel / 80.0::DOUBLE AS time_s, {R('value * 1e6')} AS amplitude_uv, 'OK' AS status FROM a WHERE rel % 2 = 0""")
def out1_erp_timeseries(spark, d):
    return averages.erp_timeseries(T.epochs(spark, d), -0.2, 0.4, factor=2).withColumn("amplitude_uv", fixed("amplitude_uv"))


@query(f"""WITH {EP}, ct AS (SELECT *, CASE WHEN epoch_id % 3 = 0 THEN 'Novel' ELSE condition END AS c FROM sm WHERE CAST(recording AS INT) % 4 <> 1 OR condition <> 'Standard'),
c AS (SELECT * FROM ct WHERE rel BETWEEN -16 AND 32 AND c IN ('Standard', 'Novel')), bs AS (SELECT *, v - avg(v) FILTER (rel BETWEEN -16 AND 0) OVER (PARTITION BY epoch_id, channel) AS u FROM c),
ev AS (SELECT recording, c AS condition, channel, rel, avg(u) AS value, count(*) AS n_epochs FROM bs GROUP BY ALL),
rec AS (SELECT DISTINCT CAST(c_custkey % 12 AS VARCHAR) AS recording FROM customer),
st AS (SELECT recording, CASE WHEN recording NOT IN (SELECT recording FROM ct) THEN 'EMPTY_EPOCHS' ELSE 'NO_CONDITIONS' END AS status FROM rec WHERE recording NOT IN (SELECT recording FROM ev))
SELECT recording AS subject, condition, n_epochs, channel, rel / 80.0::DOUBLE AS time_s, {R('value * 1e6')} AS amplitude_uv, 'OK' AS status FROM ev WHERE rel % 8 = 0
UNION ALL SELECT recording, NULL, NULL, NULL, NULL, NULL, status FROM st""")
def out1_with_status_rows(spark, d):
    """Two of three conditions asked for; some recordings have neither, others no epochs."""
    e = T.epochs(spark, d).where("cast(recording as int) % 4 <> 1 or condition <> 'Standard'")
    e = e.withColumn("condition", F.when(F.col("epoch_id") % 3 == 0, "Novel").otherwise(F.col("condition")))
    recordings = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 12).cast("string").alias("recording"))
    t = averages.erp_timeseries(e, -0.2, 0.4, factor=8, conditions=("Standard", "Novel"), recordings=recordings)
    return t.withColumn("amplitude_uv", fixed("amplitude_uv"))


@query(f"""WITH {EP}, sm2 AS (SELECT * FROM sm), {_taps_sql()}, b0 AS (SELECT recording, epoch_id, condition, channel, rel, v - avg(v) FILTER (rel BETWEEN -16 AND 0) OVER (PARTITION BY epoch_id, channel) AS v FROM sm2),
z AS (SELECT recording, condition, channel, epoch_id, f, rel + k AS rel, sum(v * re) AS re, sum(v * im) AS im FROM b0, wl WHERE rel + k BETWEEN -16 AND 47 GROUP BY ALL),
tf AS (SELECT recording, condition, channel, f AS frequency, rel, avg(re * re + im * im) AS p, sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2) AS itc, avg(re) ** 2 + avg(im) ** 2 AS ep, count(*) AS n_epochs FROM z GROUP BY ALL),
bl AS (SELECT *, avg(p) FILTER (rel BETWEEN -8 AND 0) OVER w AS mp, avg(ep) FILTER (rel BETWEEN -8 AND 0) OVER w AS me, avg(itc) FILTER (rel BETWEEN -8 AND 0) OVER w AS mi FROM tf WINDOW w AS (PARTITION BY recording, condition, channel, frequency))
SELECT recording AS subject, condition, channel, frequency, rel / 80.0::DOUBLE AS time, {R('log10(p / mp)')} AS total_power, {R('log10(ep / me)')} AS evoked_power, {R('log10(p / mp) - log10(ep / me)')} AS induced_power, {R('log10(itc / mi)')} AS itc, n_epochs, 'OK' AS status FROM bl""")
def out2_tfr_metrics(spark, d):
    t = tfr.tfr_metrics(T.epochs(spark, d), GRID)
    return t.withColumns({c: fixed(c) for c in ("total_power", "evoked_power", "induced_power", "itc")})


@query(f"WITH {COUNTS} SELECT recording AS subject, * EXCLUDE (recording), 'proxy:Fp1' AS blink_source, epoch_reject_rate > 0.2 AS ica_recommended, CASE WHEN epoch_reject_rate > 0.2 THEN 'epoch_loss>0.20' ELSE '' END AS ica_recommend_reason FROM qs")
def out3_qc_summary(spark, d):
    return jobs.qc_summary(T.epochs(spark, d), LIMITS).withColumn("epoch_reject_rate", fixed("epoch_reject_rate"))


def _session(spark, d):
    """Signal, one marker per block, BAD spans and codes of the recordings that the blocks make."""
    b = T.blocks(spark, d)
    at = b.select("recording", "block").distinct()
    stimuli = at.select("recording", F.col("block").alias("mk"), F.lit("S  1").alias("desc"), (F.col("block") * T.BLOCK + 40 + F.col("block") % 7).alias("pos"), F.lit(1).cast("long").alias("size"), F.lit(T.SFREQ).alias("sfreq"))
    spans = at.where("block % 10 = 2").select("recording", (F.col("block") + 1000).alias("mk"), F.lit("BAD_move").alias("desc"), (F.col("block") * T.BLOCK).alias("pos"), F.lit(30).cast("long").alias("size"), F.lit(T.SFREQ).alias("sfreq"))
    with work_table(T.orders(spark, d).join(written(at.select("recording").distinct()), "recording", "left_semi")) as path:  # so that its size is known where it meets the lines
        codes = written(T.codes(spark, d, spark.read.parquet(path)))
    return b, stimuli.unionAll(spans), codes


SESSION = f"""{BL}, {PTP}, {CD},
am AS (SELECT recording, s, avg(v) AS m FROM sg WHERE channel <> 'Fp1' GROUP BY ALL),
ar AS (SELECT recording, channel, s, CASE channel WHEN 'Fp1' THEN v ELSE v - m END AS v FROM sg JOIN am USING (recording, s)),
cr AS (SELECT a.recording, abs(corr(a.v, b.v)) AS r FROM ar a JOIN ar b ON a.recording = b.recording AND a.s = b.s WHERE a.channel = 'Fp1' AND b.channel <> 'Fp1' GROUP BY a.recording, b.channel),
ce AS (SELECT recording, max(r) AS eog_corr_max, avg(r) AS eog_corr_mean FROM cr GROUP BY 1),
br AS (SELECT recording, clusters / ((SELECT max(s) FROM sg g WHERE g.recording = cl.recording) / 80.0 / 60) AS rate FROM cl),
mk AS (SELECT DISTINCT recording, block AS mk, block * 64 + 40 + block % 7 AS pos FROM sg),
gp AS (SELECT *, pos / 80.0::DOUBLE - lag(pos / 80.0::DOUBLE) OVER o AS previous, lead(pos / 80.0::DOUBLE) OVER o - pos / 80.0::DOUBLE AS next FROM mk WINDOW o AS (PARTITION BY recording ORDER BY pos, mk)),
own AS (SELECT * FROM cd WHERE recording IN (SELECT recording FROM sg)), k AS (SELECT * FROM own WHERE code IN (110, 111, 210, 211)),
st AS (SELECT recording, m, coalesce(n, 0) AS n, coalesce(total, 0) AS total, m >= coalesce(n, 0) AND coalesce(n, 0) > 0 AS ok FROM (SELECT recording, count(*) AS m FROM mk GROUP BY 1)
  LEFT JOIN (SELECT recording, count(*) AS n FROM k GROUP BY 1) USING (recording) LEFT JOIN (SELECT recording, count(*) AS total FROM own GROUP BY 1) USING (recording)),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY greatest(coalesce(previous, 'inf'::DOUBLE), coalesce(next, 'inf'::DOUBLE)), pos, mk) AS rank FROM gp),
kept AS (SELECT recording, pos, row_number() OVER (PARTITION BY recording ORDER BY pos, mk) AS seq FROM rk JOIN st USING (recording) WHERE ok AND rank <= n),
ks AS (SELECT recording, code, row_number() OVER (PARTITION BY recording ORDER BY row_id, code) AS seq FROM k),
ev AS (SELECT recording, seq, pos, CASE WHEN code IN (110, 210) THEN 'Standard' ELSE 'Deviant' END AS condition FROM kept JOIN ks USING (recording, seq)),
bad AS (SELECT recording, mk * 64 AS f, mk * 64 + 30 AS t FROM mk WHERE mk % 10 = 2),
fe AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.recording = ev.recording AND f <= pos + 48 AND t > pos - 16)),
ct AS (SELECT e.recording, seq, condition, channel, s - pos AS rel, v, count(*) OVER (PARTITION BY e.recording, seq, channel) AS n FROM fe e JOIN ar g ON e.recording = g.recording AND g.s BETWEEN pos - 16 AND pos + 48),
bs AS (SELECT recording, seq, condition, channel, rel, v - avg(v) FILTER (rel BETWEEN -16 AND 0) OVER (PARTITION BY recording, seq, channel) AS u FROM ct WHERE n = 65),
bk AS (SELECT DISTINCT recording, seq, true AS blink FROM (SELECT recording, seq, rel, max(u) OVER x - min(u) OVER x AS p FROM bs WHERE channel = 'Fp1' AND rel BETWEEN -16 AND 24
  WINDOW x AS (PARTITION BY recording, seq ORDER BY rel ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) WHERE rel <= 9 AND p * 1e6 >= 60),
vo AS (SELECT DISTINCT recording, seq, true AS muscle FROM bs WHERE channel <> 'Fp1' AND rel BETWEEN -16 AND 24 AND abs(u) * 1e6 >= 40),
ef AS (SELECT recording, seq, condition, coalesce(blink, false) AS bl, coalesce(muscle, false) AS mu FROM (SELECT DISTINCT recording, seq, condition FROM bs) LEFT JOIN bk USING (recording, seq) LEFT JOIN vo USING (recording, seq)),
q AS (SELECT recording, count(*) AS n_epochs_before_artifact, count(*) FILTER (bl) AS n_blink_bad, count(*) FILTER (mu) AS n_muscle_bad, count(*) FILTER (bl OR mu) AS n_epochs_dropped,
  count(*) FILTER (NOT (bl OR mu)) AS n_epochs_final, count(*) FILTER (NOT (bl OR mu) AND condition = 'Standard') AS n_standard_final, count(*) FILTER (NOT (bl OR mu) AND condition = 'Deviant') AS n_deviant_final,
  count(*) FILTER (bl OR mu) / count(*) AS loss FROM ef GROUP BY 1),
uc AS (SELECT recording, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY code) AS unknown FROM (SELECT DISTINCT recording, code FROM own WHERE code NOT IN (110, 111, 210, 211)) GROUP BY 1),
mc AS (SELECT recording, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY code) AS missing FROM (SELECT DISTINCT recording, w.code FROM own, (VALUES (110), (111), (210), (211)) AS w(code)) x
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.recording = x.recording AND own.code = x.code) GROUP BY 1),
fin AS (SELECT *, CASE WHEN n_epochs_final = 0 THEN 'SKIP_EMPTY_EPOCHS' WHEN n_standard_final = 0 OR n_deviant_final = 0 THEN 'SKIP_EMPTY_CONDITION' ELSE 'OK' END AS status,
  concat_ws('+', CASE WHEN rate > 20 THEN 'blink_rate>20/min' END, CASE WHEN loss > 0.2 THEN 'epoch_loss>0.20' END, CASE WHEN eog_corr_max > 0.3 THEN 'eog_corr>0.30' END, CASE WHEN rate > 20 THEN 'blink_rate>20/min' END) AS why
  FROM q JOIN st USING (recording) JOIN ce USING (recording) JOIN br USING (recording) LEFT JOIN uc USING (recording) LEFT JOIN mc USING (recording))"""
QC_FACTS = ("n_epochs_before_artifact", "n_blink_bad", "n_muscle_bad", "n_epochs_dropped", "n_epochs_final", "n_standard_final", "n_deviant_final")


@query(f"""WITH {SESSION}
SELECT recording AS subject, {', '.join(QC_FACTS)}, {R('loss')} AS epoch_reject_rate, status, 'eog' AS blink_source, {R('rate')} AS blinks_per_min, {R('eog_corr_max')} AS eog_corr_max, {R('eog_corr_mean')} AS eog_corr_mean,
  why <> '' AS ica_recommended, why AS ica_recommend_reason, m AS markers_original, 0::BIGINT AS markers_dropped_by_gap, m - n AS markers_dropped_by_auto, total AS behavioral_codes_total, n AS behavioral_codes_used,
  n AS n_events_used, n AS n_events_kept_stddev, {R('rate')} AS blink_rate_per_min, 0.0::DOUBLE AS blink_proxy_rate_per_min, false AS ica_applied, '' AS ica_exclude, coalesce(unknown, '') AS unknown_codes, coalesce(missing, '') AS missing_codes,
  80.0::DOUBLE AS sfreq, '110 111 210 211' AS behavioral_keep_codes, 'off' AS ica_mode, 'EH' AS token1, 'IH' AS token2, recording || '.vhdr' AS raw_file, 'subject-' || recording || '.csv' AS subject_csv,
  CASE status WHEN 'OK' THEN '' WHEN 'SKIP_EMPTY_EPOCHS' THEN 'every epoch was rejected' ELSE 'a condition has no epoch left' END AS error FROM fin
UNION ALL BY NAME SELECT recording AS subject, m AS markers_original, 0::BIGINT AS markers_dropped_by_gap, 0::BIGINT AS markers_dropped_by_auto,
  CASE WHEN total = 0 THEN 'SKIP_MISSING_SUBJECT_CSV' ELSE 'SKIP_ALIGNMENT_FAILED' END AS status, recording || '.vhdr' AS raw_file, 'subject-' || recording || '.csv' AS subject_csv,
  CASE WHEN total = 0 THEN 'no file of behavioural codes' ELSE 'markers can''t be aligned with codes' END AS error FROM st WHERE NOT ok""")
def out3_whole_rows(spark, d):
    """The QC rows of the whole job, from signal to status; without filters and component fit, which have queries of their own."""
    given = jobs.Preprocessing(CONTRAST, T.BLOCK, notch=(), low=None, high=None, limits=LIMITS, ica=Ica(mode="off"), tokens=("EH", "IH"))
    rows = jobs.preprocess(*_session(spark, d), T.SFREQ, given)["qc"]
    rows = rows.drop(*[c for c in rows.columns if c.startswith(("ica_fit_", "ica_find_"))])  # empty without a fit
    return rows.withColumns({c: fixed(c) for c in ("epoch_reject_rate", "blinks_per_min", "eog_corr_max", "eog_corr_mean", "blink_rate_per_min")})


QUANTILES = f"""{R('min(previous)')} AS gap_min, {', '.join(f"{R(f'quantile_cont(previous, {p / 100})')} AS gap_p{p}" for p in markers.PERCENTILES)}, {R('max(previous)')} AS gap_max"""


@query(f"""WITH {ALIGNED}, ra AS (SELECT recording FROM mk UNION SELECT recording FROM cd),
g AS (SELECT recording, count(*) AS n_markers, {QUANTILES} FROM gp GROUP BY 1),
cg AS (SELECT recording, string_agg(CAST(kept AS VARCHAR), ',' ORDER BY gap_s) AS candidate_kept FROM (SELECT recording, gap_s, count(*) FILTER (previous <= gap_s AND next <= gap_s) AS kept FROM gp, (VALUES {', '.join(f'({g}::DOUBLE)' for g in GAPS)}) AS v(gap_s) GROUP BY ALL) GROUP BY 1),
fd AS (SELECT recording, count(*) AS n_descriptions, string_agg(d, ',' ORDER BY fst) AS first_descriptions FROM (SELECT recording, d, min(ROW(pos, mk)) AS fst FROM mk GROUP BY ALL) GROUP BY 1),
td AS (SELECT recording, string_agg(d || ':' || n, ',' ORDER BY n DESC, d) AS top_descriptions, string_agg(d || ':' || n, ',' ORDER BY d) AS marker_types FROM (SELECT recording, d, count(*) AS n FROM mk GROUP BY ALL) GROUP BY 1),
cc AS (SELECT recording, sum(n)::BIGINT AS n_codes_total, string_agg(code || ':' || n, ',' ORDER BY code) AS code_counts FROM (SELECT recording, code, count(*) AS n FROM cd GROUP BY ALL) GROUP BY 1),
pv AS (SELECT recording, string_agg(code || ':' || CASE WHEN (code // 100 IN (1, 3)) = (code % 10 = 0) THEN 'token1' ELSE 'token2' END, ',' ORDER BY row_id, code) AS trials FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY recording ORDER BY row_id, code) <= 5) GROUP BY 1)
SELECT recording, coalesce(n_markers, 0) AS n_markers, gap_min, {', '.join(f'gap_p{p}' for p in markers.PERCENTILES)}, gap_max, candidate_kept, marker_types, n_descriptions, first_descriptions, top_descriptions, coalesce(n_codes_total, 0) AS n_codes_total, code_counts, trials,
  coalesce(n_codes, 0) AS n_codes, CASE WHEN ok IS NOT NULL THEN 0::BIGINT END AS markers_dropped_by_gap, CASE WHEN ok THEN markers_original - n_codes WHEN NOT ok THEN 0 END AS markers_dropped_by_auto, CASE WHEN ok THEN 'OK' ELSE 'SKIP_ALIGNMENT_FAILED' END AS status
FROM ra LEFT JOIN st USING (recording) LEFT JOIN g USING (recording) LEFT JOIN cg USING (recording) LEFT JOIN fd USING (recording) LEFT JOIN td USING (recording) LEFT JOIN cc USING (recording) LEFT JOIN pv USING (recording)""")
def out4_profile(spark, d):
    p = jobs.profile(T.markers(spark, d), T.codes(spark, d), gaps=GAPS, keep=KEEP)
    both = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b].cast("string"))), ",")
    p = p.withColumns({c: fixed(c) for c in p.columns if c.startswith("gap_")})
    flat = {"marker_types": both("marker_types", "mtype", "n"), "top_descriptions": both("top_descriptions", "desc", "n"), "code_counts": both("code_counts", "code", "n"), "trials": both("trials", "code", "trial_role"), "first_descriptions": text("first_descriptions"), "candidate_kept": text("candidate_gaps.kept")}
    return p.withColumns(flat).drop("candidate_gaps")


# 2.1 sources and sinks, on text and files that are made from the given tables


@query(f"""WITH {MK} SELECT recording, CAST(mk AS INT) AS mk, d AS mtype, d AS "desc", pos, 1::BIGINT AS size, 0 AS chan FROM mk WHERE mk % 7 <> 0""")
def src2_markers(spark, d):
    """Marker files as text lines, with lines that lack fields and comments among them."""
    m = T.markers(spark, d)
    line = F.when(F.col("mk") % 7 == 0, F.format_string("Mk%d=%s,%s", "mk", "mtype", "desc")).otherwise(F.format_string("Mk%d= %s ,%s,%d.0,%d,0", "mk", "mtype", "desc", "pos", "size"))
    lines = m.select("recording", F.explode(F.array(line, F.format_string("; Mk%d=x,y,1,1,0", "mk"), F.lit("[Marker Infos]"))).alias("value"))
    return recordings.parse_markers(lines)


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


@query(ORACLE["agg9_window_amplitude"])
def snk2_metric_csv(spark, d):
    """The metric table, written as CSV and read again."""
    path = _new_folder(spark)
    sinks.save_csv(averages.erp_metrics(T.epochs(spark, d), MORE), path)
    kinds = 'subject string, condition string, channel string, window string, tmin double, tmax double, mean_uV double, n_epochs long, status string'
    return spark.read.option("header", True).schema(kinds).csv(path).withColumn("mean_uV", fixed("mean_uV"))


@query(ORACLE["out1_erp_timeseries"])
def snk3_timeseries_parquet(spark, d):
    """The time series, written one folder per subject and read again."""
    path = _new_folder(spark)
    sinks.save_timeseries(averages.erp_timeseries(T.epochs(spark, d), -0.2, 0.4, factor=2), path)
    return spark.read.parquet(path).withColumn("subject", F.col("subject").cast("string")).withColumn("amplitude_uv", fixed("amplitude_uv"))


@query(f"""WITH {EP} SELECT recording, epoch_id, channel, {R('sum(CASE WHEN CAST(recording AS INT) % 2 = 1 THEN v ELSE -v END) * 1e6')} AS uv FROM sm WHERE recording <> '3' GROUP BY ALL""")
def snk4_rerun(spark, d):
    """A stage with the signs turned, then a rerun of the odd recordings, of which one has no epochs any more."""
    folder, e = _new_folder(spark), T.epochs(spark, d)
    names = e.select("recording").distinct()
    odd = F.col("recording").cast("int") % 2 == 1
    sinks.save_stage(e.withColumn("values", F.transform("values", lambda v: -v)), folder, "3_epochs", names, "first")
    sinks.save_stage(e.where(odd & (F.col("recording") != "3")), folder, "3_epochs", names.where(odd), "second")
    rows = sinks.read_stage(spark, folder, "3_epochs")
    return rows.select("recording", "epoch_id", "channel", fixed(F.aggregate("values", F.lit(0.0), lambda s, v: s + v) * 1e6).alias("uv"))


@query(f"""WITH {CD}, r AS (SELECT DISTINCT recording FROM cd), w(code) AS (VALUES (110), (111), (210), (211)),
u AS (SELECT recording, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY code) AS unknown FROM (SELECT DISTINCT recording, code FROM cd WHERE code NOT IN (110, 111, 210, 211)) GROUP BY 1),
m AS (SELECT recording, string_agg(CAST(code AS VARCHAR), ' ' ORDER BY code) AS missing FROM r CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM cd WHERE cd.recording = r.recording AND cd.code = w.code) GROUP BY 1)
SELECT recording, coalesce(unknown, '') AS unknown_codes, coalesce(missing, '') AS missing_codes FROM r LEFT JOIN u USING (recording) LEFT JOIN m USING (recording)""")
def val1_code_facts(spark, d):
    return jobs.code_facts(T.codes(spark, d), CONTRAST)
