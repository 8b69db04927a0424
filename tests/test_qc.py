import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.functions.quantiles import exact_percentiles
from lithoframe.operators import qc
from lithoframe.operators.geometry import infer_geometry


def random_volume(volume_of, n=10, s=64, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, n, s)).astype("f4")
    data[0, 0] = 0
    return data, volume_of([((il + 1, xl + 1), data[il, xl]) for il in range(n) for xl in range(n)])


def test_stats_equal_numpy(volume_of):
    data, t = random_volume(volume_of)
    d = data.astype("f8")
    row = qc.amplitude_stats(t).first()
    for name, want in (("min", d.min()), ("max", d.max()), ("mean", d.mean()), ("std", d.std()),
                       ("p01", np.percentile(d, 1)), ("p99", np.percentile(d, 99)),
                       ("nonzero_fraction", np.count_nonzero(d) / d.size)):
        assert row[name] == pytest.approx(want, abs=1e-9), name


@pytest.mark.parametrize("values", [
    [0.0] * 50, [1.0], [1.0, 2.0], [-3.0, -3.0, 5.0], [1e-30, 1e30, -1e30, 0.0], [0.5] * 90 + [float(i) for i in range(10)]])
def test_percentiles_of_awkward_values(spark, values):
    v = np.float32(values).astype("f8")
    df = spark.createDataFrame([("a", float(x)) for x in v], "k string, v double")
    row = exact_percentiles(df, ["k"], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    assert [row["p10"], row["p50"], row["p99"]] == pytest.approx(list(np.percentile(v, [10, 50, 99])), rel=1e-12)


def test_percentiles_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", float(np.float32(rng.normal()))) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["p90"] for r in exact_percentiles(df, ["k"], {"p90": 0.9}).collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == pytest.approx(np.percentile([v for kk, v in rows if kk == k], 90), abs=1e-12)


@pytest.mark.parametrize("hz,tolerance", [(30, 3), (50, 4)])
def test_dominant_frequency_of_sinusoids(volume_of, hz, tolerance):
    wave = np.sin(2 * np.pi * hz * np.arange(256) * 0.004)
    t = volume_of([((1, i), wave) for i in range(5)])
    assert abs(qc.dominant_frequency(t).first()["dominant_freq_hz"] - hz) <= tolerance


def ricker(n, f, dt=0.004):
    t = (np.arange(n) - n // 2) * dt
    a = (np.pi * f * t) ** 2
    return (1 - 2 * a) * np.exp(-a)


def test_dominant_frequency_of_ricker(volume_of):
    t = volume_of([((1, i), ricker(128, 35)) for i in range(10)])
    assert abs(qc.dominant_frequency(t).first()["dominant_freq_hz"] - 35) <= 5


def test_symmetry(volume_of):
    wave = ricker(129, 30)
    spec = np.fft.fft(wave)
    freq = np.fft.fftfreq(129)
    rotated = np.real(np.fft.ifft(spec * (-1j * np.sign(freq))))
    sym = lambda w: qc.wavelet_symmetry(volume_of([((1, i), w) for i in range(5)])).first()["wavelet_symmetry"]
    assert sym(wave) > 0.8
    assert sym(rotated) < sym(wave) - 0.5
    assert np.isnan(sym(np.zeros(64)))


def test_normalise(volume_of, spark):
    data, t = random_volume(volume_of)
    p99 = float(np.percentile(data.astype("f8"), 99))
    level = lambda v: spark.createDataFrame([("s", v)], "survey_id string, p99 double")
    out = qc.normalise(t, level(p99)).first()
    assert max(map(abs, out["samples_norm"])) <= 1.5
    assert out["samples"] == t.first()["samples"]
    free = qc.normalise(t, level(p99), clip=False).agg(F.max(F.array_max("samples_norm"))).first()[0]
    assert free == pytest.approx(data.max() / p99, rel=1e-5)
    with pytest.raises(Exception, match="positive"):
        qc.normalise(t, level(0.0)).collect()


def test_volume_qc_prefers_sidecar_stats(volume_of, spark):
    _, t = random_volume(volume_of)
    geo = infer_geometry(t)
    plain = qc.volume_qc(t, geo).first()
    assert not plain["sidecar_stats_used"]
    assert plain["amp_min"] <= plain["amp_p01"] <= plain["amp_p99"] <= plain["amp_max"]
    assert plain["nonzero_fraction"] == 0.99
    side = spark.createDataFrame([("s", (-9.0, 9.0, 0.0, 1.0, -2.0, 2.0, 0.5))],
                                 "survey_id string, amplitude_stats struct<min:double,max:double,mean:double,"
                                 "std:double,p01:double,p99:double,nonzero_fraction:double>")
    row = qc.volume_qc(t, geo, side).first()
    assert row["sidecar_stats_used"] and row["amp_min"] == -9.0 and row["dominant_freq_hz"] == plain["dominant_freq_hz"]


def test_evenly_spaced_stops_at_n(volume_of):
    _, t = random_volume(volume_of)
    rows = qc.evenly_spaced(t, infer_geometry(t), 30)
    got = sorted((r["inline"] - 1) * 10 + r["crossline"] - 1 for r in rows.collect())
    assert got == list(range(0, 100, 3))[:30]


def test_gates(spark):
    v = lambda n, total: spark.range(1).select(qc.label_gate(F.lit(n), F.lit(total))).first()[0]
    assert [v(0, 10), v(1, 100_000), v(1, 1000), v(1, 10)] == ["FAIL", "WARN", "CAUTION", "PASS"]
    probs = lambda xs: spark.createDataFrame([("s", [float(x) for x in xs])], "survey_id string, prob array<float>")
    verdict = lambda xs: qc.probability_gate(probs(xs)).first()["verdict"]
    assert verdict([0.5] * 10) == "FAIL"
    assert verdict([0.1] * 9 + [0.9]) == "PASS"
    assert verdict([0.1] + [0.9] * 9) == "FAIL"


def test_statistics_with_nan_and_infinity(spark):
    inf, nan = float("inf"), float("nan")
    groups = {"plain": [1.0, 2.0, 4.0, -0.0, 0.0, 5e-324, 1e-40, -3.5], "nan": [1.0, 2.0, 3.0, nan],
              "high": [1.0, 2.0, inf], "low": [-inf, 0.0, 7.0, 7.5], "same": [inf, inf, inf]}
    rows = [(k, [float(v) for v in x]) for k, x in groups.items()]
    t = spark.createDataFrame(rows, "survey_id string, samples array<double>")
    got = {r["survey_id"]: r for r in qc.amplitude_stats(t).collect()}
    for k, x in groups.items():
        r, x = got[k], np.array(x)
        with np.errstate(invalid="ignore"):
            want = [x.min(), x.max(), x.mean(), *np.percentile(x, [1, 99])]
        if k == "high":  # NumPy has nan between a number and infinity when it comes from above
            want[-1] = inf
        assert r["n"] == len(x) and r["nonzero_fraction"] == np.count_nonzero(x) / len(x)
        if k != "same":  # NumPy has nan between equal infinities
            assert np.allclose([r[c] for c in ("min", "max", "mean", "p01", "p99")], want, equal_nan=True)
    assert got["same"]["p99"] == inf
