"""Wavelet peaks against one convolution and one percentile per peak over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import wavelets


def places(x, widths):
    n = len(x)
    if n == 0:
        return []
    waves = np.array([np.convolve(x, wavelets.ricker(min(10 * w, n), w)[::-1], mode="same")[:n] for w in range(1, widths + 1)])
    peak = np.zeros(waves.shape, bool)
    peak[:, 1:-1] = (waves[:, 1:-1] > waves[:, :-2]) & (waves[:, 1:-1] > waves[:, 2:])
    half, odd = divmod(-(-n // 20), 2)
    found = []
    for place in np.flatnonzero(peak.any(axis=0)):
        row = int(np.argmax(peak[:, place]))
        noise = np.percentile(waves[0, max(place - half, 0) : min(place + half + odd, n)], 10)
        if not abs(waves[row, place]) < abs(noise):
            found.append(int(place))
    return found


def table(spark, made):
    rows = [(k, i, None if np.isnan(v) else float(v)) for k, x in made.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t long, x double").withColumn("t", F.col("t").cast("timestamp")).repartition(5)


@pytest.mark.parametrize("n", [1, 2, 9, 19, 29, 30, 200, 20_000])
def test_parts_have_the_transform_of_the_whole(n):
    x = np.random.default_rng(n).normal(size=n)
    whole = wavelets.transforms(x, n)
    for w in range(1, 4):
        assert np.allclose(whole[w - 1], np.convolve(x, wavelets.ricker(min(10 * w, n), w)[::-1], mode="same")[:n])
    if n > 100:
        part = wavelets.transforms(x[40:140], n)
        assert np.allclose(part[:, 16:-16], whole[:, 56:124])


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_counts_in_ranges(n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1)
    a = rng.integers(0, n, 300)
    b = np.array([rng.integers(x + 1, n + 1) for x in a])
    a, b = np.append(a, 0), np.append(b, n)
    bound = np.round(rng.normal(size=301), 1)
    for inclusive in (True, False):
        count, down, up = wavelets.RangeCounts(values)(a, b, bound, inclusive)
        for i in range(len(a)):
            part = values[a[i] : b[i]]
            low = part <= bound[i] if inclusive else part < bound[i]
            assert count[i] == low.sum() and down[i] == max(part[low], default=-np.inf) and up[i] == min(part[~low], default=np.inf)


@pytest.mark.parametrize(("chunk", "least", "hot"), [(8_192, 4_096, None), (40, 3, 100)])
def test_series_of_all_lengths(spark, chunk, least, hot):
    rng = np.random.default_rng(chunk)
    made = {f"s{n}": rng.normal(size=n) for n in (1, 2, 3, 5, 12, 29, 31, 90, 400, 1_500)}
    t = np.arange(90)
    made["bumps"] = sum(h * np.exp(-((t - c) ** 2) / 4) for c, h in ((15, 5), (45, 8), (75, 6))) + 0.01 * np.sin(t)
    made["flat"] = np.zeros(50)
    made["steps"] = np.repeat(rng.integers(0, 3, 60), 4).astype(float)
    made["gaps"] = np.where(rng.random(300) < 0.2, np.nan, rng.normal(size=300))
    made["none"] = np.full(4, np.nan)
    got = wavelets.wavelet_peaks(table(spark, made), "k", "t", "x", chunk=chunk, least_block=least, hot_rows=hot)
    want = {k: tuple(len(places(x[~np.isnan(x)], w)) for w in (2, 3)) for k, x in made.items()}
    assert {r.k: (r.number_cwt_peaks_2, r.number_cwt_peaks_3) for r in got.collect()} == want
    assert min(want["bumps"]) >= 3 and want["flat"] == want["none"] == (0, 0)


def test_odd_calls(spark):
    df = table(spark, {"a": np.arange(5.0)})
    with pytest.raises(ValueError, match="widths"):
        wavelets.wavelet_peaks(df, "k", "t", "x", widths=(4,))
    assert wavelets.wavelet_peaks(df.where("false"), "k", "t", "x").count() == 0
