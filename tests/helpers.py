"""Small arrays to observations, and a plain sequential reading of the detectors."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from labtide.functions.profiles import ANALYTES, sigma_log
from labtide.functions.stats import Z95
from labtide.schemas import DEMOGRAPHICS, OBSERVATIONS

START = datetime(2025, 1, 1, tzinfo=timezone.utc)
START_T = int(START.timestamp())
DAY = 86_400
WEEK = 7 * DAY


def weekly(patient, code, values, unit, first=0):
    return [
        (patient, code, float(v), unit, START + timedelta(days=7 * (first + i)), "test") for i, v in enumerate(values)
    ]


def observations(spark, rows):
    return spark.createDataFrame(rows, OBSERVATIONS)


def demographics(spark, rows):
    return spark.createDataFrame(rows, DEMOGRAPHICS)


def noise(seed, n, width):
    """Seeded symmetric noise factors around 1."""
    state, out = seed * 2654435761 % 2**32 or 1, []
    for _ in range(n):
        state = (1664525 * state + 1013904223) % 2**32
        out.append(1 + width * (2 * state / 2**32 - 1))
    return out


SIGMA = {a["code"]: sigma_log(a) for a in ANALYTES}


def sequential(values, sigma):
    """Baseline, CUSUM and EWMA by their defining loops."""
    logs = [math.log(v) for v in values]
    n = len(logs)
    if n < 4:
        return None
    k = 3
    while k < 10 and k < n - 1:
        mean = sum(logs[:k]) / k
        if abs((logs[k] - mean) / (sigma * math.sqrt(1 + 1 / k))) > Z95:
            break
        k += 1
    mean = sum(logs[:k]) / k
    up = down = robust = level = 0.0
    up_start = down_start = k
    change = None
    for i in range(k, n):
        z = (logs[i] - mean) / sigma
        zc = max(-4.0, min(4.0, z))
        up, down = max(0.0, up + zc - 0.5), max(0.0, down - zc - 0.5)
        up_start = i + 1 if up == 0 else up_start
        down_start = i + 1 if down == 0 else down_start
        robust, level = 0.2 * zc + 0.8 * robust, 0.2 * z + 0.8 * level
        if change is None and (up > 5 or down > 5):
            change = (up_start if up > 5 else down_start, i)
    after = None if change is None else math.exp(sum(logs[change[0]:]) / (n - change[0]))
    return {"base_n": k, "set_point": math.exp(mean), "change": change, "after": after, "robust": robust,
            "ewma": math.exp(mean + level * sigma)}


def theil_sen(t, v):
    """All pairwise slopes per day, and Mann-Kendall S, by the double loop."""
    slopes, s = [], 0
    for i in range(len(t)):
        for j in range(i + 1, len(t)):
            s += int(v[j] > v[i]) - int(v[j] < v[i])
            if t[j] != t[i]:
                slopes.append((v[j] - v[i]) / ((t[j] - t[i]) / DAY))
    return s, sorted(slopes)
