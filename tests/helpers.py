"""Small panels for the tests."""

import numpy as np
import pandas as pd

from faultscope.canonical import METRICS


def panel(spark, series, role="case", case_id="c1", ts0=0):
    """``series``: service -> array (cpu only) or dict metric -> array."""
    frames = []
    for service, data in series.items():
        data = data if isinstance(data, dict) else {"cpu_usage": data}
        n = len(next(iter(data.values())))
        frame = pd.DataFrame({m: np.asarray(data.get(m, np.zeros(n)), float) for m in METRICS})
        frame.insert(0, "n", n)
        frame.insert(0, "i", np.arange(n))
        frame.insert(0, "ts", ts0 + np.arange(n))
        frame.insert(0, "service", service)
        frame.insert(0, "role", role)
        frame.insert(0, "case_id", case_id)
        frames.append(frame)
    pdf = pd.concat(frames)
    schema = "case_id string, role string, service string, ts bigint, i bigint, n bigint, " + ", ".join(f"{m} double" for m in METRICS)
    return spark.createDataFrame(pdf, schema)


def cases(spark, rows):
    return spark.createDataFrame(rows, "case_id string, label int, context map<string,string>")
