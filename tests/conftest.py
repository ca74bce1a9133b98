import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)


@pytest.fixture(scope="session")
def spark():
    from fieldspark.session import build_session

    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mask_runs(spark):
    """Dense 2-D arrays by frame number to mask runs."""

    def build(frames):
        rows = []
        for name, grid in frames.items():
            for y, line in enumerate(grid):
                x = 0
                while x < len(line):
                    end = x
                    while end < len(line) and line[end] == line[x]:
                        end += 1
                    if line[x]:
                        rows.append((name, y, x, end, int(line[x])))
                    x = end
        return spark.createDataFrame(rows, "frame_index long, y int, x0 int, x1 int, value int")

    return build


@pytest.fixture(scope="session")
def dense():
    """Mask runs back to dense arrays."""
    import numpy as np

    def build(runs, width, height):
        out = {}
        for r in runs.collect():
            out.setdefault(r["frame_index"], np.zeros((height, width), int))[r["y"], r["x0"] : r["x1"]] = r["value"]
        return out

    return build
