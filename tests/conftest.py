import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from skybias import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Small table from rows; times are given as text."""
    def make(rows, schema):
        timed = [part.split()[0] for part in schema.split(",") if part.split()[1].upper() == "TIMESTAMP"]
        text = ", ".join(f"{p.split()[0]} STRING" if p.split()[0] in timed else p for p in schema.split(","))
        df = spark.createDataFrame(rows, text)
        for c in timed:
            df = df.withColumn(c, df[c].cast("timestamp"))
        return df

    return make


def hours(start, values, skip=()):
    """(time, value) rows, one per hour, as text."""
    import pandas as pd

    stamps = pd.date_range(start, periods=len(values), freq="h")
    return [(str(t), v if v is None else float(v)) for i, (t, v) in enumerate(zip(stamps, values)) if i not in skip]
