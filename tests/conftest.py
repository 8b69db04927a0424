import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lithoframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


@pytest.fixture(scope="session")
def volume_of(spark):
    """Traces from {(inline, crossline): samples}; further header columns by keyword."""
    from pyspark.sql import functions as F

    from lithoframe import schema

    def build(cells, dt=4.0, scalar=0, xy=lambda il, xl: (0.0, 0.0), survey="s"):
        rows = [(survey, i, il, xl, *map(float, xy(il, xl)), scalar, 0.0, dt, len(v), [float(x) for x in v])
                for i, ((il, xl), v) in enumerate(cells)]
        return spark.createDataFrame(rows, schema.TRACES).withColumn("inline", F.col("inline"))
    return build
