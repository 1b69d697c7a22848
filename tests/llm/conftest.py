import pytest
from pyspark.sql import functions as F


@pytest.fixture
def clashing():
    """Adds columns whose names an operator might use itself."""

    def add(df):
        for name in ("id", "n", "key", "a", "b", "comp", "kept", "score", "shard", "slot", "_text", "component_id", "length", "start"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("clash"))
        return df

    return add
