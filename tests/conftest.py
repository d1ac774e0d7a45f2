import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from flowlens.session import local_session

PROPS = "array<struct<ord:int,name:string,value:string>>"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


def _props(pairs):
    return [(i, k, v) for i, (k, v) in enumerate(pairs)]


@pytest.fixture(scope="session")
def make_processors(spark):
    """rows of (template, id, name, type, group path, {property: value})"""
    def build(rows):
        data = [
            (t, i, pid, name, kind, "", path.rsplit("/", 1)[-1], path, _props(props.items()))
            for i, (t, pid, name, kind, path, props) in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, f"template string, proc_ord long, processor_id string, name string, type string, comments string, "
                  f"parent_group string, parent_group_path string, props {PROPS}")
    return build


@pytest.fixture(scope="session")
def make_connections(spark):
    """rows of (template, source, destination[, source type, destination type])"""
    def build(rows):
        data = [(r[0], i, r[1], r[2], *(r[3:5] if len(r) > 3 else ("PROCESSOR", "PROCESSOR")), ["success"]) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            data, "template string, conn_ord long, source string, destination string, source_type string, "
                  "destination_type string, relationships array<string>")
    return build


@pytest.fixture(scope="session")
def value_of(spark):
    """Evaluate a column builder on one row of string columns."""
    from pyspark.sql import functions as F

    def run(build, **columns):
        df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))
        return df.select(build(*[F.col(c) for c in columns]).alias("v")).first()["v"]
    return run
