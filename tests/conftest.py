import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from terrastat.session import get_session
    s = get_session("local[4]", app="terrastat-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


def wide_row(muni_key=1, legal_good="ECONOMY", modality="F", months=None, population=100000,
             muni="M1", state="S1", state_key=1):
    months = months if months is not None else [1] * 12
    total = sum(m for m in months if m is not None)
    d = {"state_key": state_key, "state": state, "muni_key": muni_key, "muni": muni,
         "legal_good": legal_good, "crime_type": legal_good, "subtype": legal_good,
         "modality": modality}
    for i, m in enumerate(months, start=1):
        d[f"m{i:02d}"] = m
    d["total"] = total
    d["population"] = population
    return d


INC_DDL = ("state_key int, state string, muni_key bigint, muni string, legal_good string, "
           "crime_type string, subtype string, modality string, "
           + ", ".join(f"m{i:02d} bigint" for i in range(1, 13))
           + ", total bigint, population bigint")


@pytest.fixture
def make_inc(spark):
    from pyspark.sql import functions as F
    from terrastat.functions.records import rate_per_100k

    def make(rows):
        cols = INC_DDL
        df = spark.createDataFrame([tuple(r.values()) for r in rows], cols)
        return df.withColumn("rate_100k", rate_per_100k(F.col("total"), F.col("population")))
    return make
