"""ETL E1-E15: scans, sinks, the column contract, cleaning, merge, pivot."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastat.functions.records import MONTH_COLS, rate_per_100k
from terrastat.functions.text import strip_accents
from terrastat.operators.common import checkpointed

# --- Fixed values: the reference's 22-column incidence contract, in order --
CONTRACT = [
    "Clave_Ent", "Entidad", "Cve_Municipio", "Municipio", "Bien_juridico_afectado",
    "Tipo_de_delito", "Subtipo_de_delito", "Modalidad",
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto",
    "Septiembre", "Octubre", "Noviembre", "Diciembre", "Total_Anual", "POB_TOTAL",
]
RATE_COLUMN = "Tasa_Anual_100k"
DROPPED_BEFORE_MERGE = ["NOM_ENT", "NOM_MUN"]
# ---------------------------------------------------------------------------

CANONICAL = ["state_key", "state", "muni_key", "muni", "legal_good", "crime_type",
             "subtype", "modality", *MONTH_COLS, "total", "population"]
TO_REFERENCE = dict(zip(CANONICAL, CONTRACT)) | {"rate_100k": RATE_COLUMN}
TO_CANONICAL = {v: k for k, v in TO_REFERENCE.items()}

CONTRACT_SCHEMA = T.StructType(
    [T.StructField("Clave_Ent", T.IntegerType()), T.StructField("Entidad", T.StringType()),
     T.StructField("Cve_Municipio", T.LongType()), T.StructField("Municipio", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CONTRACT[4:8]]
    + [T.StructField(c, T.LongType()) for c in CONTRACT[8:21]]
    + [T.StructField("POB_TOTAL", T.LongType())])


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    return df.select(*[F.col(c).alias(mapping.get(c, c)) for c in df.columns])


def to_reference_names(df: DataFrame) -> DataFrame:
    return rename(df, TO_REFERENCE)


def to_canonical_names(df: DataFrame) -> DataFrame:
    return rename(df, TO_CANONICAL)


def read_incidence_csv(spark: SparkSession, path: str, encoding: str = "UTF-8",
                       schema: T.StructType = CONTRACT_SCHEMA,
                       canonical: bool = True) -> DataFrame:
    """E1 (UTF-8) / E3 (``encoding='ISO-8859-1'``): header CSV with an explicit
    schema (no inference pass over the data)."""
    df = (spark.read.schema(schema).option("header", True)
          .option("encoding", encoding).option("mode", "FAILFAST").csv(path))
    return to_canonical_names(df) if canonical else df


# Reasons why a record is set aside.
TOO_SHORT, TOO_LONG, NOT_A_NUMBER, MALFORMED = ("too few fields", "too many fields",
                                                "not a number: ", "malformed")


def read_incidence_quarantine(spark: SparkSession, path: str, encoding: str = "UTF-8",
                              schema: T.StructType = CONTRACT_SCHEMA, header: bool = True,
                              canonical: bool = True) -> tuple[DataFrame, DataFrame]:
    """E1/E3 where single records may be broken: (the good rows, the rejected
    records with ``reason`` and ``file``), so one bad line does not end the job.

    Every column is parsed once (a pruned read would not see a broken column that
    nobody asks for) and stored with the raw text of the broken records; the reason
    comes from reading that text again as strings. An empty field is a null value,
    not an error; an empty file gives no rows on either side.
    """
    raw = T.StructField("_raw", T.StringType())
    table = checkpointed(
        spark.read.schema(T.StructType([*schema.fields, raw])).option("header", header)
        .option("encoding", encoding).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_raw").csv(path)
        .withColumn("_file", F.col("_metadata.file_name")))
    good = table.where(F.col("_raw").isNull()).drop("_raw", "_file")
    names = [f.name for f in schema.fields]
    fields = ", ".join(f"`{c}` string" for c in [*names, "_more"])
    # an absent field is null, an empty one is not
    text = F.from_csv("_raw", F.lit(fields), {"nullValue": "\u0001", "emptyValue": ""})
    broken = F.lit(None).cast("string")
    for f in reversed(schema.fields):
        if isinstance(f.dataType, (T.IntegralType, T.FractionalType)):
            value = F.col(f"_t.`{f.name}`")
            broken = F.when((value != "") & value.try_cast(f.dataType).isNull(),
                            F.lit(NOT_A_NUMBER + f.name)).otherwise(broken)
    reason = (F.when(F.col("_t._more").isNotNull(), F.lit(TOO_LONG))
              .when(F.col(f"_t.`{names[-1]}`").isNull(), F.lit(TOO_SHORT))
              .otherwise(F.coalesce(broken, F.lit(MALFORMED))))
    rejects = (table.where(F.col("_raw").isNotNull()).withColumn("_t", text)
               .select(F.col("_raw").alias("record"), reason.alias("reason"),
                       F.col("_file").alias("file")))
    return (to_canonical_names(good) if canonical else good), rejects


def read_mart_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """The mart has dynamic columns; infer once, then persist as parquet
    for every later read."""
    return (spark.read.option("header", True).option("inferSchema", True)
            .option("encoding", encoding).csv(path))


def mart_csv_to_parquet(spark: SparkSession, csv_path: str, parquet_path: str,
                        encoding: str = "UTF-8") -> DataFrame:
    """E2 once: infer the mart's dynamic schema in a single pass, store it as
    parquet, and return the parquet reader (typed, columnar, pushdown) that
    every later step uses."""
    read_mart_csv(spark, csv_path, encoding).write.mode("overwrite").parquet(parquet_path)
    return spark.read.parquet(parquet_path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet by default, or header CSV in UTF-8 (no index column)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        w.format(fmt).save(path)


def materialize(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """The offline ETL output (L0): write once as parquet, partitioned (by
    state by default for the incidence table) so later filters on the
    partition column prune whole folders; return the reader."""
    write_table(df, path, partition_by=partition_by)
    return df.sparkSession.read.parquet(path)


Z_BITS, Z_SAMPLE = 7, 4096


def z_key(df: DataFrame, columns: list[str]) -> Column:
    """A Z-order key: each column's place among bounds from a bounded sample of its
    distinct values (2**``Z_BITS`` ranges), the places' bits interleaved, so rows
    near in any of the columns are near in the key. Null values come first."""
    key = F.lit(0).cast("bigint")
    for k, c in enumerate(columns):
        values = df.select(c).where(F.col(c).isNotNull()).distinct()
        n = values.count()
        share = int(min(1.0, Z_SAMPLE / max(1, n)) * (1 << 30)) + 1
        some = sorted(r[0] for r in values.where(F.pmod(F.xxhash64(c), F.lit(1 << 30)) < share)
                      .limit(2 * Z_SAMPLE).collect())
        ranges = min(1 << Z_BITS, len(some))
        bounds = [some[i * len(some) // ranges] for i in range(1, ranges)]
        place = F.lit(0)
        if bounds:
            known = F.array(*[F.lit(b) for b in bounds])
            place = F.coalesce(F.size(F.filter(known, lambda b: b <= F.col(c))), F.lit(0))
            # few ranges fill all bits too
            place = F.floor(place * (1 << Z_BITS) / F.lit(ranges)).cast("int")
        for bit in range(Z_BITS):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(place, bit).bitwiseAND(1).cast("bigint"),
                                            bit * len(columns) + k))
    return key


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int) -> DataFrame:
    """E4 for several optional filters: about ``files`` parquet files, each a range
    of the Z-order key over ``columns``, so its column minima and maxima are narrow
    in all of them and any subset of equality filters skips files. The columns
    themselves end the range key, so many equal rows still divide by the others."""
    src = checkpointed(df)  # read for the bounds, the ranges and the rows
    keyed = src.withColumn("_z", z_key(src, columns))
    order = [F.col("_z"), *[F.col(c).asc_nulls_first() for c in src.columns]]
    (keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_z")
     .write.mode("overwrite").parquet(path))
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` under ``path`` as a table bucketed and sorted by ``key``: joins and
    group-bys on the key with tables of as many buckets need no shuffle of it."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key)
     .saveAsTable(name))
    return spark.table(name)


def drop_columns(df: DataFrame, names=DROPPED_BEFORE_MERGE) -> DataFrame:
    """E5: drop, ignoring names that are absent."""
    return df.drop(*names)


def select_contract(df: DataFrame, contract=CONTRACT) -> DataFrame:
    """Ordered projection; a missing column is an error."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise KeyError(f"missing contract columns: {missing}")
    return df.select(*contract)


def clean_names(df: DataFrame, columns=("muni", "state"), drop=("year",)) -> DataFrame:
    """E7 + E8: strip accents from name columns, drop the year column."""
    out = df.drop(*drop)
    return out.select(*[strip_accents(c).alias(c) if c in columns else F.col(c)
                        for c in out.columns])


def annual_total(cols=MONTH_COLS):
    """One row-wise expression summing the 12 months (null month = 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


# Fixed value: the census year of the reference's population table.
POPULATION_YEAR = 2015
# Spellings of the row that already sums both sexes.
TOTAL_SEX = ("total", "ambos sexos")


def clean_population(pop: DataFrame, year: int = POPULATION_YEAR) -> DataFrame:
    """Accents stripped; one year (when there is a year column), partial
    populations only (rows that already sum both sexes are left out), summed to
    one population per municipality (partial aggregation before the shuffle, so
    a municipality with many rows is not a hot spot)."""
    if "year" in pop.columns:
        pop = pop.where(F.col("year") == year)
    if "sex" in pop.columns:
        pop = pop.where(~F.coalesce(F.lower(strip_accents("sex")).isin(*TOTAL_SEX), F.lit(False)))
    return (pop.groupBy("muni_key")
            .agg(F.min(strip_accents("muni")).alias("muni"),
                 F.sum("population").cast("bigint").alias("population")))


def merge_population(inc: DataFrame, pop: DataFrame) -> DataFrame:
    """E11 + E12: left join of one population per key (the largest where a key
    is listed twice), unmatched keeps a null population; rate per 100k."""
    one = pop.groupBy("muni_key").agg(F.max("population").alias("population"))
    j = inc.join(one, "muni_key", "left")
    return j.withColumn("rate_100k", rate_per_100k("total", "population"))


def standardise(inc: DataFrame, catalogue: DataFrame, key: str = "state_key",
                name: str = "state", cat_key: str = "cat_key",
                cat_name: str = "cat_name") -> tuple[DataFrame, DataFrame]:
    """Trim strings, zero-fill month counts, replace names by the
    catalogue's standard spelling (left join, own name kept when unmatched).
    Returns (standardised rows, rows whose key the catalogue lacks)."""
    str_cols = [f.name for f in inc.schema.fields if isinstance(f.dataType, T.StringType)]
    trimmed = inc.select(*[F.trim(F.col(c)).alias(c) if c in str_cols else F.col(c)
                           for c in inc.columns]).fillna(0, subset=[c for c in MONTH_COLS
                                                                    if c in inc.columns])
    # one spelling a key, so that a code listed twice can't multiply rows
    cat = catalogue.groupBy(F.col(cat_key).alias(key)).agg(F.min(F.trim(F.col(cat_name))).alias("_std"))
    j = trimmed.join(cat, key, "left")
    std = j.select(*[F.coalesce(F.col("_std"), F.col(name)).alias(name) if c == name else F.col(c)
                     for c in trimmed.columns])
    unmatched = trimmed.join(cat, key, "left_anti")
    return std, unmatched


def pivot_matrix(long: DataFrame, ids: list[str], pivot_col: str, value: str,
                 values: list[str]) -> DataFrame:
    """Long -> matrix, one column per value of ``pivot_col`` (explicit
    list, stable column order), 0 where absent.

    Written as one conditional sum per value: a single aggregation keyed by
    ``ids`` with map-side partial sums (``pivot`` plans two aggregations and
    two shuffles), whose output is already partitioned by ``ids``.
    """
    p = F.col(pivot_col)
    return long.groupBy(*ids).agg(*[
        F.coalesce(F.sum(F.when(p == v, F.col(value))), F.lit(0)).cast("bigint").alias(v)
        for v in values])


def profile(df: DataFrame, order: list[str], head: int = 3) -> tuple[DataFrame, DataFrame]:
    """(one-row count frame, first ``head`` rows in a stable order)."""
    counts = df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))
    return counts, df.orderBy(*order).limit(head)
