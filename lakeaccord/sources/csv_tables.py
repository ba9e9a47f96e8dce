"""CSV tables: typed scans that never infer a schema, and the sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import present

# Cell texts that mean "missing" in the CSV files.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A headered CSV with a declared schema; missing-value texts become null.

    Period columns such as ``2023-01`` must be declared as strings: inference
    would turn them into timestamps. The header is checked against the schema.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    cleaned = [
        F.when(~F.col(f.name).isin(MISSING), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cleaned)


def scan_column(spark: SparkSession, path: str, schema: T.StructType | str, column: str) -> DataFrame:
    """The cells of one column that are neither null nor NaN.

    An absent file, and a column that is not in the schema or not in the file's
    header, give no rows; an empty frame keeps the column's declared type. Other
    errors are raised.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = declared[column].dataType if column in declared.names else T.StringType()
    nothing = spark.createDataFrame([], T.StructType([T.StructField(column, kind)]))
    if column not in declared.names:
        return nothing
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return nothing
        raise
    if [n.lower() for n in header] != [n.lower() for n in declared.names]:
        return nothing
    df = read_csv_table(spark, path, declared)
    return df.select(F.expr(present(df, column)).alias(column)).filter(F.col(column).isNotNull())


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
