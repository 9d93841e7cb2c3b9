"""Review files: strict and raw readers, and the writers of assignments, cohorts and reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clustrum.functions.text import clean_text
from clustrum.operators.cleaning import MAX_CHARACTERS, ContractError, check_reviews
from clustrum.operators.ordering import global_index
from clustrum.session import materialize
from clustrum.sources.records import read_records

# Columns of the raw review export.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("commentaire", "titre", "auteur", "date_avis", "date_experience")]
    + [T.StructField("note", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("texteServiceReply", "url", "dateServiceReply", "dataServiceReply")]
)
CSV_QUOTING = {"quote": '"', "escape": '"', "multiLine": True}
_PARSING = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "emptyValue": "", "nullValue": "\0"}


def _header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The first record of the first file."""
    top = spark.read.csv(path, header=False, sep=sep, **CSV_QUOTING).first()
    return [(v or "").lstrip("\ufeff") for v in top] if top else []


def read_fields(spark: SparkSession, path: str, sep: str = ",") -> tuple[list[str], DataFrame]:
    """Header of the CSV files under `path`, and their other records as text columns `_f0`, `_f1`, ...

    With `_bad` (too few or too many fields), and `_file`, `_block`, `_line` for their order. One file is read by many tasks, quoted
    line breaks or not. Every file has to begin with the same header, once.
    """
    header = _header(spark, path, sep)
    names = [f"_f{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in [*names, "_bad"])
    fields = F.from_csv("record", schema, {**_PARSING, "sep": sep})
    heading = F.lit(True)
    for name, value in zip(names, header):
        heading = heading & (F.coalesce(F.col(f"r.{name}"), F.lit("")) == value)
    parsed = read_records(spark, path, sep).select(fields.alias("r"), "file", "block", "line").select(
        *(F.col(f"r.{n}").alias(n) for n in names), F.col("r._bad").isNotNull().alias("_bad"), heading.alias("_heading"),
        F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("line").alias("_line"))
    parsed = materialize(parsed, "csv-fields")
    headings = parsed.groupBy("_file").agg(
        F.count_if("_heading").alias("n"), F.min_by("_heading", F.struct("_block", "_line")).alias("first")).filter("n != 1 or not first")
    if not headings.isEmpty():
        raise ContractError("invalid_csv_columns")
    return header, parsed.filter(~F.col("_heading")).drop("_heading")


def _named(header: list[str], fields: DataFrame) -> DataFrame:
    """The columns under their names; empty fields are null."""
    return fields.select(*(F.nullif(F.col(f"_f{i}"), F.lit("")).alias(name or f"_c{i}") for i, name in enumerate(header)))


def read_raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    """`;`-separated export with a header, in the raw schema; the columns have to be those of the schema, in its order."""
    header, fields = read_fields(spark, path, ";")
    if header != RAW_SCHEMA.fieldNames():
        raise ContractError("invalid_csv_columns")
    rows = _named(header, fields)
    return rows.select(*(F.expr(f"try_cast({c.name} AS {c.dataType.simpleString()})").alias(c.name) for c in RAW_SCHEMA))


def read_reviews_strict(
    spark: SparkSession,
    path: str,
    text_column: str = "commentaire",
    id_column: str = "",
    max_characters: int = MAX_CHARACTERS,
) -> DataFrame:
    """`source_row_id`, `source_row_index` (file order) and `text` of a cohort file.

    Refuses missing or repeated headers, short or long rows, missing or repeated ids, blank or
    overlong texts and an empty file. Quoted line breaks are kept; large files are read by many tasks.
    """
    header = _header(spark, path)
    if len(set(header)) != len(header) or text_column == id_column or not {text_column, id_column} <= set(header):
        raise ContractError("invalid_csv_columns")
    header, fields = read_fields(spark, path)
    parsed = fields.select(
        F.col(f"_f{header.index(id_column)}").alias("source_row_id"), F.col(f"_f{header.index(text_column)}").alias("text"),
        "_bad", "_file", "_block", "_line")
    found = parsed.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_bad").alias("shape"),
        F.count_if((clean_text("text") == "") | (F.length("text") > max_characters)).alias("limits"),
        F.count_if(clean_text("source_row_id") == "").alias("missing"),
    ).first()
    for count, reason in ((found.shape, "invalid_csv_row_shape"), (found.limits, "review_outside_limits"),
                          (found.missing, "missing_source_id")):
        if count:
            raise ContractError(f"{reason}: {count} rows")
    if not found.n:
        raise ContractError("empty_csv")
    if parsed.groupBy("source_row_id").count().filter("count > 1").limit(1).count():
        raise ContractError("duplicate_source_id")
    return global_index(parsed.drop("_bad"), ["_file", "_block", "_line"], "source_row_index").select(
        "source_row_id", "source_row_index", "text"
    )


def read_reviews_contract(
    spark: SparkSession, path: str, id_column: str, text_column: str, expected_rows: int | None = None
) -> DataFrame:
    """CSV with string ids; cleaned, and refused unless it keeps the review contract."""
    rows = _named(*read_fields(spark, path))
    return check_reviews(rows, id_column, text_column, expected_rows)


def write_reviews(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.csv(
        path, mode="errorifexists", header=True, sep=sep, quote='"', escape='"', quoteAll=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="",
    )


def write_assignments(df: DataFrame, path: str) -> None:
    """Input columns plus `cluster_id`, as CSV; never over an existing output."""
    write_reviews(df, path)


def write_splits(df: DataFrame, path: str, cohort: str = "cohort") -> None:
    """One folder per cohort; never over an existing output."""
    df.write.partitionBy(cohort).parquet(path, mode="errorifexists")


def write_report(df: DataFrame, path: str) -> None:
    """Metrics as JSON lines: undefined ones stay as null, NaN and infinity never appear."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    finite = df.withColumns({
        c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c in doubles
    }) if doubles else df
    finite.write.json(path, mode="errorifexists", ignoreNullFields=False)


def read_assignments(spark: SparkSession, path: str, id_column: str = "observation_id") -> DataFrame:
    """String ids and non-negative integer labels; a label that is neither stops the read."""
    raw = _named(*read_fields(spark, path))
    label = F.col("cluster_id")
    checked = F.when(label.rlike("^[0-9]+$"), label.cast("int")).otherwise(
        F.raise_error(F.lit("invalid cluster assignments")).cast("int")
    )
    found = raw.groupBy(id_column).count().agg(
        F.max("count").alias("copies"), F.count_if(F.col(id_column).isNull()).alias("missing")
    ).first()
    if found.missing or (found.copies or 0) > 1:
        raise ContractError("missing or duplicate observation ids")
    return raw.withColumn("cluster_id", checked)
