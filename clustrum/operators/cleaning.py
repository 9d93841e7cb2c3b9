"""Cleaning, contract checks and de-duplication of review tables."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clustrum.functions.text import clean_text, text_digest, word_count
from clustrum.functions.vectors import listed_rows, stacked_rows

# Limits of a review that may be scored.
MIN_CHARACTERS, MAX_CHARACTERS = 1, 5000


class ContractError(ValueError):
    """An input broke its contract; messages hold counts and positions, never review text."""


def with_clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(text))


def reject_invalid(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """One row: row count and the number of blank texts, missing and surplus ids."""
    return df.groupBy(F.col(id_column).alias("_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(clean_text(text) == "").alias("blank")
    ).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("blank_texts"),
        F.coalesce(F.sum(F.when(_missing("_id"), F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.coalesce(F.sum(F.when(~_missing("_id"), F.col("n") - 1)), F.lit(0)).alias("surplus_ids"),
    )


def _missing(column: str):
    return F.col(column).isNull() | (clean_text(column) == "")


def check_reviews(
    df: DataFrame, id_column: str, text: str = "text", expected_rows: int | None = None
) -> DataFrame:
    """Cleans the text; raises unless ids are complete and unique, no text is blank and the count fits."""
    found = reject_invalid(df, id_column, text).first()
    if not found.n_rows:
        raise ContractError("empty dataset")
    if expected_rows is not None and found.n_rows != expected_rows:
        raise ContractError(f"expected {expected_rows} rows, found {found.n_rows}")
    if found.blank_texts:
        first = df.filter(clean_text(text) == "").orderBy(id_column).limit(10).select(id_column).collect()
        raise ContractError(f"{found.blank_texts} blank texts, first ids {[r[0] for r in first]}")
    if found.missing_ids or found.surplus_ids:
        raise ContractError(f"{found.missing_ids} missing and {found.surplus_ids} duplicate ids")
    return with_clean_text(df, text)


def text_limits(df: DataFrame, text: str = "text", low: int = MIN_CHARACTERS, high: int = MAX_CHARACTERS) -> DataFrame:
    """Adds `limit_reason`: null when the text may be scored, otherwise why not."""
    return df.withColumn(
        "limit_reason",
        F.when(clean_text(text) == "", "blank")
        .when(F.length(text) < low, "too_short")
        .when(F.length(text) > high, "too_long"),
    )


def split_valid(df: DataFrame, reason: str = "limit_reason") -> tuple[DataFrame, DataFrame]:
    """Valid rows and the quarantined rest."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def fill_from_title(df: DataFrame, text: str = "commentaire", title: str = "titre") -> DataFrame:
    return df.withColumn(text, F.coalesce(text, title))


def drop_columns(df: DataFrame, columns: Sequence[str] = ("date_avis", "texteServiceReply", "url", "dateServiceReply")) -> DataFrame:
    return df.drop(*columns)


def language_filter(df: DataFrame, language: str = "fr", column: str = "lang", text: str = "text") -> DataFrame:
    return df.filter(F.col(column) == language).dropna(subset=[text])


def parse_experience_date(df: DataFrame, column: str = "date_experience", name: str = "date_to_sort", strict: bool = True) -> DataFrame:
    """Month-name dates such as "May 05, 2025"; strict stops on a bad one, otherwise it becomes null."""
    parsed = F.try_to_timestamp(column, F.lit("MMMM d, yyyy")).cast("date")
    if strict:
        message = F.concat(F.lit("not a date: "), F.col(column))
        parsed = F.when(F.col(column).isNotNull() & parsed.isNull(), F.raise_error(message).cast("date")).otherwise(parsed)
    return df.withColumn(name, parsed)


def year_month_parts(df: DataFrame, column: str = "date_to_sort") -> DataFrame:
    return df.withColumns(
        {"date_experience_year": F.year(column), "date_experience_month": F.month(column)}
    )


def concat_reply(df: DataFrame, text: str = "commentaire", reply: str = "dataServiceReply", name: str = "comm_reply") -> DataFrame:
    return df.withColumn(
        name, F.when(F.col(reply).isNotNull(), F.concat(text, reply)).otherwise(F.col(text))
    )


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `character_length` and `word_count` of the stripped text."""
    cleaned = clean_text(text)
    return df.withColumns({"character_length": F.length(cleaned), "word_count": word_count(cleaned)})


def l2_normalize(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit-length vectors; stops on a missing, empty, non-finite or zero vector."""

    @F.arrow_udf("array<double>")
    def scaled(vectors: pa.Array) -> pa.Array:
        matrix = stacked_rows(vectors)
        lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
        if not np.isfinite(matrix).all() or (lengths == 0).any():
            raise ValueError("vectors must be finite and nonzero")
        return listed_rows(matrix / lengths)

    return df.withColumn(vector, scaled(vector))


def drop_noise(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    return df.filter(F.col(label) >= 0)


def filter_by_rating(df: DataFrame, rating: int = 1, column: str = "note") -> DataFrame:
    return df.filter(F.col(column) == rating)


def dedupe_reviews(df: DataFrame, keys: Sequence[str], id_column: str) -> DataFrame:
    """First copy (lowest id) of each combination of `keys`; nulls compare equal.

    The rank limit is applied before the shuffle as well, so a text copied a billion times sends
    one row per input partition.
    """
    values = [F.col(k).cast("string") for k in keys]
    # The length in front keeps ("a", "bc") apart from ("ab", "c").
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    key = F.sha2(F.concat(*parts), 256)
    window = Window.partitionBy("_key").orderBy(id_column)
    return (
        df.withColumn("_key", key)
        .withColumn("_copy", F.row_number().over(window))
        .filter(F.col("_copy") == 1)
        .drop("_key", "_copy")
    )


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.groupBy(id_column).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(text_digest(clean_text(text)).alias("text_digest")).distinct()
