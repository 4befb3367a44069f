"""Records by key and time: statistics, first values, text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def float_or_null(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def provider_stats(df: DataFrame, ts: str, uid: str) -> DataFrame:
    """Counts of rows, times and ids, and the range of times."""
    return df.agg(F.count("*").alias("num_rows"), F.count_distinct(ts).alias("num_timestamps"), F.count_distinct(uid).alias("num_uids"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def first_value(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Each key's first value that is not null."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias(value))


def one_uid(df: DataFrame, uid: str) -> DataFrame:
    """df, or an error where it holds other than exactly one id."""
    n = df.agg(F.count_distinct(uid).alias("__n"))
    # one row of one number
    checked = df.join(F.broadcast(n), F.lit(True))
    return checked.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("other than one id")).cast("boolean"))).drop("__n")


def natural_key(name: Column) -> Column:
    """Sorts names by their number, then as text."""
    return F.struct(F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), name)


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most width characters; a longer word has a line of its own. Words are what ASCII white space parts."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    none = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def step(done: Column, word: Column) -> Column:
        fits = F.length(done["line"]) + 1 + F.length(word) <= width
        lines = F.when(fits | done["line"].isNull(), done["lines"]).otherwise(F.concat(done["lines"], F.array(done["line"])))
        return F.struct(lines.alias("lines"), F.when(fits, F.concat(done["line"], F.lit(" "), word)).otherwise(word).alias("line"))

    return F.aggregate(words, none, step, lambda done: F.when(done["line"].isNull(), done["lines"]).otherwise(F.concat(done["lines"], F.array(done["line"]))))
