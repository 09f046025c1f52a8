"""Raw ``date,value`` lines that fail to parse, apart from the valid ones and with their reason.

Method: structural checks by pattern on each line; then each distinct text of a column is cast once,
the failing ones form an invalid-value dictionary with reasons, and the dictionary is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.runtime import cut

# Possessive quantifiers: no backtracking and no recursion, whatever the length of a line.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
WELL_QUOTED = rf"\A{FIELD}(?:,{FIELD})*+\z"
TWO_FIELDS = rf"\A({FIELD}),({FIELD})\z"
DAY = r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

#: Copies of the dictionary over which the rows of a hot text are spread in the join.
SALTS = 8


def content(field: Column) -> Column:
    """Content of a field: quotes undone, blanks and tabs around it removed."""
    inner = F.replace(F.substring(field, F.lit(2), F.greatest(F.length(field) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
    return F.btrim(F.when(field.startswith('"'), inner).otherwise(field), F.lit(" \t"))


def split_lines(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """line_id, the columns to keep, structural reason (null if sound), date_text and value_text of each line.

    A carriage return at the end is no part of a line; a null line counts as an empty one.
    """
    line = F.regexp_replace(F.coalesce(F.col(raw).cast("string"), F.lit("")), r"\r\z", "")
    out = lines.select(F.col(line_id).alias("line_id"), *keep, line.alias("_line"))
    reason = F.when(~F.col("_line").rlike(WELL_QUOTED), "quoting").when(~F.col("_line").rlike(TWO_FIELDS), "columns")
    out = out.withColumn("structure", reason)
    sound = F.col("structure").isNull()
    for name, group in (("date_text", 1), ("value_text", 2)):
        out = out.withColumn(name, F.when(sound, content(F.regexp_extract("_line", TWO_FIELDS, group))))
    return out.drop("_line")


def day_of(text: Column) -> Column:
    """The existing day that the first ten characters name, or null."""
    return F.when(text.rlike(DAY), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def invalid_values(split: DataFrame) -> DataFrame:
    """Dictionary (column, text, reason) of the distinct texts that can't be cast; each is cast once."""
    texts = split.filter("structure is null").select(F.explode(F.array(F.struct(F.lit("date").alias("column"), F.col("date_text").alias("text")), F.struct(F.lit("value").alias("column"), F.col("value_text").alias("text")))).alias("c")).select("c.*").distinct()
    bad = F.when(F.col("column") == "date", day_of(F.col("text")).isNull()).otherwise(~F.col("text").rlike(NUMBER))
    return texts.filter(bad).withColumn("reason", F.col("column"))


def judged_lines(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line", keep: tuple[str, ...] = ()) -> DataFrame:
    """line_id, the columns to keep, reason (null for a valid record), date_text, value_text: one row for each line.

    The first reason that applies of quoting, columns, date, value. Lines delivered twice stay two
    rows. An empty table gives no rows. Lines are read and split once, whatever is made of them.
    """
    out = split = cut(split_lines(lines, line_id, raw, keep))
    book = cut(invalid_values(split)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = out.withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int"))
    for column in ("date", "value"):
        own = book.filter(F.col("column") == column).select("salt", F.col("text").alias(f"{column}_text"), F.col("reason").alias(f"{column}_reason"))
        out = out.join(own, ["salt", f"{column}_text"], "left")
    return out.select("line_id", *keep, F.coalesce("structure", "date_reason", "value_reason").alias("reason"), "date_text", "value_text")


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines after each download's header; a line without number is none of them."""
    return lines.filter("line_no > 1")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """line_id and reason of each data line that holds no valid record."""
    return judged_lines(data_lines(lines)).filter("reason is not null").select("line_id", "reason")


def loaded_lines(lines: DataFrame) -> DataFrame:
    """The valid data lines, typed: line_id, date, value. A number beyond double's range loads as infinity."""
    ok = judged_lines(data_lines(lines)).filter("reason is null")
    return ok.select("line_id", day_of(F.col("date_text")).alias("date"), F.col("value_text").try_cast("double").alias("value"))


def rejection_report(lines: DataFrame) -> DataFrame:
    """Data lines and rejected ones by file and reason; files with null name are one file."""
    judged = judged_lines(data_lines(lines), keep=("file_name",))
    return judged.groupBy("file_name", F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_lines"))
