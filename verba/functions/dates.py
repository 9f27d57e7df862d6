"""Historical dates, month words and numeral agreement (OP-49, OP-90, OP-91)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verba.functions.textnorm import PREREFORM, normalized

# Month words after pre-reform orthography, without a final dot.
MONTHS = {
    1: "январь января генварь генваря янв генв", 2: "февраль февраля фев февр", 3: "март мартъ марта мар", 4: "апрель апреля апр апрел", 5: "май мая", 6: "июнь июня июн",
    7: "июль июля июл", 8: "август августъ августа авг", 9: "сентябрь сентября сен сент сентяб", 10: "октябрь октября окт октяб", 11: "ноябрь ноября ноя нояб ноябр", 12: "декабрь декабря дек декаб",
}
# Fixed patterns: day.month[.year] and day month-word [year].
NUMERIC = r"^([0-9]{1,2})[./-]([0-9]{1,2})(?:[./-]([0-9]{4})(?:[ \t\n\f\r]*(?:года|г)\.?)?)?\z"
WORDED = r"^([0-9]{1,2})(?:-го)?[ \t\n\f\r.]*([а-я]+)\.?(?:[ \t\n\f\r]*([0-9]{4})(?:[ \t\n\f\r]*(?:года|г)\.?)?)?\z"


def month_number(form: Column) -> Column:
    """1..12 of a month word in comparison spelling; null for anything else."""
    table = F.create_map(*(F.lit(x) for n, forms in MONTHS.items() for w in forms.split() for x in (w, n)))
    bare = F.regexp_replace(F.regexp_replace(form, "^[ \t\r\n ]+|[ \t\r\n ]+$", ""), r"\.\z", "")
    return F.try_element_at(table, bare)


def date_struct(form: Column, context_year: Column) -> Column:
    """struct(year, month, day, year_from_context) of a text in comparison spelling; null if it is no date."""
    s = F.trim(F.regexp_replace(form, r"(?U)\s+", " "))
    part = lambda p, i: F.nullif(F.regexp_extract(s, p, i), F.lit(""))
    numeric = s.rlike(NUMERIC)
    day = F.when(numeric, part(NUMERIC, 1)).otherwise(part(WORDED, 1)).cast("int")
    month = F.when(numeric, part(NUMERIC, 2).cast("int")).otherwise(month_number(F.regexp_extract(s, WORDED, 2)))
    own = F.when(numeric, part(NUMERIC, 3)).otherwise(part(WORDED, 3)).cast("int")
    year = F.coalesce(own, context_year.cast("int"))
    real = F.expr("true") & year.between(1000, 9999) & month.between(1, 12) & day.between(1, 31)
    real = real & F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).isNotNull()
    return F.when(real, F.struct(year.alias("year"), month.alias("month"), day.alias("day"), own.isNull().alias("year_from_context")))


def parse_dates(df: DataFrame, col: str, context_year: Column | None = None, out: str = "date") -> DataFrame:
    """The frame with ``out``: spelling is folded once per distinct text, the rest is expressions."""
    df = normalized(df, col, "_spelled", PREREFORM, word=False)
    return df.withColumn(out, date_struct(F.col("_spelled"), context_year if context_year is not None else F.lit(0))).drop("_spelled")


def months(df: DataFrame, col: str, out: str = "month") -> DataFrame:
    df = normalized(df, col, "_spelled", PREREFORM, word=False)
    return df.withColumn(out, month_number(F.col("_spelled"))).drop("_spelled")


def numeral_grammemes(n: Column) -> Column:
    """Case and number of a noun after a count, by the count's last two digits."""
    m = F.abs(n % 100)
    many = F.array(F.lit("gent"), F.lit("plur"))
    return F.when(m.between(11, 14), many).when(m % 10 == 1, F.array(F.lit("nomn"), F.lit("sing"))).when((m % 10).between(2, 4), F.array(F.lit("gent"), F.lit("sing"))).otherwise(many)
