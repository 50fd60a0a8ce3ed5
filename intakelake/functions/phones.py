"""Phone number columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from .regex import every
from .stage import once


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def impossible(digits: Column) -> Column:
    """Wrong length, or one digit repeated."""
    return ~F.length(digits).between(8, 15) | (F.replace(digits, F.left(digits, F.lit(1)), F.lit("")) == "")


def with_phone(df: DataFrame, raw: str, prefix: str = "phone") -> DataFrame:
    """Add ``<prefix>``, ``_valid``, ``_country`` and ``_reason`` for the number written in ``raw``."""
    r, d, form = F.trim(F.col(raw)), F.col("_digits"), F.col("_form")
    plus = F.coalesce(r.rlike(r"^\s*\(?\+"), F.lit(False))
    df = once(df, _plus=plus, _all=digits_of(r))
    df = once(df, _digits=F.when(~F.col("_plus") & F.col("_all").startswith("00"), F.expr("substring(_all, 3)")).otherwise(F.col("_all")))
    blank = r.isNull() | (r == "") | r.rlike(r"(?i)^not\s*found$") | r.rlike(r"(?i)^n/?a$")
    df = once(
        df,
        _form=F.when(blank, "empty")
        .when(F.col("_all") == "", "no digits")
        .when(d.rlike(r"^[6-9]\d{9}$"), "mobile0")
        .when(d.rlike(r"^0[6-9]\d{9}$"), "mobile1")
        .when(d.rlike(r"^91[6-9]\d{9}$"), "mobile2")
        .when(d.rlike(r"^(091|910)[6-9]\d{9}$"), "mobile3")
        .when(d.rlike(r"^0\d{9,10}$"), "landline")
        .when(d.rlike(r"^\d{8,15}$"), F.when(F.col("_plus"), "intl").otherwise("ambiguous format"))
        .otherwise("invalid length"),
    )
    mobile = form.startswith("mobile")
    return (
        df.withColumn(
            prefix,
            F.when(mobile, F.concat(F.lit("+91"), F.right(d, F.lit(10))))
            .when(form == "landline", F.concat(F.lit("+91"), F.expr("substring(_digits, 2)")))
            .when(form == "intl", F.concat(F.lit("+"), d))
            .when(form == "ambiguous format", d)
            .otherwise(V.NOT_FOUND),
        )
        .withColumn(f"{prefix}_valid", mobile | form.isin("landline", "intl"))
        .withColumn(f"{prefix}_country", F.when(mobile | (form == "landline"), "IN").when(form == "intl", "INTL").otherwise("UNKNOWN"))
        .withColumn(f"{prefix}_reason", F.when(~mobile & (form != "intl"), form))
        .drop("_plus", "_all", "_digits", "_form")
    )


def phone_mentions(texts: DataFrame) -> DataFrame:
    """Distinct valid numbers written anywhere in each text."""
    return mentioned(texts.select("doc_id", mentions(F.col("text")).alias("mentions")))


def mentions(text: Column) -> Column:
    """What is written like a number, in order."""
    return every(text, V.PHONE_MENTION)


def mentioned(rows: DataFrame) -> DataFrame:
    """Distinct valid numbers among each row's ``mentions``."""
    return with_phone(rows.select("doc_id", F.explode("mentions").alias("raw")), "raw").filter("phone_valid").select("doc_id", "phone").distinct()
