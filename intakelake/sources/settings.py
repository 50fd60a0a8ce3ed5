"""Runtime settings: a JSON document per row, typed, with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V


def _valid(kind: str, lo, hi, v: Column, t: Column, name: str) -> Column:
    """A present value has the right JSON type and stays inside its bounds."""
    text, num = F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(v, f"$.{name}", "double")
    number = t.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    if kind == "double":
        return number & num.between(lo, hi)
    if kind == "int":
        return number & num.between(lo, hi) & (num == F.floor(num))
    if kind == "enum":
        return (t == "STRING") & text.isin(*V.ENGINES)
    ok = (t == "STRING") & F.length(text).between(lo, hi)
    return ok | (t == "VOID") if kind == "nullable" else ok


def scan_settings(rows: DataFrame, id_col: str, json_col: str = "value") -> DataFrame:
    """Missing keys take their default; any invalid value sends the whole row back to the defaults."""
    df = rows.select(id_col, F.try_parse_json(json_col).alias("_v"))
    v, ok = F.col("_v"), F.col("_v").isNotNull()
    for name, kind, lo, hi, _ in V.SETTINGS:
        t = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        ok = ok & F.coalesce(_valid(kind, lo, hi, v, t, name), F.lit(True))
    df = df.withColumn("valid", ok)
    types = {"double": "double", "int": "int"}
    return df.select(id_col, "valid", *[
        F.coalesce(F.when(F.col("valid"), F.try_variant_get(v, f"$.{name}", types.get(kind, "string"))), F.lit(default).cast(types.get(kind, "string"))).alias(name)
        for name, kind, _, _, default in V.SETTINGS
    ])
