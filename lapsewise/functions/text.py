"""Text expressions: category normalisation, masking and display names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapsewise.config import HEADER_NAMES, NORMALIZED_COLUMNS

# Field names treated as personal data, compared in lower case.
PII_FIELDS = (
    "customerid",
    "customer_id",
    "surname",
    "last_name",
    "email",
    "phone",
    "ssn",
    "password",
    "api_key",
    "token",
)
# Prefixes a preprocessing step puts before a feature name.
STEP_PREFIX = "^(num__|cat__|m__)"

_BLANKS = " \t\n\r\f\x0b"


def capitalized(column: Column | str) -> Column:
    """Strip surrounding whitespace, upper-case the first letter, lower the rest.

    ``initcap`` would capitalise every word and ``trim`` strips spaces only.
    A null stays null.
    """
    c = F.col(column) if isinstance(column, str) else column
    s = F.btrim(c, F.lit(_BLANKS))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))


def normalize(
    df: DataFrame,
    mapping: Mapping[str, str] = HEADER_NAMES,
    columns: Iterable[str] = NORMALIZED_COLUMNS,
) -> DataFrame:
    """Rename headers, then normalise the listed categories that exist."""
    df = df.withColumnsRenamed(dict(mapping))
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: capitalized(F.col(f"`{c}`")) for c in present})


def first_present(df: DataFrame, names: Iterable[str], out: str) -> DataFrame:
    """First non-null value among header aliases; absent aliases are skipped."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of the columns {sorted(names)} is present")
    return df.withColumn(out, F.coalesce(*present))


def masked(column: Column) -> Column:
    s = column.cast("string")
    return F.when(F.length(s) > 4, F.concat(F.lit("***"), F.right(s, F.lit(4)))).when(
        s.isNotNull(), F.lit("***")
    )


def mask_pii(df: DataFrame, fields: Iterable[str] = PII_FIELDS) -> DataFrame:
    """Mask personal fields by name, at any depth of structs, arrays and maps. In a map
    with text values the keys are names too."""
    wanted = {f.lower() for f in fields}

    def holds_names(dtype: T.DataType) -> bool:
        if isinstance(dtype, T.StructType):
            return any(f.name.lower() in wanted or holds_names(f.dataType) for f in dtype.fields)
        if isinstance(dtype, T.ArrayType):
            return holds_names(dtype.elementType)
        if isinstance(dtype, T.MapType):
            return isinstance(dtype.valueType, T.StringType) or holds_names(dtype.valueType)
        return False

    def rewrite(value: Column, name: str, dtype: T.DataType) -> Column | None:
        if name.lower() in wanted:
            return masked(value)
        if isinstance(dtype, T.ArrayType):
            if not holds_names(dtype.elementType):
                return None
            return F.transform(value, lambda x: rewrite(x, "", dtype.elementType))
        if isinstance(dtype, T.MapType):
            if not holds_names(dtype):
                return None
            if isinstance(dtype.valueType, T.StringType):
                return F.transform_values(value, lambda k, v: F.when(F.lower(k.cast("string")).isin(*wanted), masked(v)).otherwise(v))
            return F.transform_values(value, lambda k, v: rewrite(v, "", dtype.valueType))
        if not isinstance(dtype, T.StructType):
            return None
        out, touched = value, False
        for f in dtype.fields:
            inner = rewrite(value.getField(f.name), f.name, f.dataType)
            if inner is not None:
                out, touched = out.withField(f"`{f.name}`", inner), True
        return out if touched else None

    changed = {}
    for f in df.schema.fields:
        new = rewrite(F.col(f"`{f.name}`"), f.name, f.dataType)
        if new is not None:
            changed[f.name] = new
    return df.withColumns(changed) if changed else df


def display_name(column: Column | str) -> Column:
    """Readable feature name: ``cat__Geography_Germany`` -> ``Geography Germany``."""
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(c, STEP_PREFIX, "")
    spaced = F.regexp_replace(F.replace(bare, F.lit("_"), F.lit(" ")), "([a-z])([A-Z])", "$1 $2")
    return F.btrim(F.initcap(spaced))
