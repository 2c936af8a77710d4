"""Schema alignment, reshaping, fills and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..functions.maths import lenient_double


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_names(columns: list[str]) -> dict[str, str]:
    """Reversible map from hostile column names to plain identifiers."""
    out, used = {}, set()
    for c in columns:
        base = "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else f"_x{ord(ch):02x}_" for ch in c)
        name, i = base, 1
        while name.lower() in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name.lower())
        out[c] = name
    return out


def align(df: DataFrame, mapping: dict[str, str | Column | None], numeric: tuple[str, ...] = ()) -> DataFrame:
    """Project to canonical names.

    A string renames, a Column computes, ``None`` is a typed null for an
    attribute the source lacks; ``numeric`` targets are cast leniently.
    """
    out = []
    for target, source in mapping.items():
        if source is None:
            c = F.lit(None).cast("double" if target in numeric else "string")
        else:
            c = quoted(source) if isinstance(source, str) else source
            if target in numeric:
                c = lenient_double(c)
        out.append(c.alias(target))
    return df.select(*out)


def keep_existing(df: DataFrame, order: list[str]) -> DataFrame:
    """Reorder to ``order`` and keep only the columns that exist."""
    have = set(df.columns)
    return df.select(*[quoted(c) for c in order if c in have])


def align_signature(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Features in model order as doubles, absent ones and nulls 0; plus the absent names."""
    have = set(df.columns)
    missing = [f for f in features if f not in have]
    cols = [
        (F.coalesce(quoted(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0)).alias(f)
        for f in features
    ]
    return df.select(*[quoted(k) for k in keep], *cols), missing


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def fill_family(df: DataFrame, marker: str, value: float) -> DataFrame:
    """Constant fill for every column whose name holds ``marker``."""
    return df.select(*[
        (F.coalesce(quoted(c), F.lit(value)) if marker in c else quoted(c)).alias(c) for c in df.columns
    ])


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*[quoted(i) for i in ids], *[quoted(v).cast("double").alias(v) for v in values]).unpivot(
        [quoted(i) for i in ids], [quoted(v) for v in values], name, value
    )


def pivot_series(df: DataFrame, index: str, series: str, value: Column, values: list[str], prefix: str) -> DataFrame:
    """One ``<prefix><series>`` column per series on the full index."""
    wide = df.groupBy(index).pivot(series, values).agg(value)
    return wide.select(index, *[quoted(v).alias(f"{prefix}{v}") for v in values])


def rename_prefixed(df: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """The column starting with ``prefix`` becomes ``<prefix>_<suffix>``."""
    return df.withColumnsRenamed({c: f"{prefix}_{suffix}" for c in df.columns if c.startswith(prefix)})


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null or absent request fields take their default."""
    have = set(df.columns)
    return df.withColumns({
        c: F.coalesce(quoted(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()
    })


def company_rows(train: DataFrame, test: DataFrame, column: str, company: str) -> DataFrame:
    """One company's rows of both parts."""
    only = F.col(column) == company
    return train.where(only).unionByName(test.where(only), allowMissingColumns=True)
