"""Choosing, dropping and expanding columns by their names and types."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast.functions.scalars import quoted


def cols_like(df: DataFrame | Iterable[str], starts: str | Sequence[str] = (), contains: str | Sequence[str] = (),
              ends: str | Sequence[str] = ()) -> list[str]:
    """Column names, in table order, that start with, contain or end with any of the given texts."""
    names = df.columns if isinstance(df, DataFrame) else list(df)
    many = lambda x: (x,) if isinstance(x, str) else tuple(x)
    starts, contains, ends = many(starts), many(contains), many(ends)
    return [n for n in names
            if n.startswith(starts) or n.endswith(ends) or any(part in n for part in contains)]


def candidate_features(df: DataFrame) -> list[str]:
    """Diagnosis counts, lab statistics and categories by name, then age and sex."""
    names = {c.lower(): c for c in df.columns}
    out = cols_like(df, starts="n_") + cols_like(df, contains=": ") + cols_like(df, contains=">>>")
    return out + [names[c] for c in ("pat_age", "sex_c") if c in names]


def logistic_candidates(columns: Sequence[str]) -> list[str]:
    """Last lab values, then names containing ``n_``, then age and sex."""
    names = {c.lower(): c for c in columns}
    out = cols_like(columns, contains=": last") + cols_like(columns, contains="n_")
    return list(dict.fromkeys(out + [names[c] for c in ("pat_age", "sex_c") if c in names]))


def unscaled_inputs(columns: Sequence[str]) -> list[str]:
    """Counts, deviations and shares of ordered tests: inputs of a logistic model that are taken as they are."""
    return cols_like(columns, contains=(": count", ": std", ": prop STAT ordered"))


def drop_columns(df: DataFrame, names: Sequence[str] = ("pat_id", "empi", "appt_date")) -> DataFrame:
    """Drop index residue (``Unnamed...``) and the named columns that are there."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed") or c in names])


def fill_missing(df: DataFrame, number: float = 0, text: str = "0") -> DataFrame:
    """Missing numbers and texts to zero."""
    return df.na.fill(number).na.fill(text)


def category_values(df: DataFrame, column: str, limit: int = 1000) -> list[str]:
    """The sorted distinct values of a column that becomes one column per value.

    A value is a column of the result, so there cannot be many; more than ``limit`` is an error, not a cut.
    """
    values = [r[0] for r in df.select(F.col(quoted(column))).where(F.col(quoted(column)).isNotNull())
              .distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values, too many for one column each")
    return sorted(values)


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = False,
            values: dict[str, Sequence[str]] | None = None, sep: str = "_") -> DataFrame:
    """Replace each column by 0/1 columns ``<column><sep><value>``; a missing value is 0 in all of them."""
    values = values or {}
    out = [F.col(quoted(c)) for c in df.columns if c not in columns]
    for c in columns:
        vals = list(values.get(c) or category_values(df, c))
        out += [F.coalesce((F.col(quoted(c)) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}{sep}{v}")
                for v in vals[1 if drop_first else 0:]]
    return df.select(*out)


def one_hot_strings(df: DataFrame, drop_first: bool = True) -> DataFrame:
    """``one_hot`` of every text column."""
    return one_hot(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)], drop_first)
