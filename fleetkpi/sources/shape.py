"""Header handling: positions, names, aliases and column detection.

Names are metadata, so these run on the schema; rows are touched only to look at ten sample
values of one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALIASES, CODE_KEYWORDS, ROLE_KEYWORDS, SITE_COLUMNS


def select_positions(df: DataFrame, first: int, end: int) -> DataFrame:
    """Columns by position, ``end`` excluded (sheet columns B:Y are 1 to 25)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[first:end]])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def clean_names(names: Sequence[str]) -> list[str]:
    """Lower-case word names; repeated ones get ``_1``, ``_2`` …"""
    taken: list[str] = []
    for raw in names:
        text = str(raw).lower().translate(str.maketrans(" -", "__"))
        base = "".join(ch for ch in text if ch == "_" or ch.isalnum()).strip("_") or "unnamed_col"
        name, n = base, 0
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.append(name)
    return taken


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def map_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """Rename the first alias present to its canonical name, unless that name is taken."""
    names = list(df.columns)
    renames = {}
    for target, candidates in aliases.items():
        if target in names:
            continue
        found = next((c for c in candidates if c in names), None)
        if found:
            renames[found] = target
            names[names.index(found)] = target
    return df.withColumnsRenamed(renames)


def to_canonical(df: DataFrame, mapping: Mapping[str, str] = SITE_COLUMNS) -> DataFrame:
    """Project the site's columns under canonical names; absent ones are null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{source}`") if source in have else F.lit(None).cast("string")).alias(name)
            for name, source in mapping.items()
        ]
    )


def detect_code_column(df: DataFrame, order_by: str | None = None) -> str | None:
    """The column that holds machine codes, by name or else by ten sample values."""
    for name in df.columns:
        if any(word in name.lower() for word in CODE_KEYWORDS):
            return name
    first = df.columns[0]
    text = F.col(f"`{first}`").cast("string")
    sample = df.select(text.alias("v"), F.col(order_by or first).alias("o")).filter("v is not null")
    hits = sample.orderBy("o").limit(10).filter(F.col("v").contains("-") & (F.length("v") >= 5))
    return None if hits.isEmpty() else first


def detect_roles(df: DataFrame) -> dict[str, list[str]]:
    found = {
        role: [c for c in df.columns if any(word in c.upper() for word in words)]
        for role, words in ROLE_KEYWORDS.items()
    }
    return {role: columns for role, columns in found.items() if columns}
