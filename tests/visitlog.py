"""Small visit logs for tests."""

from __future__ import annotations

from fleetkpi.schema import VISITS

AS_OF = "2024-12-31 00:00:00"


def visits(spark, rows):
    """Rows are (id, code, entry[, exit[, system]]) with times as text; the rest is filled in."""
    full = []
    for row in rows:
        visit_id, code, entry, leave, system = (*row, None, None)[:5]
        full.append((visit_id, code, entry, leave, system or "MOTOR", "CORRECTIVA", None, "F1", "C1"))
    kinds = ", ".join(
        f"{f.name} {'string' if f.name.startswith('fecha') else f.dataType.simpleString()}"
        for f in VISITS.fields
    )
    df = spark.createDataFrame(full, kinds)
    return df.withColumns({c: df[c].cast("timestamp") for c in ("fecha_in", "fecha_out")})


def values(df, key, *columns):
    """{key: value or tuple of values} of a small result."""
    return {
        row[key]: row[columns[0]] if len(columns) == 1 else tuple(row[c] for c in columns)
        for row in df.collect()
    }
