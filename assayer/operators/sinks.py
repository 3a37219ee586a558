"""Small report files: numbers rounded at the driver, fixed columns, manifests."""

from __future__ import annotations

import csv
import math
import os
import tempfile

from pyspark.sql import DataFrame

MOST_ROWS = 10_000


def number(value: object, digits: int = 4, missing: str = "NaN") -> str:
    """Text of a metric, rounded on its exact binary value."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return missing
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def rounded(rows: list[dict], digits: int) -> list[dict]:
    return [{k: round(v, digits) if isinstance(v, float) and math.isfinite(v) else v for k, v in r.items()} for r in rows]


def report_rows(df: DataFrame) -> list[dict]:
    """The rows of a report; larger tables belong in a written table."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of over {MOST_ROWS} rows")
    return [r.asDict() for r in rows]


def write_csv(rows: list[dict], path: str, columns: list[str], blank: dict[str, set[str]] | None = None, digits: int = 4, table: str = "") -> None:
    """Atomic: a temporary file in the same folder takes the old one's place. Metrics not of this table stay blank."""
    unknown = {k for r in rows for k in r} - set(columns)
    if unknown:
        raise ValueError(f"columns without a place: {sorted(unknown)}")
    skip = (blank or {}).get(table, set())
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(columns)
            for r in rows:
                out.writerow(["" if c in skip else number(r.get(c), digits) for c in columns])
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def manifest_lines(digests: DataFrame) -> list[str]:
    return [f"{r['digest']}  {r['path']}" for r in digests.orderBy("path").toLocalIterator()]


def leaderboard_text(rows: list[dict], columns: list[str], digits: int = 2) -> str:
    table = [columns, *([number(r.get(c), digits, "N/A") for c in columns] for r in rows)]
    widths = [max(len(r[k]) for r in table) for k in range(len(columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in table)
