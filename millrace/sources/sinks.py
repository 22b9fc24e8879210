"""Sinks: canonical JSON lines, append-only logs, cumulative reports, partitioned caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(rows: DataFrame) -> Column:
    """A row as JSON with its keys in order and nulls kept."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as sorted canonical JSON lines in ordered part files; the commit protocol makes the write all or nothing."""
    line = canonical(rows)
    rows.select(line.alias("value"), *[F.col(o).alias(f"__{i}") for i, o in enumerate(order)]).orderBy(*[f"__{i}" for i in range(len(order))]).select("value").write.mode("overwrite").text(path)


def write_lock(states: DataFrame, path: str) -> None:
    """A snapshot's lock, and equally a change set: (path, ...) as canonical lines in the order of paths."""
    write_lines(states, path, "path")


def append(rows: DataFrame, path: str, applied_from: str) -> None:
    """Applied operations to a log, without private columns."""
    kept = rows.select(*[c for c in rows.columns if not c.startswith("_")], F.lit(applied_from).alias("applied_from"))
    kept.write.mode("append").json(path)


def write_cache(rows: DataFrame, path: str) -> None:
    """Draft records below prompt version and drafter."""
    rows.write.mode("append").partitionBy("prompt_version", "drafter").json(path)


def write_pages(rows: DataFrame, path: str, frozen: bool) -> bool:
    """Pages as Parquet unless the corpus is frozen; says whether it wrote."""
    if not frozen:
        rows.write.mode("overwrite").parquet(path)
    return not frozen


def cards(rows: DataFrame, page: str) -> DataFrame:
    """(page, json): one document per page, its rows in a list."""
    rest = [c for c in rows.columns if c != page]
    got = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("items"))
    return got.select(page, F.to_json(F.struct(F.col(page), "items"), {"ignoreNullFields": "false"}).alias("json"))


def table(rows: list, columns: list[str]) -> str:
    """Collected rows of a small report as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"
