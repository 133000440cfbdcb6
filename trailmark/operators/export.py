"""Export rows and what changed in them since the original roster."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.cells import canonical, differs, format_cell
from trailmark.functions.numbers import to_completed
from trailmark.functions.text import normalise_id, text_of
from trailmark.operators.joins import join_by_key

HELPERS = ["status_ordered", "first_log_text"]


def project_export(processed: DataFrame) -> DataFrame:
    """Columns that are handed out: ordered stages in place of the plain ones, no helpers."""
    df = processed
    if "status_ordered" in df.columns:
        stages = [c for c in ("status", "funnel_stage") if c == "status" or c in df.columns]
        df = df.withColumns({c: F.col("status_ordered") for c in stages})
    if "first_log_text" in df.columns:
        df = df.withColumn("first_log_at", F.coalesce(format_cell(df, "first_log_at"), "first_log_text"))
    return df.drop(*HELPERS)


def export_cell(df: DataFrame, name: str) -> Column:
    """Cell as it is written; completion is always true or false."""
    return to_completed(F.col(name)) if name == "completed" else format_cell(df, name)


def export_rows(processed: DataFrame) -> DataFrame:
    """Processed participants as they are handed out."""
    df = project_export(processed)
    return df.select(*[export_cell(df, c).alias(c) for c in df.columns])


def latest_rows(original: DataFrame, order_by: str) -> DataFrame:
    """Last row per normalised id, every cell as text, in one column ``old``."""
    cells = F.struct(*[text_of(original, c).alias(c) for c in original.columns if c != order_by])
    return (
        original.select(normalise_id(text_of(original, "id")).alias("match_id"), F.col(order_by), cells.alias("old"))
        .groupBy("match_id")
        .agg(F.max_by("old", order_by).alias("old"))
    )


def fingerprint(cells: str) -> Column:
    """128 bits of the canonical forms of an array of cells."""
    forms = F.transform(cells, lambda x: F.coalesce(canonical(x), F.lit("")))  # no form is the empty text
    return F.struct(F.xxhash64(forms).alias("a"), F.xxhash64(F.lit(1), forms).alias("b"))


def export_diff(
    processed: DataFrame, original: DataFrame | None, cfg: ProgressConfig, order_by: str = "row_no"
) -> DataFrame:
    """Export rows with ``change_kind`` (new, changed, same) and ``changed_columns``.

    A row is new if its id is not in the original; without an original every
    row is.  Only columns of both tables are compared.
    """
    none = F.array().cast("array<string>")
    if original is None:
        return export_rows(processed).withColumns({"change_kind": F.lit("new"), "changed_columns": none})
    df = project_export(processed)
    keyed = df.withColumn("match_id", normalise_id(text_of(df, "id")))
    joined = join_by_key(keyed, latest_rows(original, order_by), "match_id", "left")
    shared = [c for c in df.columns if c in original.columns and c != order_by]
    names = F.array(*map(F.lit, shared))
    new = F.array(*[(F.col(c) if c == "completed" else format_cell(df, c)).cast("string") for c in shared])
    joined = joined.withColumns({"_new": new, "_old": F.array(*[F.col(f"old.{c}") for c in shared])})
    joined = joined.withColumns({"_new_form": fingerprint("_new"), "_old_form": fingerprint("_old")})
    # Rows of one fingerprint are the same; of the others only cells whose canonical forms differ are compared by kinds.
    cells = F.arrays_zip(names.alias("name"), F.col("_new").alias("new"), F.col("_old").alias("old"))
    unlike = F.filter(cells, lambda x: ~canonical(x["new"]).eqNullSafe(canonical(x["old"])))
    different = F.filter(unlike, lambda x: differs(x["new"], x["old"], cfg.dayfirst_fallback))
    found = F.col("old").isNotNull()
    same = F.col("_new_form") == F.col("_old_form")
    changed = F.when(found & ~same, F.transform(different, lambda x: x["name"])).otherwise(none)
    kind = F.when(~found, "new").when(F.size("changed_columns") > 0, "changed").otherwise("same")
    return joined.withColumn("changed_columns", changed).select(
        *[export_cell(df, c).alias(c) for c in df.columns], kind.alias("change_kind"), "changed_columns"
    )


def in_roster_order(rows: DataFrame, order_by: str = "row_no") -> DataFrame:
    """Rows dealt and sorted so that the files they are written to, in the order of their names, have the roster's order."""
    if order_by not in rows.columns:
        return rows
    return rows.repartitionByRange(order_by).sortWithinPartitions(order_by)


def write_export(rows: DataFrame, folder: str, day: date) -> str:
    """Rows of :func:`export_diff` written as Parquet and as CSV below a folder of the day, which is returned.

    The files of both, in the order of their names, hold the rows in the order of the uploaded roster.  CSV has the
    names of changed columns joined by commas.  An export of the same day replaces the one before.
    """
    target = f"{folder.rstrip('/')}/{day.isoformat()}"
    in_roster_order(rows).write.mode("overwrite").parquet(f"{target}/parquet")
    written = rows.sparkSession.read.parquet(f"{target}/parquet")
    flat = in_roster_order(written.withColumn("changed_columns", F.array_join("changed_columns", ",")))
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    flat.write.mode("overwrite").csv(f"{target}/csv", header=True, **kept)
    return target
