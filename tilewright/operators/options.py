"""Options, presets and records of builds as key-value tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_keys(record: DataFrame, current: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Keys whose value differs between two maps; a missing key differs from any value."""
    a = record.select(key, F.col(value).alias("_a"))
    b = current.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def merge_presets(built_in: DataFrame, own: DataFrame, key: list[str]) -> DataFrame:
    """Built-in rows, replaced by own rows of the same key."""
    both = built_in.withColumn("_own", F.lit(0)).unionByName(own.withColumn("_own", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_own"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_own")


def rendered(values: DataFrame, schema: DataFrame) -> DataFrame:
    """One row with the command-line flags of the values in the schema's order; unknown and null values are left out."""
    flags = schema.join(values.where("value IS NOT NULL"), "key").select("seq", F.concat(F.lit("--"), "flag", F.lit("="), "value").alias("text"))
    return flags.agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("f")).select(F.transform("f", lambda x: x["text"]).alias("flags"))


def unknown_keys(values: DataFrame, schema: DataFrame) -> DataFrame:
    return values.join(schema.select("key"), "key", "left_anti")


def typed(values: DataFrame, schema: DataFrame) -> DataFrame:
    """Values by the schema's kind; ``ok`` is false where a value is not of its kind."""
    both = values.join(schema, "key")
    number, flag = F.col("value").try_cast("double"), F.lower("value").isin("true", "false")
    ok = F.when(F.col("kind") == "bool", flag).when(F.col("kind") == "int", F.col("value").rlike("^-?[0-9]+$")).when(F.col("kind") == "float", number.isNotNull()).otherwise(True)
    return both.select("key", "value", "kind", F.coalesce(ok, F.lit(False)).alias("ok"))


def step_status(outputs: DataFrame, listing: DataFrame, record: DataFrame, current: DataFrame) -> DataFrame:
    """(step, status): missing, options_changed, built or untracked.

    outputs (step, path), listing (path, size), record and current (step, name, value). An output
    of no bytes counts as missing; a step without a record is built but untracked.
    """
    files = outputs.join(listing, "path", "left").groupBy("step").agg(F.min(F.coalesce("size", F.lit(0))).alias("least"))
    tracked = record.select("step").distinct().withColumn("tracked", F.lit(True))
    a = record.select("step", "name", F.col("value").alias("_a"))
    b = current.select("step", "name", F.col("value").alias("_b"))
    changed = a.join(b, ["step", "name"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("step").distinct().withColumn("changed", F.lit(True))
    status = (
        F.when(F.col("least") <= 0, "missing").when(F.col("tracked").isNull(), "untracked").when(F.col("changed"), "options_changed").otherwise("built")
    )
    return files.join(tracked, "step", "left").join(changed, "step", "left").select("step", status.alias("status"))


def all_statuses(steps: DataFrame, statuses: DataFrame) -> DataFrame:
    """``(step, status)`` of every step of ``steps``; those without any output listed are missing."""
    return steps.select("step").distinct().join(statuses, "step", "left").fillna("missing", ["status"])


def latest_status(events: DataFrame, step: str, order: str, fields: list[str]) -> DataFrame:
    """The last value that each field had in a step's events; an event that leaves a field out does not clear it."""
    return events.groupBy(step).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def grouped_options(options: DataFrame, group: str, option: str, order: str) -> DataFrame:
    """``(group, options)``: each group's options in the order they first come in."""
    first = options.groupBy(group, option).agg(F.min(order).alias("_first"))
    listed = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_first", option))).alias("o"))  # of one group
    return listed.select(group, F.transform("o", lambda x: x[option]).alias("options"))


def chosen_bounds(explicit: DataFrame, shape: DataFrame, basemap: DataFrame, by: str) -> DataFrame:
    """``(by, bounds)``: what was said explicitly, else the shape's, else the basemap's; an error where there is none."""
    a, b, c = (t.select(by, F.col("bounds").alias(n)) for t, n in ((explicit, "_a"), (shape, "_b"), (basemap, "_c")))
    both = a.join(b, by, "full_outer").join(c, by, "full_outer")
    chosen = F.coalesce("_a", "_b", "_c")
    return both.select(by, F.when(chosen.isNotNull(), chosen).otherwise(F.raise_error(F.lit("no bounds or shape given, and no basemap to take them from"))).alias("bounds"))


def in_order_of(*candidates: DataFrame) -> DataFrame:
    """The rows of all lists, repeats and all, with ``place``: the list they come from."""
    out = None
    for n, c in enumerate(candidates):
        c = c.withColumn("place", F.lit(n))
        out = c if out is None else out.unionByName(c)
    return out


def first_with_length(found: DataFrame, by: str) -> DataFrame:
    """``(by, source, file_len)``: of the sources in their order, the first that knows the file's length."""
    known = found.where("file_len IS NOT NULL")
    return known.groupBy(by).agg(F.min_by(F.struct("source", "file_len"), "place").alias("s")).select(by, "s.source", "s.file_len")


def command_lines(lines: DataFrame, by: str, order: str, line: str = "line") -> DataFrame:
    """``(by, name, description)`` of a program's commands, from the block of its help between ``Commands:`` and a blank line.

    ``help`` itself is left out. The lines of one program's help are few.
    """
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    clean = F.trim(line)
    head = F.max(F.startswith(clean, F.lit("Commands:")).cast("int")).over(before)
    inside = lines.withColumn("_in", F.coalesce(head, F.lit(0)) == 1)
    blank = F.max((F.col("_in") & (clean == "")).cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = inside.withColumn("_over", blank == 1).where("_in AND NOT _over")
    name = F.regexp_extract(clean, r"^(\S+)", 1)
    return rows.where((name != "help") & (name != "")).select(by, name.alias("name"), F.trim(F.regexp_extract(clean, r"^\S+\s*(.*)$", 1)).alias("description"))
