"""Deep differences of JSON records, and where a wrong value came from."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

ABSENT = object()


def differences(old, new, path: str = "", skip: str = "") -> Iterator[tuple]:
    """(path, change, old, new) of two JSON values; a subtree of one side only is one row at its highest missing ancestor.

    Objects are compared by key in the order of the keys, arrays by place. Keys that begin with `skip`, if any, are left out.
    """
    if isinstance(old, dict) and isinstance(new, dict):
        steps = ((f"{path}.{k}" if path else k, old.get(k, ABSENT), new.get(k, ABSENT)) for k in sorted(old.keys() | new.keys()) if not (skip and k.startswith(skip)))
    elif isinstance(old, list) and isinstance(new, list):
        steps = ((f"{path}[{i}]", old[i] if i < len(old) else ABSENT, new[i] if i < len(new) else ABSENT) for i in range(max(len(old), len(new))))
    else:
        if old != new:
            yield path or "(root)", "changed", old, new
        return
    for at, a, b in steps:
        if a is ABSENT:
            yield at, "added", None, b
        elif b is ABSENT:
            yield at, "removed", a, None
        else:
            yield from differences(a, b, at, skip)


def deep_diff(old: DataFrame, new: DataFrame, key: str, record: str, *, skip: str = "") -> DataFrame:
    """Rows (key, path, change, old, new) of the JSON records that both sides have; old and new are JSON, null for the side that lacks the path.

    A record that is no JSON is compared as a string. Records of one side only are rows with the path (record).
    """
    both = old.select(key, F.col(record).alias("old")).join(new.select(key, F.col(record).alias("new")), key, "full")
    both = both.filter(~F.col("old").eqNullSafe(F.col("new")))
    kind = dict(both.dtypes)[key]

    def parsed(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda v, there: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if there else None
        for b in batches:
            rows: list[tuple] = []
            for i, (a, c) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if a is None or c is None:
                    rows.append((i, "(record)", "added" if a is None else "removed", a, c))
                    continue
                rows += [(i, path, change, shown(x, change != "added"), shown(y, change != "removed")) for path, change, x, y in differences(parsed(a), parsed(c), skip=skip)]
            columns = [pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.string()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(columns[0]), *columns[1:]], [key, "path", "change", "old", "new"])

    return both.select(key, "old", "new").mapInArrow(run, f"`{key}` {kind}, path string, change string, old string, new string")


def _holds(data, value: str) -> bool:
    if data == value:
        return True
    if isinstance(data, dict):
        return any(_holds(v, value) for v in data.values())
    return isinstance(data, list) and any(_holds(v, value) for v in data)


@F.pandas_udf(StructType([StructField("there", BooleanType()), StructField("elsewhere", BooleanType())]))
def found_at(records: pd.Series, fields: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Whether a JSON record holds a value at a dotted field or below it, and whether it does anywhere."""
    out = []
    for record, field, value in zip(records, fields, values, strict=True):
        data = at = json.loads(record)
        for step in field.split("."):
            at = at.get(step) if isinstance(at, dict) else None
        out.append((_holds(at, value), _holds(data, value)))
    return pd.DataFrame(out, columns=["there", "elsewhere"])


def trace_origin(issues: DataFrame, lineage: DataFrame, stages: DataFrame, *, last: str = "clean") -> DataFrame:
    """Where each issue's value came in: the distinct issues with introduced_at, origin_field and source_field.

    issues: (id, field_path, value); lineage: (field, step from 1 on, stage, stage_field); stages: (id, stage, record as
    JSON). A path's lineage is that of the longest field that the path, without places in arrays, begins with: all its
    prefixes are joined and the longest is kept. The walk goes back over the stages whose record is there, as long as the
    value is found at the stage's field. Where it is not, the stage before brought the value in, and the stage's field
    is the source if the record holds the value elsewhere. Without a lineage the stage is `unknown`.
    """
    key = ["id", "field_path", "value"]
    rows = issues.select(*key).distinct().withColumn("base", F.regexp_replace("field_path", r"\[\d+\]", ""))
    prefixes = F.transform(F.sequence(F.lit(1), F.char_length("base")), lambda n: F.substring("base", F.lit(1), n))
    known = rows.select("base").distinct().withColumn("field", F.explode(prefixes)).join(lineage.select("field").distinct(), "field")
    rows = rows.join(known.groupBy("base").agg(F.max_by("field", F.char_length("field")).alias("field")), "base", "left")
    steps = rows.filter("field is not null").join(lineage, "field").join(stages, ["id", "stage"])
    steps = steps.select(*key, "step", "stage", "stage_field", found_at("record", "stage_field", "value").alias("f"))
    walk = Window.partitionBy(*key).orderBy("step")  # as many rows as an issue's lineage has steps
    steps = steps.withColumns({"before_stage": F.lag("stage").over(walk), "before_field": F.lag("stage_field").over(walk)})
    end = F.struct("before_stage", "before_field", F.when(F.col("f.elsewhere"), F.col("stage_field")).alias("source_field"))
    ended = F.min_by(F.when(~F.col("f.there"), end), F.when(~F.col("f.there"), F.col("step")))
    walked = steps.groupBy(*key).agg(ended.alias("end"), F.max_by(F.struct("stage", "stage_field"), "step").alias("first"))
    out = rows.join(walked, key, "left")
    none, stopped = F.col("field").isNull(), F.col("end").isNotNull()
    stage = F.when(none, "unknown").when(stopped, F.coalesce("end.before_stage", F.lit(last))).otherwise(F.coalesce("first.stage", F.lit(last)))
    field = F.when(none, F.col("field_path")).when(stopped, F.coalesce("end.before_field", "field_path")).otherwise(F.coalesce("first.stage_field", "field_path"))
    return out.select(*key, stage.alias("introduced_at"), field.alias("origin_field"), F.col("end.source_field").alias("source_field"))


def stage_trace(stages: DataFrame, fields: tuple[tuple[str, str, str], ...], order: tuple[str, ...]) -> DataFrame:
    """Each record's fields over the stages it went through: rows (id, field, trace, first_value, last_value, changed_at, lost_at, held).

    stages: (id, stage, record as JSON), one record a stage; fields: (field, stage, JSON path); order: the stages from the
    first on. trace lists (stage, value) of the stages that hold a value; held is their number. changed_at is the first of
    them whose value is not that of the one before, lost_at the first stage of `order` after a holding one that lacks the
    value, be it that its record lacks the path, that it has no path for the field, or that the record is not there. A field
    that no stage of a record holds has no row. One grouping by (id, field), of as many values as there are stages.
    """
    spark = stages.sparkSession
    places = spark.createDataFrame([(f, s, order.index(s), p) for f, s, p in fields], "field string, stage string, step int, path string")
    rows = stages.join(F.broadcast(places), "stage")  # the paths given, a parameter
    values = rows.select("id", "field", "step", "stage", F.expr("get_json_object(record, path)").alias("value")).filter("value is not null")
    trace = F.array_sort(F.collect_list(F.struct("step", "stage", "value")))
    return _told(values.groupBy("id", "field").agg(trace.alias("t")), "id", order)


def record_trace(records: DataFrame, key: str, fields: tuple[tuple[str, str, str], ...], order: tuple[str, ...]) -> DataFrame:
    """The same as stage_trace, of rows that have all stages of a record, each as a column of JSON named by its stage.

    A row's traces are made in place: nothing is joined, grouped or shuffled, and paths are literals, parsed once and not for each row.
    """
    held = lambda s, path: F.struct(F.lit(order.index(s)).alias("step"), F.lit(s).alias("stage"), F.get_json_object(s, path).alias("value"))
    paths: dict[str, list[Column]] = {}
    for f, s, path in fields:
        paths.setdefault(f, []).append(held(s, path))
    traces = [x for f, values in paths.items() for x in (F.lit(f), F.array_sort(F.filter(F.array(*values), lambda v: v["value"].isNotNull())))]
    # stack, not an exploded array: Spark tests an array's size before it explodes it, down at the scan, which builds the records once more
    rows = records.select(key, F.stack(F.lit(len(paths)), *traces).alias("field", "t"))
    return _told(rows.filter(F.size("t") > 0), key, order)


def _told(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Rows (key, field, t), with t the sorted (step, stage, value) that hold a value, as a trace and its changes."""
    t = F.col("t")
    after = F.zip_with(F.slice(t, F.lit(2), F.size(t) - 1), F.slice(t, F.lit(1), F.size(t) - 1), lambda b, a: F.when(b["value"] != a["value"], b["stage"]))
    steps = F.transform(t, lambda x: x["step"])
    missing = F.filter(F.sequence(F.array_min(steps), F.lit(len(order) - 1)), lambda i: ~F.array_contains(steps, i))
    names = F.array(*map(F.lit, order))
    return rows.select(
        key, "field", F.transform(t, lambda x: F.struct(x["stage"].alias("stage"), x["value"].alias("value"))).alias("trace"),
        F.try_element_at(t, F.lit(1))["value"].alias("first_value"), F.try_element_at(t, F.lit(-1))["value"].alias("last_value"),
        F.try_element_at(F.filter(after, lambda s: s.isNotNull()), F.lit(1)).alias("changed_at"), F.get(names, F.array_min(missing)).alias("lost_at"), F.size(t).alias("held"),
    )
