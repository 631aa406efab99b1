"""Text formats: event recordings and cycles as CSV or JSON files, read and written by Spark.

Files are read whole, one row each, and parsed where they are; a file that breaks a rule gives a row in the error
column instead of events, so one bad file doesn't stop a load.
"""

from __future__ import annotations

import csv
import io
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?")
TIMES = ("t", "time", "timestamp")
#: Column names that say what is measured, without case, blanks, `_` and `-` (fixed values).
KNOWN = {"frequency": "frequency", "freq": "frequency", "f": "frequency", "pri": "pri", "pulsewidth": "pulse-width", "pw": "pulse-width"}
EVENTS = "path string, recording string, event_idx long, t double, values map<string,double>, error string"
SAMPLES = "path string, metadata map<string,string>, t double, f double, missing boolean, error string"


#: Characters of a cycle file (fixed value).
MOST_CHARS = 2_000_000


def number(cell: str) -> float | None:
    """A cell's number; blank and `null` are missing values. Anything else is an error."""
    cell = cell.strip()
    if cell in ("", "null"):
        return None
    if not NUMBER.fullmatch(cell) or not math.isfinite(float(cell)):
        raise ValueError(f"not a number: {cell}")
    return float(cell)


def channels_of(header: list[str], declared: list[dict] | None) -> list[dict]:
    """S3: the channels of CSV columns: those declared, in the same order, or known names."""
    if declared is not None:
        if [c["id"] for c in declared] != header:
            raise ValueError("declared channels and columns differ")
        return declared
    found = [{"id": h, "quantity": KNOWN.get(re.sub(r"[_\s-]", "", h.lower()))} for h in header]
    if any(c["quantity"] is None for c in found):
        raise ValueError("columns of unknown names must be declared")
    return found


def parse_events(text: str) -> tuple[dict, list[tuple[float, dict]]]:
    """A recording's metadata and its events, from JSON (text starting with a brace) or CSV."""
    text = text.removeprefix("﻿")
    if text.lstrip().startswith("{"):
        whole = json.loads(text)
        names = [c["id"] for c in whole["channels"]]
        events = []
        for e in whole.pop("events"):
            if set(e["values"]) != set(names):
                raise ValueError("every event must have every channel; null where it is missing")
            events.append((float(e["t"]), {k: None if e["values"][k] is None else float(e["values"][k]) for k in names}))
        return whole, events
    lines, meta = [], {}
    for line in text.splitlines():
        if line.startswith("# recording:"):
            meta = json.loads(line.split(":", 1)[1])
        elif line.strip() and not line.startswith("#"):
            lines.append(line)
    rows = list(csv.reader(lines, strict=True))
    if not rows or rows[0][0].strip().lower() not in TIMES:
        raise ValueError("the first column must be the time")
    header = [h.strip() for h in rows[0][1:]]
    if len(set(header)) != len(header) or not header:
        raise ValueError("columns must have different names")
    meta["channels"] = channels_of(header, meta.get("channels"))
    events = []
    for n, row in enumerate(rows[1:], 2):
        if len(row) != len(header) + 1:
            raise ValueError(f"row {n} has {len(row)} cells")
        t = number(row[0])
        if t is None:
            raise ValueError(f"row {n} has no time")
        events.append((t, dict(zip(header, map(number, row[1:]), strict=True))))
    return meta, events


def parse_cycle(text: str) -> tuple[dict[str, str], list[tuple[float, float | None]]]:
    """Metadata lines `# key: value` and rows of `t,f` (or `t,pri`); a blank value is missing. A text that begins
    with a brace is JSON with `samples` of t and f, `missingTimes`, and the metadata beside them."""
    text = text.removeprefix("﻿")
    if len(text) > MOST_CHARS:
        raise ValueError(f"more than {MOST_CHARS} characters")
    if text.lstrip().startswith("{"):
        whole = json.loads(text)
        samples = [(float(s["t"]), None if s["f"] is None else float(s["f"])) for s in whole["samples"]]
        samples += [(float(t), None) for t in whole.get("missingTimes") or []]
        if not all(math.isfinite(x) for row in samples for x in row if x is not None):
            raise ValueError("times and values must be finite")
        return {k.lower(): v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in whole.items() if k not in ("samples", "missingTimes")}, sorted(samples, key=lambda s: s[0])
    meta, rows = {}, []
    for line in text.splitlines():
        if line.startswith("#"):
            key, _, value = line[1:].partition(":")
            meta[key.strip().lower()] = value.strip()
        elif line.strip():
            rows.append([c.strip() for c in line.split(",")])
    if not rows or [c.lower() for c in rows[0]] not in (["t", "f"], ["t", "pri"]):
        raise ValueError("columns must be t and f")
    found = []
    for n, row in enumerate(rows[1:], 2):
        if len(row) != 2 or (t := number(row[0])) is None:
            raise ValueError(f"row {n} is not a time and a value")
        found.append((t, number(row[1])))
    return meta, found


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files at path: (path, recording as JSON, event_idx, t, values, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["path"], batch["value"], strict=True):
                try:
                    meta, events = parse_events(text)
                    about = json.dumps(meta, sort_keys=True)
                    out += [(name, about, k, t, v, None) for k, (t, v) in enumerate(events)]
                except (ValueError, KeyError, TypeError, csv.Error) as e:
                    out.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "recording", "event_idx", "t", "values", "error"])

    return _whole_files(spark, path).mapInPandas(run, EVENTS)


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all cycle files at path: (path, metadata, t, f, missing, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch["path"], batch["value"], strict=True):
                try:
                    meta, rows = parse_cycle(text)
                    out += [(name, meta, t, f, f is None, None) for t, f in rows]
                except ValueError as e:
                    out.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "metadata", "t", "f", "missing", "error"])

    return _whole_files(spark, path).mapInPandas(run, SAMPLES)


def event_csv(metadata: dict, events: DataFrame, names: list[str]) -> DataFrame:
    """K2: the lines of one recording's CSV, in order: metadata, header, and a row an event; null is blank."""
    head = events.sparkSession.createDataFrame([(-2, f"# recording: {json.dumps(metadata, sort_keys=True)}"), (-1, ",".join(["t", *names]))], "n long, value string")
    cells = [F.coalesce(F.col("values")[n].cast("string"), F.lit("")) for n in names]
    rows = events.select(F.col("event_idx").alias("n"), F.concat_ws(",", F.col("t").cast("string"), *cells).alias("value"))
    return head.unionByName(rows).orderBy("n").select("value")


def cycle_csv(metadata: dict[str, str], samples: DataFrame) -> DataFrame:
    """The lines of one cycle's CSV: missing times go back among the samples as blank values."""
    head = samples.sparkSession.createDataFrame([(float(k - len(metadata) - 1), f"# {a}: {b}") for k, (a, b) in enumerate(sorted(metadata.items()))] + [(-1.0, "t,f")], "n double, value string")
    head = head.select(F.lit(0).alias("part"), "n", "value")
    rows = samples.select(F.lit(1).alias("part"), F.col("t").alias("n"), F.concat_ws(",", F.col("t").cast("string"), F.coalesce(F.col("f").cast("string"), F.lit(""))).alias("value"))
    return head.unionByName(rows).orderBy("part", "n").select("value")


def cycle_json(metadata: dict[str, str], samples: DataFrame) -> DataFrame:
    """K1: one row a cycle: its JSON, with samples and missing times in order of time. samples: (cycle_id, t, f)."""
    listed = samples.groupBy("cycle_id").agg(F.array_sort(F.collect_list(F.struct("t", "f"))).alias("all"))
    seen = F.filter("all", lambda x: x["f"].isNotNull())
    missing = F.transform(F.filter("all", lambda x: x["f"].isNull()), lambda x: x["t"])
    about = [F.lit(v).alias(k) for k, v in sorted(metadata.items())]
    return listed.select("cycle_id", F.to_json(F.struct(*about, seen.alias("samples"), missing.alias("missingTimes"))).alias("value"))
