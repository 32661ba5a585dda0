"""Reports: canonical JSON and atomic files on the driver, tables as Parquet beside them."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: What no key of a report may hold, for it would claim a latent property.
LATENT = ("advance", "bearing", "em_size", "font", "glyph_name", "kern", "leading", "point_size", "typeface", "tracking", "word_space", "_mm", "_pt", "_inch", "_dpi")


class DestinationError(ValueError):
    """A report may not be written there."""


def compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def pretty(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def write_report(value: object, path: str, corpus: str | None = None) -> None:
    """Write a JSON report in one step: a staged file, synced, then renamed; never inside the corpus."""
    target = Path(path).resolve()
    if corpus is not None and Path(corpus).resolve() in (target, *target.parents):
        raise DestinationError(f"{target} lies inside the corpus")
    handle, staged = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(pretty(value))
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, target)
    except BaseException:
        Path(staged).unlink(missing_ok=True)
        raise
    folder = os.open(target.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def rows(df: DataFrame):
    """Rows as plain values, in the table's order, a partition at a time."""
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)


def latent_keys(value: object, path: str = "") -> list[str]:
    """Paths of the keys anywhere in a JSON tree that claim a latent property: that hold one of its names, in any case."""
    if isinstance(value, dict):
        at = {k: f"{path}.{k}" if path else str(k) for k in value}
        return [at[k] for k in value if any(t in str(k).lower() for t in LATENT)] + [x for k, v in value.items() for x in latent_keys(v, at[k])]
    return [x for i, v in enumerate(value) for x in latent_keys(v, f"{path}[{i}]")] if isinstance(value, list | tuple) else []


#: What an estimate says of itself.
ESTIMATE = {"unit": "px", "frame": "source", "confidence_kind": "uncalibrated"}


def estimate_faults(value: object, path: str = "") -> list[str]:
    """Faults of the estimates below every key `estimates` of a JSON tree: no object, another unit, frame or kind, or a confidence."""
    out = []
    if isinstance(value, dict):
        found = value.get("estimates")
        for i, e in enumerate(found if isinstance(found, list | tuple) else ()):
            at = f"{path}.estimates[{i}]" if path else f"estimates[{i}]"
            if not isinstance(e, dict):
                out.append(f"{at}: no object")
                continue
            out += [f"{at}: {k} is {e.get(k)!r}" for k, v in ESTIMATE.items() if e.get(k) != v]
            out += [f"{at}: confidence"] if e.get("confidence") is not None else []
        return out + [x for k, v in value.items() for x in estimate_faults(v, f"{path}.{k}" if path else str(k))]
    return [x for i, v in enumerate(value) for x in estimate_faults(v, f"{path}[{i}]")] if isinstance(value, list | tuple) else out


def json_schema(df: DataFrame) -> dict:
    """A JSON Schema of a table's rows as JSON objects: types, fields in order, which may be null, and none besides."""
    from pyspark.sql import types as T

    plain = {T.StringType: "string", T.BooleanType: "boolean", T.IntegerType: "integer", T.LongType: "integer", T.ShortType: "integer", T.ByteType: "integer", T.DoubleType: "number", T.FloatType: "number", T.BinaryType: "string"}

    def of(kind: T.DataType, nullable: bool) -> dict:
        if isinstance(kind, T.StructType):
            out = {"type": "object", "properties": {f.name: of(f.dataType, f.nullable) for f in kind.fields}, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
        elif isinstance(kind, T.ArrayType):
            out = {"type": "array", "items": of(kind.elementType, kind.containsNull)}
        elif isinstance(kind, T.MapType):
            out = {"type": "object", "additionalProperties": of(kind.valueType, kind.valueContainsNull)}
        else:
            out = {"type": plain.get(type(kind), "string")}
        return out | {"type": [out["type"], "null"]} if nullable else out

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of(df.schema, False)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


#: Version of the reports that stages write, and the algorithm that they name.
VERSION, ALGORITHM = 1, "inkfold/1"


class ReportError(ValueError):
    """A report is not one of ours, of this version, whole and unchanged."""


def digest(df: DataFrame) -> str:
    """A table's fingerprint whatever its order: the number of rows and the sum of two hashes of each."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    total = df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.concat(F.lit("+"), row)).alias("b")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"]).first()
    return f"{total['n']}:{total['a'] or 0}:{total['b'] or 0}"


def described(table: DataFrame) -> dict:
    return {"rows": table.count(), "schema": schema_json(table), "digest": digest(table)}


def read_tables(spark: SparkSession, directory: str, stage: str, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables of a stage's report below a directory, for the next stage: each must have the schema, rows and digest that the report
    tells, and no two rows with the same keys. Anything else is a ReportError."""
    try:
        told = json.loads(files.read(spark, f"{directory}/report.json"))
    except Exception as e:
        raise ReportError(f"no report in {directory}") from e
    if told.get("schema_version") != VERSION or told.get("algorithm") != ALGORITHM:
        raise ReportError("another version")
    if told.get("stage") != stage:
        raise ReportError(f"a report of {told.get('stage')}, not of {stage}")
    out = {}
    for name, own in keys.items():
        if name not in told["tables"]:
            raise ReportError(f"no table {name}")
        table = spark.read.parquet(f"{directory}/{name}")
        if schema_json(table) != told["tables"][name]["schema"] or digest(table) != told["tables"][name]["digest"]:
            raise ReportError(f"{name} has changed since its report")
        if own and table.groupBy(*own).count().filter("count > 1").limit(1).count():
            raise ReportError(f"{name} has a row twice")
        out[name] = table
    return out


#: Fixed names within an inventory directory.
ROWS, ATLAS, MANIFEST, MARKER = "glyphs.jsonl", "atlas", "manifest.json", ".nobackup"
IDENTITY = ["project_id", "page_name", "tier", "line", "word", "glyph"]


def write_inventory(glyphs: DataFrame, pages: DataFrame, path: str, corpus: str, sheets=None) -> dict:
    """An inventory directory: rows as JSON lines in identity order, then their hashes, the atlas, and last the manifest.

    glyphs: a row a glyph with IDENTITY; pages: the page table (project_id, page_name, sha256, path); sheets(rows): the atlas of
    rows read back from what was written. Parts of the rows are in order by name, as their rows are. An identity twice is refused,
    and so is a place inside the corpus. Gives the manifest.
    """
    from inkfold.functions.text import natural_key

    spark = glyphs.sparkSession
    if files.inside(spark, path, corpus):
        raise DestinationError(f"{path} lies inside the corpus")
    if glyphs.groupBy(*IDENTITY).count().filter("count > 1").limit(1).count():
        raise ReportError("a glyph identity stands twice")
    files.write(spark, f"{path}/{MARKER}", b"")
    order = [F.col("project_id"), natural_key(F.col("page_name")), *[F.col(c) for c in IDENTITY[2:]]]
    plain = glyphs.drop("image", "grid")
    plain.orderBy(*order).select(F.to_json(F.struct(*[F.col(c) for c in sorted(plain.columns)])).alias("value")).write.text(f"{path}/{ROWS}")
    parts = spark.read.format("binaryFile").load(f"{path}/{ROWS}").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name")
    manifest = {"schema_version": VERSION, "algorithm": ALGORITHM, "rows": {"parts": [r.asDict() for r in parts.collect()], "glyphs": spark.read.text(f"{path}/{ROWS}").count()}, "coverage": [r.asDict() for r in plain.groupBy("tier", "style", "character").count().orderBy("tier", F.col("style").asc_nulls_first(), "character").collect()]}
    if sheets is not None:
        sheets.write.parquet(f"{path}/{ATLAS}")
        manifest["atlas"] = {"sheets": spark.read.parquet(f"{path}/{ATLAS}").count(), "digest": digest(spark.read.parquet(f"{path}/{ATLAS}").drop("png"))}
    pages.write.parquet(f"{path}/pages")
    files.write(spark, f"{path}/{MANIFEST}", pretty(manifest).encode())
    return manifest


def read_inventory(spark: SparkSession, path: str, schema) -> tuple[dict, DataFrame]:
    """(manifest, rows) of an inventory whose parts have the hashes that the manifest tells; ReportError otherwise."""
    try:
        manifest = json.loads(files.read(spark, f"{path}/{MANIFEST}"))
    except Exception as e:
        raise ReportError(f"no manifest in {path}") from e
    if manifest.get("schema_version") != VERSION or manifest.get("algorithm") != ALGORITHM:
        raise ReportError("another version")
    parts = spark.read.format("binaryFile").load(f"{path}/{ROWS}").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name")
    try:
        same = [r.asDict() for r in parts.collect()] == manifest["rows"]["parts"]
    except Exception as e:  # a file system with checksums of its own refuses to read what has changed
        raise ReportError("rows have changed since the manifest") from e
    if not same:
        raise ReportError("rows have changed since the manifest")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{ROWS}")
    if rows.count() != manifest["rows"]["glyphs"] or rows.groupBy(*IDENTITY).count().filter("count > 1").limit(1).count():
        raise ReportError("rows are missing, or stand twice")
    return manifest, rows
