"""A corpus directory as tables: one row a project, page, transcription, scan or recognised word; failures are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "projectid string, title string, author string, genre string, pages_total int, pg_ebook_number int, _bad string"
WITNESS = """schema_version string, project_id string, page_name string, image_sha256 string, image_width int, image_height int, confidence_tier string,
recognizer struct<name:string,version:string,config_sha256:string>, words array<struct<text:string,bbox:struct<top_left:struct<x:int,y:int,is_normalized:boolean>,bottom_right:struct<x:int,y:int,is_normalized:boolean>,is_normalized:boolean>,confidence:double,line_index:int,word_index:int>>, _bad string"""
IMAGE = r"(?i)\.(png|pbm|pgm|pnm|jpe?g)$"


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """project_id, path, content of files named `pattern` below project directories."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = rows.withColumn("project_id", F.regexp_extract("path", r"/(projectID[^/]*)/", 1))
    return rows.filter("project_id <> ''").withColumn("relative", F.regexp_extract("path", r"/projectID[^/]*/(.*)$", 1))


def _text(content: Column) -> Column:
    return content.cast("string")


#: Fields of a project's metadata by JSON type; all but projectid may be absent, and others are ignored.
_TYPES = {"projectid": "STRING", "title": "STRING", "author": "STRING", "genre": "STRING", "pages_total": "BIGINT", "pg_ebook_number": "BIGINT"}


def projects(spark: SparkSession, root: str) -> DataFrame:
    """project_id, metadata, diagnostic: malformed_project_metadata, project_id_mismatch or null.

    Metadata is strict: a field of another type (a whole number must be written as one; null is no value), a missing projectid, or
    what is no JSON object spoils it.
    """
    rows = _files(spark, root, "project.json").filter("relative = 'project.json'")
    text = _text(F.col("content"))
    fields = F.from_json(text, "map<string,variant>")
    right = F.lit(True)
    for name, kind in _TYPES.items():
        value = F.try_element_at(fields, F.lit(name))
        typed = F.schema_of_variant(value) == kind
        right &= F.when(F.array_contains(F.map_keys(fields), name), F.coalesce(typed, F.lit(False))).otherwise(F.lit(name != "projectid"))
    m = F.from_json(text, PROJECT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = rows.select("project_id", m.alias("m"), F.coalesce(right, F.lit(False)).alias("_right"))
    code = F.when(~F.col("_right") | F.col("m._bad").isNotNull() | F.col("m.projectid").isNull(), "malformed_project_metadata").when(F.col("m.projectid") != F.col("project_id"), "project_id_mismatch")
    return rows.select("project_id", F.col("m").dropFields("_bad").alias("metadata"), code.alias("diagnostic"))


def _page_map(rows: DataFrame, bad: str) -> DataFrame:
    """project_id, page_name, text, diagnostic from string-to-string JSON objects; any other value spoils the whole file."""
    values = F.from_json(_text(F.col("content")), "map<string,variant>")
    plain = F.forall(F.map_values(values), lambda v: F.schema_of_variant(v) == "STRING")
    rows = rows.withColumn("_ok", F.coalesce(plain, F.lit(False)))
    good = rows.filter("_ok").select("project_id", F.explode(F.from_json(_text(F.col("content")), "map<string,string>")).alias("page_name", "text")).withColumn("diagnostic", F.lit(None).cast("string"))
    failed = rows.filter("not _ok").select("project_id", F.lit(None).cast("string").alias("page_name"), F.lit(None).cast("string").alias("text"), F.lit(bad).alias("diagnostic"))
    return good.unionByName(failed)


def f2_pages(spark: SparkSession, root: str) -> DataFrame:
    return _page_map(_files(spark, root, "F2.json").filter("relative = 'rounds/F2.json'"), "malformed_f2")


def transcriptions(spark: SparkSession, root: str) -> DataFrame:
    return _page_map(_files(spark, root, "pages.json").filter("relative = 'pages.json'"), "malformed_pages_json")


def missing_transcriptions(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """project_id, diagnostic of the projects in `known` that have no transcription map."""
    have = _files(spark, root, "pages.json").filter("relative = 'pages.json'").select("project_id").distinct()
    return known.select("project_id").distinct().join(have, "project_id", "left_anti").withColumn("diagnostic", F.lit("missing_pages_json"))


def unresolvable(pages: DataFrame) -> DataFrame:
    """project_id, page_name, diagnostic of page names that no scan can have: within the project as they are written, but with a
    backslash, a NUL or a dot part. Empty and absolute names and those that lead upward have no scan and no diagnostic."""
    name = F.col("page_name")
    outside = (name == "") | name.startswith("/") | name.rlike(r"(?:^|/)\.\.(?:/|$)")
    return pages.filter(~outside & ~safe_name(name)).select("project_id", "page_name", F.lit("unresolvable_image_path").alias("diagnostic"))


def changed_scans(spark: SparkSession, root: str, recorded: DataFrame) -> DataFrame:
    """project_id, page_name, diagnostic of recorded(project_id, page_name, sha256) scans whose bytes are others now, or gone."""
    now = scans(spark, root).select("project_id", "page_name", F.col("sha256").alias("_now"))
    both = recorded.filter("sha256 is not null").select("project_id", "page_name", "sha256").join(now, ["project_id", "page_name"], "left")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("_now"))).select("project_id", "page_name", F.lit("source_changed").alias("diagnostic"))


def safe_name(name: Column) -> Column:
    """A page name that stays inside its project: not empty or absolute, without backslash, NUL, dot or dot-dot parts."""
    return (name != "") & ~name.rlike(r"^/|\\|\x00|(?:^|/)\.{1,2}(?:/|$)")


def scans(spark: SparkSession, root: str) -> DataFrame:
    """project_id, page_name, path, sha256, content: of two scans of a page, the one in the project's own directory."""
    rows = _files(spark, root, "*").filter(F.col("relative").rlike(IMAGE) & F.col("relative").rlike(r"^(?:images/)?[^/]+$"))
    rows = rows.select("project_id", F.regexp_replace("relative", "^images/", "").alias("page_name"), F.col("relative").startswith("images/").alias("_second"), "path", "content")
    best = rows.groupBy("project_id", "page_name").agg(F.min(F.struct("_second", "path")).alias("b")).select(F.col("project_id").alias("_p"), F.col("b.path").alias("_path"))
    rows = rows.join(best, (F.col("project_id") == F.col("_p")) & (F.col("path") == F.col("_path")), "left_semi")
    return rows.filter(safe_name(F.col("page_name"))).select("project_id", "page_name", "path", F.sha2("content", 256).alias("sha256"), "content")


def witness_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words with pixel boxes of a recogniser's JSON lines; normalised or empty boxes are left out."""
    rows = _witness(spark, path).filter("_bad is null")
    rows = rows.select("project_id", "page_name", "image_sha256", "recognizer", F.explode("words").alias("w"))
    a, b = F.col("w.bbox.top_left"), F.col("w.bbox.bottom_right")
    usable = ~F.col("w.bbox.is_normalized") & ~a["is_normalized"] & ~b["is_normalized"] & (b["x"] > a["x"]) & (b["y"] > a["y"])
    return rows.filter(usable).select("project_id", "page_name", "image_sha256", "recognizer", F.col("w.line_index").alias("line_index"), F.col("w.word_index").alias("word_index"), F.col("w.text").alias("word"), F.col("w.confidence").alias("confidence"), F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")).alias("box"))


def _witness(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WITNESS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


class WitnessError(ValueError):
    """A recogniser's record can't be used."""


def require_witness(spark: SparkSession, path: str, project_id: str | None = None) -> DataFrame:
    """witness_words of a record that has no fault; WitnessError with the faults of one that has.

    Faults: unreadable records, another schema version than 1.x, several or other projects, several recognisers, a page twice.
    """
    pages = _witness(spark, path)
    seen = pages.agg(
        F.count_if(F.col("_bad").isNotNull() | F.col("page_name").isNull()).alias("bad"), F.count_if(~F.coalesce(F.col("schema_version").startswith("1."), F.lit(False))).alias("version"),
        F.countDistinct("project_id").alias("p"), F.min("project_id").alias("first"), F.countDistinct("recognizer").alias("r"), (F.count("page_name") - F.countDistinct("project_id", "page_name")).alias("again"),
    ).first()
    faults = {
        "unreadable_record": seen["bad"], "unknown_version": seen["version"], "several_projects": seen["p"] > 1, "other_project": project_id is not None and seen["first"] not in (None, project_id),
        "several_recognizers": seen["r"] > 1, "repeated_page": seen["again"],
    }
    if any(faults.values()):
        raise WitnessError(", ".join(k for k, v in faults.items() if v))
    return witness_words(spark, path)


def witness_faults(words: DataFrame) -> DataFrame:
    """Why a witness can't be used: several projects or recognisers, or a page with several scan hashes."""
    seen = words.agg(F.countDistinct("project_id").alias("p"), F.countDistinct("recognizer").alias("r"))
    pages = words.groupBy("project_id", "page_name").agg(F.countDistinct("image_sha256").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("k"))
    both = seen.join(F.broadcast(pages))
    return both.select(F.array_compact(F.array(F.when(F.col("p") > 1, "several_projects"), F.when(F.col("r") > 1, "several_recognizers"), F.when(F.col("k") > 0, "repeated_page"))).alias("faults"))
