"""Command line: rank, profile, align, typography, glyphs. Tables go to Parquet below the output, a summary to report.json.

Exit codes: 2 usage, 3 input that can't be used, 6 a destination that may not be written.
"""

from __future__ import annotations

import argparse
import sys

STAGES = ("rank", "profile", "align", "typography", "glyphs")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkfold", description="Measure a corpus of proofread pages and scans.")
    p.add_argument("stage", choices=STAGES)
    p.add_argument("corpus")
    p.add_argument("output")
    p.add_argument("--projects", type=int, default=50)
    p.add_argument("--pages", type=int, default=12)
    p.add_argument("--ranked", help="output of an earlier rank run, whose selection is taken as it stands")
    p.add_argument("--selected-only", action="store_true", help="measure the selected pages alone, not the whole books")
    p.add_argument("--witness", help="a recogniser's JSON lines for the one project measured")
    p.add_argument("--overlays", action="store_true", help="with align or typography, review images of pages or lines too")
    return p


def tables(spark, a: argparse.Namespace, keep) -> dict:
    """The tables of a stage; keep(name, table) writes what later stages read twice and gives it back."""
    from inkfold.operators.pages import aligned, line_overlays, page_overlays
    from inkfold.plans import stages as S
    from inkfold.sources import corpus, report

    ranked = S.rank(spark, a.corpus, a.projects, a.pages)
    if a.stage == "rank":
        return {k: ranked[k] for k in ("projects", "pages", "diagnostics")}
    pages = report.read_tables(spark, a.ranked, "rank", {"projects": ["project_id"], "pages": S.PAGE})["pages"] if a.ranked else keep("pages", ranked["pages"])
    scans = S.selected(corpus.scans(spark, a.corpus), pages, not a.selected_only)
    profile = {k: keep(k, v) for k, v in S.profile(scans).items()}
    emitted = scans.filter("emit").select(*S.PAGE)
    if a.stage == "profile":
        return profile | {"measurements": profile["measurements"].join(emitted, S.PAGE, "left_semi")}
    tokens = keep("tokens", ranked["tokens"].join(scans.select("project_id").distinct(), "project_id", "left_semi"))
    candidates = keep("candidates", S.align(tokens, scans, profile["classes"], profile["measurements"])["candidates"])
    alignments = keep("alignments", aligned(S.scored_pages(tokens), candidates))
    if a.stage == "align":
        return {"candidates": candidates.drop("mask"), "alignments": alignments} | ({"overlays": page_overlays(scans, candidates, alignments)} if a.overlays else {})
    witness = corpus.require_witness(spark, a.witness) if a.witness else None
    typography = S.typography(tokens, candidates, alignments, profile["measurements"], profile["classes"], witness)
    if a.stage == "typography":
        return typography | ({"overlays": line_overlays(scans, typography["lines"])} if a.overlays else {})
    out = S.glyphs(keep("lines", typography["lines"]), candidates, profile["measurements"], tokens, scans, witness, alignments)
    return out | {"glyphs": keep("glyphs", out["glyphs"])}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.projects < 1 or a.pages < 1:
        print("limits must be positive", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from inkfold.sources import corpus, files, report

    spark = SparkSession.builder.getOrCreate()
    a.corpus, a.output = files.qualified(spark, a.corpus), files.qualified(spark, a.output)
    if not any(n.startswith("projectID") for n in files.names(spark, a.corpus)):
        print("no projects there", file=sys.stderr)
        return 3
    if files.inside(spark, a.output, a.corpus) or files.exists(spark, a.output):
        print("the destination exists or lies inside the corpus", file=sys.stderr)
        return 6

    def keep(name, table):
        path = f"{a.output}/_work/{name}"
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    told = {"schema_version": report.VERSION, "algorithm": report.ALGORITHM, "stage": a.stage, "limits": {"projects": a.projects, "pages": a.pages}, "tables": {}}
    try:
        found = tables(spark, a, keep)
    except (report.ReportError, corpus.WitnessError) as e:
        print(e, file=sys.stderr)
        return 3
    if a.stage == "glyphs":
        rows, atlas = found.pop("glyphs"), found.pop("atlas")
        pages = spark.read.parquet(f"{a.output}/_work/measurements").select("project_id", "page_name", "sha256")
        report.write_inventory(rows, pages, f"{a.output}/inventory", a.corpus, atlas)
        found["glyphs"] = rows.drop("image", "grid")
    for name, table in found.items():
        table.write.parquet(f"{a.output}/{name}")
        told["tables"][name] = report.described(spark.read.parquet(f"{a.output}/{name}"))
        files.write(spark, f"{a.output}/schemas/{name}.json", report.pretty(report.json_schema(table)).encode())
    files.write(spark, f"{a.output}/report.json", report.pretty(told).encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
