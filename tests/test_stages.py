"""The stages end to end on a drawn corpus, and corpus readers, reports and the command line."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.plans import stages as S
from inkfold.sources import corpus, report

PITCH, BAR, GAP, LINE = 8, 6, 24, 60
ASCENDERS, DESCENDERS = "bdfhklt", "gjpqy"


def drawn(text, head=True):
    """A page: one bar a character, x-height rows 10 to 30 of a line, ascenders from row 8, descenders to row 32."""
    rows = text.split("\n")
    width = 80 + max(sum(PITCH * len(w) for w in r.split(" ")) + GAP * r.count(" ") for r in rows)
    gray = np.full((100 + LINE * (len(rows) + 1), width), 255, np.uint8)
    if head:
        for x in range(200, 420, PITCH):
            gray[40:60, x : x + BAR] = 0
    for i, r in enumerate(rows):
        x, y = 40, 90 + LINE * i
        for w in r.split(" "):
            for c in w:
                gray[y + (8 if c in ASCENDERS else 10) : y + (32 if c in DESCENDERS else 30), x : x + BAR] = 0
                x += PITCH
            x += GAP - (PITCH - BAR)
    return gray


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(3)
    words = ["nose", "sense", "more", "have", "kind", "type", "bold", "quay", "remove", "common", "seven"]
    a = top / "projectIDa"
    (a / "rounds").mkdir(parents=True)
    pages = {}
    for n in range(1, 9):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(15, 18))) for _ in range(6)]
        name = f"p{n}.png"
        pages[name] = "\n".join(lines)
        gray = drawn(pages[name])
        (a / name).write_bytes(b"P5\n%d %d\n255\n" % (gray.shape[1], gray.shape[0]) + gray.tobytes())
    pages["p20.png"] = "/*\nMenu      1\nSoup      2\nFish      3\n*/ <i>x</i>"
    (a / "project.json").write_text(json.dumps({"projectid": "projectIDa", "title": "A book"}))
    (a / "rounds/F2.json").write_text(json.dumps(pages))
    (a / "pages.json").write_text(json.dumps({"p1.png": "ocr"}))
    for name, meta, f2 in (("projectIDb", {"projectid": "other"}, {"p1.png": "x"}), ("projectIDc", {"projectid": "projectIDc"}, {"p1.png": 3}), ("projectIDd", {"projectid": "projectIDd"}, None)):
        (top / name / "rounds").mkdir(parents=True)
        (top / name / "project.json").write_text(json.dumps(meta))
        if f2 is not None:
            (top / name / "rounds/F2.json").write_text(json.dumps(f2))
    return top


@pytest.fixture(scope="module")
def ranked(spark, root):
    return S.rank(spark, str(root), 50, 3)


def test_rank(ranked):
    projects = ranked["projects"].collect()
    assert [r.project_id for r in projects] == ["projectIDa"] and projects[0].metadata.title == "A book"
    assert projects[0].score == 5 + 1 + 8 + 8 + 6 * 0 + 20 * 2
    first = min(ranked["pages"].collect(), key=lambda r: r.position)
    assert first.page_name == "p20.png" and not first.image_available and sorted(first.groups) == ["mixed_typography", "table_like_structure"]
    assert ranked["pages"].count() == 3
    assert {(r.code, r.project_id) for r in ranked["diagnostics"].collect()} == {("project_id_mismatch", "projectIDb"), ("malformed_f2", "projectIDc"), ("missing_f2", "projectIDd"), ("missing_pages_json", "projectIDc"), ("missing_pages_json", "projectIDd")}


@pytest.fixture(scope="module")
def measured(spark, root, ranked, tmp_path_factory):
    d = tmp_path_factory.mktemp("work")

    numbers = itertools.count()

    def keep(name, df):
        path = f"{d}/{next(numbers)}-{name}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    scans = corpus.scans(spark, str(root))
    profile = {k: keep(k, v) for k, v in S.profile(scans).items()}
    tokens = keep("tokens", ranked["tokens"])
    aligned = {k: keep(k, v) for k, v in S.align(tokens, scans, profile["classes"], profile["measurements"]).items()}
    typography = {k: keep(k, v) for k, v in S.typography(tokens, aligned["candidates"], aligned["alignments"], profile["measurements"], profile["classes"]).items()}
    return scans, profile, aligned, typography, S.glyphs(typography["lines"], aligned["candidates"], profile["measurements"], tokens, scans)


def test_profile(measured):
    _, profile, *_ = measured
    assert profile["measurements"].count() == 8
    assert all(r.first_top == 40 for r in profile["templates"].collect())
    assert all(r.furniture == [0] and r.page_class.startswith("normal") for r in profile["classes"].collect())
    pooled = {r.name: r for r in profile["estimates"].collect()}
    assert pooled["band_pitch"].sample_count == 8 and pooled["band_pitch"].evidence == [f"p{i}.png" for i in range(1, 9)] and pooled["top_margin"].value == 40


def test_alignment(measured):
    _, _, aligned, *_ = measured
    got = {r.page_name: r for r in aligned["alignments"].collect()}
    assert got["p20.png"].state == "excluded" and "profile_page_missing" in got["p20.png"].exclusions and "table_like" in got["p20.png"].exclusions
    good = [r for r in got.values() if r.state == "accepted"]
    assert len(good) >= 3
    for r in good:
        assert [(o.kind, o.source, o.candidate) for o in r.operations] == [("match", i, i) for i in range(6)]


def test_typography_and_glyphs(measured):
    *_, typography, glyphs = measured
    every = typography["lines"].collect()
    lines = [r for r in every if r.measured]
    assert 4 * len(lines) > len(every) and all(abs(r.x_height_px - 20) <= 2 and r.words_reconciled for r in lines)
    assert {r.reason for r in every if not r.measured} <= {"insufficient_segments", "skew_exceeds_maximum"}
    assert typography["thresholds"].first().rule == "x-height-ratio"  # two spikes without a valley between them
    estimates = {(r.style, r.name): r for r in typography["estimates"].collect()}
    assert abs(estimates[None, "x_height"].value - 20) <= 2 and estimates[None, "baseline_pitch"].value == LINE and ("body", "skew") in estimates
    assert typography["accuracy"].first().gap_accuracy == 1
    cut = glyphs["glyphs"].collect()
    assert len(cut) == sum(len(r.text.replace(" ", "")) for r in lines)
    assert {r.box.y1 - r.box.y0 for r in cut if r.character in "nmrs"} == {20}
    assert {r.style for r in cut} == {"roman"} and {r.tier for r in cut} == {"transcribed"} and all(len(r.grid) == 192 for r in cut)
    assert all(("ascends" in r.flags) == (r.character in ASCENDERS) for r in cut) and all(r.bottom_offset_px == 2 for r in cut if r.character in "qy")
    medians = {(r.page_name, r.name): r for r in typography["pages"].collect()}
    assert medians["p1.png", "line_indent"].value == 0 and medians["p1.png", "word_gap"].value is not None and {r.missing_reason for r in medians.values() if r.value is None} <= {"no_measured_lines", "no_baseline_pitch", "no_reconciled_word_gaps"}
    assert [(r.style, r.exclusions) for r in typography["unpooled"].collect()] == [("body", [])]
    sheets = glyphs["atlas"].collect()
    assert sum(r.cells for r in sheets) == len(cut) and all(r.png[:4] == b"\x89PNG" for r in sheets)


def test_witness(spark, measured, tmp_path):
    _, _, aligned, typography, _ = measured
    page = aligned["candidates"].filter("size(candidates) > 0").first()
    box = page.candidates[0].box
    point = lambda x, y: {"x": x, "y": y, "is_normalized": False}
    word = lambda t, x0, y0, x1, y1: {"text": t, "bbox": {"top_left": point(x0, y0), "bottom_right": point(x1, y1), "is_normalized": False}, "confidence": 1.0, "line_index": 0, "word_index": 0}
    record = {"schema_version": "1.0", "project_id": page.project_id, "page_name": page.page_name, "image_sha256": "0" * 64, "image_width": 9, "image_height": 9, "confidence_tier": "x", "recognizer": {"name": "r", "version": "1", "config_sha256": "0"}}
    text = typography["lines"].filter(f"page_name = '{page.page_name}' and candidate = 0").first().text
    inside = [word(t, box.x0 + 10 * i, box.y0 + 2, box.x0 + 10 * i + 8, box.y1 - 2) for i, t in enumerate(text.split())]
    record["words"] = [*inside, word("HEAD", 200, 40, 420, 60) | {"line_index": 1}, word("empty", 5, 5, 5, 9)]
    (tmp_path / "w.jsonl").write_text(json.dumps(record) + "\nnot json\n")
    got = corpus.witness_words(spark, str(tmp_path / "w.jsonl"))
    assert got.count() == len(inside) + 1
    with pytest.raises(corpus.WitnessError, match="unreadable_record"):
        corpus.require_witness(spark, str(tmp_path / "w.jsonl"))
    (tmp_path / "good.jsonl").write_text(json.dumps(record) + "\n")
    assert corpus.require_witness(spark, str(tmp_path / "good.jsonl"), page.project_id).count() == got.count()
    for wrong, fault in (({}, "repeated_page"), ({"project_id": "z", "page_name": "q"}, "several_projects"), ({"schema_version": "2.0", "page_name": "q"}, "unknown_version"), ({"page_name": "q", "recognizer": {"name": "s", "version": "1", "config_sha256": "0"}}, "several_recognizers")):
        (tmp_path / "bad.jsonl").write_text(json.dumps(record) + "\n" + json.dumps(record | wrong) + "\n")
        with pytest.raises(corpus.WitnessError, match=fault):
            corpus.require_witness(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(corpus.WitnessError, match="other_project"):
        corpus.require_witness(spark, str(tmp_path / "good.jsonl"), "other")
    assert [r.word for r in S.furniture_words(got, aligned["candidates"]).collect()] == ["HEAD"]
    assert [(r.page_name, r.candidate) for r in S.admitted_lines(got, typography["lines"]).collect()] == [(page.page_name, 0)]


def test_recognised_tier(spark, measured):
    """The running head, read by a recogniser of the same scan, is cut into glyphs with its confidence; of another scan it is not."""
    scans, profile, aligned, typography, _ = measured
    page = aligned["alignments"].filter("state = 'accepted'").orderBy("page_name").first().page_name
    sha = aligned["candidates"].filter(f"page_name = '{page}'").first().sha256
    head = "a" * 28  # drawn as 28 bars from column 200 to 424
    word = ("projectIDa", page, sha, 3, 1, head, 0.75, (190, 30, 5_000, 66))
    schema = "project_id string, page_name string, image_sha256 string, line_index int, word_index int, word string, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>"
    for own in (sha, "0" * 64):
        witness = spark.createDataFrame([word[:2] + (own, *word[3:])], schema)
        got = S.glyphs(typography["lines"], aligned["candidates"], profile["measurements"], None, scans, witness, aligned["alignments"])
        rows = got["glyphs"].filter("tier = 'recognized'").collect()
        if own == sha:
            assert len(rows) == 28 and {(r.line, r.word, r.confidence, r.style, r.top_offset_px) for r in rows} == {(3, 1, 0.75, None, None)}
            assert (rows[0].box.y0, rows[0].box.y1) == (40, 60)
        else:
            assert not rows and [(r.tier, r.reason) for r in got["cuts"].collect() if r.tier == "recognized"] == [("recognized", "scan_changed")]


def test_changed_masks_and_scans(spark, measured, root):
    """A mask that does not reproduce a candidate's ink leaves its page's lines unmeasured; a scan changed since it was measured makes no boxes."""
    _, profile, aligned, _, _ = measured
    tokens = spark.createDataFrame([], "project_id string, page_name string")
    assert tokens.count() == 0
    page = aligned["candidates"].filter("size(candidates) > 0").first()
    size = profile["measurements"].filter(f"page_name = '{page.page_name}'").first()
    one = page.candidates[0]
    schema = "project_id string, page_name string, width int, height int, mask binary, gap int, matched array<struct<candidate:int,box:struct<x0:int,y0:int,x1:int,y1:int>,profile:array<double>,ink:long,text:string>>"
    from inkfold.operators import pages as P

    for ink, profile_, reason in ((one.ink, list(one.profile), None), (one.ink + 1, list(one.profile), "foreground_pixels_mismatch"), (one.ink, list(one.profile)[::-1][:-1] + [0.5], "horizontal_ink_profile_mismatch")):
        rows = P.line_typography(spark.createDataFrame([("a", "p", size.width, size.height, page.mask, None, [(0, one.box, profile_, ink, "x")])], schema)).collect()
        assert rows[0].reason in ({None, "insufficient_segments"} if reason is None else {reason})
    now = aligned["candidates"].withColumn("sha256", F.when(F.col("page_name") == page.page_name, "0").otherwise(F.col("sha256")))
    found = {r.page_name: r for r in S.unchanged(now, profile["measurements"]).collect()}
    assert found[page.page_name].exclusions[0] == "source_changed" and not found[page.page_name].candidates
    assert all("source_changed" not in r.exclusions for n, r in found.items() if n != page.page_name)
    recorded = profile["measurements"].withColumn("sha256", F.when(F.col("page_name") == "p1.png", "0").otherwise(F.col("sha256")))
    assert [(r.page_name, r.diagnostic) for r in corpus.changed_scans(spark, str(root), recorded).collect()] == [("p1.png", "source_changed")]


def test_selection_widens_to_whole_books(spark):
    scans = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("b", "p1")], "project_id string, page_name string")
    pages = scans.filter("project_id = 'a' and page_name = 'p2'")
    assert sorted(map(tuple, S.selected(scans, pages).collect())) == [("a", "p1", False), ("a", "p2", True)]
    assert sorted(map(tuple, S.selected(scans, pages, False).collect())) == [("a", "p2", True)]


def test_styles_of_characters(spark):
    from inkfold.kernels import source
    from inkfold.operators import pages as P

    text = "plain <i>two words</i> end\r\n<b>bo<sc>th</sc></b> x\n\nlast"
    tokens = P.tokenized(spark.createDataFrame([("a", "p1", text)], "project_id string, page_name string, text string"))
    rows = {r.source: r for r in S.line_styles(tokens).collect()}
    lines = {x["ordinal"]: x["visible_text"] for x in source.tokenize({"p1": text})[0]["lines"]}
    assert lines[0] == "plain two words end" and lines[1] == "both x"
    assert [tuple(s) for s in rows[0].spans] == [(6, 15, "italic")] and not rows[3].spans
    at = lambda i, k: spark.createDataFrame([rows[i]], S.line_styles(tokens).schema).select(S.style_at(F.col("spans"), F.lit(k)).alias("s")).first().s
    assert [at(0, 5), at(0, 6), at(0, 15)] == ["roman", "italic", "roman"] and [at(1, 0), at(1, 2), at(1, 5)] == ["bold", "bold+small_caps", "roman"]
    starts = spark.createDataFrame([("  a\u00a0bc  d",)], "t string").select(*[S.word_start(F.col("t"), F.lit(k)).alias(str(k)) for k in range(3)]).first()
    assert list(starts) == [2, 4, 8]


def test_bad_scans_are_rows(spark):
    from inkfold.operators import pages as P

    scans = spark.createDataFrame([("a", "p1", b"junk"), ("a", "p2", None), ("a", "p3", b"P1\n4 4\n" + b"0" * 16)], "project_id string, page_name string, content binary")
    assert {r.page_name: r.diagnostics for r in P.measured(scans).collect()} == {"p1": ["image_decode_failed"], "p2": ["image_missing"], "p3": ["blank"]}
    assert {r.page_name: r.exclusions for r in P.extracted(scans).collect()} == {"p1": ["image_decode_failed"], "p2": ["image_missing"], "p3": ["blank_page"]}
    assert P.inherited(["one_band", "no_bands", "border_dominated", "something_new", "other"]) == ["insufficient_ink_bands", "border_dominated", "inherited_profile_diagnostic"]
    assert P.measured(scans.limit(0)).count() == 0


def test_reports(tmp_path):
    target = tmp_path / "out" / "r.json"
    target.parent.mkdir()
    report.write_report({"b": 1, "a": ["é"]}, str(target), str(tmp_path / "corpus"))
    assert target.read_text() == '{\n  "a": [\n    "é"\n  ],\n  "b": 1\n}\n' and len(list(target.parent.iterdir())) == 1
    with pytest.raises(report.DestinationError):
        report.write_report({}, str(tmp_path / "out" / "x.json"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        report.compact({"x": float("nan")})
    assert report.latent_keys({"a": [{"Kerning_x": 1}], "font": 2, "b": "font"}) == ["font", "a[0].Kerning_x"]
    good = {"unit": "px", "frame": "source", "confidence_kind": "uncalibrated", "confidence": None}
    assert report.estimate_faults({"pages": [{"estimates": [good, good | {"unit": "pt"}, 3, good | {"confidence": 0.5}]}]}) == ["pages[0].estimates[1]: unit is 'pt'", "pages[0].estimates[2]: no object", "pages[0].estimates[3]: confidence"]


def test_metadata_is_strict(spark, tmp_path):
    given = {
        "good": {"projectid": "projectIDgood", "title": "t", "pages_total": 12, "other": [1]}, "bare": {"projectid": "projectIDbare"}, "float": {"projectid": "projectIDfloat", "pages_total": 1.5}, "text": {"projectid": "projectIDtext", "pg_ebook_number": "7"},
        "null": {"projectid": "projectIDnull", "title": None}, "none": {"title": "t"}, "other": {"projectid": "projectIDx"}, "list": [1],
    }
    for name, value in given.items():
        (tmp_path / f"projectID{name}").mkdir()
        (tmp_path / f"projectID{name}" / "project.json").write_text(json.dumps(value))
    (tmp_path / "projectIDbroken").mkdir()
    (tmp_path / "projectIDbroken" / "project.json").write_text("{")
    got = {r.project_id.removeprefix("projectID"): r.diagnostic for r in corpus.projects(spark, str(tmp_path)).collect()}
    assert got == {"good": None, "bare": None, "other": "project_id_mismatch"} | dict.fromkeys(["float", "text", "null", "none", "list", "broken"], "malformed_project_metadata")


def test_json_schema(spark):
    df = spark.sql("select 1 as a, array(named_struct('x', 1.5D, 'y', cast(null as string))) as b, map('k', 2L) as c")
    assert report.json_schema(df) == {
        "$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["a", "b", "c"], "additionalProperties": False,
        "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": ["string", "null"]}}, "required": ["x"], "additionalProperties": False}}, "c": {"type": "object", "additionalProperties": {"type": "integer"}}},
    }


def test_overlays_of_stages(spark, measured):
    from inkfold.operators import pages as P

    scans, _, aligned, typography, _ = measured
    pages = P.page_overlays(scans, aligned["candidates"], aligned["alignments"]).collect()
    assert len(pages) == aligned["candidates"].filter("size(candidates) > 0").count() and all(bytes(r.png[:4]) == b"\x89PNG" for r in pages)
    one = typography["lines"].filter("measured").limit(1)
    assert P.line_overlays(scans, typography["lines"]).count() == typography["lines"].filter("measured").count() and one.count() == 1


def test_command_line(spark, root, tmp_path):
    from inkfold.cli import main

    assert main(["rank", str(root), str(tmp_path / "o"), "--pages", "2"]) == 0
    told = json.loads((tmp_path / "o" / "report.json").read_text())
    assert told["schema_version"] == 1 and told["tables"]["pages"]["digest"].startswith("2:")
    assert told["tables"]["pages"]["rows"] == 2 and told["stage"] == "rank"
    assert main(["rank", str(root), str(tmp_path / "o")]) == 6 and main(["rank", str(root), str(root / "x")]) == 6
    assert main(["rank", str(tmp_path), str(tmp_path / "p")]) == 3 and main(["rank", str(root), str(tmp_path / "p"), "--pages", "0"]) == 2
    with pytest.raises(SystemExit) as e:
        main(["unknown"])
    assert e.value.code == 2
    assert main(["glyphs", str(root), str(tmp_path / "g")]) == 0
    assert json.loads((tmp_path / "g" / "report.json").read_text())["tables"]["glyphs"]["rows"] > 300
    inventory(spark, root, tmp_path)
    # a rank run that has been changed since is refused, and so is another stage's report
    assert main(["profile", str(root), str(tmp_path / "r1"), "--ranked", str(tmp_path / "o"), "--selected-only"]) == 0
    assert {r.page_name for r in spark.read.parquet(str(tmp_path / "r1" / "measurements")).collect()} < {f"p{i}.png" for i in range(1, 9)}
    assert main(["profile", str(root), str(tmp_path / "r2"), "--ranked", str(tmp_path / "r1")]) == 3
    spark.createDataFrame([("projectIDa", "p1.png")], "project_id string, page_name string").write.mode("overwrite").parquet(str(tmp_path / "o" / "pages"))
    assert main(["profile", str(root), str(tmp_path / "r3"), "--ranked", str(tmp_path / "o")]) == 3


def inventory(spark, root, tmp_path):
    """The inventory is in identity order, reads back by its manifest, and its atlas is what its rows give; changes are found."""
    from inkfold.kernels.natural import natural_key
    from inkfold.operators import pages as P

    top = tmp_path / "g" / "inventory"
    kept = spark.read.parquet(str(tmp_path / "g" / "_work" / "glyphs"))
    manifest, rows = report.read_inventory(spark, str(top), kept.drop("image", "grid").schema)
    assert (top / ".nobackup").exists() and manifest["rows"]["glyphs"] == rows.count() == kept.count() == sum(x["count"] for x in manifest["coverage"])
    lines = [json.loads(x) for f in sorted((top / "glyphs.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    order = [(x["project_id"], natural_key(x["page_name"]), x["tier"], x["line"], x["word"], x["glyph"]) for x in lines]
    assert order == sorted(order) and len(set(order)) == len(order)
    keys = ["tier", "style", "character"]
    atlas = spark.read.parquet(str(top / "atlas"))
    assert P.atlas_mismatches(atlas, kept, keys).count() == 0
    one = atlas.limit(1).collect()[0]
    broken = atlas.withColumn("png", F.when((F.col("character") == one.character) & (F.col("sheet") == one.sheet), F.lit(b"x")).otherwise(F.col("png")))
    assert [r.character for r in P.atlas_mismatches(broken, kept, keys).collect()] == [one.character]
    assert [r.character for r in P.atlas_mismatches(atlas, kept.filter(F.col("character") != one.character), keys).collect()] == [one.character]
    with pytest.raises(report.ReportError):
        report.write_inventory(kept.unionAll(kept), rows.limit(0), str(tmp_path / "twice"), str(root))
    with pytest.raises(report.DestinationError):
        report.write_inventory(kept, rows.limit(0), str(root / "inside"), str(root))
    part = sorted((top / "glyphs.jsonl").glob("part-*"))[0]
    part.write_text(part.read_text().replace("transcribed", "recognized", 1))
    with pytest.raises(report.ReportError, match="changed"):
        report.read_inventory(spark, str(top), rows.schema)


def test_session_bands(spark):
    from inkfold.streaming.bands import session_bands

    rows = spark.sql("select 'a' k, timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,x) ts from values (0),(10),(25),(60),(61) t(x)")
    assert sorted(r.n for r in session_bands(rows, "k", "ts").collect()) == [2, 3]
