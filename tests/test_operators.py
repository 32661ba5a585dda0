"""Column functions and table operators on small literal tables, and every query against its SQL."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from inkfold.functions import text as T
from inkfold.kernels import source
from inkfold.kernels.natural import natural_key
from inkfold.operators import checks, intervals, islands, pooling, review, selection
from inkfold.operators.features import GROUPS, local_blocks, page_features, scored_pages
from inkfold.operators.histogram import otsu

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value", ["", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "\n\n", " \ta \n"])
def test_lines(spark, value):
    assert one(spark, T.lines, value) == value.splitlines()


@pytest.mark.parametrize("value", ["  a b\t", "\xa0é　", "\x1c x \x1f", "\n"])
def test_strip(spark, value):
    assert one(spark, T.strip, value) == value.strip()


def test_natural_key_orders_like_the_kernel(spark):
    names = ["p10", "p002", "p2", "P02", "p1", "", "12", "a", "a1b", "a01b", "a1B", "Straße", "strasse", "STRASSE2", "ſx", "sy", "βa", "ϐb", "ΟΔΟΣ", "οδος", "Iı", "iı", "p" + "9" * 50, "p1" + "0" * 50, "p0" + "9" * 50, "ᏸ", "Ᏸ", "ꭰ", "Ꭰ", "ﬁ", "fi"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()
    assert [r.n for r in rows] == sorted(names, key=natural_key)


def test_case_folding_is_the_full_one(spark):
    """Every letter of the first plane that this Java and this Python both know."""
    import unicodedata

    chars = [chr(k) for k in range(0x20, 0x10000) if unicodedata.category(chr(k))[0] == "L" and not 0xD800 <= k < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", T.case_folded(F.col("c")).alias("f")).collect()
    wrong = [(r.c, r.f, r.c.casefold()) for r in rows if r.f != r.c.casefold()]
    assert len(wrong) <= 4, wrong[:20]  # letters newer than the older of the two


def test_positions_and_invariants(spark):
    rows = [(c, p, f"n{i}") for i, (c, p) in enumerate([("b", None), ("a", "x"), ("a", "x"), ("b", "y"), ("a", None)] * 7)]
    got = selection.positions(spark.createDataFrame(rows, "c string, p string, n string"), [F.col("c"), F.coalesce("p", F.lit(""))], [F.col("n")]).collect()
    assert [(r.c, r.p, r.n) for r in sorted(got, key=lambda r: r.position)] == sorted(rows, key=lambda r: (r[0], r[1] or "", r[2]))
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))


def test_invariants_find_breaches(spark):
    box = "struct<x0:int,y0:int,x1:int,y1:int>"
    n = lambda df: {r.broken: r.n for r in df.collect()}
    schema = f"sha256 string, width int, height int, threshold int, bounds {box}, margins {box}, foreground_pixels long, bands array<struct<y_start:int,y_end:int>>, diagnostics array<string>"
    good = [
        (None, None, None, None, None, None, None, None, ["image_missing"]),
        ("a", None, None, None, None, None, None, None, ["image_decode_failed"]),
        ("a", 9, 9, 0, None, None, 0, [], ["blank"]),
        ("a", 9, 8, 0, (1, 2, 5, 6), (1, 2, 4, 2), 16, [(2, 6)], []),
    ]
    bad = [
        (None, None, None, None, None, None, None, None, []),
        ("a", 9, 9, 0, None, None, 0, [], []),
        ("a", 9, 8, 0, (1, 2, 5, 6), (1, 2, 4, 3), 16, [(2, 6)], []),
        ("a", 9, 8, 0, (1, 2, 5, 6), (1, 2, 4, 2), 17, [(2, 6)], []),
        ("a", 9, 8, 0, (1, 2, 5, 6), (1, 2, 4, 2), 16, [(2, 9)], []),
    ]
    assert n(checks.page_coherence(spark.createDataFrame(good, schema))) == {"page_coherence": 0} and n(checks.page_coherence(spark.createDataFrame(bad, schema))) == {"page_coherence": len(bad)}
    est = spark.createDataFrame([(1.0, 2, ["a", "b"]), (None, 0, []), (1.0, 0, []), (1.0, 2, ["a"]), (1.0, 2, ["a", "a"])], "value double, sample_count long, evidence array<string>")
    assert n(checks.estimate_coherence(est)) == {"estimate_coherence": 3}
    text = "aé\nb"
    line = "struct<ordinal:int,span_ids:array<string>,continued_ids:array<string>>"
    tok = f"source_text string, visible_text string, spans array<struct<opening_id:string,block_id:string,kind:string,byte_start:long,byte_end:long>>, styles array<struct<start:int,end:int,byte_start:long,byte_end:long>>, lines array<{line}>"
    span = ("o", "k", "continued", 0, 3)
    rows = [(text, text, [span], [(0, 4, 0, 5)], [(0, ["k"], ["o"])]), (text, text, [("o", "k", "local", 0, 2)], [], []), (text, text, [], [(0, 5, 0, 5)], []), (text, text, [span], [], [(0, ["z"], [])]), (text, text, [("o", "k", "local", 0, 3)], [], [(0, ["k"], ["o"])])]
    assert n(checks.markup_references(spark.createDataFrame(rows, tok))) == {"markup_references": 4}
    op = "project_id string, page_name string, state string, operations array<struct<kind:string,source:int,candidate:int>>"
    lines = spark.createDataFrame([("a", "p", [(0, "x", True), (1, "", True), (2, "y", False), (3, "z", True)])], "project_id string, page_name string, lines array<struct<ordinal:int,visible_text:string,matching_eligible:boolean>>")
    cand = spark.createDataFrame([("a", "p", [1, 1])], "project_id string, page_name string, candidates array<int>")
    for ops, want in (([("match", 0, 0), ("match", 3, 1)], (0, 0, 0, 0)), ([("match", 3, 0), ("match", 0, 1)], (0, 0, 1, 0)), ([("match", 0, 0), ("skip_image", None, 0)], (1, 2, 0, 1)), ([("match", 0, 0), ("skip_image", None, 1), ("skip_text", 2, None)], (2, 0, 0, 0))):
        got = n(checks.operation_coverage(spark.createDataFrame([("a", "p", "accepted", ops)], op), lines, cand))
        assert tuple(got[k] for k in ("lines_cover", "candidates_cover", "source_order", "candidate_order")) == want
    done = spark.createDataFrame([("a", "p", "accepted", [("match", 0, 0), ("skip_text", 3, None)]), ("a", "q", "proposed", [("match", 0, 0)])], op)
    rev = "project_id string, page_name string, kind string, source int, candidate int, decision string, intended_source int, intended_candidate int"
    reviewed = [("a", "p", "match", 0, 0, "correct", 0, 0), ("a", "p", "skip_text", 3, None, "wrong", 3, 1), ("a", "p", "match", 0, 1, "wrong", 0, 0), ("a", "q", "match", 0, 0, "correct", 0, 0), ("a", "p", "skip_text", 3, None, "correct", 3, 1)]
    assert n(checks.reviewed_lines(spark.createDataFrame(reviewed, rev), done)) == {"reviewed_lines": 3, "reviewed_twice": 1}
    ln = f"project_id string, page_name string, candidate int, box {box}, measured boolean, reason string, baseline_row_px int, x_height_top_row_px int, x_height_px int, ascender_extent_px int, descender_extent_px int, stroke_width_px double, skew_slope double, word_run_count int, source_word_count int, words_reconciled boolean, words array<{box}>"
    whole = ("a", "p", 0, (0, 10, 50, 40), True, None, 30, 20, 10, 20, 10, 2.0, 0.0, 1, 1, True, [(0, 10, 9, 40)])
    none = ("a", "p", 1, (0, 10, 50, 40), False, "insufficient_segments", *[None] * 10, None)
    wrong = [whole[:6] + (31, *whole[7:]), whole[:7] + (None, *whole[8:]), whole[:13] + (2, 1, True, [(0, 10, 9, 40)]), whole[:16] + ([(0, 9, 9, 40)],), none[:5] + (None, *none[6:])]
    assert n(checks.line_coherence(spark.createDataFrame([whole, none], ln))) == {"line_coherence": 0} and n(checks.line_coherence(spark.createDataFrame(wrong, ln))) == {"line_coherence": len(wrong)}
    assert n(checks.count_identities(spark.createDataFrame([whole, none], ln), ["page_name"])) == {"count_identities": 0} and n(checks.count_identities(spark.createDataFrame([whole, whole], ln), ["page_name"])) == {"count_identities": 1}
    gl = f"character string, box {box}, ink_density double, top_offset_px int, bottom_offset_px int, tier string, confidence double, style string"
    one = ("a", (0, 0, 2, 2), 0.5, 1, 0, "transcribed", None, "roman")
    odd = [("ab", *one[1:]), one[:3] + (None, *one[4:]), one[:6] + (0.5, "roman"), one[:5] + ("recognized", 0.5, "roman"), one[:2] + (1.5, *one[3:])]
    assert n(checks.glyph_rows(spark.createDataFrame([one, one[:3] + (None, None, "recognized", 0.5, None)], gl))) == {"glyph_rows": 0} and n(checks.glyph_rows(spark.createDataFrame(odd, gl))) == {"glyph_rows": len(odd)}


def test_bands_by_column_and_kernel(spark):
    from statistics import median

    from inkfold.kernels.components import Blob, _band_reason
    from inkfold.operators.bands import band_reasons

    rnd = random.Random(6)
    rows = [(p, i, (h := rnd.choice([1, 2, 3, 6, 20, 22])), (a := h * rnd.randint(5, 300)), rnd.randint(0, a)) for p in range(8) for i in range(15)]
    got = {(r.p, r.i): r.reason for r in band_reasons(spark.createDataFrame(rows, "p int, i int, height int, area int, ink int"), ["p"]).collect()}
    for p, i, h, a, k in rows:
        own = [r for r in rows if r[0] == p]
        assert got[p, i] == _band_reason([Blob((0, 0, a // h, h), 0, 1, k)], median(r[4] for r in own), median(r[2] for r in own))


def test_ranked_values_and_counted_medians(spark):
    from statistics import median

    rnd = random.Random(3)
    rows = [("ab"[i % 2], float(rnd.randint(0, 9))) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in pooling.median_mad(df, ["k"], "v").collect()}
    spread = {r.k: r for r in pooling.dispersion(df, ["k"], "v").collect()}
    for k in "ab":
        v = sorted(x for g, x in rows if g == k)
        assert (got[k].center, got[k].spread, got[k].n) == (median(v), median(abs(x - median(v)) for x in v), len(v))
        assert (spread[k].p16, spread[k].p84) == tuple(v[int(s * (len(v) - 1) + 0.5)] for s in (0.16, 0.84))


def test_medians(spark):
    from statistics import median

    for v in ([3, 1], [5], [1, 2, 9], [4, 4, 4, 1]):
        assert one(spark, T.middle, v, "array<int>") == median(v)
        assert one(spark, T.deviation, v, "array<int>") == median(abs(x - median(v)) for x in v)
    assert one(spark, T.middle, [], "array<int>") is None


def test_small_functions(spark):
    assert one(spark, T.code_point, "A") == "U+0041" and one(spark, T.code_point, "😀") == "U+1F600"
    assert one(spark, T.letters_only, "Don’t_1!") == "dont1"
    assert one(spark, lambda c: T.tag_count(c, "i"), "<i><I a='b'/> <ix> </i> <i >") == 3
    assert [one(spark, T.is_recto, n) for n in ("p12", "p13a", "cover", "1p2")] == [False, True, True, False]
    assert [one(spark, T.half_up, v, "double") for v in (0.5, 1.5, 2.4)] == [1, 2, 2]


def test_blocks_fold_like_the_kernel(spark):
    rnd = random.Random(1)
    bits = ["/*", "*/", "/#", "#/", "a", "bc\n", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    rows = local_blocks(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in rows:
        page = source.tokenize({"p": texts[r.i]})[0]
        want = source.feature_page(page, texts[r.i])["blocks"]
        assert list(r.blocks) == want, texts[r.i]


def features(spark, text, name="p1.png"):
    return page_features(local_blocks(spark.createDataFrame([(name, text)], "page_name string, text string"))).first()


def test_features(spark):
    table = "/*\na    1\nb    2\nc    3\n*/"
    f = features(spark, table)
    assert f.special_format and f.aligned_fields and f.table_like and not f.dot_leaders
    two = features(spark, "/*\na    1\n*/\n/*\nb    2\n*/")
    assert not two.aligned_fields and not two.table_like
    assert features(spark, "/* I . . . 1 */").dot_leaders and not features(spark, "I . . . 1").dot_leaders
    long = "\n".join(["a much longer line of ordinary prose than any in the block"] * 6)
    assert features(spark, f"/*\nfirst\nsecond one\nthird\nfour\n*/\n{long}").poetry_like
    assert not features(spark, f"/*\nsame\nsame\nsame\nsame\n*/\n{long}").poetry_like
    assert features(spark, '/*\n"a"\n"b"\n"c"\n"d"\n*/').quotation_like and not features(spark, '/*\n"a"\n"b"\n\n"c"\n"d"\n*/').quotation_like
    assert features(spark, "/#\n  a\n  b\n#/").quotation_like and not features(spark, "/#\n  a\n b\n#/").quotation_like
    assert features(spark, "x", "p1L.png").multipart_name and not features(spark, "x", "p1l.png").multipart_name
    note = features(spark, "[Illustration: a] [**b] <I>c</i> <sc>")
    assert note.illustration_or_ornament and note.uncertainty_note and note.italic_tags == 1 and note.small_caps_tags == 1


def test_scores_and_groups(spark):
    row = scored_pages(local_blocks(spark.createDataFrame([("p", "<i>" * 15 + "<b>[**")], "page_name string, text string"))).first()
    assert row.score == 10 + 1 + 2 and list(row.groups) == ["mixed_typography"] and row.components["italic_tags"] == 10


def test_coverage_first(spark):
    rnd = random.Random(4)
    rows = [(f"b{i % 3}", f"p{i}", rnd.randint(0, 6), rnd.sample(GROUPS, rnd.randint(0, 3))) for i in range(90)]
    for k in (1, 3, 7, 40):
        got = selection.coverage_first(spark.createDataFrame(rows, "b string, n string, s int, groups array<string>"), ["b"], "n", [-F.col("s"), T.natural_key(F.col("n"))], GROUPS, k).collect()
        for b in ("b0", "b1", "b2"):
            order = sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], natural_key(r[1])))
            taken = []
            for g in GROUPS:
                fit = [r[1] for r in order if g in r[3] and r[1] not in taken]
                taken += fit[:1] if len(taken) < k else []
            taken += [r[1] for r in order if r[1] not in taken][: k - len(taken)]
            assert [r.n for r in sorted(got, key=lambda r: r.position) if r.b == b] == taken


def test_runs_and_gaps(spark):
    rows = spark.createDataFrame([("a", x) for x in (0, 1, 4, 5, 9, 20)], "k string, x int")
    assert [(r.start, r.stop, r.size) for r in islands.runs(rows, ["k"], "x", F.lit(3)).orderBy("run").collect()] == [(0, 6, 4), (9, 10, 1), (20, 21, 1)]
    assert [(r.x, r.gap) for r in islands.gaps(rows, ["k"], "x").orderBy("x").collect()] == [(4, 2), (9, 3), (20, 10)]
    assert islands.runs(rows, ["k"], "x", F.lit(3), at_least=2).count() == 1 and islands.runs(rows.limit(0), ["k"], "x", F.lit(1)).count() == 0


def test_otsu(spark):
    rows = spark.createDataFrame([("two", 10, 5), ("two", 200, 5), ("one", 7, 9), ("tie", 0, 1), ("tie", 1, 1), ("tie", 2, 1), ("tie", 3, 1)], "k string, level long, n long")
    assert {r.k: r.threshold for r in otsu(rows, ["k"]).collect()} == {"two": 10, "one": 0, "tie": 1}


def test_pooling(spark):
    rows = spark.createDataFrame([("b", "p10", 4.0, None), ("b", "p2", 2.0, None), ("b", "p3", None, "blank_page"), ("c", "p1", None, "image_missing")], "k string, p string, v double, x string")
    got = {r.k: r for r in pooling.pool_estimate(rows, ["k"], "v", F.col("p"), F.col("x"), T.natural_key(F.col("p"))).collect()}
    assert (got["b"].value, got["b"].mad, got["b"].sample_count, got["b"].evidence, got["b"].exclusions) == (3.0, 1.0, 2, ["p2", "p10"], ["p3:blank_page"])
    assert got["c"].value is None and got["c"].evidence == [] and got["c"].exclusions == ["p1:image_missing"]


def test_interval_merge_is_transitive(spark):
    rows = spark.createDataFrame([(1, 0, 10, 0, 5), (1, 9, 12, 2, 9), (1, 11, 20, 0, 1), (1, 20, 25, 0, 1)], "k int, x0 int, x1 int, y0 int, y1 int")
    assert sorted((r.x0, r.x1, r.y1, r.n) for r in intervals.merged(rows, ["k"]).collect()) == [(0, 20, 9, 3), (20, 25, 1, 1)]


def test_review(spark):
    rows = spark.createDataFrame([(True, True, False)] * 49 + [(True, False, False)], "accepted boolean, correct boolean, complex boolean").withColumn("k", F.lit(1))
    got = review.review_summary(rows, ["k"]).first()
    assert got.precision == 0.98 and got.passes and not review.review_summary(rows.withColumn("complex", F.lit(True)), ["k"]).first().passes
    codes = spark.createDataFrame([(["new_code"],)], "c array<string>")
    with pytest.raises(Exception, match="unknown exclusion"):
        codes.select(review.category(F.col("c"), ["a"], ["b"], ["d"])).collect()


def test_checks(spark):
    rows = spark.createDataFrame([(1, 0, 4), (1, 4, 6), (1, 7, 9)], "k int, a int, b int")
    assert checks.not_contiguous(rows, ["k"], "a", "b", "x").first().n == 1 and checks.repeated(rows, ["k"], "x").first().n == 1
    assert checks.violations(rows, "x", F.col("a") < 7).first().n == 1 and checks.not_covering(rows, rows.filter("a > 0"), "x").first().n == 1


def _catalog():
    from inkfold.plans import catalog

    return catalog.queries(), catalog.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(_catalog()[0]))
def test_query(spark, name):
    queries, oracle = _catalog()
    got = queries[name](spark, SF)
    rows = got.collect()
    assert rows and len(set(got.columns)) == len(got.columns)
    if name in oracle:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(oracle[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        plain = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
        order = sorted(names)
        assert sorted(([plain(r[c]) for c in order] for r in rows), key=str) == sorted(([plain(r[names.index(c)]) for c in order] for r in want.fetchall()), key=str)


def test_turn_alignment_takes_whole_texts(spark, tmp_path):
    """Turns of over 400 characters, told apart by their whole lengths."""
    from inkfold.kernels import align
    from inkfold.plans.q_kernels import QUERIES

    said, heard = [450, 1900, 700, 1200, 520], [1800, 430, 900, 1500, 610]
    rows = [(1, 2 * i + k, role, "x" * n) for i, pair in enumerate(zip(said, heard, strict=True)) for k, (role, n) in enumerate(zip(("user", "assistant"), pair, strict=True))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["turn_alignment"][0](spark, str(tmp_path)).collect()
    lines = [align.TextLine(i, "x" * n) for i, n in enumerate(said)]
    want = align.align(lines, [(0, 20 * i, n, 20 * i + 12) for i, n in enumerate(heard)], (0, 0, 1900, 4000))
    assert [(r.page_name, r.cost, r.operations) for r in got] == [("1", round(want["normalized_cost"], 9), len(want["operations"]))]
