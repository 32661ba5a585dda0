"""Queries over cut characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.functions.text import code_point
from inkfold.operators.glyphs import ascender_flatness, cell_extent, coverage, flagged, sheets, width_references, x_height_references
from inkfold.operators.selection import first_n

from .adapters import table

QUERIES: dict = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


_G = """g AS (SELECT item_id AS page, word, pos AS glyph, ch AS character, CASE WHEN item_id % 5 = 0 THEN NULL WHEN word % 9 = 0 THEN 'italic' ELSE 'roman' END AS style,
 CASE WHEN word % 17 = 0 THEN 'furniture' ELSE 'transcribed' END AS tier, CAST(4 + unicode(ch) % 7 + (item_id * 31 + word * 7 + pos) % 5 AS INT) AS width, CAST(10 + unicode(ch) % 6 + (item_id + pos * 3) % 4 AS INT) AS height
 FROM (SELECT item_id, word, unnest(regexp_extract_all(x, '.')) AS ch, generate_subscripts(regexp_extract_all(x, '.'), 1)::INT - 1 AS pos FROM
 (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS x, generate_subscripts(string_split_regex(text, '\\s+'), 1)::INT - 1 AS word FROM benchmark)))"""


def glyphs(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split("text", r"\s+")).alias("word", "x"))
    rows = rows.select("page", "word", F.posexplode(F.regexp_extract_all("x", F.lit("(.)"), F.lit(1))).alias("glyph", "character"))
    return rows.withColumns(
        {
            "style": F.when(F.col("page") % 5 != 0, F.when(F.col("word") % 9 == 0, "italic").otherwise("roman")),
            "tier": F.when(F.col("word") % 17 == 0, "furniture").otherwise("transcribed"),
            "width": (4 + F.ascii("character") % 7 + (F.col("page") * 31 + F.col("word") * 7 + F.col("glyph")) % 5).cast("int"),
            "height": (10 + F.ascii("character") % 6 + (F.col("page") + F.col("glyph") * 3) % 4).cast("int"),
        }
    )


@query(f"""WITH {_G} SELECT tier, style, character, grouping(tier, style, character) AS level, count(*) AS n, CASE WHEN character IS NOT NULL THEN printf('U+%04X', unicode(character)) END AS label FROM g GROUP BY GROUPING SETS ((tier, style, character), (tier, style), (tier))""")
def glyph_coverage(spark, d):
    return coverage(glyphs(spark, d)).withColumn("label", F.when(F.col("character").isNotNull(), F.col("label")))


@query(f"WITH {_G} SELECT DISTINCT character, printf('U+%04X', unicode(character)) AS label FROM g")
def code_point_labels(spark, d):
    return glyphs(spark, d).select("character").distinct().withColumn("label", code_point(F.col("character")))


@query(f"WITH {_G} SELECT character, style, median(width) AS reference FROM g GROUP BY ALL HAVING count(*) >= 30")
def character_widths(spark, d):
    return width_references(glyphs(spark, d))


@query(f"WITH {_G} SELECT page, word, median(height) AS x_reference FROM g WHERE contains('acemnorsuvwxz', character) GROUP BY ALL HAVING count(*) >= 4")
def line_x_heights(spark, d):
    return x_height_references(glyphs(spark, d), ["page", "word"])


_FLAG = f"""{_G}, r AS (SELECT character, style, median(width) AS reference FROM g GROUP BY ALL HAVING count(*) >= 30), x AS (SELECT page, word, median(height) AS xr FROM g WHERE contains('acemnorsuvwxz', character) GROUP BY ALL HAVING count(*) >= 4),
k AS (SELECT g.*, list_filter([CASE WHEN width < 0.6::DOUBLE * reference THEN 'narrow' END, CASE WHEN contains('acemnorsuvwxz', g.character) AND height >= 1.35::DOUBLE * xr THEN 'overtall' END, CASE WHEN width >= 1.5::DOUBLE * reference THEN 'wide' END], lambda v: v IS NOT NULL) AS flags
 FROM g LEFT JOIN r ON r.character = g.character AND r.style IS NOT DISTINCT FROM g.style LEFT JOIN x ON x.page = g.page AND x.word = g.word)"""


@query(f"WITH {_FLAG} SELECT page, word, glyph, array_to_string(flags, '+') AS flags FROM k WHERE len(flags) > 0")
def glyph_flags(spark, d):
    return flagged(glyphs(spark, d), ["page", "word"]).filter("size(flags) > 0").select("page", "word", "glyph", F.array_join("flags", "+").alias("flags"))


@query(f"WITH {_FLAG} SELECT tier, f AS flag, count(*) AS n FROM (SELECT tier, unnest(flags) AS f FROM k) GROUP BY ALL")
def flag_tallies(spark, d):
    return flagged(glyphs(spark, d), ["page", "word"]).select("tier", F.explode("flags").alias("flag")).groupBy("tier", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_G}, x AS (SELECT page, word, max(height) FILTER (WHERE contains('bdfhklt', character)) AS t, median(height) FILTER (WHERE contains('acemnorsuvwxz', character)) AS m FROM g GROUP BY page, word) SELECT page, word, t / m AS flatness, t / m < 1.1::DOUBLE AS flat FROM x WHERE t IS NOT NULL AND m > 0""")
def ascender_words(spark, d):
    return ascender_flatness(glyphs(spark, d), ["page", "word"])


@query(f"""WITH {_G}, s AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY page, word, glyph) - 1 AS o FROM g) SELECT tier, page, word, glyph, (o // 1024)::INT AS sheet, (o % 1024 // 32)::INT AS cell_row, (o % 1024 % 32)::INT AS cell_column FROM s""")
def atlas_cells(spark, d):
    return sheets(glyphs(spark, d), ["tier"], ["page", "word", "glyph"]).select("tier", "page", "word", "glyph", "sheet", "cell_row", "cell_column")


@query(f"""WITH {_G}, s AS (SELECT tier, list_sort(list(width)) AS w, list_sort(list(height)) AS h, count(*) AS n FROM g GROUP BY tier) SELECT tier, w[1 + least(n - 1, floor(0.95::DOUBLE * n))::INT] AS cell_width, h[1 + least(n - 1, floor(0.95::DOUBLE * n))::INT] AS cell_height FROM s""")
def cell_extents(spark, d):
    return cell_extent(glyphs(spark, d), ["tier"])


@query(f"WITH {_G} SELECT character, style, page, word, glyph FROM (SELECT *, row_number() OVER (PARTITION BY character, style ORDER BY page, word, glyph) AS r FROM g) WHERE r <= 250")
def shape_samples(spark, d):
    return first_n(glyphs(spark, d), ["character", "style"], [F.col("page"), F.col("word"), F.col("glyph")], 250).select("character", "style", "page", "word", "glyph")


_BAND = f"""{_G}, q AS (SELECT *, width * height AS area, floor(width * height * ((unicode(character) * 7 + glyph) % 11) / 10)::BIGINT AS ink, 100 - height + (page + glyph) % 6 - 2 AS y0, tier = 'transcribed' AS known FROM g),
e AS (SELECT *, ink / area AS density, CASE WHEN known THEN y0 - 88 END AS top, CASE WHEN known THEN y0 + height - 1 - 100 END AS bottom FROM q)"""


@query(f"""WITH {_BAND} SELECT page, word, glyph, density AS ink_density, height AS row_extent_px, top::INT AS top_offset_px, bottom::INT AS bottom_offset_px, array_to_string(list_filter([CASE WHEN top < -1 THEN 'ascends' END, CASE WHEN bottom > 1 THEN 'descends' END, CASE WHEN bottom < -1 THEN 'short_of_baseline' END,
CASE WHEN density < 0.15::DOUBLE THEN 'sparse_ink' END, CASE WHEN known AND y0 + height >= 103 THEN 'touches_line_bottom' END, CASE WHEN known AND y0 <= 86 THEN 'touches_line_top' END], lambda v: v IS NOT NULL), '+') AS flags FROM e""")
def glyph_geometry(spark, d):
    """Drawn boxes on a line from row 86 to 103 with its baseline at 100 and its x-height top at 88; furniture has no line."""
    from inkfold.operators.glyphs import band_quality

    g = glyphs(spark, d)
    y0 = (100 - F.col("height") + (F.col("page") + F.col("glyph")) % 6 - 2).cast("int")
    box = F.struct(F.lit(0).alias("x0"), y0.alias("y0"), F.col("width").alias("x1"), (y0 + F.col("height")).alias("y1"))
    line = F.when(F.col("tier") == "transcribed", F.struct(F.lit(0).alias("x0"), F.lit(86).alias("y0"), F.lit(900).alias("x1"), F.lit(103).alias("y1")))
    ink = F.floor(F.col("width") * F.col("height") * ((F.ascii("character") * 7 + F.col("glyph")) % 11) / 10)
    rows = g.withColumns({"box": box, "line_box": line, "ink": ink, "baseline_row_px": F.lit(100), "x_height_top_row_px": F.lit(88)})
    return band_quality(rows).select("page", "word", "glyph", "ink_density", "row_extent_px", "top_offset_px", "bottom_offset_px", F.array_join("band_flags", "+").alias("flags"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: least(greatest(floor(128 + 300 * v::DOUBLE), 0), 255)::INT) AS grid, vec_id % 10 = 0 AS defect FROM embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e WHERE NOT defect), k AS (SELECT * FROM s WHERE r <= 40), n AS (SELECT label, count(*) AS n FROM k GROUP BY label HAVING count(*) >= 20),
c AS (SELECT label, i, median(v) AS m FROM (SELECT label, unnest(grid) AS v, generate_subscripts(grid, 1) AS i FROM k SEMI JOIN n USING (label)) GROUP BY label, i), m AS (SELECT label, list(m ORDER BY i) AS m FROM c GROUP BY label),
w AS (SELECT label, sqrt(list_sum(list_transform(range(1, 65), lambda i: (grid[i] - m[i]) * (grid[i] - m[i])))) / 255 AS away FROM k JOIN m USING (label)),
t AS (SELECT label, list_sort(list(away)) AS a, count(*) AS n FROM w GROUP BY label), f AS (SELECT label, a[1 + least(n - 1, floor(0.95::DOUBLE * n))::INT] AS scatter FROM t),
o AS (SELECT vec_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (grid[i] - trunc(m[i])) * (grid[i] - trunc(m[i])))))/255 AS away, scatter FROM e JOIN m USING (label) JOIN f USING (label))
SELECT e.vec_id, concat(CASE WHEN defect THEN 'narrow' ELSE '' END, CASE WHEN defect AND scatter > 0 AND away > 1.4::DOUBLE * scatter THEN '+' ELSE '' END, CASE WHEN scatter > 0 AND away > 1.4::DOUBLE * scatter THEN 'unlike_character' ELSE '' END) AS flags FROM e LEFT JOIN o USING (vec_id)""")
def shape_outliers(spark, d):
    """Grids of embeddings against their label's shape, from samples of 20 to 40."""
    from inkfold.operators.glyphs import shape_references, unlike_flagged

    cell = lambda v: F.least(F.greatest(F.floor(128 + 300 * v.cast("double")), F.lit(0)), F.lit(255)).cast("int")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("character"), F.lit("roman").alias("style"), F.transform("embedding", cell).alias("grid"))
    rows = rows.withColumn("flags", F.when(F.col("vec_id") % 10 == 0, F.array(F.lit("narrow"))).otherwise(F.array().cast("array<string>")))
    return unlike_flagged(rows, ["vec_id"], shape_references(rows, ["vec_id"], 20, 40)).select("vec_id", F.array_join("flags", "+").alias("flags"))


@query("""WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, list_transform(embedding, lambda v: least(greatest(floor(128 + 300 * v::DOUBLE), 0), 255)::INT) AS grid FROM embeddings), k AS (SELECT * FROM e WHERE r <= 30),
c AS (SELECT label, i, median(v) AS m FROM (SELECT label, unnest(grid) AS v, generate_subscripts(grid, 1) AS i FROM k) GROUP BY label, i) SELECT label, sum(trunc(m))::BIGINT AS cells, (SELECT count(*) FROM k WHERE k.label = c.label) AS samples FROM c GROUP BY label HAVING samples >= 15""")
def shape_medians(spark, d):
    from inkfold.operators.glyphs import shape_references

    cell = lambda v: F.least(F.greatest(F.floor(128 + 300 * v.cast("double")), F.lit(0)), F.lit(255)).cast("int")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("character"), F.lit("roman").alias("style"), F.transform("embedding", cell).alias("grid"), F.array().cast("array<string>").alias("flags"))
    refs = shape_references(rows, ["vec_id"], 15, 30)
    counts = rows.groupBy("character").agg(F.least(F.count(F.lit(1)), F.lit(30)).alias("samples"))
    return refs.join(counts, "character").select(F.col("character").alias("label"), F.aggregate("median", F.lit(0).cast("long"), lambda s, x: s + x).alias("cells"), "samples")


@query(f"""WITH {_G} SELECT 'repeated_identity' AS broken, count(*) AS n FROM (SELECT 1 FROM g GROUP BY tier, page, word, glyph HAVING count(*) > 1) UNION ALL
SELECT 'coverage_sum', abs((SELECT count(*) FROM g) - (SELECT sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY tier, style, character)))::BIGINT""")
def glyph_invariants(spark, d):
    from inkfold.operators.checks import coverage_gap, repeated

    g = glyphs(spark, d)
    return repeated(g, ["tier", "page", "word", "glyph"], "repeated_identity").unionByName(coverage_gap(g, ["tier", "style", "character"]))
