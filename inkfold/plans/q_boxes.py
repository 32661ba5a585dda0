"""Queries over boxes, intervals and page templates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.operators.intervals import best_overlap, contained, joined_pieces, merged, overlapping
from inkfold.operators.templates import classify, fit_templates, head_ordinal, head_windows

from .adapters import BOXES, FIRST_BANDS, WORDS, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


_W, _B = f"w AS ({WORDS.replace('{part}', 'part')})", f"b AS ({BOXES.replace('{supplier}', 'supplier')})"
_AREA = "2 * greatest(least(w.x1, b.x1) - greatest(w.x0, b.x0), 0) * greatest(least(w.y1, b.y1) - greatest(w.y0, b.y0), 0) >= (w.x1 - w.x0) * (w.y1 - w.y0)"
_F = f"f AS ({FIRST_BANDS.replace('{orders}', 'orders')})"


def words(spark, d):
    return spark.sql(WORDS, part=table(spark, d, "part"))


def boxes(spark, d):
    return spark.sql(BOXES, supplier=table(spark, d, "supplier"))


def first_bands(spark, d):
    return spark.sql(FIRST_BANDS, orders=table(spark, d, "orders"))


@query(f"WITH {_W}, {_B} SELECT word_id, box_id FROM w JOIN b ON w.page = b.page AND {_AREA}")
def words_in_lines(spark, d):
    return contained(words(spark, d), boxes(spark, d)).select("word_id", "box_id")


@query(f"WITH {_W}, {_B} SELECT word_id, page FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE w.page = b.page AND {_AREA})")
def furniture_words(spark, d):
    return contained(words(spark, d), boxes(spark, d), "left_anti").select("word_id", "page")


@query(f"""WITH {_W}, {_B}, m AS (SELECT word_id, w.page, box_id, greatest(least(w.x1, b.x1) - greatest(w.x0, b.x0), 0) AS shared FROM w JOIN b ON w.page = b.page
AND greatest(least(w.y1, b.y1) - greatest(w.y0, b.y0), 0) * 10 > (w.y1 - w.y0) * 4 AND least(w.x1, b.x1) > greatest(w.x0, b.x0))
SELECT box_id, page, word_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY shared DESC, word_id) AS r FROM m) WHERE r = 1""")
def witness_words(spark, d):
    return best_overlap(boxes(spark, d), words(spark, d))


@query(f"""WITH {_W}, {_B}, l AS (SELECT b.*, 1 + box_id % 4 AS runs, 1 + box_id % 3 AS words, CASE box_id % 3 WHEN 0 THEN 'Part' ELSE 'other' END AS own FROM b),
m AS (SELECT box_id, word, greatest(least(w.x1, l.x1) - greatest(w.x0, l.x0), 0) AS shared, word_id FROM w JOIN l ON w.page = l.page AND greatest(least(w.y1, l.y1) - greatest(w.y0, l.y0), 0) * 10 > (w.y1 - w.y0) * 4 AND least(w.x1, l.x1) > greatest(w.x0, l.x0)),
f AS (SELECT box_id, regexp_replace(lower(string_split(word, ' ')[1]), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS said FROM m QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY shared DESC, word_id) = 1),
x AS (SELECT l.*, said, coalesce(runs > words AND said <> lower(own), false) AS fragment FROM l LEFT JOIN f USING (box_id))
SELECT page % 7 AS project_id, count(*) AS measured, count(said) AS witnessed, count(*) FILTER (WHERE fragment) AS continuation_fragments, count(*) FILTER (WHERE runs = words OR (fragment AND runs - 1 = words)) AS reconciled_after_witness,
 count(*) FILTER (WHERE runs = words OR (fragment AND runs - 1 = words)) / count(*) AS reconciled_share FROM x GROUP BY page % 7""")
def witness_tallies(spark, d):
    """Boxes as lines of one to four runs and one to three words, and the first word of a part's name as what a recogniser read."""
    from inkfold.operators.witness import first_runs, tallies

    runs, own = 1 + F.col("box_id") % 4, 1 + F.col("box_id") % 3
    lines = boxes(spark, d).select((F.col("page") % 7).alias("project_id"), F.col("page").alias("page_name"), F.col("box_id").alias("candidate"), F.concat(F.when(F.col("box_id") % 3 == 0, "Part").otherwise("other"), F.lit(" more")).alias("text"), F.struct("x0", "y0", "x1", "y1").alias("first_run"),
                                   runs.alias("word_run_count"), own.alias("source_word_count"), (runs == own).alias("words_reconciled"), F.lit(True).alias("measured"))
    read = words(spark, d).select((F.col("page") % 7).alias("project_id"), F.col("page").alias("page_name"), F.lit(0).alias("line_index"), F.col("word_id").alias("word_index"), F.get(F.split("word", " "), F.lit(0)).alias("word"), F.lit(1.0).alias("confidence"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    return tallies(first_runs(lines, read), ["project_id"])


@query(f"""WITH {_W}, {_B}, r AS (SELECT DISTINCT box_id, lower(string_split(word, ' ')[1]) AS said FROM w JOIN b ON w.page = b.page AND {_AREA}),
o AS (SELECT b.box_id, unnest(list_transform(string_split(p_name, ' '), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS own FROM b JOIN part ON p_partkey = b.page * 50 + box_id % 50 + 1),
a AS (SELECT o.box_id, count(r.said) / count(*) AS agreement FROM o LEFT JOIN r ON r.box_id = o.box_id AND r.said = o.own AND o.own <> '' GROUP BY o.box_id)
SELECT box_id, agreement FROM a WHERE agreement >= 0.4::DOUBLE""")
def line_admission(spark, d):
    """Boxes as lines with the name of a part of their page, against the first words of the parts in them; admitted from 0.4 on."""
    from .stages import admitted_lines

    names = table(spark, d, "part").select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("text"))
    lines = boxes(spark, d).withColumn("_k", F.col("page") * 50 + F.col("box_id") % 50 + 1).join(names, "_k")
    lines = lines.select(F.lit("a").alias("project_id"), F.col("page").alias("page_name"), F.col("box_id").alias("candidate"), "text", F.struct("x0", "y0", "x1", "y1").alias("box"))
    read = words(spark, d).select(F.lit("a").alias("project_id"), F.col("page").alias("page_name"), F.get(F.split("word", " "), F.lit(0)).alias("word"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    return admitted_lines(read, lines, 0.4).select(F.col("candidate").alias("box_id"), "agreement")


@query(f"""WITH {_W}, {_B} SELECT word_id, box_id, greatest(w.x0, b.x0) AS cut_start, least(w.x1, b.x1) AS cut_stop FROM w JOIN b ON w.page = b.page AND w.x0 < b.x1 AND w.x1 > b.x0""")
def styles_on_lines(spark, d):
    a = words(spark, d).select("word_id", "page", F.col("x0").alias("s0"), F.col("x1").alias("s1"))
    b = boxes(spark, d).select("box_id", "page", F.col("x0").alias("l0"), F.col("x1").alias("l1"))
    return overlapping(a, b, ["page"], ("s0", "s1"), ("l0", "l1")).select("word_id", "box_id", "cut_start", "cut_stop")


@query(f"""WITH {_W}, {_B}, k AS (SELECT box_id, word_id, CASE word_id % 3 WHEN 0 THEN 'bold' WHEN 1 THEN 'italic' ELSE 'small_caps' END AS kind FROM b JOIN w ON w.page = b.page AND w.x0 <= b.x0 + 30 AND w.x1 > b.x0 + 30)
SELECT b.box_id, CASE WHEN b.box_id % 10 = 0 THEN NULL ELSE coalesce((SELECT string_agg(kind, '+' ORDER BY kind) FROM (SELECT DISTINCT kind FROM k WHERE k.box_id = b.box_id)), 'roman') END AS style FROM b""")
def style_at_character(spark, d):
    from .stages import style_at

    kind = F.when(F.col("word_id") % 3 == 0, "bold").when(F.col("word_id") % 3 == 1, "italic").otherwise("small_caps")
    spans = words(spark, d).groupBy("page").agg(F.collect_list(F.struct(F.col("x0").alias("start"), F.col("x1").alias("stop"), kind.alias("kind"))).alias("spans"))
    rows = boxes(spark, d).join(spans, "page", "left")
    known = F.when(F.col("box_id") % 10 != 0, F.coalesce("spans", F.filter("spans", lambda s: F.lit(False)), F.expr("cast(array() as array<struct<start:int,stop:int,kind:string>>)")))
    return rows.select("box_id", style_at(known, F.col("x0") + 30).alias("style"))


@query(f"""WITH {_W}, e AS (SELECT *, max(x1) OVER (PARTITION BY page, y0 ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM w),
g AS (SELECT *, sum(CASE WHEN edge IS NULL OR x0 >= edge THEN 1 ELSE 0 END) OVER (PARTITION BY page, y0 ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT page, y0 AS band, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM g GROUP BY page, y0, k""")
def merged_clusters(spark, d):
    return merged(words(spark, d).withColumn("band", F.col("y0")), ["page", "band"]).select("page", "band", "x0", "x1", "y1", "n")


@query(f"""WITH RECURSIVE {_W}, s AS (SELECT *, median(y1 - y0) OVER (PARTITION BY page) AS h FROM w), e AS (SELECT a.page, a.word_id AS a, b.word_id AS b FROM s a JOIN s b ON a.page = b.page AND a.word_id <> b.word_id
 AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 100 >= 40 * least(a.y1 - a.y0, b.y1 - b.y0) AND abs(a.y0 + a.y1 - b.y0 - b.y1) * 10 <= 12 * greatest(a.y1 - a.y0, b.y1 - b.y0)
 AND greatest(0, b.x0 - a.x1, a.x0 - b.x1) <= 2 * a.h), r AS (SELECT page, word_id, word_id AS root FROM s UNION SELECT r.page, e.b, r.root FROM r JOIN e ON r.page = e.page AND r.word_id = e.a)
SELECT page, word_id, min(root) AS cluster FROM r GROUP BY page, word_id""")
def joined_components(spark, d):
    return joined_pieces(words(spark, d), ["page"], "word_id")


@query(f"WITH {_B} SELECT page, arg_min(box_id, (-(x1 - x0), x0, y0, box_id)) AS box_id FROM b GROUP BY page")
def widest_gutters(spark, d):
    return boxes(spark, d).groupBy("page").agg(F.min_by("box_id", F.struct((F.col("x0") - F.col("x1")).alias("w"), "x0", "y0", "box_id")).alias("box_id"))


@query(f"WITH {_W} SELECT page, word_id, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1, word_id) - 1 AS ordinal FROM w")
def candidate_order(spark, d):
    w = Window.partitionBy("page").orderBy("y0", "x0", "x1", "y1", "word_id")
    return words(spark, d).select("page", "word_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query(f"""WITH {_W}, {_B} SELECT word_id, box_id, least(w.x0, b.x0) AS ux0, least(w.y0, b.y0) AS uy0, greatest(w.x1, b.x1) AS ux1, greatest(w.y1, b.y1) AS uy1,
(greatest(least(w.x1, b.x1) - greatest(w.x0, b.x0), 0) * greatest(least(w.y1, b.y1) - greatest(w.y0, b.y0), 0))::BIGINT AS area, least(w.x1, 150) > greatest(w.x0, 20) AS inside FROM w JOIN b ON w.page = b.page""")
def box_algebra(spark, d):
    m = words(spark, d).alias("w").join(boxes(spark, d).alias("b"), "page")
    low, high = (lambda c: F.least(F.col(f"w.{c}"), F.col(f"b.{c}"))), (lambda c: F.greatest(F.col(f"w.{c}"), F.col(f"b.{c}")))
    part = lambda a, b: F.greatest(low(b) - high(a), F.lit(0))
    return m.select("word_id", "box_id", low("x0").alias("ux0"), low("y0").alias("uy0"), high("x1").alias("ux1"), high("y1").alias("uy1"), (part("x0", "x1").cast("long") * part("y0", "y1")).alias("area"), (F.least(F.col("w.x1"), F.lit(150)) > F.greatest(F.col("w.x0"), F.lit(20))).alias("inside"))


@query(f"""WITH {_W}, x AS (SELECT word_id, page, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, floor((x1 - x0) * (y1 - y0) * (word_id % 21) / 20)::BIGINT AS ink FROM (SELECT word_id, page, x0, y0, x1, CASE WHEN word_id % 5 = 0 THEN y0 + 1 + word_id % 4 ELSE y1 END AS y1 FROM w)),
t AS (SELECT page, median(height) AS h, median(ink) AS k FROM x GROUP BY page)
SELECT word_id, CASE WHEN k > 0 AND height * 100 <= h * 31 AND ink * 100 < k * 5 THEN 'speck_band' WHEN height * 100 <= h * 50 AND ink * 100 > area * 60 THEN 'rule_band' END AS reason FROM x JOIN t USING (page)""")
def speck_and_rule_bands(spark, d):
    """Words as bands, a fifth of them one to four rows high, with 0 to 100 % of their box inked."""
    from inkfold.operators.bands import band_reasons

    w = words(spark, d).withColumn("y1", F.when(F.col("word_id") % 5 == 0, F.col("y0") + 1 + F.col("word_id") % 4).otherwise(F.col("y1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    bands = w.select("word_id", "page", (F.col("y1") - F.col("y0")).alias("height"), area.alias("area"), F.floor(area * (F.col("word_id") % 21) / 20).alias("ink"))
    return band_reasons(bands, ["page"]).select("word_id", "reason")


_HEAD = f"""{_F}, c AS (SELECT book, median(first_top) AS c, count(*) AS n FROM f GROUP BY book), m AS (SELECT f.book, any_value(c) AS c, any_value(n) AS n, median(abs(first_top - c)) AS spread FROM f JOIN c USING (book) GROUP BY f.book),
h AS (SELECT book, c AS center, spread, n, CASE WHEN spread <= 25 THEN greatest(8, 3 * spread) END AS win FROM m)"""


@query(f"WITH {_HEAD} SELECT book, center, spread, n, win AS \"window\" FROM h")
def head_bands(spark, d):
    return head_windows(first_bands(spark, d))


_FIT = f"""{_HEAD}, r AS (SELECT f.*, center, win, regexp_extract(page_name, '([0-9])[^0-9]*$', 1)::INT % 2 = 1 AS recto FROM f JOIN h USING (book) WHERE win IS NOT NULL),
nm AS (SELECT r.*, text_left <= median(text_left) OVER (PARTITION BY book) AS low FROM r WHERE abs(first_top - center) <= win),
sd AS (SELECT book, count(*) FILTER (WHERE low) AS nl, count(*) FILTER (WHERE NOT low) AS nh, coalesce(avg(recto::INT) FILTER (WHERE NOT low), 0) > coalesce(avg(recto::INT) FILTER (WHERE low), 0) AS hr FROM nm GROUP BY book),
al AS (SELECT nm.book, first_top, text_left, text_right, band_count, CASE WHEN (CASE WHEN least(nl, nh) < 0.2::DOUBLE * (nl + nh) THEN recto WHEN hr THEN NOT low ELSE low END) THEN 'normal_recto' ELSE 'normal_verso' END AS page_class FROM nm JOIN sd USING (book)
 UNION ALL SELECT book, first_top, text_left, text_right, band_count, 'chapter_opening' FROM r WHERE first_top - center >= 150),
tc AS (SELECT *, median(first_top) OVER (PARTITION BY book, page_class) AS tc FROM al),
tp AS (SELECT book, page_class, trunc(any_value(tc))::INT AS first_top, trunc(median(abs(first_top - tc)))::INT AS first_spread, trunc(median(text_left))::INT AS text_left, trunc(median(text_right))::INT AS text_right, trunc(median(band_count))::INT AS band_count, count(*) AS page_count, count(*) / (SELECT count(*) FROM f WHERE f.book = tc.book) AS page_share FROM tc GROUP BY book, page_class)"""


@query(f"WITH {_FIT} SELECT * FROM tp")
def page_templates(spark, d):
    return fit_templates(first_bands(spark, d))


@query(f"""WITH {_FIT}, x AS (SELECT f.book, page, first_top AS head_top, text_left, center, win FROM f JOIN h USING (book)),
k AS (SELECT x.book, x.page, t.page_class, abs(head_top - t.first_top) AS residual, greatest(0, 1 - abs(head_top - t.first_top) / greatest(t.first_spread, 8)) AS confidence,
 row_number() OVER (PARTITION BY x.book, x.page ORDER BY abs(x.text_left - t.text_left), t.page_class) AS o, abs(x.text_left - t.text_left) <= win AS near FROM x JOIN tp t ON x.book = t.book AND t.page_class LIKE 'normal%' WHERE abs(head_top - center) <= win),
s AS (SELECT x.book, x.page, t.page_class, abs(head_top - t.first_top) AS residual, greatest(0, 1 - abs(head_top - t.first_top) / greatest(t.first_spread, 8)) AS confidence FROM x JOIN tp t ON x.book = t.book AND t.page_class = 'chapter_opening' WHERE abs(head_top - center) > win AND head_top - center >= 150)
SELECT x.book, x.page, coalesce(k.page_class, s.page_class, 'unknown') AS page_class, coalesce(k.residual, s.residual) AS residual, coalesce(k.confidence, s.confidence)::DOUBLE AS confidence
FROM x LEFT JOIN k ON k.book = x.book AND k.page = x.page AND k.o = 1 AND k.near LEFT JOIN s ON s.book = x.book AND s.page = x.page""")
def page_classes(spark, d):
    pages = first_bands(spark, d)
    return classify(pages.withColumn("head_top", F.col("first_top")), fit_templates(pages))


@query(f"""WITH {_HEAD}, t AS (SELECT f.book, page, [first_top - 90, first_top - 6, first_top + 40] AS tops, center, win FROM f JOIN h USING (book))
SELECT book, page, CASE WHEN tops[1] >= center - win THEN 0 WHEN tops[2] >= center - win THEN 1 WHEN tops[3] >= center - win THEN 2 ELSE 0 END AS head_ordinal FROM t""")
def head_band_search(spark, d):
    """Pages of three bands, the first of them above the head's window."""
    pages = first_bands(spark, d)
    rows = pages.join(head_windows(pages).select("book", "center", "window"), "book")
    tops = F.array(*[F.col("first_top") + k for k in (-90, -6, 40)])
    return rows.select("book", "page", head_ordinal(tops, F.col("center"), F.col("window")).alias("head_ordinal"))
