"""Queries over measured lines, ink profiles and row counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.functions.text import half_up
from inkfold.operators.histogram import clamped, otsu
from inkfold.operators.islands import gaps, runs
from inkfold.operators.pooling import dispersion, median_mad, pool_estimate, two_stage
from inkfold.operators.selection import first_n

from .adapters import LINES, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


_L = f"l AS ({LINES.replace('{lineitem}', 'lineitem')})"
_INK = "i AS (SELECT line_id, book, col FROM (SELECT vec_id AS line_id, label AS book, unnest(embedding) AS v, generate_subscripts(embedding, 1)::INT - 1 AS col FROM embeddings) WHERE abs(v) > 0.1)"
_GAPS = f"{_INK}, g AS (SELECT line_id, book, col, (col - lag(col) OVER (PARTITION BY line_id ORDER BY col) - 1)::INT AS gap FROM i)"


def measured(spark, d):
    return spark.sql(LINES, lineitem=table(spark, d, "lineitem"))


def ink(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("line_id"), F.col("label").alias("book"), F.posexplode("embedding").alias("col", "v"))
    return rows.filter("abs(v) > 0.1").drop("v")


@query(f"""WITH {_L}, c AS (SELECT book, median(height) FILTER (WHERE exclusion IS NULL) AS value, count(*) FILTER (WHERE exclusion IS NULL) AS sample_count, count(*) FILTER (WHERE exclusion IS NOT NULL) AS excluded FROM l GROUP BY book)
SELECT l.book, any_value(value) AS value, median(abs(height - value)) FILTER (WHERE exclusion IS NULL) AS mad, any_value(sample_count) AS sample_count, any_value(excluded) AS excluded FROM l JOIN c USING (book) GROUP BY l.book""")
def pooled_heights(spark, d):
    rows = measured(spark, d)
    mad = median_mad(rows.filter("exclusion is null"), ["book"], "height")
    out = rows.groupBy("book").agg(F.count_if(F.col("exclusion").isNotNull()).alias("excluded"))
    return mad.join(out, "book").select("book", F.col("center").alias("value"), F.col("spread").alias("mad"), F.col("n").alias("sample_count"), "excluded")


@query(f"""WITH {_L}, x AS (SELECT * FROM l), c AS (SELECT book, page, median(height) FILTER (WHERE exclusion IS NULL) AS value FROM x GROUP BY book, page)
SELECT x.book, x.page, any_value(value) AS value, median(abs(height - value)) FILTER (WHERE exclusion IS NULL) AS mad, count(*) FILTER (WHERE exclusion IS NULL) AS sample_count,
array_to_string(list(concat('n', line) ORDER BY line) FILTER (WHERE exclusion IS NULL), ',') AS evidence, array_to_string(list(concat('n', line, ':', exclusion) ORDER BY line) FILTER (WHERE exclusion IS NOT NULL), ',') AS exclusions
FROM x JOIN c USING (book, page) GROUP BY x.book, x.page""")
def page_estimates(spark, d):
    rows = measured(spark, d)
    got = pool_estimate(rows, ["book", "page"], "height", F.concat(F.lit("n"), "line"), F.col("exclusion"), F.col("line"))
    join = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return got.select("book", "page", "value", "mad", "sample_count", join("evidence").alias("evidence"), join("exclusions").alias("exclusions"))


@query(f"""WITH {_L}, p AS (SELECT book, page, page_class, median(height) AS h, count(height) AS nh, median(slope) FILTER (WHERE exclusion IS NULL) AS s, count(slope) FILTER (WHERE exclusion IS NULL) AS ns FROM l GROUP BY ALL),
n AS (SELECT book, page_class, 'height' AS name, h AS v, nh AS k FROM p UNION ALL SELECT book, page_class, 'slope', s, ns FROM p)
SELECT book, page_class, name, median(v) AS value, count(v) AS sample_count, sum(k)::BIGINT AS line_sample_count FROM n GROUP BY GROUPING SETS ((book, name), (book, page_class, name))""")
def book_estimates(spark, d):
    ok = F.col("exclusion").isNull()
    return two_stage(measured(spark, d), "book", "page", "page_class", {"height": F.col("height"), "slope": F.when(ok, F.col("slope"))}).select("book", "page_class", "name", "value", "sample_count", "line_sample_count")


@query(f"""WITH {_L}, p AS (SELECT book, page, median(height) AS h, count(*) AS n, median(slope) FILTER (WHERE exclusion IS NULL) AS s, count(*) FILTER (WHERE exclusion IS NULL) AS m FROM l GROUP BY book, page)
SELECT book, page, 'height' AS name, h AS value, n AS line_sample_count, 0::BIGINT AS excluded_line_count, NULL AS missing_reason FROM p UNION ALL SELECT book, page, 'slope', s, m, n - m, CASE WHEN m = 0 THEN 'no_measured_lines' END FROM p
UNION ALL SELECT book, page, 'gap', CASE WHEN x > 0 THEN g END, x, n - x, CASE WHEN x = 0 THEN 'no_reconciled_word_gaps' END FROM p JOIN (SELECT book, page, count(*) FILTER (WHERE line % 2 = 0) AS x FROM l GROUP BY book, page) USING (book, page)
LEFT JOIN (SELECT book, page, median(v) AS g FROM (SELECT book, page, unnest([line, height]) AS v FROM l WHERE line % 2 = 0) GROUP BY book, page) USING (book, page)""")
def page_line_medians(spark, d):
    from inkfold.operators.pooling import one, page_medians

    none = F.array().cast("array<double>")
    gaps_of = F.when(F.col("line") % 2 == 0, F.array(F.col("line").cast("double"), F.col("height"))).otherwise(none)
    metrics = {"height": (one(F.col("height")), "no_matched_lines"), "slope": (one(F.when(F.col("exclusion").isNull(), F.col("slope"))), "no_measured_lines"), "gap": (gaps_of, "no_reconciled_word_gaps")}
    return page_medians(measured(spark, d), ["book", "page"], metrics)


@query(f"""WITH {_L}, p AS (SELECT DISTINCT book, page, CASE WHEN page % 5 <> 0 THEN page_class END AS style FROM l), s AS (SELECT DISTINCT book, style FROM p WHERE style IS NOT NULL)
SELECT s.book, s.style, coalesce(string_agg(concat(page, ':unpooled_page_class'), ',' ORDER BY page), '') AS exclusions FROM s LEFT JOIN p ON p.book = s.book AND p.style IS DISTINCT FROM s.style GROUP BY s.book, s.style""")
def unpooled_pages(spark, d):
    from inkfold.operators.pooling import unpooled

    rows = measured(spark, d).withColumn("style", F.when(F.col("page") % 5 != 0, F.col("page_class")))
    return unpooled(rows.withColumn("page", F.col("page").cast("string")), "book", "page", "style", F.col("page").cast("long")).select("book", "style", F.array_join("exclusions", ",").alias("exclusions"))


@query(f"""WITH {_L}, v AS (SELECT book, list_sort(list(height)) AS s, count(*) AS n FROM l GROUP BY book) SELECT book, s[1 + floor(0.16::DOUBLE * (n - 1) + 0.5)::INT] AS p16, s[1 + floor(0.84::DOUBLE * (n - 1) + 0.5)::INT] AS p84 FROM v""")
def book_dispersion(spark, d):
    return dispersion(measured(spark, d), ["book"], "height")


@query(f"""WITH {_L}, x AS (SELECT * FROM l WHERE exclusion IS NULL), c AS (SELECT book, median(slope) AS center FROM x GROUP BY book) SELECT x.book, any_value(center) AS skew, median(abs(slope - center)) AS mad, count(*) AS lines FROM x JOIN c USING (book) GROUP BY x.book""")
def skew_summary(spark, d):
    return median_mad(measured(spark, d).filter("exclusion is null"), ["book"], "slope").select("book", F.col("center").alias("skew"), F.col("spread").alias("mad"), F.col("n").alias("lines"))


@query(f"""WITH {_L}, p AS (SELECT book, page, count(*) AS n, count(*) FILTER (WHERE exclusion IS NULL) AS m FROM l GROUP BY book, page) SELECT book, count(*) AS pages, sum(n)::BIGINT AS matched, sum(m)::BIGINT AS measured, sum(n - m)::BIGINT AS excluded, bool_and(m <= n) AS coherent FROM p GROUP BY book""")
def book_tallies(spark, d):
    pages = measured(spark, d).groupBy("book", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("exclusion").isNull()).alias("m"))
    return pages.groupBy("book").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("matched"), F.sum("m").alias("measured"), F.sum(F.col("n") - F.col("m")).alias("excluded"), F.bool_and(F.col("m") <= F.col("n")).alias("coherent"))


@query(f"""WITH {_L} SELECT book, sum(greatest(0, CAST(height AS INT) - 1))::BIGINT AS gaps, sum(abs(CAST(height AS INT) - line * 8))::BIGINT AS wrong, sum(abs(CAST(height AS INT) - line * 8)) / sum(greatest(0, CAST(height AS INT) - 1)) AS ratio, count(*) FILTER (WHERE abs(CAST(height AS INT) - line * 8) = 1) AS reconciled FROM l GROUP BY book""")
def gap_accuracy(spark, d):
    words, found = F.col("height").cast("int"), F.col("line") * 8
    wrong, some = F.sum(F.abs(words - found)), F.sum(F.greatest(F.lit(0), words - 1))
    return measured(spark, d).groupBy("book").agg(some.alias("gaps"), wrong.alias("wrong"), F.try_divide(wrong, some).alias("ratio"), F.count_if(F.abs(words - found) == 1).alias("reconciled"))


@query(f"""WITH {_L}, x AS (SELECT book, page, line, height, lag(line) OVER w AS pl, lag(height) OVER w AS ph FROM l WHERE exclusion IS NULL WINDOW w AS (PARTITION BY book, page ORDER BY line, height)) SELECT book, page, line, height - ph AS pitch FROM x WHERE line - pl = 1""")
def baseline_pitches(spark, d):
    w = Window.partitionBy("book", "page").orderBy("line", "height")
    rows = measured(spark, d).filter("exclusion is null").select("book", "page", "line", (F.col("height") - F.lag("height").over(w)).alias("pitch"), F.lag("line").over(w).alias("_p"))
    return rows.filter(F.col("line") - F.col("_p") == 1).drop("_p")


@query(f"""WITH {_L} SELECT book, page, line FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page, line) AS r FROM l WHERE exclusion IS NULL) WHERE r <= 12""")
def evidence_rows(spark, d):
    return first_n(measured(spark, d), ["book"], [F.col("page"), F.col("line")], 12, F.col("exclusion").isNull()).select("book", "page", "line")


@query(f"""WITH {_L}, p AS (SELECT book, page, sum(height) AS s, max(height) AS m, max(slope) AS a, count(*) AS n FROM l GROUP BY book, page)
SELECT book, page, CASE WHEN page % 13 = 0 THEN 'image_unavailable' WHEN s < 20 THEN 'blank_page' WHEN m = 50 THEN 'border_dominated' WHEN a > 0.075::DOUBLE THEN 'high_foreground_ratio' WHEN n < 2 THEN 'foreground_bounds_unavailable' END AS reason FROM p""")
def pooling_exclusions(spark, d):
    from .stages import pooling_exclusion

    pages = measured(spark, d).groupBy("book", "page").agg(F.sum("height").alias("s"), F.max("height").alias("m"), F.max("slope").alias("a"), F.count(F.lit(1)).alias("n"))
    told = F.array_compact(F.array(F.when(F.col("a") > F.lit(0.075), "high_foreground_ratio"), F.when(F.col("m") == 50, "border_dominated"), F.when(F.col("s") < 20, "blank"), F.lit("one_band")))
    rows = pages.withColumns({"width": F.when(F.col("page") % 13 != 0, 1), "bounds": F.when(F.col("n") >= 2, 1), "diagnostics": told})
    return rows.select("book", "page", pooling_exclusion().alias("reason"))


@query(f"""WITH {_GAPS} SELECT line_id, col, gap FROM g WHERE gap > 0""")
def word_gaps(spark, d):
    return gaps(ink(spark, d), ["line_id"], "col").withColumn("gap", F.col("gap").cast("int"))


@query(f"""WITH {_GAPS}, m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY col) AS r FROM g)
SELECT line_id, (r - 1)::BIGINT AS run, min(col)::INT AS start, (max(col) + 1)::INT AS stop, count(*) AS size FROM m GROUP BY line_id, r""")
def word_runs(spark, d):
    return runs(ink(spark, d), ["line_id"], "col", F.lit(2)).select("line_id", F.col("run").cast("long").alias("run"), F.col("start"), F.col("stop"), "size")


@query(f"""WITH {_GAPS}, m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY col) AS r FROM g), k AS (SELECT line_id, count(DISTINCT r) AS found FROM m GROUP BY line_id)
SELECT line_id, found, CASE WHEN line_id % 17 = 0 THEN 'no_labelled_letters' WHEN found <> 20 + line_id % 10 THEN 'run_count_disagrees' END AS reason FROM k""")
def separable_words(spark, d):
    found = runs(ink(spark, d), ["line_id"], "col", F.lit(1)).groupBy("line_id").agg(F.count(F.lit(1)).alias("found"))
    return found.withColumn("reason", F.when(F.col("line_id") % 17 == 0, "no_labelled_letters").when(F.col("found") != 20 + F.col("line_id") % 10, "run_count_disagrees"))


@query(f"""WITH {_GAPS} SELECT book, least(gap, 64)::BIGINT AS level, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL""")
def gap_histogram(spark, d):
    return clamped(gaps(ink(spark, d), ["book", "line_id"], "col"), ["book"], "gap")


def _otsu_sql(hist: str, keys: str) -> str:
    return f"""c AS (SELECT {keys}, level, n, sum(n) OVER w AS w1, sum(n * level) OVER w AS s1, sum(n) OVER (PARTITION BY {keys}) AS w, sum(n * level) OVER (PARTITION BY {keys}) AS s FROM {hist} WINDOW w AS (PARTITION BY {keys} ORDER BY level)),
v AS (SELECT *, (w1::HUGEINT * s - w::HUGEINT * s1) * (w1::HUGEINT * s - w::HUGEINT * s1) AS num, w1::HUGEINT * (w - w1) AS den FROM c WHERE w1 < w),
o AS (SELECT {keys}, min(level) AS threshold FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.{keys} = a.{keys} AND b.num * a.den > a.num * b.den) GROUP BY {keys}),
t AS (SELECT {keys}, coalesce(threshold, 0) AS threshold FROM (SELECT DISTINCT {keys} FROM {hist}) LEFT JOIN o USING ({keys}))"""


@query(f"""WITH h AS (SELECT event_type, least(255, floor(value))::BIGINT AS level, count(*) AS n FROM events GROUP BY ALL), {_otsu_sql('h', 'event_type')} SELECT * FROM t""")
def gray_thresholds(spark, d):
    levels = table(spark, d, "events").select("event_type", F.floor("value").alias("v"))
    return otsu(clamped(levels, ["event_type"], "v", 255), ["event_type"])


@query(f"""WITH {_GAPS}, h AS (SELECT book, least(gap, 64)::BIGINT AS level, count(*) AS n FROM g WHERE gap > 0 GROUP BY ALL), {_otsu_sql('h', 'book')},
y AS (SELECT book, any_value(threshold) AS threshold, sum(n)::BIGINT AS samples, max(n) FILTER (WHERE level <= threshold) AS l, max(n) FILTER (WHERE level > threshold) AS r, max(n) FILTER (WHERE level = threshold) AS hit FROM h JOIN t USING (book) GROUP BY book)
SELECT book, threshold, samples, coalesce(hit, 0) / least(l, r) AS valley, CASE WHEN samples >= 64 AND coalesce(hit, 0) / least(l, r) <= 0.5::DOUBLE THEN greatest(2, threshold) END AS split FROM y""")
def gap_valleys(spark, d):
    hist = clamped(gaps(ink(spark, d), ["book", "line_id"], "col"), ["book"], "gap")
    rows = hist.join(otsu(hist, ["book"]), "book")
    at = lambda c: F.max(F.when(c, F.col("n")))
    level, t = F.col("level"), F.col("threshold")
    out = rows.groupBy("book", "threshold").agg(F.sum("n").alias("samples"), at(level <= t).alias("l"), at(level > t).alias("r"), at(level == t).alias("a"))
    valley = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.coalesce("a", F.lit(0)) / F.least("l", "r"))
    return out.select("book", "threshold", "samples", valley.alias("valley"), F.when((F.col("samples") >= 64) & (valley <= F.lit(0.5)), F.greatest(F.lit(2), t)).alias("split"))


_ROWS = "b AS (SELECT DISTINCT event_type, floor(epoch(ts) / 600)::BIGINT AS y FROM events)"


@query(f"""WITH {_ROWS}, g AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY y) - 1 AS gap FROM b), m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY y) AS r FROM g)
SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY y_start) - 1)::BIGINT AS band, y_start, y_end FROM (SELECT event_type, r, min(y) AS y_start, max(y) + 1 AS y_end FROM m GROUP BY ALL) WHERE y_end - y_start >= 2""")
def ink_bands(spark, d):
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_type", F.floor(secs / 600).alias("y")).distinct()
    out = runs(rows, ["event_type"], "y", F.lit(2), at_least=2)
    return out.select("event_type", F.col("run").cast("long").alias("band"), F.col("start").alias("y_start"), F.col("stop").alias("y_end"))


@query(f"""WITH {_ROWS}, g AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type ORDER BY y) - 1 AS gap FROM b), m AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY y) AS r FROM g),
s AS (SELECT event_type, min(y) AS y FROM m GROUP BY event_type, r), p AS (SELECT event_type, lead(y) OVER (PARTITION BY event_type ORDER BY y) - y AS pitch FROM s) SELECT event_type, median(pitch) AS pitch FROM p GROUP BY event_type""")
def band_pitch(spark, d):
    secs = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_type", F.floor(secs / 600).alias("y")).distinct()
    out = runs(rows, ["event_type"], "y", F.lit(2))
    w = Window.partitionBy("event_type").orderBy("start")
    return out.select("event_type", (F.lead("start").over(w) - F.col("start")).alias("p")).groupBy("event_type").agg(F.median("p").alias("pitch"))


@query(f"""WITH {_L}, x AS (SELECT book, page, median(height) AS m FROM l GROUP BY book, page HAVING count(*) >= 5) SELECT book, page, floor(m + 0.5)::BIGINT AS up, round_even(m, 0)::BIGINT AS even, trunc(m)::BIGINT AS cut, round_even(m / 7, 4) AS four FROM x""")
def rounded_medians(spark, d):
    pages = measured(spark, d).groupBy("book", "page").agg(F.median("height").alias("m"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return pages.select("book", "page", half_up(F.col("m")).alias("up"), F.bround("m").cast("long").alias("even"), F.col("m").cast("long").alias("cut"), F.bround(F.col("m") / 7, 4).alias("four"))


@query(f"""WITH {_L} SELECT book, round(coalesce(regr_slope(height, line), 0), 9) AS slope FROM l GROUP BY book""")
def fitted_slopes(spark, d):
    return measured(spark, d).groupBy("book").agg(F.round(F.coalesce(F.regr_slope("height", F.col("line").cast("double")), F.lit(0.0)), 9).alias("slope"))


@query(f"""WITH {_L}, x AS (SELECT book, page, round_even(median(height), 0) AS x FROM l GROUP BY book, page HAVING count(*) >= 5) SELECT book, max(x) - min(x) AS spread, count(*) AS pages FROM x GROUP BY book""")
def x_height_spread(spark, d):
    pages = measured(spark, d).groupBy("book", "page").agg(F.bround(F.median("height")).alias("x"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return pages.groupBy("book").agg((F.max("x") - F.min("x")).alias("spread"), F.count(F.lit(1)).alias("pages"))
