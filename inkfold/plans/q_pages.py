"""Queries over marked pages: features, ranking, selection, text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkfold.functions.text import CONTROL, is_recto, letters_only, lines, middle, natural_key, nonblank, strip, tag_count
from inkfold.operators.features import GROUPS, local_blocks, scored_pages
from inkfold.operators.islands import since_last
from inkfold.operators.selection import coverage_first, positions, ranked

from .adapters import MARKED, spread, table

QUERIES: dict = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def marked(spark, d):
    return spark.sql(MARKED, documents=spread(table(spark, d, "documents")))


def _pages(spark, d):
    return scored_pages(local_blocks(marked(spark, d)))


#: Features and scores in the oracle's words; the adapter's markup is one block a page at most.
PAGES = f"""
m AS ({MARKED.replace("{documents}", "documents")}),
b AS (SELECT *, CASE WHEN doc_id % 7 IN (0, 3, 5, 6) THEN regexp_extract(text, '/\\*((?s:.*))\\*/', 1) WHEN doc_id % 7 = 4 THEN regexp_extract(text, '/#((?s:.*))#/', 1) END AS block,
  regexp_replace(text, '/\\*|\\*/|/#|#/', '', 'g') AS feature_text FROM m),
l AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: regexp_matches(x, '\\S')) AS bl, string_split(block, chr(10)) AS all_bl,
  list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS pl FROM b),
k AS (SELECT *, list_transform(bl, lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS ll,
  len(list_filter(bl, lambda x: regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^\\S(?:.*?\\S)? {{3,}}\\S(?:.*\\S)?$'))) AS aligned,
  array_to_string(list_transform(all_bl, lambda x: CASE WHEN regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^"(.*")?$') THEN 'q' ELSE 'n' END), '') AS quoted,
  list_transform(bl, lambda x: regexp_extract(x, '^[ \\t]*')) AS indent FROM l),
k2 AS (SELECT *, list_median(ll) AS lm, list_median(pl) AS pm FROM k),
f AS (SELECT project_id, page_name, doc_id, block IS NOT NULL AS special_format,
  len(regexp_extract_all(feature_text, '(?i)<i(?:\\s+[^>]*)?/?>'))::INT AS italic_tags, len(regexp_extract_all(feature_text, '(?i)<b(?:\\s+[^>]*)?/?>'))::INT AS bold_tags,
  len(regexp_extract_all(feature_text, '(?i)<sc(?:\\s+[^>]*)?/?>'))::INT AS small_caps_tags,
  coalesce(regexp_matches(block, '\\.(?: *\\.){{2,}}'), false) AS dot_leaders, coalesce(aligned >= 2, false) AS aligned_fields, coalesce(aligned >= 3, false) AS table_like,
  coalesce(len(ll) >= 4 AND lm < pm * 0.7::DOUBLE AND list_median(list_transform(ll, lambda x: abs(x - lm))) <> 0, false) AS poetry_like,
  coalesce(quoted LIKE '%qqqq%', false) OR coalesce(len(indent) >= 2 AND len(list_distinct(indent)) = 1 AND indent[1] <> '', false) AS quotation_like,
  regexp_matches(page_name, '[LMR]\\.[^.]+$') AS multipart_name, regexp_matches(text, '(?i)\\[(?:illustration|decoration)\\b[^\\]]*\\]') AS illustration_or_ornament, contains(text, '[**') AS uncertainty_note FROM k2),
s AS (SELECT *, 5 * special_format::INT + least(italic_tags, 10) + least(bold_tags, 10) + least(small_caps_tags, 10) + 8 * (dot_leaders OR aligned_fields)::INT + 8 * table_like::INT + 8 * poetry_like::INT
  + 6 * quotation_like::INT + 6 * multipart_name::INT + 4 * illustration_or_ornament::INT + 2 * uncertainty_note::INT AS score,
  list_filter([CASE WHEN italic_tags > 0 OR bold_tags > 0 OR small_caps_tags > 0 THEN 'mixed_typography' END, CASE WHEN table_like OR dot_leaders OR aligned_fields THEN 'table_like_structure' END,
   CASE WHEN poetry_like THEN 'poetry' END, CASE WHEN quotation_like THEN 'quotation' END, CASE WHEN multipart_name THEN 'multipart_layout' END], lambda x: x IS NOT NULL) AS groups FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, doc_id, page_name) AS rank FROM s)
"""
_FLAGS = "special_format, italic_tags, bold_tags, small_caps_tags, dot_leaders, aligned_fields, table_like, poetry_like, quotation_like, multipart_name, illustration_or_ornament, uncertainty_note"
def _order():
    return [-F.col("score"), natural_key(F.col("page_name"))]


@query(f"WITH {PAGES} SELECT page_name, {_FLAGS}, score FROM s")
def page_features(spark, d):
    return _pages(spark, d).select("page_name", *_FLAGS.split(", "), "score")


@query(f"WITH {PAGES} SELECT page_name, array_to_string(groups, '+') AS groups FROM s")
def page_groups(spark, d):
    return _pages(spark, d).select("page_name", F.array_join("groups", "+").alias("groups"))


@query(f"WITH {PAGES} SELECT project_id, page_name, score, rank FROM r")
def ranked_pages(spark, d):
    return ranked(_pages(spark, d), ["project_id"], _order()).select("project_id", "page_name", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {PAGES}, a AS (SELECT project_id, sum(score)::BIGINT AS top_ten FROM r WHERE rank <= 10 GROUP BY project_id),
g AS (SELECT project_id, count(DISTINCT x) AS n FROM (SELECT project_id, unnest(groups) AS x FROM s) GROUP BY project_id)
SELECT project_id, top_ten, 20 * coalesce(n, 0) AS group_bonus, top_ten + 20 * coalesce(n, 0) AS score FROM a LEFT JOIN g USING (project_id) ORDER BY score DESC, project_id LIMIT 50"""
)
def rank_projects(spark, d):
    from .stages import project_scores

    scores = project_scores(_pages(spark, d)).withColumnRenamed("top_ten_page_scores", "top_ten")
    return scores.orderBy(F.col("score").desc(), "project_id").limit(50)


@query(f"WITH {PAGES} SELECT count(DISTINCT project_id) AS projects, count(*) AS pages, count(*) FILTER (WHERE len(groups) > 0) AS matched, sum(score)::BIGINT AS score FROM s")
def corpus_counts(spark, d):
    return _pages(spark, d).agg(F.countDistinct("project_id").alias("projects"), F.count(F.lit(1)).alias("pages"), F.count_if(F.size("groups") > 0).alias("matched"), F.sum("score").alias("score"))


def _chained(k: int) -> str:
    out, taken = [], "SELECT NULL::VARCHAR AS project_id, NULL::VARCHAR AS page_name, 0 AS position WHERE false"
    out.append(f"t0 AS ({taken})")
    for i, g in enumerate(GROUPS, 1):
        out.append(
            f"""t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT c.project_id, c.page_name, coalesce(n, 0) + 1 FROM (SELECT project_id, page_name FROM (SELECT r.*, row_number() OVER (PARTITION BY project_id ORDER BY rank) AS o
            FROM r ANTI JOIN t{i - 1} USING (project_id, page_name) WHERE list_contains(groups, '{g}')) WHERE o = 1) c LEFT JOIN (SELECT project_id, count(*) AS n FROM t{i - 1} GROUP BY 1) USING (project_id) WHERE coalesce(n, 0) < {k})"""
        )
    out.append(
        f"""rest AS (SELECT project_id, page_name, coalesce(n, 0) + row_number() OVER (PARTITION BY project_id ORDER BY rank) AS position FROM r ANTI JOIN t5 USING (project_id, page_name)
        LEFT JOIN (SELECT project_id, count(*) AS n FROM t5 GROUP BY 1) USING (project_id))"""
    )
    return ", ".join(out) + f" SELECT project_id, page_name, position::INT AS position FROM (SELECT * FROM t5 UNION ALL SELECT * FROM rest) WHERE position <= {k}"


@query(f"WITH {PAGES}, {_chained(12)}")
def review_selection(spark, d):
    return coverage_first(_pages(spark, d).select("project_id", "page_name", "score", "groups"), ["project_id"], "page_name", _order(), GROUPS, 12)


@query("""WITH x AS (SELECT CASE WHEN toxic = 1 THEN 'malformed_f2' WHEN quality = 0 THEN 'missing_f2' END AS code, CASE WHEN doc_id % 4 <> 0 THEN concat('project', doc_id % 5) END AS project_id, concat('p', doc_id) AS page_name FROM labels)
SELECT code, project_id, page_name, row_number() OVER (ORDER BY code, coalesce(project_id, ''), coalesce(page_name, '')) AS position FROM x WHERE code IS NOT NULL""")
def sorted_diagnostics(spark, d):
    x = table(spark, d, "labels").select(
        F.when(F.col("toxic") == 1, "malformed_f2").when(F.col("quality") == 0, "missing_f2").alias("code"),
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("project"), F.col("doc_id") % 5)).alias("project_id"),
        F.concat(F.lit("p"), "doc_id").alias("page_name"),
    ).filter("code is not null")
    empty = F.lit("")
    return positions(x, [F.col("code"), F.coalesce("project_id", empty)], [F.coalesce("page_name", empty)]).withColumn("position", F.col("position").cast("long"))


@query("SELECT doc_id, source AS project_id, true AS available FROM documents SEMI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, source, false FROM documents ANTI JOIN labels USING (doc_id)")
def transcription_available(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", F.col("source").alias("project_id")), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("available", F.lit(True)).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("available", F.lit(False)))


@query(f"WITH m AS ({MARKED.replace('{documents}', 'documents')}) SELECT page_name, len(regexp_extract_all(text, '/\\*|\\*/|/#|#/'))::INT AS controls, array_to_string(regexp_extract_all(text, '/\\*|\\*/|/#|#/'), ' ') AS found FROM m")
def control_markers(spark, d):
    found = F.regexp_extract_all("text", F.lit(f"({CONTROL})"), F.lit(1))
    return marked(spark, d).select("page_name", F.size(found).alias("controls"), F.array_join(found, " ").alias("found"))


@query(f"WITH {PAGES} SELECT b.page_name, (block IS NOT NULL)::INT AS blocks, coalesce(length(block), 0)::INT AS block_chars, length(feature_text)::INT AS feature_chars, 0 AS malformed FROM b")
def block_fold(spark, d):
    rows = local_blocks(marked(spark, d))
    return rows.select("page_name", F.size("blocks").alias("blocks"), F.aggregate("blocks", F.lit(0), lambda s, b: s + F.length(b)).alias("block_chars"), F.length("feature_text").alias("feature_chars"), "malformed")


_LINES = "l AS (SELECT doc_id, i::INT AS ordinal, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (i = n - 1 AND line = ''))"


def doc_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.col("text"))).alias("ordinal", "line"))


@query(f"WITH {_LINES} SELECT doc_id, ordinal, length(line)::INT AS chars, octet_length(encode(line))::INT AS bytes, NOT regexp_matches(line, '\\S') AS blank FROM l")
def source_lines(spark, d):
    return doc_lines(spark, d).select("doc_id", "ordinal", F.length("line").alias("chars"), F.octet_length("line").alias("bytes"), (strip(F.col("line")) == "").alias("blank"))


@query(f"WITH {_LINES}, x AS (SELECT doc_id, list(length(line)) AS n FROM l WHERE regexp_matches(line, '\\S') GROUP BY doc_id) SELECT doc_id, list_median(n) AS middle, list_median(list_transform(n, lambda v: abs(v - list_median(n)))) AS mad FROM x")
def line_length_spread(spark, d):
    from inkfold.functions.text import deviation

    rows = table(spark, d, "documents").select("doc_id", F.transform(nonblank(lines(F.col("text"))), F.length).alias("n")).filter("size(n) > 0")
    return rows.select("doc_id", middle(F.col("n")).alias("middle"), deviation(F.col("n")).alias("mad"))


@query(f"""WITH {_LINES}, x AS (SELECT *, NOT regexp_matches(line, '\\S') AS blank FROM l), y AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY ordinal) AS t FROM x),
z AS (SELECT *, last_value(CASE WHEN NOT blank THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM y)
SELECT doc_id, ordinal, (t - coalesce(p, 0))::BIGINT AS blank_since FROM z WHERE NOT blank""")
def blank_lines_before(spark, d):
    blank = strip(F.col("line")) == ""
    return since_last(doc_lines(spark, d), ["doc_id"], "ordinal", blank, ~blank).filter(~blank).select("doc_id", "ordinal", "blank_since")


@query("""SELECT item_id, w.i::INT AS word, (1 + sum(1 + length(x)) OVER (PARTITION BY item_id ORDER BY i) - 1 - length(x) - 1)::INT AS start FROM (SELECT item_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM (SELECT item_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS l FROM benchmark)) w""")
def word_offsets(spark, d):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("word", "x"))
    before = Window.partitionBy("item_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("item_id", "word", F.coalesce(F.sum(F.length("x") + 1).over(before), F.lit(0)).cast("int").alias("start"))


@query("SELECT source AS project_id, count(*) AS pages, count(*) FILTER (WHERE (doc_id % 10) % 2 = 1) AS recto FROM documents GROUP BY source")
def recto_pages(spark, d):
    rows = marked(spark, d)
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(is_recto(F.col("page_name"))).alias("recto"))


@query(f"""WITH m AS ({MARKED.replace('{documents}', 'documents')}) SELECT project_id, page_name, row_number() OVER (PARTITION BY project_id ORDER BY doc_id, page_name) AS position FROM m""")
def natural_order(spark, d):
    return ranked(marked(spark, d), ["project_id"], [natural_key(F.col("page_name"))], "position").select("project_id", "page_name", F.col("position").cast("long").alias("position"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<i(?:\\s+[^>]*)?/?>'))::INT AS italic, len(regexp_extract_all(html, '(?i)<b(?:\\s+[^>]*)?/?>'))::INT AS bold, len(regexp_extract_all(html, '(?i)<p(?:\\s+[^>]*)?/?>'))::INT AS paragraphs FROM pages")
def opening_tags(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", tag_count(html, "i").alias("italic"), tag_count(html, "b").alias("bold"), tag_count(html, "p").alias("paragraphs"))


@query("SELECT item_id, w.i::INT AS word, regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g') AS letters FROM (SELECT item_id, unnest(string_split_regex(text, '\\s+')) AS x, generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 AS i FROM benchmark) w")
def normalized_words(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\s+")).alias("word", "x"))
    return rows.select("item_id", "word", letters_only(F.col("x")).alias("letters"))


@query("""SELECT doc_id, ordinal, count(*) OVER (PARTITION BY doc_id) AS evidence FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INT - 1 AS ordinal FROM (SELECT doc_id, string_split(replace(text, ', ', '    '), chr(10)) AS l FROM documents))
WHERE regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^\\S(?:.*?\\S)? {3,}\\S(?:.*\\S)?$') QUALIFY evidence >= 3""")
def table_evidence(spark, d):
    from inkfold.operators.features import _aligned

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(lines(F.replace("text", F.lit(", "), F.lit("    ")))).alias("ordinal", "line"))
    rows = rows.filter(_aligned(F.col("line")))
    return rows.select("doc_id", "ordinal", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("evidence")).filter("evidence >= 3")
