"""Queries over gates, reviews, sets, scalars, joins by key and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkfold.operators.checks import not_contiguous, violations
from inkfold.operators.review import book_yield, category, count_exclusions, gate, quality_exclusions, review_summary

from .adapters import table
from .q_pages import _LINES, doc_lines

QUERIES: dict = {}


def query(sql: str | None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


_TURNS = "t AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS lines, count(*) FILTER (WHERE role <> 'user') AS candidates, sum(length(text)) FILTER (WHERE role = 'user') AS a, sum(length(text)) FILTER (WHERE role <> 'user') AS b FROM conversations GROUP BY conv_id)"


def turns(spark, d):
    user = F.col("role") == "user"
    size = lambda c: F.sum(F.when(c, F.length("text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(user).alias("lines"), F.count_if(~user).alias("candidates"), size(user).alias("a"), size(~user).alias("b"))


@query(f"""WITH {_TURNS}, x AS (SELECT *, least(lines, candidates) AS matched, abs(coalesce(a, 0) - coalesce(b, 0)) / greatest(coalesce(a, 0) + coalesce(b, 0), 1) AS cost, (conv_id % 10) / 20 AS uniqueness,
 CASE WHEN conv_id % 9 = 0 THEN ['blank_page', 'blank_page'] ELSE [] END AS inherited FROM t),
y AS (SELECT *, list_filter([CASE WHEN lines < 4 OR lines > 80 THEN 'line_count_out_of_range' END, CASE WHEN abs(lines - candidates) > greatest(2, ceil(0.1::DOUBLE * lines)) THEN 'line_count_difference_exceeds_maximum' END], lambda v: v IS NOT NULL) AS early,
 list_filter([CASE WHEN (CASE WHEN lines > 0 THEN matched / lines ELSE 0 END) < 0.9::DOUBLE THEN 'matched_ratio_below_minimum' END, CASE WHEN cost > 0.22::DOUBLE THEN 'normalized_cost_exceeds_maximum' END, CASE WHEN uniqueness < 0.15::DOUBLE THEN 'uniqueness_margin_below_minimum' END], lambda v: v IS NOT NULL) AS late FROM x)
SELECT conv_id, array_to_string(list_concat(CASE WHEN len(inherited) > 0 THEN ['blank_page'] ELSE [] END, list_concat(early, late)), '+') AS exclusions, CASE WHEN len(inherited) + len(early) > 0 THEN 'excluded' WHEN len(late) > 0 THEN 'proposed' ELSE 'accepted' END AS state FROM y""")
def acceptance_gate(spark, d):
    t = turns(spark, d)
    total = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    cost = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))) / F.greatest(total, F.lit(1))
    inherited = F.when(F.col("conv_id") % 9 == 0, F.array(F.lit("blank_page"), F.lit("blank_page"))).otherwise(F.array().cast("array<string>"))
    codes, state = gate(inherited, count_exclusions(F.col("lines"), F.col("candidates")), quality_exclusions(F.least("lines", "candidates"), F.col("lines"), cost, (F.col("conv_id") % 10) / 20))
    return t.select("conv_id", F.array_join(codes, "+").alias("exclusions"), state.alias("state"))


_LAB = "x AS (SELECT d.doc_id, source, CASE WHEN l.doc_id IS NULL THEN ['image_unavailable'] WHEN toxic = 1 THEN ['source_changed', 'table_like'] WHEN quality = 0 THEN ['table_like'] ELSE [] END AS codes, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left")
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    none = F.array().cast("array<string>")
    return rows.withColumn("codes", F.when(F.col("quality").isNull(), lit("image_unavailable")).when(F.col("toxic") == 1, lit("source_changed", "table_like")).when(F.col("quality") == 0, lit("table_like")).otherwise(none))


@query(f"WITH {_LAB} SELECT doc_id, CASE WHEN list_contains(codes, 'source_changed') THEN 'source_changed' WHEN list_contains(codes, 'image_unavailable') THEN 'unavailable' WHEN len(codes) > 0 THEN 'complex' ELSE 'eligible' END AS category FROM x")
def review_categories(spark, d):
    return labelled(spark, d).select("doc_id", category(F.col("codes"), ["source_changed"], ["image_unavailable"], ["table_like"]).alias("category"))


@query("""WITH x AS (SELECT source, quality = 1 AS accepted, toxic = 0 AS correct, labels.doc_id % 3 = 0 AS complex FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (WHERE accepted AND correct) AS accepted_correct, count(*) FILTER (WHERE accepted AND NOT correct) AS accepted_wrong, count(*) FILTER (WHERE NOT accepted AND correct) AS rejected_correct,
 count(*) FILTER (WHERE NOT accepted AND NOT correct) AS rejected_wrong, count(*) FILTER (WHERE accepted AND complex) AS complex_accepted, count(*) FILTER (WHERE accepted AND correct) / nullif(count(*) FILTER (WHERE accepted), 0) AS precision,
 count(*) FILTER (WHERE accepted) / count(*) AS coverage, coalesce(count(*) FILTER (WHERE accepted AND correct) / nullif(count(*) FILTER (WHERE accepted), 0) >= 0.98::DOUBLE, false) AND count(*) FILTER (WHERE accepted AND complex) = 0 AS passes FROM x GROUP BY source""")
def review_counts(spark, d):
    rows = labelled(spark, d).filter("quality is not null").select("source", (F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("correct"), (F.col("doc_id") % 3 == 0).alias("complex"))
    return review_summary(rows, ["source"])


@query("""WITH p AS (SELECT DISTINCT source FROM documents), c AS (SELECT source, count(*) FILTER (WHERE toxic = 0) AS eligible, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS accepted FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, coalesce(eligible, 0) AS eligible, coalesce(accepted, 0) AS accepted, accepted / nullif(eligible, 0) AS coverage, coalesce(accepted, 0) >= 30 AS admitted FROM p LEFT JOIN c USING (source)""")
def book_yields(spark, d):
    rows = labelled(spark, d)
    pages = rows.filter("quality is not null").select("source", (F.col("toxic") == 0).alias("eligible"), (F.col("quality") == 1).alias("accepted"))
    return book_yield(rows.select("source").distinct(), pages, "source")


@query("SELECT o.o_orderkey, c.c_custkey IS NULL AS profile_missing, coalesce(c_mktsegment, 'none') AS segment FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey AND c_acctbal > 0")
def missing_counterparts(spark, d):
    orders, some = table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal > 0")
    return orders.join(some, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_custkey").isNull().alias("profile_missing"), F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("SELECT l_orderkey, l_linenumber, p_name, o_orderpriority, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_discount > 0.05::DOUBLE")
def matched_lines(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_discount") > F.lit(0.05))
    rows = rows.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "p_name", "o_orderpriority", "l_quantity")


@query("""SELECT source AS project_id, doc_id AS page_name, CASE WHEN doc_id % 50 = 0 THEN 'source_changed+x' ELSE 'x' END AS exclusions, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 1 END AS candidates FROM documents WHERE text <> ''""")
def provenance(spark, d):
    """Scans hashed when they were measured and again when they were cut; one in fifty has changed in between."""
    from .stages import unchanged

    docs = table(spark, d, "documents").filter("text <> ''").select(F.col("source").alias("project_id"), F.col("doc_id").alias("page_name"), "text")
    later = F.when(F.col("page_name") % 50 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    now = docs.select("project_id", "page_name", F.sha2(later, 256).alias("sha256"), F.array(F.lit("x")).alias("exclusions"), F.array(F.lit(1)).alias("candidates"))
    got = unchanged(now, docs.select("project_id", "page_name", F.sha2("text", 256).alias("sha256")))
    return got.select("project_id", "page_name", F.array_join("exclusions", "+").alias("exclusions"), F.size("candidates").alias("candidates"))


@query("""SELECT p_partkey, greatest(2, (p_size + 199) // 200)::BIGINT AS active_rows, ceil(p_size / 100)::BIGINT AS strip, ceil(0.1::DOUBLE * p_size)::BIGINT AS tolerance, p_size * 100 < 25 * 5 AS speck, least(greatest(p_retailprice, 910::DOUBLE), 1500::DOUBLE) AS clamped,
 abs(p_retailprice - 1200) / CASE WHEN p_size % 10 = 0 THEN 1 ELSE p_size % 10 END AS divided, round(0.55::DOUBLE * p_size + 0.25::DOUBLE * (p_size % 7) + 0.15::DOUBLE * (p_size % 5) + 0.05::DOUBLE * (p_size % 3), 9) AS cost FROM part""")
def scalar_rules(spark, d):
    s, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select(
        "p_partkey", F.greatest(F.lit(2), F.floor((s + 199) / 200)).cast("long").alias("active_rows"), F.ceil(s / 100).alias("strip"), F.ceil(F.lit(0.1) * s).alias("tolerance"), (s * 100 < 25 * 5).alias("speck"),
        F.least(F.greatest(price, F.lit(910.0)), F.lit(1500.0)).alias("clamped"), (F.abs(price - 1200) / F.when(s % 10 == 0, 1).otherwise(s % 10)).alias("divided"),
        F.round(F.lit(0.55) * s + F.lit(0.25) * (s % 7) + F.lit(0.15) * (s % 5) + F.lit(0.05) * (s % 3), 9).alias("cost"),
    )


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), a AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e) GROUP BY label, i),
x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e) SELECT vec_id, round(sqrt(sum((v - m) * (v - m))) / 255, 9) AS distance FROM x JOIN a USING (label, i) GROUP BY vec_id""")
def shape_distances(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    cells = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    reference = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("r"))
    square = F.aggregate(F.zip_with("embedding", "r", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return e.join(reference, "label").select("vec_id", F.round(F.sqrt(square) / 255, 9).alias("distance"))


@query("""WITH x AS (SELECT vec_id, embedding AS e, len(embedding) AS n FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, n), lambda i: abs(e[i + 1]::DOUBLE - e[i]::DOUBLE))), 6) AS travel, len(list_filter(e, lambda v: v > 0)) AS positive, list_bool_or(list_transform(e, lambda v: v > 0.3::DOUBLE)) AS peak, round(e[3]::DOUBLE, 6) AS third FROM x""")
def array_rules(spark, d):
    e = F.col("embedding")
    steps = F.zip_with(F.slice(e, F.lit(2), F.size(e) - 1), F.slice(e, F.lit(1), F.size(e) - 1), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x), 6).alias("travel"), F.size(F.filter(e, lambda v: v > 0)).cast("long").alias("positive"), F.exists(e, lambda v: v.cast("double") > F.lit(0.3)).alias("peak"), F.round(F.element_at(e, 3).cast("double"), 6).alias("third")
    )


@query("""WITH c AS (SELECT user_id % 10 AS book, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT book, string_agg(concat(event_type, '=', n), ',' ORDER BY event_type) AS counts FROM c GROUP BY book""")
def counter_maps(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("book"), "event_type").count()
    maps = counts.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    return maps.select("book", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NULL AS malformed, len(json_keys(props)) AS keys FROM events""")
def event_properties(spark, d):
    parsed = F.from_json("props", "struct<k:bigint>")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["k"].isNull().alias("malformed"), F.size(F.json_object_keys("props")).cast("long").alias("keys"))


@query("""SELECT key AS name, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key""")
def payload_keys(spark, d):
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT source AS project_id, concat('p', doc_id) AS page_name, doc_id IN (SELECT doc_id FROM p) AS emit FROM documents WHERE source IN (SELECT source FROM p)""")
def whole_book_pages(spark, d):
    from .stages import selected

    pages = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.concat(F.lit("p"), "doc_id").alias("page_name"), "doc_id")
    chosen = pages.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return selected(pages.drop("doc_id"), chosen)


@query("""SELECT lang, (SELECT string_agg(x, '+' ORDER BY x) FROM (SELECT DISTINCT source AS x FROM documents e WHERE e.lang = d.lang EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 2000)) AS only_here FROM (SELECT DISTINCT lang FROM documents) d""")
def source_differences(spark, d):
    docs = table(spark, d, "documents")
    known = docs.filter("lang = 'de' and n_chars > 2000").agg(F.collect_set("source").alias("k"))
    left = docs.groupBy("lang").agg(F.collect_set("source").alias("s")).join(F.broadcast(known))
    only = F.array_sort(F.array_except("s", "k"))
    return left.select("lang", F.when(F.size(only) > 0, F.array_join(only, "+")).alias("only_here"))


@query(f"WITH {_LAB} SELECT doc_id, len(list_distinct(list_concat(codes, codes)))::INT AS codes, list_has_any(codes, ['table_like']) AS defect FROM x")
def exclusion_sets(spark, d):
    rows = labelled(spark, d)
    both = F.array_distinct(F.concat("codes", "codes"))
    return rows.select("doc_id", F.size(both).alias("codes"), F.arrays_overlap("codes", F.array(F.lit("table_like"))).alias("defect"))


@query(f"""WITH {_LINES}
SELECT 'source_lines_contiguous' AS broken, (SELECT count(*) FROM l WHERE doc_id % 100 = 7 AND ordinal = 2) AS n UNION ALL SELECT 'line_order', 0""")
def line_invariants(spark, d):
    """Byte ranges of lines; where doc_id ends in 07 the second line is left out, so that its successor begins too late."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("line") + 1
    rows = doc_lines(spark, d).select("doc_id", "ordinal", (F.sum(size).over(w) - size).alias("a"), F.sum(size).over(w).alias("b"))
    rows = rows.filter("doc_id % 100 <> 7 or ordinal <> 1")
    return not_contiguous(rows, ["doc_id"], "a", "b", "source_lines_contiguous").unionByName(violations(rows, "line_order", (F.col("ordinal") >= 0) & (F.col("b") > F.col("a"))))
