"""The tables at hand in the roles of pages, lines, boxes, profiles and glyphs; the same SQL runs on Spark and in the oracle."""

from __future__ import annotations

from inkfold.sources.tables import spread, table

__all__ = ["spread", "table"]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: documents as marked pages: markup that depends on doc_id only.
MARKED = """
SELECT source AS project_id, concat('p', doc_id, CASE WHEN doc_id % 3 = 0 THEN 'L' ELSE '' END, '.png') AS page_name, doc_id,
  CASE doc_id % 7
    WHEN 0 THEN concat('/*', chr(10), replace(text, ', ', '    '), chr(10), '*/')
    WHEN 1 THEN concat('<i>', text, '</i> <B class="x">b</B>', CASE WHEN doc_id % 2 = 0 THEN '<sc>s</sc>' ELSE '' END)
    WHEN 2 THEN concat('[Illustration: x]', chr(10), text, ' [**note]')
    WHEN 3 THEN concat('/*', chr(10), replace(text, '. ', chr(10)), chr(10), '*/', chr(10), replace(text, chr(10), ' '))
    WHEN 4 THEN concat('/#', chr(10), '    ', replace(replace(text, '. ', chr(10)), chr(10), concat(chr(10), '    ')), chr(10), '#/')
    WHEN 5 THEN concat('/*', chr(10), '"', replace(replace(text, '. ', chr(10)), chr(10), concat('"', chr(10), '"')), '"', chr(10), '*/')
    ELSE concat('/*', replace(text, '. ', ' . . . '), '*/', ' tail') END AS text
FROM {documents}
"""
#: lineitem as measured lines.
LINES = """
SELECT l_returnflag AS book, l_orderkey AS page, l_linenumber AS line, CAST(l_quantity AS DOUBLE) AS height, CAST(l_extendedprice AS DOUBLE) AS width,
  CAST(l_tax AS DOUBLE) AS slope, CASE WHEN l_discount = 0 THEN 'too_short' END AS exclusion, CASE l_linestatus WHEN 'O' THEN 'recto' ELSE 'verso' END AS page_class
FROM {lineitem}
"""
#: part as recognised words and supplier as line boxes, on pages by key.
WORDS = """
SELECT p_partkey AS word_id, CAST(floor(p_partkey / 50) AS BIGINT) AS page, CAST((p_partkey * 37) % 200 AS INT) AS x0, CAST((p_partkey * 53) % 100 AS INT) AS y0,
  CAST((p_partkey * 37) % 200 + 5 + p_size AS INT) AS x1, CAST((p_partkey * 53) % 100 + 4 + p_size % 9 AS INT) AS y1, p_name AS word FROM {part}
"""
BOXES = """
SELECT s_suppkey AS box_id, CAST(floor(s_suppkey / 3) AS BIGINT) AS page, CAST((s_suppkey * 29) % 150 AS INT) AS x0, CAST((s_suppkey * 31) % 90 AS INT) AS y0,
  CAST((s_suppkey * 29) % 150 + 70 AS INT) AS x1, CAST((s_suppkey * 31) % 90 + 12 AS INT) AS y1 FROM {supplier}
"""
#: orders as pages with a first ink band and a left edge.
FIRST_BANDS = """
SELECT o_orderpriority AS book, o_orderkey AS page, concat('p', o_orderkey, '.png') AS page_name,
  CAST(100 + o_custkey % 14 + CASE WHEN o_orderkey % 11 = 0 THEN 200 ELSE 0 END AS INT) AS first_top,
  CAST(100 + (CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 60 END) + CAST(floor(o_totalprice) AS BIGINT) % 9 AS INT) AS text_left,
  CAST(1000 + o_custkey % 7 AS INT) AS text_right, CAST(20 + o_custkey % 13 AS INT) AS band_count FROM {orders}
"""
