"""Documents rendered from the star tables: one Markdown file for each customer.

The files exercise every construct of the parsers, and what must come out of
them follows from the tables themselves, so plain SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def customer_markdown(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """doc_id and text: front matter, headings of three levels, a paragraph with an address and a date, table, label and list, code."""
    key = F.col("c_custkey").cast("string")
    row = F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderstatus", F.lit(" | "), "o_orderpriority", F.lit(" |"))
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row"))))["row"], "\n").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_set("o_orderpriority")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("marks"),
    )
    day = (F.col("c_custkey") % 28 + 1).cast("string")
    intro = F.concat(F.lit("Customer "), "c_name", F.lit(" of segment "), "c_mktsegment", F.lit(" can be reached at c"), key, F.lit("@example.org since March "), day, F.lit(", 2019."))
    some = F.concat(F.lit("| order | status | priority |\n|---|---|---|\n"), "rows", F.lit("\n\nPriorities:\n\n"), "marks")
    body = F.when(F.col("rows").isNull(), F.lit("No orders.")).otherwise(some)
    text = F.concat(
        F.lit("---\ntitle: "), "c_name", F.lit("\nsource: crm\n---\n# "), "c_name", F.lit("\n\n"), intro, F.lit("\n\n## Orders\n\n"), body,
        F.lit("\n\n### Method of query\n\n```sql\nselect * from orders\nwhere o_custkey = "), key, F.lit("\n```\n"),
    )
    return customer.join(per, "c_custkey", "left").select(F.col("c_custkey").cast("long").alias("doc_id"), text.alias("text"))


#: The blocks that must come of `customer_markdown`, as SQL: doc_id, ordinal, id, type, text, level, prev and so on follow.
EXPECTED = """
per AS (
  SELECT o_custkey, string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |', chr(10) ORDER BY o_orderkey) AS table_rows,
    list_sort(list(DISTINCT o_orderpriority)) AS prio, count(*) AS n_rows
  FROM orders GROUP BY o_custkey),
src AS (SELECT c.*, p.* FROM customer c LEFT JOIN per p ON p.o_custkey = c.c_custkey),
raw_expected AS (
  SELECT c_custkey AS doc_id, 0 AS ordinal, 'heading' AS type, c_name AS text, 1 AS level FROM src
  UNION ALL SELECT c_custkey, 1, 'paragraph', 'Customer ' || c_name || ' of segment ' || c_mktsegment || ' can be reached at c' || c_custkey || '@example.org since March ' || (c_custkey % 28 + 1) || ', 2019.', NULL FROM src
  UNION ALL SELECT c_custkey, 2, 'heading', 'Orders', 2 FROM src
  UNION ALL SELECT c_custkey, 3, 'table', 'Table' || chr(10) || '| order | status | priority |' || chr(10) || table_rows, NULL FROM src WHERE n_rows IS NOT NULL
  UNION ALL SELECT c_custkey, 5, 'list', 'Priorities:' || chr(10) || array_to_string(list_transform(prio, lambda p: '- ' || p), chr(10)), NULL FROM src WHERE n_rows IS NOT NULL
  UNION ALL SELECT c_custkey, 3, 'paragraph', 'No orders.', NULL FROM src WHERE n_rows IS NULL
  UNION ALL SELECT c_custkey, CASE WHEN n_rows IS NULL THEN 4 ELSE 6 END, 'heading', 'Method of query', 3 FROM src
  UNION ALL SELECT c_custkey, CASE WHEN n_rows IS NULL THEN 5 ELSE 7 END, 'code_block', 'select * from orders' || chr(10) || 'where o_custkey = ' || c_custkey, NULL FROM src),
blocks AS (
  SELECT doc_id, ordinal, 'blk-' || lpad(CAST(ordinal AS VARCHAR), 3, '0') AS chunk_id, type, text, level, length(text) AS chars,
    len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) AS words,
    greatest(1, CAST(floor(len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')) * 0.75) AS INTEGER)) AS tokens,
    CASE WHEN ordinal < 2 THEN 'sec-000' WHEN type = 'code_block' OR level = 3 THEN 'sec-002' ELSE 'sec-001' END AS node,
    CASE WHEN ordinal < 2 THEN ['root', 'sec-000'] WHEN type = 'code_block' OR level = 3 THEN ['root', 'sec-000', 'sec-001', 'sec-002'] ELSE ['root', 'sec-000', 'sec-001'] END AS path
  FROM raw_expected)
"""
