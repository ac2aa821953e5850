"""Reading canonical JSON documents back: the tables that chunking and validation work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = (
    "chunk_id string, type string, text_plain string, text_original string, char_count int, token_count_est int, embedding_ready boolean, "
    "prev_chunk_id string, next_chunk_id string, parent_heading_chunk_id string, page_number int"
)
NODE = "node_id string, parent_id string, node_type string, title string, level int, path array<string>, chunk_ids array<string>"
DOCUMENT = f"version string, document_id string, metadata map<string,string>, structure struct<nodes:array<struct<{NODE}>>>, blocks array<struct<{BLOCK}>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line of JSON below `path`, as the sink of documents writes them; see `parsed`."""
    return parsed(spark.read.text(path).withColumnRenamed("value", "json"))


def parsed(jsons: DataFrame) -> DataFrame:
    """doc_id, version, metadata, nodes, blocks of the rows' `json`, by a fixed schema; a text that is no document gives nulls and `bad`."""
    rows = jsons.select(F.from_json("json", DOCUMENT).alias("d"))
    return rows.select(
        F.col("d.document_id").try_cast("long").alias("doc_id"), "d.version", "d.metadata", F.col("d.structure.nodes").alias("nodes"), "d.blocks", F.col("d.document_id").isNull().alias("bad")
    )


def blocks_of(docs: DataFrame) -> DataFrame:
    """The blocks as a table: doc_id, ordinal (their place), and their fields."""
    return docs.select("doc_id", F.posexplode("blocks").alias("ordinal", "b")).select("doc_id", "ordinal", "b.*")


def nodes_of(docs: DataFrame) -> DataFrame:
    """The structure's nodes as a table, in reading order by `place`."""
    return docs.select("doc_id", F.posexplode("nodes").alias("place", "n")).select("doc_id", "place", "n.*")


def sections_of(docs: DataFrame) -> DataFrame:
    """The blocks with the node they are in, its path and the titles along it: what chunking reads."""
    tree = nodes_of(docs)
    titles = tree.where("node_id <> 'root' AND title <> ''").select("doc_id", F.col("node_id").alias("step"), "title")
    steps = tree.select("doc_id", "node_id", F.posexplode("path").alias("k", "step")).join(titles, ["doc_id", "step"])
    headings = steps.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("k", "title")))["title"].alias("heading_path"))
    owned = tree.select("doc_id", "node_id", F.col("path").alias("structure_path"), F.explode("chunk_ids").alias("chunk_id"))
    rows = blocks_of(docs).join(owned, ["doc_id", "chunk_id"], "left").join(headings, ["doc_id", "node_id"], "left")
    return rows.withColumn("heading_path", F.coalesce("heading_path", F.array().cast("array<string>")))
