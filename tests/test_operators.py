import json
import random

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import blocks as B
from docloom.operators import chunk as C
from docloom.operators import derive as M
from docloom.operators import enrich as E
from docloom.operators import select as Q
from docloom.operators import sinks as K
from docloom.operators import structure as T
from docloom.operators import validate as V
from docloom.plans.documents import Documents
from docloom.sources import extract
from docloom.streaming import ingest


def raw(spark, docs):
    """Raw blocks of {doc_id: [dict, ...]}."""
    rows = []
    for i, bs in docs.items():
        for k, b in enumerate(bs):
            row = extract.raw_row({"type": "paragraph", "text": ""} | b)
            rows.append((i, k, *[row[f] for f in schemas.RAW_BLOCK.names]))
    from pyspark.sql import types as T_

    schema = T_.StructType([T_.StructField("doc_id", T_.LongType()), T_.StructField("ordinal", T_.IntegerType()), *schemas.RAW_BLOCK.fields])
    return spark.createDataFrame(rows, schema)


def h(level, text="H"):
    return {"type": "heading", "level": level, "text": text}


def tree_model(levels):
    """Paths of a stack: None stands for a paragraph."""
    dense = {v: k for k, v in enumerate(sorted({x for x in levels if x}), 1)}
    stack, out, n = [("root", 0)], [], 0
    for x in levels:
        if x:
            while stack[-1][1] >= dense[x]:
                stack.pop()
            stack.append((f"sec-{n:03d}", dense[x]))
            n += 1
        out.append([s[0] for s in stack])
    return out


def test_sections_against_a_stack(spark):
    rng = random.Random(5)
    shapes = {i: [rng.choice([None, None, 1, 2, 3, 4, 6]) for _ in range(rng.randrange(1, 25))] for i in range(60)}
    shapes |= {100: [1, 3, 3, 5], 101: [2, 1], 102: [None, 1], 103: [None, None]}
    docs = {i: [h(x) if x else {"text": "p"} for x in s] for i, s in shapes.items()}
    sections = T.with_sections(B.canonical_blocks(raw(spark, docs))).cache()
    got = {}
    for r in sections.collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = r
    for i, s in shapes.items():
        assert [got[i][k].structure_path for k in range(len(s))] == tree_model(s)
        for k, x in enumerate(s):
            above = [j for j in range(k) if s[j] and (not x or s[j] < x)]
            assert got[i][k].parent_heading_chunk_id == (f"blk-{above[-1]:03d}" if above else None)
            assert (got[i][k].parent_structure_node_id is None) == (not any(s))
    nodes = {(r.doc_id, r.node_id): r for r in T.nodes(sections).collect()}
    assert [nodes[100, f"sec-{k:03d}"].node_type for k in range(4)] == ["section", "subsection", "subsection", "subsubsection"]
    assert nodes[101, "root"].title == "H" and nodes[102, "root"].title == "" and nodes[102, "root"].chunk_ids == ["blk-000"]
    assert "root" not in {r.node_id for r in T.heading_map(T.nodes(sections)).where("doc_id = 101").collect()}
    owned = T.nodes(sections).groupBy("doc_id").agg(F.sum("token_count_est").alias("a")).join(sections.groupBy("doc_id").agg(F.sum("token_count_est").alias("b")), "doc_id")
    assert owned.where("a <> b").count() == 0


def test_label_merge_and_links(spark):
    items = {"type": "list", "items": [{"text": "a", "level": 0}, {"text": "b", "level": 0}]}
    b = B.canonical_blocks(raw(spark, {1: [{"text": "Items:"}, items], 2: [{"text": "These are far too many words here:"}, items], 3: [{"text": "x"}, {"text": "y"}, {"text": "z"}]}))
    rows = {(r.doc_id, r.ordinal): r for r in b.collect()}
    assert (1, 0) not in rows and rows[1, 1].text_plain == "Items:\n- a\n- b"
    assert (rows[1, 1].char_count, rows[1, 1].token_count_est, rows[1, 1].chunk_id) == (14, 3, "blk-001")
    assert (2, 0) in rows and rows[3, 1].surrounding_text_preview == "x | z" and rows[3, 0].surrounding_text_preview == "y"
    assert (rows[3, 0].prev_chunk_id, rows[3, 2].next_chunk_id, rows[3, 1].prev_chunk_id) == (None, None, "blk-000")


def test_code_keeps_its_original(spark):
    b = B.canonical_blocks(raw(spark, {1: [{"type": "code_block", "text": "  x=1", "language": "py"}, {"type": "image_placeholder", "src": "s", "alt": ""}, {"type": "divider"}, {"type": "footnote", "text": "n"}]}))
    rows = sorted(b.collect(), key=lambda r: r.ordinal)
    assert (rows[0].text_plain, rows[0].text_original, rows[0].char_count) == ("x=1", "  x=1", 3)
    assert [r.text_plain for r in rows[1:]] == ["s", "---", "n"] and [r.embedding_ready for r in rows] == [True, True, True, False]


def greedy(ts, most, over):
    out, cur = [], []
    for i, t in enumerate(ts):
        if t > most:
            out += ([cur] if cur else []) + [[i]]
            cur = []
        elif cur and sum(ts[j] for j in cur) + t > most:
            out.append(cur)
            tail = []
            for j in reversed(cur):
                if sum(ts[k] for k in tail) + ts[j] > over:
                    break
                tail.insert(0, j)
            cur = [*tail, i]
        else:
            cur = [*cur, i]
    return out + ([cur] if cur else [])


def test_greedy_groups_against_a_loop(spark):
    rng = random.Random(2)
    cases = [[300, 200, 50, 40, 600, 10, 500, 30, 20], [490, 20, 30], [], [700]] + [[rng.choice([1, 5, 20, 49, 51, 200, 511, 513]) for _ in range(rng.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t array<int>")
    running = F.expr("transform(t, (x, i) -> CAST(aggregate(slice(t, 1, i + 1), 0, (a, y) -> a + y) AS BIGINT))")
    for r in df.select("k", C.greedy_spans(running, 512, 50).alias("g")).collect():
        assert [list(range(g.first, g.last + 1)) for g in r.g] == greedy(cases[r.k], 512, 50)
    assert greedy(cases[0], 512, 50) == [[0, 1], [2, 3], [4], [5, 6], [7, 8]] and greedy(cases[1], 512, 50) == [[0, 1], [1, 2]]


def test_truncation(spark):
    texts = [" ".join(["w"] * n) for n in (5, 682, 683, 684, 690, 700, 2000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("k", C.truncated(F.col("t"), 512).alias("v")).collect():
        n = len(texts[r.k].split())
        while int(n * 0.75) > 512 and n > 10:
            n -= 10
        assert len(r.v.split()) == n
    small = df.select(C.truncated(F.lit(" ".join("abcdefghijklm")), 2).alias("v")).first().v
    assert small == "a b c"


def test_common_prefix(spark):
    df = spark.createDataFrame([([["root", "a", "b"], ["root", "a"], ["root", "a", "c"]],), ([["x"], ["y"]],), ([],)], "p array<array<string>>")
    assert [r[0] for r in df.select(C.common_prefix(F.col("p"))).collect()] == [["root", "a"], [], []]


def test_chunk_rendering(spark):
    docs = {1: [h(2, "T"), {"type": "list", "ordered": True, "items": [{"text": "a", "level": 0}]}, {"type": "table", "rows": [["k"], ["v"]]}, {"type": "code_block", "text": "c", "language": None}]}
    rows = sorted(C.block_text(B.canonical_blocks(raw(spark, docs))).collect(), key=lambda r: r.ordinal)
    assert [r.rendered for r in rows] == ["## T", "- a", "| v |", "```None\nc\n```"]
    paragraph = {1: [{"text": " ".join(["w"] * 700)}]}
    sections = T.with_sections(B.canonical_blocks(raw(spark, paragraph)))
    only = C.chunks(sections).first()
    assert (len(only.text.split()), only.token_count_est, only.chunk_id) == (680, 510, "chunk-0001")


def test_references(spark):
    text = "see https://x.io/a). and a@b.co https://x.io/a"
    b = B.canonical_blocks(raw(spark, {1: [{"text": text}, {"text": "arXiv:2101.00001v2, doi 10.1234/ab.c; Wikipedia:Foo a@b.co"}]}))
    got = [(r.seq, r.type, r.target, r.source_chunk_id) for r in sorted(E.cross_references(b).collect(), key=lambda r: r.seq)]
    assert got == [
        (1, "url", "https://x.io/a", "blk-000"), (2, "email", "a@b.co", "blk-000"), (3, "arxiv", "arXiv:2101.00001v2", "blk-001"),
        (4, "doi", "10.1234/ab.c", "blk-001"), (5, "wikipedia", "Wikipedia:Foo", "blk-001"),
    ]
    assert {r.context for r in E.cross_references(b).where("seq <= 2").collect()} == {text}


def test_dates_of_the_head_only(spark):
    b = B.canonical_blocks(raw(spark, {1: [{"text": "x" * 4990}, {"text": "March 5, 2020"}], 2: [{"text": "March 5, 2020"}, {"text": "May 6, 2021"}]}))
    assert {r.doc_id: r.dates for r in E.document_dates(b).collect()} == {1: [], 2: ["2020-03-05", "2021-05-06"]}


def test_validation_finds_faults(spark):
    b = B.canonical_blocks(raw(spark, {1: [h(1), {"text": "w " * 5470}, {"text": " "}], 2: [{"text": "fine"}], 3: [{"type": "figure", "text": "f"}]})).cache()
    assert V.missing_fields(b.withColumn("type", F.when(F.col("doc_id") == 2, None).otherwise(F.col("type")))).count() == 1
    assert [r.doc_id for r in V.strict_types(b).collect()] == [3]
    ready = {r.doc_id: r for r in V.readiness(b, b.where("ordinal < 2"), b.where("embedding_ready")).collect()}
    assert not ready[1].no_empty_text and not ready[1].tokens_in_range and not ready[1].structure_covers_blocks and not ready[1].ml_ready
    assert ready[2].ml_ready and ready[3].ml_ready
    chunks = spark.createDataFrame([(1, "a", 5, ["h"]), (1, "b", 3000, [])], "doc_id long, text string, token_count_est int, heading_path array<string>")
    r = V.chunk_readiness(chunks).first()
    assert (r.tokens_in_range, r.all_have_heading_path, r.many_tiny) == (False, False, True)
    issues = spark.createDataFrame([(1, "error"), (1, "warning"), (2, "error"), (2, "error"), (2, "error")], "doc_id long, severity string")
    assert {r.doc_id: round(r.completeness, 6) for r in E.completeness(issues).collect()} == {1: 0.75, 2: 0.5}


def test_structure_repair_and_scores(spark):
    b = B.canonical_blocks(raw(spark, {1: [h(2), h(4), h(3)], 2: [{"text": "A SHOUTED TITLE"}, {"text": "text"}], 3: [h(1), {"text": "LOUD"}, h(3)]}))
    got = {(r.doc_id, r.ordinal): r.repaired_level for r in T.repaired_headings(b).collect()}
    assert got == {(1, -1): 1, (1, 0): 2, (1, 1): 4, (1, 2): 3, (2, 0): 1, (2, 1): None, (3, 0): 1, (3, 1): 2, (3, 2): 2}
    b = b.where("doc_id < 3")
    assert {r.doc_id: round(r.structure_score, 6) for r in E.structure_scores(b).collect()} == {1: round(1 - 0.5 / 3, 6), 2: 0.3}


def test_nested_list_paths(spark):
    items = [{"text": t, "level": n} for t, n in (("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 3))]
    rows = sorted(T.list_paths(B.base_blocks(raw(spark, {1: [{"type": "list", "items": items}]}))).collect(), key=lambda r: r.item)
    assert [r.item_path for r in rows] == [[0], [0, 1], [0, 2], [3], [3, 4]]


def test_derivations_on_small_documents(spark):
    docs = {1: [h(1, "Setup"), {"text": "do this"}, {"type": "code_block", "text": "run", "language": "sh"}, {"type": "table", "rows": [["k", "v"], ["a", "1"], ["b"]]}, {"text": "after"}, {"type": "footnote", "text": "[1] note"}, {"text": "cited [1] **bold** text [https://x.y]"}]}
    s = T.with_sections(B.canonical_blocks(raw(spark, docs))).cache()
    assert M.code_examples(s).first().description == "do this"
    t = M.table_texts(s).first()
    assert t.description == "after" and [json.loads(x) for x in t.records] == [{"k": "a", "v": "1"}, {"k": "b"}]
    assert E.footnote_links(s).first().referenced_by == "blk-006"
    assert {(r.type, r.start, r.end, r.text, r.href) for r in E.inline_marks(s).collect()} == {("bold", 10, 18, "bold", None), ("link", 19, 37, "text", "https://x.y")}
    assert {r.chunk_id for r in Q.by_keyword(s, "CITED").collect()} == {"blk-006"}
    assert B.table_markdown(s).first().markdown == "| k | v |\n| --- | --- |\n| a | 1 |\n| b |"


@pytest.fixture
def folder(tmp_path):
    tmp_path = tmp_path / "files"
    tmp_path.mkdir()
    (tmp_path / "a.md").write_text("# A\n\ntext\n")
    (tmp_path / "b.html").write_text("<article><h1>B</h1><p>x</p></article>")
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04broken")
    return tmp_path


def test_files_to_json(spark, folder, tmp_path):
    d = Documents.from_files(extract.read_files(spark, str(folder)))
    assert {r.path.rsplit("/", 1)[-1]: r.error is None for r in d.parsed.collect()} == {"a.md": True, "b.html": True, "bad.docx": False}
    assert [r.path for r in V.error_issues(d.parsed).collect()] == ["EXTRACT_002"]
    docs = {json.loads(r.json)["metadata"]["title"]: json.loads(r.json) for r in K.document_json(d.described).collect()}
    assert [b["text_plain"] for b in docs["a.md"]["blocks"]] == ["A", "text"] and [n["node_id"] for n in docs["a.md"]["structure"]["nodes"]] == ["root", "sec-000"]
    K.write_documents(K.document_json(d.described), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    K.write_json_lines(K.alpaca_lines(M.instruction_pairs(d.sections, d.nodes)), str(tmp_path / "pairs"))
    assert {r.instruction for r in spark.read.json(spark.read.json(str(tmp_path / "pairs")).rdd.map(lambda r: r.json)).collect()} == {"Explain: A", "Explain: B"}


def test_stream_of_files(spark, folder, tmp_path):
    seen = []
    files = ingest.file_stream(spark, str(folder), per_trigger=1)
    q = ingest.write_documents(files, lambda d, n: seen.extend(r.text_plain for r in d.blocks.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert sorted(seen) == ["A", "B", "text", "x"]
    assert ingest.raw_block_stream(files).isStreaming


def test_one_shuffle_for_blocks_and_sections(spark):
    """All windows over a document share one exchange."""
    s = T.with_sections(B.canonical_blocks(raw(spark, {1: [h(1), {"text": "x"}]})))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["section_tree", "document_json", "embedding_payloads", "chunk_common_path"])
def test_parses_once(spark, name):
    from docloom import catalog

    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1


def test_roots_own_what_no_section_does(spark):
    from docloom.operators import structure

    rows = [(1, 0, "paragraph", "before", None), (1, 1, "heading", "One", 1), (2, 0, "heading", "Low", 2), (2, 1, "heading", "High", 1), (3, 0, "paragraph", "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, type string, text_plain string, heading_level int")
    df = df.selectExpr("*", "concat('blk-00', ordinal) AS chunk_id", "ordinal + 1 AS token_count_est", "CAST(null AS int) AS page_number")
    got = {(r.doc_id, r.node_id): (r.title, r.level, r.chunk_ids, r.token_count_est) for r in structure.nodes(structure.with_sections(df)).collect()}
    assert got[1, "root"] == ("", 0, ["blk-000"], 1) and got[3, "root"] == ("", 0, ["blk-000"], 1)
    assert got[2, "root"] == ("Low", 0, [], 0) and got[2, "sec-000"] == ("Low", 2, ["blk-000"], 1)


def test_structure_scores_of_flat_documents(spark):
    from docloom.operators import enrich

    df = spark.createDataFrame([(1, 0, "paragraph", None), (2, 0, "paragraph", None), (3, 0, "heading", 1), (3, 1, "heading", 3)], "doc_id long, ordinal int, type string, heading_level int")
    got = {r.doc_id: float(r.structure_score) for r in enrich.structure_scores(df, df.where("doc_id = 2")).collect()}
    assert got == {1: 0.3, 2: 0.5, 3: 0.75}
