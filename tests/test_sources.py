"""Readers and sinks on hand-written folders."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from vellum.operators import audit, merge, pages
from vellum.sources import layout, sinks
from vellum.streaming import intake


def line(*contents, **more):
    return {"spans": [{"content": c, "score": 0.95} | more for c in contents]}


_LAYOUT = {
    "pdf_info": [
        {
            "preproc_blocks": [
                {"type": "text", "index": 2, "bbox": [1, 2, 3, 4], "lines": [line("乙①")]},
                {"type": "title", "index": 1, "level": 2, "bbox": [1, 2, 3, 4], "lines": [line("2016"), line("2017")]},
                {"type": "image", "index": 3, "bbox": [0, 0, 9, 9], "blocks": [{"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": "/x/a.jpg"}]}]}, {"type": "image_caption", "lines": [line("图 1")]}]},
            ],
            "discarded_blocks": [{"type": "page_footnote", "lines": [line("①<sub>注</sub>")]}, {"type": "page_number", "lines": [line("7")]}],
        },
        {"preproc_blocks": [], "discarded_blocks": []},
    ]
}
_LIST = {"pdfData": [[{"block_position": "0-1", "index": 1}, {"block_position": "0-2", "index": 2}]], "mergeConnections": [{"blocks": ["0-1", "0-2", "9-9"], "type": "x"}]}


def folders(tmp_path):
    for name, files in {
        "one": {"layout.json": _LAYOUT, "x_middle.json": {"pdf_info": []}, "block_list.json": _LIST, "images/a.jpg": "x", "full.md": "x"},
        "two": {"result/sample_middle.json": {"pdf_info": []}},
        "three": {"full.md": "x"},
    }.items():
        for path, content in files.items():
            file = tmp_path / name / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))
    return str(tmp_path)


def test_discovery(spark, tmp_path):
    found = layout.artifacts(layout.list_files(spark, folders(tmp_path)))
    rows = {(r["doc"], r["kind"]): r["path"].split("/")[-1] for r in found.collect()}
    assert rows["one", "layout"] == "layout.json"
    assert rows["two", "layout"] == "sample_middle.json"
    assert rows["one", "images"] == "images"
    assert rows["three", "full_md"] == "full.md"
    assert [r["doc"] for r in layout.documents_without(found).collect()] == ["three"]


def test_layout_becomes_blocks(spark, tmp_path):
    found = layout.artifacts(layout.list_files(spark, folders(tmp_path)))
    blocks = layout.blocks_of(layout.read_json_documents(spark, found, "layout", layout.LAYOUT)).where("doc_id = 'one'")
    body = {r["index"]: r for r in pages.body(blocks).collect()}
    assert body[1]["text"] == "2016 2017"
    assert body[1]["n_lines"] == 2
    assert (body[3]["text"], body[3]["images"], body[3]["n_lines"]) == ("图 1", ["x/a.jpg"], 0)
    assert [(s["type"], s["text"]) for s in body[3]["sub"]] == [("image_body", ""), ("image_caption", "图 1")]
    assert pages.footnote_blocks(blocks).first()["text"] == "①注"
    assert audit.page_texts(blocks).first()["text"] == "2016 2017乙①图 1"
    n_pages = spark.createDataFrame([("one", 0), ("one", 1)], "doc_id string, page_idx long")
    assert [r["pnum"] for r in pages.page_numbers(n_pages, blocks).orderBy("page_idx").collect()] == [7, 8]


def test_block_list(spark, tmp_path):
    found = layout.artifacts(layout.list_files(spark, folders(tmp_path)))
    lists = layout.read_json_documents(spark, found, "block_list", layout.BLOCK_LIST)
    edges = merge.merge_edges(layout.block_positions(lists), layout.merge_connections(lists))
    assert [tuple(r) for r in edges.collect()] == [("one", 0, 1, 0, 2)]
    none = layout.read_json_documents(spark, found.where("false"), "block_list", layout.BLOCK_LIST)
    assert none.count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ty\nz")], "doc_id string, text string")
    sinks.write_tsv(rows, str(tmp_path / "t"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {"doc_id\ttext", "a\tx y z"}
    sinks.write_documents(rows, str(tmp_path / "d"))
    assert [r["text"] for r in layout.read_markdown(spark, [str(tmp_path / "d" / "doc_id=a")]).collect()] == ["x\ty\nz\n"]
    assert sinks.status(rows.agg(F.count("*").alias("pages"), F.lit(None).alias("x"))).first()["status"] == "pages=1 x=none"


def test_layout_stream(spark, tmp_path):
    folders(tmp_path)
    stream = intake.layout_stream(spark, str(tmp_path / "one")).where("zone is not null")
    query = stream.writeStream.format("memory").queryName("blocks_in").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("blocks_in").where("type = 'page_footnote'").count() == 1


def test_comma_lists_and_globs_keep_their_order(spark, tmp_path):
    for name in ("b2", "b1", "a"):
        (tmp_path / f"{name}.md").write_text(f"# {name}\n")
    found = layout.read_parts(spark, f"{tmp_path}/b*.md, {tmp_path}/a.md").orderBy("part").collect()
    assert [(r["part"], r["text"]) for r in found] == [(0, "# b1\n"), (1, "# b2\n"), (2, "# a\n")]


def test_broken_json_is_reported(spark, tmp_path):
    for doc, text in (("good", '{"pdf_info": []}'), ("bad", '{"pdf_info": [')):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "layout.json").write_text(text)
    found = layout.artifacts(layout.list_files(spark, str(tmp_path)))
    assert {r["doc_id"]: r["pdf_info"] for r in layout.read_json_documents(spark, found, "layout", layout.LAYOUT).collect()} == {"good": [], "bad": None}
    assert [r["doc_id"] for r in layout.broken_documents(spark, found, "layout", layout.LAYOUT).collect()] == ["bad"]


def test_reports_keep_earlier_ones(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "doc_id string, n long")
    at = datetime(2024, 5, 6, 7, 8, 9)
    names = [sinks.write_report(rows, str(tmp_path), at).rsplit("/", 1)[-1] for _ in range(3)]
    assert names == ["report-20240506-070809", "report-20240506-070809-2", "report-20240506-070809-3"]
    assert spark.read.json(str(tmp_path / names[2])).first()["n"] == 1
