"""Golden cases of the relational operators, on hand-written blocks."""

from pyspark.sql import Row

from pyspark.sql import functions as F

from vellum.operators import audit, diff, footnotes, ingest, merge, pages, render, seam, split, verify
from vellum.profile import CJK_PROFILE

_SCHEMA = "doc_id string, page_idx long, zone string, ord long, `index` long, type string, level long, x0 double, x1 double, n_lines long, text string, scores array<double>, html string, sub array<struct<type:string,text:string,html:string>>, images array<string>"


def blocks(spark, *rows):
    """rows: (page, zone letter, type, text, fields)"""
    out, counts = [], {}
    for page, zone, kind, text, *more in rows:
        place = counts.setdefault((page, zone), 0)
        counts[page, zone] += 1
        base = {"index": place, "level": 2, "x0": 65.0, "x1": 520.0, "n_lines": 2, "scores": [], "html": "", "sub": [], "images": []} | (more[0] if more else {})
        out.append(("d", page, {"b": "body", "n": "discarded"}[zone], place, base["index"], kind, base["level"], base["x0"], base["x1"], base["n_lines"], text, base["scores"], base["html"], base["sub"], base["images"]))
    return spark.createDataFrame(out, _SCHEMA)


def page_table(spark, n):
    return spark.createDataFrame([("d", p) for p in range(n)], "doc_id string, page_idx long")


def numbers(spark, *values):
    return spark.createDataFrame([("d", p, v) for p, v in enumerate(values)], "doc_id string, page_idx long, pnum long")


def no_edges(spark):
    return spark.createDataFrame([], "doc_id string, src_page long, src_index long, dst_page long, dst_index long")


def edges(spark, *pairs):
    return spark.createDataFrame([("d", *a, *b) for a, b in pairs], "doc_id string, src_page long, src_index long, dst_page long, dst_index long")


def listed(df, *columns, order=None):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*(order or columns)).collect()]


def pnums(spark, n, found):
    b = blocks(spark, (0, "b", "text", "x"), *[(p, "n", "page_number", t) for p, t in found])
    return [x[0] for x in listed(pages.page_numbers(page_table(spark, n), b), "pnum", order=["page_idx"])]


def test_page_numbers(spark):
    assert pnums(spark, 5, [(1, "- 108 -"), (2, "109"), (4, "115")]) == [107, 108, 109, 110, 115]
    assert pnums(spark, 3, []) == [1, 2, 3]
    assert pnums(spark, 3, [(0, "5"), (1, "9")]) == [5, 9, 7]
    assert pnums(spark, 2, [(0, "no digits"), (0, "7"), (1, "x")]) == [7, 8]


def test_margins_prefer_blocks_of_several_lines(spark):
    b = blocks(spark, (0, "b", "text", "a", {"x0": 60.0, "x1": 500.0}), (0, "b", "text", "b", {"x0": 70.0, "x1": 520.0}), (0, "b", "text", "c", {"x0": 90.0, "n_lines": 1}), (1, "b", "text", "d", {"x0": 90.0, "n_lines": 1}))
    assert listed(pages.margins(b), "page_idx", "left", "right") == [(0, 60.0, 520.0), (1, 90.0, 520.0)]


def test_enumerations(spark):
    far = "①" + "x" * 40 + "②"
    b = blocks(spark, (0, "b", "text", "条件：①甲；②乙"), (0, "b", "text", "甲①乙②丙"), (0, "b", "text", "①a②b③c"), (0, "b", "text", far))
    assert listed(audit.enum_runs(b), "index", "n") == [(0, 2), (2, 3)]


def test_notes_by_kind(spark):
    b = blocks(spark, (0, "n", "page_footnote", "2. 某书"), (0, "n", "page_footnote", "某书"), (0, "n", "page_footnote", "收稿日期：x"), (0, "n", "page_footnote", "①好"))
    n = numbers(spark, 1)
    assert listed(audit.misfiled_notes(b, n), "text") == [("2. 某书",)]
    assert listed(audit.orphan_notes(b, n), "text") == [("2. 某书",), ("某书",)]
    assert listed(audit.meta_notes(b, n), "text") == [("收稿日期：x",)]


def test_footnotes_split_and_sorted(spark):
    b = blocks(spark, *[(0, "n", "page_footnote", t) for t in ("①甲", "②③⑥⑦⑧史记", "④乙", "⑤丙")])
    assert [x[1] for x in listed(footnotes.footnotes(b, numbers(spark, 1)), "n", "note")] == ["甲", "史记", "史记", "乙", "丙", "史记", "史记", "史记"]
    b = blocks(spark, *[(0, "n", "page_footnote", t) for t in ("②b", "x", "①a", "")])
    assert [x[1] for x in listed(footnotes.footnotes(b, numbers(spark, 1)), "n", "note")] == ["b", "x", "a"]


def test_added_footnotes_and_pages_that_do_not_exist(spark):
    b = blocks(spark, (0, "n", "page_footnote", "①甲"))
    added = spark.createDataFrame([("d", 0, 1, "乙"), ("d", 9, 0, "丙")], "doc_id string, page_idx long, circ long, text string")
    assert [x[1] for x in listed(footnotes.footnotes(b, numbers(spark, 1), added), "n", "note")] == ["甲", "乙"]


def test_renumber_with_skip(spark):
    rows = spark.createDataFrame([("d", 1, "a①b②"), ("d", 2, "c①"), ("d", 3, "")], "doc_id string, page_idx long, text string")
    skip = spark.createDataFrame([("d", 2)], "doc_id string, seq long")
    assert listed(render.renumber(rows, ["page_idx"], skip), "page_idx", "text", "n_used") == [(1, "a[^1]b②", 1), (2, "c[^2]", 1), (3, "", 0)]


def test_headings(spark):
    titles = ["第一章 甲", "第一节 乙", "一、丙", "1. 丁", "第二章 戊", "第二节 己"]
    b = blocks(spark, *[(0, "b", "title", t) for t in titles])
    assert [x[1] for x in listed(render.heading_levels(b), "index", "level")] == [2, 3, 4, 5, 2, 3]
    b = blocks(spark, *[(0, "b", "title", t) for t in titles[:5]])
    assert [x[1] for x in listed(render.heading_levels(b), "index", "level")] == [2] * 5


def seams(spark, cases):
    lines = spark.createDataFrame([(str(d), p, t) for d, texts in enumerate(cases) for p, t in enumerate(texts)], "doc_id string, pos long, md string")
    found = {str(d): [] for d in range(len(cases))}
    for r in seam.join_page_breaks(lines).orderBy("doc_id", "pos").collect():
        found[r["doc_id"]].append(r["md"])
    return [found[str(d)] for d in range(len(cases))], seam.page_joins(lines)


def test_seams(spark):
    same = [["近代化。[^11]", "<!--p.2-->", "续"], ["甲", "<!--p.2-->", "第二章 x"], ["甲", "<!--p.0-->", "乙"], ["<!--p.2-->", "乙"], ["甲", "<!--p.2-->", "<!--p.3-->", "乙"], ["甲", "<!--p.2-->"], [" 甲 ", "# 乙"]]
    joined = [
        (["甲未完", "<!--p.2-->", "续。"], ["甲未完<!--p.2-->续。"]),
        (["甲未完", "<!--p.2-->", "![](x)", "*图*", "续。"], ["甲未完<!--p.2-->续。", "![](x)", "*图*"]),
        (["a", "<!--p.2-->", "b", "<!--p.3-->", "c"], ["a<!--p.2-->b<!--p.3-->c"]),
        (["a", "<!--p.2-->", "b", "<!--p.3-->", "![](x)", "c", "d"], ["a<!--p.2-->b<!--p.3-->c", "![](x)", "d"]),
        (["a", "<!--p.2-->", "![](x)", "b", "<!--p.3-->", "c"], ["a<!--p.2-->b", "![](x)", "<!--p.3-->", "c"]),
        (["a", "<!--p.2-->", "![](x)", "b", "<!--p.3-->", "c", "<!--p.4-->", "d"], ["a<!--p.2-->b", "![](x)", "<!--p.3-->", "c<!--p.4-->d"]),
        (["a", "<!--p.2-->", "[^3]", "<!--p.3-->", "c"], ["a<!--p.2-->[^3]<!--p.3-->c"]),
        (["x。", "<!--p.2-->", "[^3]", "<!--p.3-->", "c"], ["x。", "<!--p.2-->", "[^3]", "<!--p.3-->", "c"]),
        (["a", " <!--p.2--> ", " b [^1] "], ["a<!--p.2-->b [^1]"]),
    ]
    found, joins = seams(spark, same + [a for a, _ in joined])
    assert found == same + [b for _, b in joined]
    rows = sorted((int(r["doc_id"]) - len(same), r["pnum"], r["before"], r["after"], r["floats"]) for r in joins.collect())
    assert rows[:4] == [(0, 2, "甲未完", "续。", 0), (1, 2, "甲未完", "续。", 2), (2, 2, "a", "b", 0), (2, 3, "a<!--p.2-->b", "c", 0)]
    assert seam.join_page_breaks(joins.select("doc_id", F.lit(1).alias("pos"), F.col("before").alias("md")).where("false")).count() == 0


def test_chain_puts_the_anchor_at_the_seam(spark):
    b = blocks(spark, (0, "b", "text", "甲①"), (1, "b", "text", "乙②"), (1, "b", "text", "丙①"), (2, "b", "text", "丁"))
    e = edges(spark, ((0, 0), (1, 0)))
    n = numbers(spark, 4, 5, 6)
    rendered = render.rendered_blocks(b, e, merge.chains(e), n)
    assert listed(rendered, "pos", "md") == [(1, "甲[^1]<!--p.5-->乙[^2]"), (2, "丙[^3]"), (3, "丁")]
    assert [x[1] for x in listed(render.anchored(rendered, n), "pos", "md")] == ["甲[^1]<!--p.5-->乙[^2]", "丙[^3]", "<!--p.6-->", "丁"]


def test_cycles_end_and_are_found(spark):
    e = edges(spark, ((0, 0), (1, 0)), ((1, 0), (2, 0)), ((2, 0), (1, 0)), ((5, 0), (6, 0)), ((6, 0), (5, 0)))
    walked = merge.chains(e)
    assert listed(walked, "page_idx", "depth") == [(1, 1), (2, 2)]
    assert listed(merge.cycles(e, walked), "src_page", "dst_page") == [(2, 1), (5, 6), (6, 5)]
    assert listed(merge.double_targets(e), "dst_page", "n") == [(1, 2)]


def test_media(spark):
    sub = [Row(type="image_caption", text="图①", html=""), Row(type="image_body", text="字", html=""), Row(type="image_footnote", text="注", html="")]
    b = blocks(spark, (0, "b", "image", "", {"sub": sub, "images": ["a/b.jpg"]}), (0, "b", "table", "", {"sub": [Row(type="table_body", text="内①", html="<table>①</table>")]}), (0, "b", "table", "", {"sub": [Row(type="table_body", text="内", html="")]}))
    rendered = render.rendered_blocks(b, no_edges(spark), merge.chains(no_edges(spark)), numbers(spark, 1))
    assert [x[1] for x in listed(rendered, "pos", "md")] == ["*图[^1]*\n\n![](images/b.jpg)\n\n<small>注</small>", "<table>①</table>", "内"]


def test_assembled_document(spark):
    b = blocks(spark, (0, "b", "text", "甲①。"), (0, "n", "page_footnote", "①注"))
    n = numbers(spark, 3)
    rendered = render.rendered_blocks(b, no_edges(spark), merge.chains(no_edges(spark)), n)
    notes = footnotes.footnotes(b, n)
    text = render.assemble(render.anchored(rendered, n), notes, n).first()["text"]
    assert text.endswith("<!--p.3-->\n\n甲[^1]。\n\n---\n\n## 注释\n\n[^1]: <!--p.3--> 注\n\n")
    source, product = diff.source_sections(b), diff.product_sections(spark.createDataFrame([("d", text)], "doc_id string, text string"))
    assert diff.changes(source, product).count() == 0


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "doc_id string, text string")


def rules(spark, text):
    return {r["rule"]: r["detail"] for r in verify.problems(docs(spark, text)).collect()}


def test_verify(spark):
    head = "---\ntitle: x\n---\n"
    found = rules(spark, head + "a[^1]b[^3]\n\n## 注释\n\n[^1]: x\n\n[^2]: y\n")
    assert found == {"unreferenced": "2", "undefined": "3"}
    found = rules(spark, head + "<!--p.5-->a<!--p.5-->b\n")
    assert found == {"repeated_anchor": "5x2"}
    assert rules(spark, head + "<!--p.3-->a<!--p.2-->b\n") == {"falling_anchor": "1"}
    assert rules(spark, head + "`<sub>` a <!--?quote--> x") == {"pending_quote": "1"}
    assert rules(spark, head + "<sub>a</sub>") == {"tags": "2"}
    assert rules(spark, "---\n标签: x\na: [\n---\nx").keys() == {"yaml", "property_name"}
    assert rules(spark, "x") == {"no_frontmatter": ""}


def test_missing_images(spark):
    d = docs(spark, "![](a.png) ![](http://x/b.png) ![](c.png)")
    files = spark.createDataFrame([("d0", "a.png")], "doc_id string, path string")
    assert verify.missing_images(d, files).first()["detail"] == "c.png"


_BOOK = "# A\n\nx[^2]y[^1]\n\n<!--p.3-->\n\nz[^2]\n\n# B\n\nw[^3]\n\n---\n\n## 注释\n\n[^1]: <!--p.1--> one\n\n[^2]: two\n\n[^3]: <!--p.3--> three"


def test_split(spark):
    parsed = split.parse(docs(spark, "---\ntitle: T\nlang: zh\n---\n" + _BOOK))
    assert listed(split.chapters(parsed, start_page="1"), "chapter", "title", "pages") == [(1, "A", "1-3"), (2, "B", "3-3")]
    assert listed(split.chapter_notes(parsed), "chapter", "new", "n", "note") == [(1, 1, 2, "two"), (1, 2, 1, "one"), (2, 1, 3, "three")]
    files = split.chapter_files(parsed, start_page="1", extra={"book": "书"})
    first, second = [r["text"] for r in files.orderBy("chapter").collect()]
    assert first == "---\ntitle: A\nlang: zh\nbook: 书\npages: 1-3\n---\n\n# A\n\nx[^1]y[^2]\n\n<!--p.3-->\n\nz[^1]\n\n---\n\n## 注释\n\n[^1]: two\n\n[^2]: <!--p.1--> one\n"
    assert "w[^1]" in second
    assert split.split_report(parsed, files).first()["n_unplaced"] == 0
    assert "| A | [[01-A]] | 1-3 | 2 |" in split.index(files, {"book": "书"}).first()["text"]
    assert split.faults(parsed).count() == 0


def test_split_faults(spark):
    found = {r["fault"] for r in split.faults(split.parse(docs(spark, "x", "# A\n\ny[^9]\n\n---\n\n## 注释\n\nnot a note"))).collect()}
    assert found == {"no_chapter_start", "bad_note", "undefined_note"}


def test_diff(spark):
    side = lambda t: spark.createDataFrame([("d", "body", t)], "doc_id string, section string, text string")
    changed = diff.changes(side("秦令8行"), side("秦令行x"))
    assert listed(changed, "tag", "before", "after", order=["seq"]) == [("delete", "8", ""), ("insert", "", "x")]
    assert diff.changes(side("秦①"), side("秦")).count() == 0
    assert diff.report_rows(changed).orderBy("seq").first()["label"] == "删"
    assert diff.moved(changed, side("秦令8行x"), side("秦令行x")).first()["n_moved"] == 1


def test_breaks_between_pages(spark):
    b = blocks(spark, (0, "b", "text", "未完"), (1, "b", "text", "续文。"), (2, "b", "text", "新段"), (3, "b", "text", "第二章"))
    args = (page_table(spark, 4), b, numbers(spark, 1, 2, 3, 4))
    assert listed(audit.break_candidates(*args, no_edges(spark), CJK_PROFILE), "page_idx", "after") == [(0, "续文。")]
    assert audit.break_candidates(*args, edges(spark, ((0, 0), (1, 0))), CJK_PROFILE).count() == 0


def test_usage(spark):
    ledger = spark.createDataFrame([("2024-01-01", "b:x.pdf", 2, 1), ("2024-01-01", "b:x.pdf", 9, 2)], "date string, key string, pages long, at long")
    row = ingest.daily_usage(ingest.append_usage(ledger.where("false"), ledger)).first()
    assert (row["files"], row["pages"], row["files_left"], row["pages_left"]) == (1, 2, 4999, 998)
    row = ingest.daily_usage(spark.createDataFrame([("d", "k", 5000, 1)], ledger.schema)).first()
    assert row["pages_left"] == 0


def test_upload_parts(spark):
    files = spark.createDataFrame([(1, "a.pdf", 201, 1000), (2, "b.pdf", 4, 900 * 1024 * 1024), (3, "c.pdf", 1, 300 * 1024 * 1024)], "file_id long, name string, pages long, bytes long")
    parts = ingest.upload_parts(files)
    assert listed(parts.where("file_id = 1"), "page_start", "page_end") == [(1, 200), (201, 201)]
    assert listed(parts.where("file_id = 2"), "page_start", "page_end") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert listed(parts.where("oversize"), "file_id") == [(2,)] * 4 + [(3,)]


def test_states(spark):
    events = spark.createDataFrame([(1, "a", 1, "running"), (1, "a", 2, "running"), (1, "a", 3, "done"), (1, "b", 1, "failed")], "batch long, file string, seq long, state string")
    assert listed(ingest.batch_states(events), "n", "n_done", "n_failed", "complete") == [(2, 1, 1, True)]
    assert ingest.state_changes(events).count() == 3
    results = spark.createDataFrame([("a", "done", "u", None), ("b", "done", "", None), ("c", "failed", None, "e"), ("d", "done", "u", None), ("e", "running", None, None)], "file string, state string, url string, error string")
    previous = spark.createDataFrame([("d", True)], "file string, downloaded boolean")
    parts = spark.createDataFrame([(x, x) for x in "abcde"], "file string, data_id string")
    actions = ingest.reconcile(results, previous, parts)
    assert listed(actions, "file", "action") == [("a", "fetch"), ("b", "missing_url"), ("c", "failed"), ("d", "keep"), ("e", "wait")]
    assert ingest.exit_code(actions).first()["code"] == 2


def test_submission_tables(spark):
    files = spark.createDataFrame([("a.PDF", 5), ("b.pdf", 0), ("c.txt", 9)], "path string, size long")
    assert listed(ingest.valid_inputs(files), "path") == [("a.PDF",)]
    parts = spark.createDataFrame([("s", "/x", "a", "i", 0, 0)], "source string, path string, upload_name string, data_id string, batch long, place long")
    assert ingest.public_part(parts).columns == ["source", "upload_name", "data_id"]
    urls = spark.createDataFrame([(0, 0, "u")], "batch long, place long, url string")
    assert ingest.assign_urls(parts, urls).first()["url"] == "u"
    jobs = spark.createDataFrame([("b", "x", True), ("b", "y", None), ("c", "z", None)], "batch_id string, file string, downloaded boolean")
    assert listed(ingest.resumable(jobs, "b"), "file") == [("y",)]


def test_names_never_clash(spark):
    names = ["a.pdf", "A.pdf", "a.x.2.pdf", "a.pdf", "b", "B", "A.X.5.pdf"]
    files = spark.createDataFrame([(k, n, k, "x") for k, n in enumerate(names)], "file_id long, name string, pos long, data_id string")
    found = {r["file_id"]: r["name"] for r in ingest.unique_names(files).collect()}
    assert len({n.lower() for n in found.values()}) == len(names)
    assert [found[k] for k in range(7)] == ["a.pdf", "A.x.6.pdf", "a.x.2.pdf", "a.x.7.pdf", "b", "B.x.2.pdf", "A.X.5.pdf"]


def test_poll_outcomes(spark):
    events = [(1, 0, 1, "running", 0), (1, 0, 2, "done", 9), (2, 0, 1, "running", 0), (2, 0, 2, "running", 10), (3, 0, 1, "running", 5)]
    rows = spark.createDataFrame(events, "batch long, file long, seq long, state string, at long")
    found = {r["batch"]: (r["n_polls"], r["outcome"]) for r in ingest.poll_outcomes(rows, 10).collect()}
    assert found == {1: (2, "done"), 2: (2, "timeout"), 3: (1, "open")}


def test_batches_follow_the_order(spark):
    parts = spark.range(230).select((F.lit(229) - F.col("id")).alias("k")).repartition(3)
    assert sorted((r["k"], r["batch"]) for r in ingest.batches(parts, ["k"], 50).collect()) == [(k, k // 50) for k in range(230)]


def test_report_of_a_rebuild(spark):
    b = blocks(spark, (0, "b", "text", "甲①"), (0, "n", "page_footnote", "①②注"))
    n = numbers(spark, 1)
    notes = footnotes.footnotes(b, n)
    counts = render.build_report(pages.body(b), render.renumber(pages.body(b).select("doc_id", "page_idx", "index", "text"), ["page_idx", "index"]), notes)
    added = spark.createDataFrame([("d", 0, 2, "补")], "doc_id string, page_idx long, circ long, text string")
    found = render.report_sections(counts, added=added, split=footnotes.split_notes(b, n), meta=audit.meta_notes(b, n))
    assert listed(found, "section", "page", "value") == [
        ("added", 0, "③ 补"),
        ("counts", None, "n_blocks=1"),
        ("counts", None, "n_marks=1"),
        ("counts", None, "n_notes=2"),
        ("counts", None, "n_used=1"),
        ("split", 1, "①② 注"),
        ("warning", None, "1 <> 2"),
    ]
