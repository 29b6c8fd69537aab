"""Documents with their gold, what a service shows of them, rendered drafts and reports, against literals worked by hand."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import drafts, evaluate, tracks
from docketry.sources import documents, files, render

GOLD = "row_no int, file string, org string, role string, title string, name string, note string"


def gold(spark):
    return spark.createDataFrame([
        (1, "b.pdf", "A", "검토", "팀장", "가", ""), (2, "b.pdf", "A", "기안", "주무관", "나", ""), (3, "b.pdf", "B", "검토", "과장", "다", "대결"),
        (4, "c.pdf", "A", "협조", "-", "-", ""), (5, "z.pdf", "A", "기안", "주무관", "라", ""),
    ], GOLD)


def test_metadata_order_and_limit(spark):
    meta = spark.createDataFrame([(3, "a.b.pdf"), (1, "x.pdf"), (2, "b.pdf"), (4, "y.pdf"), (5, "c.pdf")], "row_no int, file string")
    there = spark.createDataFrame([("a.b.pdf",), ("b.pdf",), ("c.pdf",), ("c.pdf",), ("other.pdf",)], "file string")
    told = lambda n: ([r["doc_id"] for r in documents.collected(meta, there, n)[0].orderBy("row_no").collect()], sorted(r["file"] for r in documents.collected(meta, there, n)[1].collect()))
    assert told(None) == (["b", "a.b", "c"], ["x.pdf", "y.pdf"])
    assert told(2) == (["b", "a.b"], ["x.pdf"])  # reading ends before y
    assert told(9) == (["b", "a.b", "c"], ["x.pdf", "y.pdf"]) and told(0) == ([], [])


def test_documents_with_gold_and_types(spark):
    docs = spark.createDataFrame([("b", "b.pdf", "계획 알림"), ("c", "c.pdf", "지출 결의"), ("d", "d.pdf", "안부")], "doc_id string, file string, title string")
    kept, cells = documents.with_gold(docs, gold(spark))
    assert {r["doc_id"]: r["org"] for r in kept.collect()} == {"b": "B", "c": "A"}  # the last row's; no gold, no document; explicit "no cell" is gold
    assert sorted((r["doc_id"], r["role"], r["pos"], r["title"]) for r in cells.collect()) == [("b", "검토", 0, "팀장"), ("b", "검토", 1, "과장"), ("b", "기안", 0, "주무관")]
    typed = documents.with_types(docs, gold(spark))
    assert {r["doc_id"]: (r["org"], r["doc_type"]) for r in typed.collect()} == {"b": ("B", "계획"), "c": ("A", "지출"), "d": ("", "기타")}


def test_bodies_and_cards(spark):
    pages = spark.createDataFrame([("b", 2, "둘"), ("b", 1, "하나 김하나"), ("b", 10, None), ("c", 1, "")], "doc_id string, page_no int, text string")
    whole = documents.bodies(pages)
    assert {r["doc_id"]: (r["body"], r["page_count"]) for r in whole.collect()} == {"b": ("하나 김하나\n둘\n", 3), "c": ("", 1)}
    docs = whole.join(spark.createDataFrame([("b", "A", "계획", "n-1", "2024-01-01", "과"), ("c", "", "기타", "", "", "")], "doc_id string, org string, doc_type string, doc_no string, date string, dept string"), "doc_id")
    cells = spark.createDataFrame([("b", "결재", 0, "국장", "x"), ("b", "검토", 1, "과장", "x"), ("b", "검토", 0, "팀장", "x"), ("b", "기안", 0, "주무관", "x")], "doc_id string, role string, pos int, title string, name string")
    got = {r["doc_id"]: r for r in documents.cards(docs, cells).collect()}
    assert (got["b"]["gold_titles"], got["b"]["body_chars"], got["b"]["has_gold"]) == (["주무관", "팀장", "과장", "국장"], 9, True) and (got["c"]["gold_cell_count"], got["c"]["has_gold"]) == (0, False)
    assert [r["org"] for r in documents.organisations(docs).collect()] == ["A"] and documents.of_organisation(docs, "A").count() == 1 and documents.of_organisation(docs).count() == 2
    assert {r["doc_id"]: r["s"] for r in docs.select("doc_id", documents.shown_body(F.col("body"), ["김하나"]).alias("s")).collect()}["b"] == "하나 ○○○\n둘\n"


def test_numbered_gold(spark):
    rows = [(2, "1", "n1", "과", "2024.1.2", "검토", "팀장", ""), (1, "1", "n1", "과", "2024.01.02", "기안", "주무관", "x"), (3, "2", "n2", "국", "2024-03-04", "기안", "주사", None)]
    docs, cells = documents.numbered_gold(spark.createDataFrame(rows, "row_no int, no string, doc_no string, org string, date string, role string, title string, note string"))
    assert sorted(tuple(r) for r in docs.collect()) == [("1", "n1", "과", "2024-01-02"), ("2", "n2", "국", "2024-03-04")]
    assert [(r["pos"], r["title"]) for r in cells.filter("no = '1'").orderBy("pos").collect()] == [(0, "주무관"), (1, "팀장")]


def test_fields_and_their_report(spark):
    pages = spark.createDataFrame([("a", "도로교통부장관\n제목  도로 정비\n2024. 3. 5. 도로과-0012 2024. 1. 9."), ("b", "")], "doc_id string, text string")
    cells = spark.createDataFrame([("a", 1, "검토", "팀장", "다"), ("a", 0, "기안", "주무관", "나")], "doc_id string, ord int, role string, title string, name string")
    found = documents.fields(pages, cells)
    got = {r["doc_id"]: r.asDict() for r in found.collect()}
    assert {k: v for k, v in got["a"].items() if k != "agency"} == {"doc_id": "a", "title": "도로 정비", "dept": "도로과", "date": "2024-01-09", "doc_no": "도로과-12", "drafter": "나"} and got["a"]["agency"] == "도로교통부"
    assert got["b"]["drafter"] == "" and got["b"]["title"] == ""
    truth = spark.createDataFrame([("a", "도로정비", "도로교통부", "도로과", "나", "2024-01-09", "도로과-12"), ("b", "x", "", "", "", "", "")], "doc_id string, title string, agency string, dept string, drafter string, date string, doc_no string")
    _, by_field = tracks.field_report(found, truth)
    assert {r["field"]: (r["documents"], r["accuracy"]) for r in by_field.collect() if r["field"] in ("title", "dept", "doc_no")} == {"title": (2, 0.5), "dept": (2, 1.0), "doc_no": (2, 1.0)}


def test_rendered_drafts(spark):
    rows = [(1, 1, "목적", "paragraph", "추진한다", ""), (1, 2, "기간", "item", " 3일 ", ""), (1, 3, "비고", "item", "x", "skipped"), (1, 4, "예산", None, None, "needs_input"), (1, 5, "붙임", "attachment", "계획서 1부", "")]
    got = drafts.rendered(spark.createDataFrame(rows, "req int, ord int, label string, style string, value string, status string"), spark.createDataFrame([(1, "행사"), (2, None)], "req int, title string"))
    assert {r["req"]: r["text"] for r in got.collect()} == {1: "제목  행사\n\n추진한다\n\n1. 기간: 3일\n2. 예산: \n\n붙임  계획서 1부  끝.\n", 2: "제목\n"}


def test_summaries_checked_and_reported(spark):
    pages = spark.createDataFrame([("a", 1, "도로 공사 1,200원 2024. 1. 5."), ("a", 2, "하천 정비 300원"), ("b", 1, "가나다 10원")], "doc_id string, page_no int, text string")
    items = spark.createDataFrame([("a", "one", "도로 공사 1,200원"), ("a", "points", "하천 정비 999원 김하나"), ("b", "one", "없음")], "doc_id string, slot string, value string")
    points = spark.createDataFrame([("a", 0, "하천 정비", 2), ("a", 1, "도로 공사", 2), ("a", 2, "무관", None)], "doc_id string, n int, value string, page int")
    got = {r["doc_id"]: r.asDict() for r in evaluate.summary_checks(items, pages, points, ["김하나", "가"]).collect()}
    a = got["a"]
    assert (a["tokens"], a["ungrounded"], a["rate"], a["names_in_output"], a["checked"], a["correct"], a["missing_page"]) == (2, 1, 0.5, 1, 2, 1, 1)
    assert (got["b"]["tokens"], got["b"]["rate"], got["b"]["checked"]) == (0, 0.0, 0)
    checks = evaluate.summary_checks(items, pages, points, ["김하나"]).withColumns({"raw_tokens": F.lit(4), "raw_ungrounded": F.lit(1), "dropped": F.lit(2)})
    total = tracks.summary_report(checks).first()
    assert (total["cases"], total["raw_rate"], total["final_rate"], total["dropped"], total["names_in_output"], total["checked"], total["correct"]) == (2, 0.25, 0.5, 4, 1, 2, 1)


def test_changed_rules_as_a_table(spark):
    diff = spark.createDataFrame([("A", "teams", ["x"], ["y"], []), ("A", "draft", ["x"], [], [])], "org string, item string, both array<string>, only_induced array<string>, only_official array<string>")
    assert [r["line"] for r in evaluate.diff_table(diff).collect()] == ["| A | teams | x | y | - |"]


def test_rules_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("rules:\n  - {org: A, title: 과장}\n  - {org: B, title: 국장}\n", encoding="utf-8")
    got = files.yaml_rules(spark, str(tmp_path / "r.yaml"), lambda y: [(r["org"], r["title"]) for r in y["rules"]], "org string, title string")
    assert sorted(tuple(r) for r in got.collect()) == [("A", "과장"), ("B", "국장")]


# ------------------------------------------------------------------ pages
def test_pages_with_figures_and_their_choice(spark):
    body, table, toc = "긴 문장이 이어지는 본문 줄입니다 아주 길게", "\n".join(["짧은"] * 12), "○ 제목 ·········· 3"
    pages = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate([body, body, body, table, toc, None])] + [("b", 1, body)], "doc_id string, page_no int, text string")
    gutters = spark.createDataFrame([("a", 2, True), ("b", 1, None)], "doc_id string, page_no int, has_gutter boolean")
    told = documents.page_table(pages, gutters)
    assert [(r["page_no"], r["page_type"], r["doc_pages"], r["lines"]) for r in told.filter("doc_id = 'a'").orderBy("page_no").collect()] == [(1, "body_1col", 6, 1), (2, "body_2col", 6, 1), (3, "body_1col", 6, 1), (4, "table", 6, 12), (5, "toc", 6, 1), (6, "body_1col", 6, 0)]
    picked = lambda n: sorted((r["doc_id"], r["page_no"]) for r in documents.selected_pages(told, n).collect())
    assert picked(4) == [("a", 1), ("a", 2), ("a", 4), ("a", 5), ("b", 1)] and picked(5) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 1)]


def test_pages_are_rendered_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"one two"), ("b.pdf", b"one two"), ("c.pdf", b"three"), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(content)
    calls = spark.sparkContext.accumulator(0)

    def draw(content, dpi):
        calls.add(1)
        return [w + str(dpi).encode() for w in content.split()]

    files_, kept = render.documents(spark, str(tmp_path / "in")), str(tmp_path / "kept")
    images, made = render.rendered(files_, kept, draw, 100)
    assert made == 2 and calls.value == 2  # two files of equal content are rendered once
    assert sorted((r["doc_id"], r["page_no"], bytes(r["image"])) for r in images.collect()) == [("a", 1, b"one100"), ("a", 2, b"two100"), ("b", 1, b"one100"), ("b", 2, b"two100"), ("c", 1, b"three100")]
    assert render.rendered(files_, kept, draw, 100)[1] == 0 and render.rendered(files_, kept, draw, 200)[1] == 2
    regions = spark.createDataFrame([("a", 2, 1, 3), ("c", 1, 0, 2)], "doc_id string, page_no int, y0 int, y1 int")
    cut = render.cropped(images, regions, lambda image, y0, y1: image[int(y0) : int(y1)])
    assert sorted((r["doc_id"], bytes(r["image"])) for r in cut.collect()) == [("a", b"wo"), ("c", b"th")]
