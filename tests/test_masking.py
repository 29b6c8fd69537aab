"""Masking, answers of engines and odd values, against literals worked by hand; functions that no query runs."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import extract, masking, text
from docketry.operators import evaluate, history, index, layout, retrieval, rules, sampling
from docketry.sources import files


def one(spark, use, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(use(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


# ------------------------------------------------------------------ masking
@pytest.mark.parametrize(("said", "titles", "want", "n"), [
    ("김철수 이영희", {"김철수": "과장", "이영희": "과장"}, "과장 ", 2),  # the title that the first name left stands before the second
    ("이영희 김철수", {"김철수": "과장", "이영희": "과장"}, "과장 과장", 2),  # 김철수 is replaced first, and has no title before it
    ("과장 김 철 수 보고", {"김철수": "과장"}, "과장  보고", 1),
    ("과장 그리고 아주 멀리 있는 김철수", {"김철수": "과장"}, "과장 그리고 아주 멀리 있는 과장", 1),
    ("김철수한 김철수", {"김철수": "과장", "김철수한": "팀장"}, "팀장 과장", 2),
    ("김 김철수", {"김": "x", "김철수": ""}, "김 ○○○", 1), ("없음", {}, "없음", 0),
])
def test_names_give_way_to_titles(spark, said, titles, want, n):
    assert tuple(one(spark, lambda c: masking.replace_names(c, titles), said)) == (want, n)


def test_sanitised_text(spark):
    clean = lambda t, allowed, source, names=("김철수",): one(spark, lambda a, b, c: masking.sanitize(a, b, c, list(names), F.array(F.lit("다른청"), F.lit("다른청"), F.lit(""), F.lit("먼청"))), t, allowed, source)
    assert tuple(clean(" 하천과-12 도로과-123 「지방법」 『없는법』 김 철수 다른 청 ", "도로과-123", "지방법")) == ("[확인 필요] 도로과-123 「지방법」 [근거 확인 필요] ○○○ 다른 청", 1, 1, 1, 1)
    assert tuple(clean("도로과-12", "도로과-123", None)) == ("도로과-12", 0, 0, 0, 0)
    assert tuple(clean("", None, None)) == ("", 0, 0, 0, 0) and clean(None, "", "") is None
    assert tuple(clean("도로과-12", None, None, ())) == ("[확인 필요]", 1, 0, 0, 0)


def test_cells_of_answers(spark):
    cells = lambda t: [(c["role"], c["title"], c["name"]) for c in one(spark, masking.cells_of_answer, t)]
    assert cells('<think>[{"role":"기안","title":"a"},{"title":"b"}]</think> 답 ```[{"role": "결재", "title": " 과장 ", "name": "ㄱ"}]```') == [("결재", "과장", "ㄱ")]
    assert cells('[1, 2, 3] [{"title": "x"}] [{"title": "y"}, 5]') == [("검토", "y", "")]
    assert cells('설명 [1] 과 [{"role": "이상", "title": "a [b]", "name": 3}]') == [("검토", "a [b]", "3")]
    assert cells("없음 [") == [] and cells(None) == [] and cells("[{]") == []


def test_public_names(spark):
    cells = spark.createDataFrame([("김하나",), ("?",), ("-",), ("가",), (None,), ("이두리",)], "name string")
    roster = spark.createDataFrame([("이두리", "팀장", 1), ("이두리", "과장", 2), ("박세찌", "주사", 3), ("나", "주사", 4)], "name string, title string, row_no int")
    assert sorted(r["name"] for r in masking.all_names(cells, roster).collect()) == ["김하나", "박세찌", "이두리"]
    assert {r["name"]: r["title"] for r in masking.names_to_titles(roster).collect()} == {"이두리": "과장", "박세찌": "주사"}


def test_white_space_is_the_same_in_both_tokenisers(spark):
    texts = ["a\x1cb", "a\x1d\x1e\x1fb c", "a\x85b", "a\xa0b　c", " \t\n", "", "é​f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.tokenize(F.col("t")).alias("ts")).collect()
    assert {r["i"]: r["ts"] for r in got} == {i: index.terms_of(t) for i, t in enumerate(texts)}


# ------------------------------------------------------------------ retrieval
def test_vectors_with_odd_components_take_no_part(spark):
    data = spark.createDataFrame([(1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [2.0, 1.0]), (4, None), (5, [float("inf"), 0.0]), (6, [0.0, 0.0])], "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.5]), (11, [None, 1.0])], "query_id int, embedding array<double>")
    got = [tuple(r) for r in retrieval.vectors(asked, data, 2).orderBy("rank").collect()]
    assert got == [(10, 1, 3, 1.0), (10, 2, 6, 0.0)]


def pools(spark):
    rng = random.Random(4)
    words = "도로 하천 산림 공원 민원 예산 계약 관리 점검 정비".split()
    table = [(i, s, "묶음", " ".join(rng.choices(words, k=3)), None, None) for i, s in enumerate(["도로과", "하천과", "(공통) 가", "도로과", "(공통) 나", "하천과", "도로과", "(공통) 가"])] + [(20, "도로과", "x", "도로 도로", 5, None)]
    queries = [(i, d, " ".join(rng.choices(words, k=4))) for i, d in enumerate(["도로과", "하천과", "없는과"] * 4)] + [(50, "도로과", ""), (51, "도로과", None), (52, None, "도로")]
    return spark.createDataFrame(queries, "query_id int, dept string, query string"), spark.createDataFrame(table, "rid int, sheet string, `group` string, item string, amount_min bigint, amount_max bigint")


def test_pools_in_tasks_and_by_joins_agree(spark, monkeypatch):
    queries, table = pools(spark)
    got = sorted(map(tuple, retrieval.candidates(queries.filter("query is not null and dept is not null"), table, 3).collect()))
    assert len(got) == 13 * 3 and all(r[2] != 20 for r in got)
    monkeypatch.setattr(index, "MOST_POOL_ROWS", 2)
    assert sorted(map(tuple, retrieval.candidates(queries.filter("query is not null and dept is not null"), table, 3).collect())) == got


def test_pools_with_nulls_and_vectors(spark):
    queries, table = pools(spark)
    got = retrieval.candidates(queries, table, 2).collect()
    assert [(r["rank"], r["rid"], r["score"]) for r in got if r["query_id"] == 51] == [(1, 0, 0.0), (2, 2, 0.0)]
    assert {r["rid"] for r in got if r["query_id"] == 52} <= {2, 4, 7}
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(8)], "rid int, embedding array<double>")
    asked = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 0.5, 0.0, 0.0, 0.0, 0.0])], "query_id int, embedding array<double>")
    plain = [r["rid"] for r in sorted((r for r in retrieval.candidates(queries, table, 6).collect() if r["query_id"] == 0), key=lambda r: r["rank"])]
    near = [3, 0, 2, 4, 6, 7]  # row 1 is another department's
    fused = sorted(plain, key=lambda r: (-round(1 / (61 + plain.index(r)) + 1 / (61 + near.index(r)), 9), r))
    got = [r["rid"] for r in sorted(retrieval.candidates(queries.filter("query_id = 0"), table, 6, embedded=(asked, vectors)).collect(), key=lambda r: r["rank"])]
    assert got == fused


def test_kept_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["도로 관리 계획", "하천 정비", "도로 도로 점검", None, "", "공원 관리 예산 도로"])], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "도로 관리"), (2, "없는 말"), (3, "")], "query_id int, query string")
    path = str(tmp_path / "index")
    built = index.build(docs, path)
    want = sorted(map(tuple, retrieval.bm25(queries, docs, 3).collect()))
    assert sorted(map(tuple, retrieval.search(queries, built, 3).collect())) == want
    assert sorted(map(tuple, retrieval.search(queries, index.kept(spark, path), 3).collect())) == want and len(want) == 9
    assert built.sizes()[0] == 6 and built.rows.filter("n = 0 and size(terms) = 0").count() == 2
    assert retrieval.search(queries, index.build(docs.limit(0)), 3).count() == 0
    assert [r["doc_id"] for r in retrieval.make_retriever(docs, id_col="doc_id")(queries.filter("query_id = 1"), 1).collect()] == [0]


def test_cut_before_the_filter(spark):
    hits = spark.createDataFrame([(1, r, f"o{r % 2}") for r in range(1, 9)], "query_id int, rank int, org string")
    kept = lambda df: [r["rank"] for r in df.orderBy("rank").collect()]
    assert kept(retrieval.cut_then_filter(hits, F.col("org") == "o0", 5, 3)) == [1, 2] and kept(retrieval.filtered_hits(hits, F.col("org") == "o0", 3)) == [1, 2, 3]


# ------------------------------------------------------------------ functions that no query runs
def test_leads_and_teams(spark):
    teams = spark.createDataFrame([("가", 1, "도로팀", "도로 팀장"), ("가", 2, "하천팀", ""), ("나", 1, "도로팀", "x")], "dept string, ord int, team string, lead string")
    asked = spark.createDataFrame([(1, "가", "도로팀"), (2, "가", "하천팀"), (3, "가", "산림팀"), (4, "가", "보건소장"), (5, "가", "")], "req int, dept string, team string")
    assert {r["req"]: r["lead"] for r in rules.team_lead(teams, asked).collect()} == {1: "도로 팀장", 2: "하천팀장", 3: "산림팀장", 4: "보건소장", 5: None}
    leads = spark.createDataFrame([(1, "가", "도로팀장"), (2, "나", "도로팀장")], "req int, dept string, lead string")
    assert {r["req"]: r["team"] for r in rules.team_of_lead(teams, leads).collect()} == {1: "도로팀", 2: None}


def test_prior_of_routed_teams(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "doc_id int, org string")
    routed = spark.createDataFrame([(1, "x", 3, False), (2, "x", 1, True), (3, None, 0, False)], "doc_id int, team string, score int, tied boolean")
    teams = spark.createDataFrame([("A", 1, "x", 2), ("A", 2, "y", 5), ("A", 3, "z", 5)], "org string, ord int, lead string, observed_docs int")
    assert {r["doc_id"]: (r["lead"], r["prior"]) for r in rules.with_prior(routed, teams, docs).collect()} == {1: ("x", "y"), 2: (None, "y"), 3: (None, None)}


def test_mostly_empty_and_acting(spark):
    rows = spark.createDataFrame([("a", ""), ("a", None), ("a", "x"), ("b", ""), ("b", "x")], "k string, v string")
    assert {r["k"]: r["empty"] for r in history.mostly_empty(rows, "k", "v").collect()} == {"a": True, "b": False}
    docs = spark.createDataFrame([(1, "A"), (2, "A")], "doc_id int, org string")
    cells = spark.createDataFrame([(1, "결재", "과장", "대결"), (2, "결재", "과장", "전결(대결)"), (2, "검토", "팀장", None)], "doc_id int, role string, title string, note string")
    chains = spark.createDataFrame([("A", "국장")], "org string, approve string")
    assert [tuple(r) for r in history.induce_acting(docs, cells, chains).collect()] == [("A", "국장", "과장", 2)]


def test_delegation_impact(spark):
    outcomes = spark.createDataFrame([("A", True), ("A", False), ("B", False), ("C", True)], "org string, title_ok boolean")
    diff = spark.createDataFrame([("A", "same"), ("A", "differs"), ("B", "same"), ("C", "only_a")], "org string, status string")
    assert {r["org"]: (r["cells"], r["wrong"]) for r in evaluate.delegation_impact(outcomes, diff).collect()} == {"A": (2, 1), "C": (1, 0)}


def test_bodies_of_segments(spark):
    entries = spark.createDataFrame([("g", 1, 2, 3), ("g", 2, 3, 3), ("g", 3, 9, 9)], "source string, seq int, first int, until int")
    pages = spark.createDataFrame([("g", p, f"p{p}") for p in (1, 2, 3, 4)], "source string, page_no int, text string")
    assert {r["seq"]: r["body"] for r in sampling.bodies(entries, pages, "source", ["seq"]).collect()} == {1: "p2\np3", 2: "p3"}


def test_drawn_rounds_repeat(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", i) for i in range(30)], "g string, k int")
    draw = lambda: sorted(map(tuple, sampling.resampled(rows, "g", "k", 4, 3, seed=1).select("round", "g", "k").collect()))
    got = draw()
    assert got == draw() and len(got) == 4 * 3 * 3 and len({k for r, _, k in got if r == 0} ^ {k for r, _, k in got if r == 1}) > 0


def test_org_chart(spark):
    raw = [(1, "국A", "과1", "", "과1장", ""), (2, "국B", "과1", "", "다른장", ""), (3, "", "과1", "팀1", "소장", "하나"), (4, "", "과1", "팀1", "팀1팀장", "둘"), (5, "", "과1", "팀1", "팀2팀장", ""), (6, "", "과1", "팀2", "주사", None)]
    dept, team = files.org_chart(spark.createDataFrame(raw, "row_no int, bureau string, dept string, team string, title string, duty string"))
    assert [tuple(r) for r in dept.collect()] == [("과1", "국A", "과1장")]
    assert sorted(tuple(r) for r in team.collect()) == [("과1", "팀1", "팀2팀장", "하나 둘"), ("과1", "팀2", "", "")]


def test_broken_titles_are_joined(spark):
    words = [(1, 50.0, 10.0, "출입국관리서", 40.0), (2, 52.0, 25.0, "기", 41.0), (3, 50.0, 40.0, "홍길동", 40.0), (4, 200.0, 10.0, "총무사무관", 190.0), (5, 200.0, 25.0, "이몽룡", 190.0), (6, 300.0, 10.0, "시설관리주", 290.0), (7, 300.0, 28.0, "사", 290.0), (8, 300.0, 30.0, "사보", 290.0)]
    rows = spark.createDataFrame([("d", *w) for w in words], "doc_id string, word_id int, xc double, y double, text string, xl double")
    got = [(r["title"], r["name"]) for r in layout.approval_cells(rows, "top").orderBy("ord").collect()]
    assert ("출입국관리서기", "홍길동") in got and ("총무사무관", "이몽룡") in got and any(t == "시설관리주사" for t, _ in got)


def test_extractors_over_documents_text(spark):
    docs = [("도로과-0012 금 1,234원 2024. 1. 5.", "도로과-12", 1234, "2024-01-05"), ("", "", None, ""), ("2024-12-01 2023.2.3", "", None, "2023-02-03")]
    got = spark.createDataFrame([(t,) for t, *_ in docs], "t string").select(extract.doc_no(F.col("t")).alias("n"), extract.amount(F.col("t")).alias("a"), extract.earliest_date(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in got] == [d[1:] for d in docs]
    assert [r[0] for r in spark.createDataFrame([("12,3a",), ("x",), ("-5",)], "t string").select(extract.lenient_int(F.col("t"))).collect()] == [123, None, -5]


def test_blocks_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"도로 {i} 하천") for i in range(12)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, f"하천 {i}") for i in range(9)], "query_id int, query string")
    data = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "vec_id int, embedding array<double>")
    found = lambda: (sorted(map(tuple, retrieval.bm25(queries, docs, 2).collect())), sorted(map(tuple, retrieval.vectors(data.withColumnRenamed("vec_id", "query_id"), data, 2).collect())), sorted(map(tuple, retrieval.holders(queries, docs).collect())))
    want = found()
    monkeypatch.setattr(retrieval, "MOST_BYTES", 40)
    assert found() == want and len(want[0]) == 18 and len(want[1]) == 24
