"""Layered lines, votes without self, sheets of delegation, side tables, engines and gazette items, against literals worked by hand."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import shared
from docketry.operators import bundles, drafts, gazette, history, layout, predict
from docketry.sources import engines, matrix, side_table

DOCS, CELLS = "doc_id int, org string, date string, doc_no string, title string, body string", "doc_id int, role string, pos int, title string, name string"


# ------------------------------------------------------------------ votes and layers
def test_votes_without_self_keep_null_keys_and_values(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, None, "b"), (4, "k", None), (5, "k", None), (6, "k", "c"), (7, "solo", "x")]
    got = {r["i"]: (r["voted"], r["votes"]) for r in history.vote_without_self(spark.createDataFrame(rows, "i int, k string, v string"), ["k"], "v", "i").collect()}
    # 1: a (2) and b (3) once each, b is later; 4: null (5) and c (6), c is later; 6: null twice
    assert got == {1: ("b", 1), 2: ("b", 1), 3: ("a", 2), 4: ("c", 1), 5: ("c", 1), 6: (None, 2), 7: (None, 0)}
    copied = {r["i"]: r["copied"] for r in history.copy_latest_other(spark.createDataFrame(rows, "i int, k string, v string"), "k", "v", "i").collect()}
    assert copied == {1: "b", 2: "b", 3: "a", 4: "c", 5: "c", 6: None, 7: None}


def test_votes_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice("uvwxyz"), rng.randint(0, 40)) for i in range(300)]
    got = {r["i"]: (r["voted"], r["votes"]) for r in history.vote_without_self(spark.createDataFrame(rows, "i int, k string, v string, d int"), ["k"], "v", "d", "i").collect()}
    for i, k, _, _ in rows:
        others = [(v, (d, j)) for j, k2, v, d in rows if k2 == k and j != i]
        best = max({v for v, _ in others}, key=lambda v: (sum(x == v for x, _ in others), max(r for x, r in others if x == v)))
        assert got[i] == (best, sum(x == best for x, _ in others))


def test_layers_see_only_what_is_open(spark):
    slots = spark.createDataFrame([(i, 0) for i in range(10)], "doc int, pos int")
    asked = []

    def layer(name, keep):
        def answer(open_):
            asked.append((name, sorted(r["doc"] for r in open_.collect())))
            return open_.filter(keep).select("doc", "pos", F.lit(name).alias("name"))

        return name, answer

    out = predict.resolve(slots, [layer("a", "doc < 3"), layer("b", "doc % 2 = 0"), layer("c", "doc in (0, 9)")], ["doc", "pos"])
    assert asked == [("a", list(range(10))), ("b", list(range(3, 10))), ("c", [3, 5, 7, 9])]
    assert {r["doc"]: (r["name"], r["evidence"]) for r in out.collect()} == {**{i: ("a", "a") for i in range(3)}, 4: ("b", "b"), 6: ("b", "b"), 8: ("b", "b"), 9: ("c", "c"), **{i: ("", "none") for i in (3, 5, 7)}}


def test_names_without_self(spark):
    docs = spark.createDataFrame([(i, "A", f"2024-01-{i:02d}", str(i), "", "") for i in range(1, 7)], DOCS)
    cells = [(1, "검토", 0, "팀장", "가"), (2, "검토", 0, "팀장", "나"), (3, "검토", 0, "팀장", "다"), (4, "검토", 0, "팀장", "라"), (4, "검토", 1, "팀장", "다"), (5, "검토", 0, "팀장", "?"), (6, "검토", 0, "과장", "마")]
    own = docs.select("doc_id", "org", "date", "doc_no").withColumn("title", F.lit("팀장"))
    got = {r["doc_id"]: r["names"] for r in predict.names_without_self(own, docs, spark.createDataFrame(cells, CELLS)).collect()}
    # latest first; document 4 alone has had 라, and 다 after 3
    assert got == {1: ["다", "라", "나"], 2: ["다", "라", "가"], 3: ["다", "라", "나", "가"], 4: ["다", "나", "가"], 5: ["다", "라", "나", "가"], 6: ["다", "라", "나", "가"]}
    # only the first two are promised; the fifth name may be left out
    assert all(len(v) >= 2 for v in got.values())


def test_layered_line_by_hand(spark):
    docs = [(1, "A", "2024-01-01", "1", "도서 점검", ""), (2, "A", "2024-01-02", "2", "공연 점검", ""), (3, "A", "2024-01-03", "3", "점검", ""), (4, "B", "2024-01-01", "4", "x", ""), (5, "B", "2024-01-02", "5", "x", "")]
    cells = []
    for i, lead in ((1, "자료팀장"), (2, "운영팀장"), (3, "운영팀장")):
        cells += [(i, "기안", 0, "주무관", f"ㄱ{i % 2}"), (i, "검토", 0, lead, "ㄴ"), (i, "검토", 1, "부장", "ㄷ"), (i, "결재", 0, "관장", "ㄹ"), (i, "협조", 0, "전산팀장", "ㅁ")]
    cells += [(4, "기안", 0, "주사", "ㅂ"), (4, "결재", 0, "소장", "ㅅ"), (5, "기안", 0, "서기", ""), (5, "결재", 0, "소장", "ㅅ")]
    teams = [("자료팀장", ["도서"], 1), ("운영팀장", ["공연"], 2)]
    bundled = spark.createDataFrame([("A", "manual", 3, "주무관", "관장", 2, teams, [(1, None, None, None, "관장", "r")], None, True, [(["결과보고"], "회계팀장")], None, [])], bundles.SCHEMA)
    made = lambda **more: {(r["doc_id"], r["role"], r["pos"]): (r["title"], r["name"], r["title_source"], r["name_source"]) for r in predict.layered(spark.createDataFrame(docs, DOCS), spark.createDataFrame(cells, CELLS), bundled, **more).collect()}
    got = made()
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {
        ("기안", 0): ("주무관", "ㄱ1", "rule", "vote"), ("검토", 0): ("자료팀장", "", "rule", "none"), ("검토", 1): ("회계팀장", "", "rule", "none"), ("결재", 0): ("관장", "", "rule", "rule"), ("협조", 0): ("전산팀장", "ㅁ", "vote", "roster"),
    }
    # no hit: the team seen most often, by vote; two reviewers are there already, so that the usual second one has no place
    assert got[3, "검토", 0] == ("운영팀장", "ㄴ", "vote", "roster") and (3, "검토", 2) not in got
    # no rules: all by vote
    assert {k[1:]: v for k, v in got.items() if k[0] == 4} == {("기안", 0): ("서기", "", "vote", "vote"), ("결재", 0): ("소장", "ㅅ", "vote", "vote")}
    # an engine's picks, of the teams and among the names
    picks = {"team_picks": spark.createDataFrame([(3, "자료팀장"), (1, "없는팀장")], "doc_id int, pick string"), "name_picks": spark.createDataFrame([(1, "주무관", "ㄱ0"), (2, "주무관", "없음")], "doc_id int, title string, pick string")}
    got = made(**picks)
    assert got[3, "검토", 0][::2] == ("자료팀장", "llm") and got[1, "기안", 0] == ("주무관", "ㄱ0", "rule", "llm") and got[2, "기안", 0][3] == "roster"


# ------------------------------------------------------------------ sheets
def test_sheet_by_hand(spark):
    rows = [
        ["연번", "사 무 명", "비고", "담 당 자", "팀 장", "과장", "부군수"], ["", "", "", "과장", "", "", "군수"],
        ["1", "의회 관계", "", "", "", "", ""], ["", "의안  처리", "", "기안", "", "○", ""], ["", "물품 구매", "", "", "", "", ""], ["", "5천만원 초과 4억원 이하", "", "", "○", "○", ""], ["", "4억원 초과", "", "ㅇ", "", "", " ● "],
        ["2", "민원", "", "", "", "", ""], ["", "1억원 이하", "", "", "○", "", ""], ["3", "표창", "", "기안자", "기안", "O", ""], ["", "2백만원 미만", "", "○", "", "", ""], ["", "", "", "○", "", "", ""],
    ]
    cells = [("b", "과", r, c, t) for r, line in enumerate(rows, 1) for c, t in enumerate(line, 1) if t] + [("b", "빈", 1, 1, "설명"), ("b", "빈", 2, 2, "○")]
    got = matrix.delegation(spark.createDataFrame(cells, matrix.CELLS)).orderBy("sheet", "row").collect()
    assert {r["sheet"] for r in got} == {"과"}  # a sheet without grades has no tasks
    assert [(r["row"], r["group"], r["item"], r["amount_min"], r["amount_max"], r["drafter_level"], r["final_level"]) for r in got] == [
        (4, "의회 관계", "의안 처리", None, None, 0, 2),
        (6, "의회 관계", "물품 구매 5천만원 초과 4억원 이하", 50_000_000, 400_000_000, None, 2),  # the parent's text; the highest mark
        (7, "의회 관계", "물품 구매 4억원 초과", 400_000_000, None, None, 4),
        (9, "민원", "1억원 이하", None, 100_000_000, None, 1),  # a heading ends the task before
        (10, "민원", "표창", None, None, 0, 2),  # numbered, but marked: a task; who drafts is the lowest
        (11, "민원", "표창 2백만원 미만", None, 2_000_000, None, 0),
    ]
    head = matrix.headers(spark.createDataFrame(cells, matrix.CELLS), ["book", "sheet"]).first()
    assert head["levels"] == {4: 0, 5: 1, 6: 2, 7: 4} and (head["name_col"], head["start"]) == (2, 3)


def test_sheets_from_files(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"1,1;1,2")
    read = lambda content: [("S", *map(int, part.split(b",")), "x") for part in content.split(b";")] + [("S", 9, 9, None)]
    assert sorted(tuple(r) for r in matrix.cells(spark, str(tmp_path), read).collect()) == [("a.xlsx", "S", 1, 1, "x"), ("a.xlsx", "S", 1, 2, "x")]


# ------------------------------------------------------------------ side tables and engines
def test_fill_makes_only_what_is_missing(spark, tmp_path):
    path, schema = str(tmp_path / "side"), "key string, n int"
    made = spark.sparkContext.accumulator(0)

    def make(todo):
        def run(parts):
            for part in parts:
                made.add(len(part))
                yield part[part["text"] != "bad"].assign(n=part["text"].str.len())[["key", "n"]]

        return todo.mapInPandas(run, schema)

    wanted = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", side_table.content_key("v1", "text"))
    assert side_table.fill(wanted(["a", "bb", "bb", "bad"]), path, make, schema)[1] == 2 and made.value == 3
    table, n = side_table.fill(wanted(["a", "bb"]), path, make, schema)
    assert n == 0 and made.value == 3 and table.count() == 2  # nothing is made again
    assert side_table.fill(wanted(["bb", "ccc", "bad"]), path, make, schema)[1] == 1 and made.value == 5  # what failed is tried again
    # a run that never finished doesn't count, and harms nobody
    (tmp_path / "side" / "run-broken").mkdir()
    (tmp_path / "side" / "run-broken" / "part-0.parquet").write_bytes(b"half")
    assert len(side_table.runs(spark, path)) == 2 and side_table.read(spark, path, schema).count() == 3
    # a run written twice over
    table.write.parquet(path + "/run-again")
    assert side_table.read(spark, path, schema).count() == 3
    side_table.compact(spark, path, schema)
    assert len(side_table.runs(spark, path)) == 1 and sorted(r["n"] for r in side_table.read(spark, path, schema).collect()) == [1, 2, 3]
    assert [r["n"] for r in side_table.looked_up(wanted(["ccc", "zz"]), side_table.read(spark, path, schema)).orderBy("text").collect()] == [3, None]
    assert side_table.read(spark, str(tmp_path / "none"), schema).count() == 0 and not shared.exists(spark, str(tmp_path / "none"))


def test_content_keys_tell_places_apart(spark):
    rows = [("a", "b"), ("ab", ""), ("ab", None), (None, "ab"), ("", "ab"), ("a=", "b"), ("a", "=b"), ("a", "b")]
    keys = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(side_table.content_key("v", "x", "y")).collect()]
    assert len(set(keys)) == 7 and keys[0] == keys[-1]
    assert spark.createDataFrame(rows[:1], "x string, y string").select(side_table.content_key("w", "x", "y")).first()[0] != keys[0]


def test_engine_that_fails_at_times(spark):
    def call(asks):
        if len(asks) > 1 and "trip" in asks:
            raise RuntimeError("trip")
        if asks == ["never"]:
            raise TimeoutError("late")
        return [None if a == "mute" else a.upper() for a in asks][: 1 if "short" in asks else None]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "trip", "never", "mute", "short", None, "no"])], "i int, t string").coalesce(1)
    got = {r["i"]: (r["raw"], r["error"], r["attempts"]) for r in engines.called(rows, "t", call, batch=3, accept=lambda a: a != "NO").collect()}
    assert got == {0: ("A", None, 2), 1: ("TRIP", None, 2), 2: (None, "TimeoutError: late", 2), 3: (None, "no answer", 2), 4: ("SHORT", None, 2), 5: (None, None, 0), 6: (None, "not accepted: NO", 2)}
    once = engines.called(rows, "t", call, batch=1, attempts=1).collect()
    assert len(once) == 7 and {r["i"]: r["attempts"] for r in once}[0] == 1
    assert [r["raw"] for r in drafts.generate(rows.filter("i = 0"), "t", call).collect()] == ["A"]


def test_prompts_and_picks(spark):
    row = spark.createDataFrame([("제목", "본문 긴 글", "", ["가", "나"], "<think>A</think> 답: b)"), ("x", None, None, ["가"], "C")], "t string, b string, e string, o array<string>, a string")
    got = row.select(engines.prompt([("제목", "t"), ("본문", "b"), ("첨부", "e")], {"b": 2}).alias("p"), engines.menu("o").alias("m"), engines.picked("a", "o").alias("k")).collect()
    assert tuple(got[0]) == ("# 제목\n\n제목\n\n# 본문\n\n본문", "A) 가\nB) 나", "나") and tuple(got[1]) == ("# 제목\n\nx", "A) 가", None)


# ------------------------------------------------------------------ gazette
def test_offsets_of_printed_pages(spark):
    entries = spark.createDataFrame([("g", 1, "도로 관리 규칙 전부 개정", 3), ("g", 2, "다른", 9), ("far", 1, "먼 제목", 2), ("none", 1, " ", 4)], "source string, seq int, title string, page int")
    pages = [("g", 1, "표지"), ("g", 2, "목차 ○ 도로 관리 규칙 전부 개정 ○ ○"), ("g", 6, "○ 하나 도로관리 규칙 전부 개정 본문"), ("g", 7, "도로 관리 규칙 전부 개정"), ("far", 11, "먼 제목"), ("none", 4, "x")]
    got = {r["source"]: r["offset"] for r in drafts.page_offset(entries, spark.createDataFrame(pages, "source string, page_no int, text string")).collect()}
    assert got == {"g": 3, "far": 0, "none": 0}  # bullets count wherever they stand; beyond eight pages it isn't looked for


def test_items_stay_within_the_issue(spark):
    toc = "○ 도로청 고시제1호(가나 고시(일부))·····2\n○ 하천청 공고제2-1호(다라 공고)·····2\n○ 산림청 공고제3호(마바 공고)·····4\n○ 쪽수 없는 줄"
    pages = [("g", 1, "표지"), ("g", 2, toc), ("g", 3, "가나 고시(일부) 시작"), ("g", 4, "이어서 다라 공고"), ("g", 5, "마바 공고"), ("g", 6, "끝")]
    got = gazette.items(spark.createDataFrame(pages, "source string, page_no int, text string")).orderBy("seq").collect()
    assert [(r["item_id"], r["title"], r["issuer"], tuple(r["pdf_pages"]), r["body"]) for r in got] == [
        ("g#고시1", "가나 고시(일부)", "도로청", (3, 3), "가나 고시(일부) 시작"), ("g#공고2-1", "다라 공고", "하천청", (3, 4), "가나 고시(일부) 시작\n이어서 다라 공고"), ("g#공고3", "마바 공고", "산림청", (5, 6), "마바 공고\n끝"),
    ]
    assert [r["body_chars"] for r in got] == [len(r["body"]) for r in got]
    assert gazette.targets(spark.createDataFrame([(f"i{k}", "고시" if k % 3 else "공고", 400 - 150 * (k == 5)) for k in range(9)], "item_id string, kind string, body_chars int"), 4).groupBy("kind").count().collect().__len__() == 2


def test_items_of_issues_with_many_pages(spark):
    toc = "○ 도로청 고시제1호(가나 고시)·····1\n○ 하천청 공고제2호(다라 공고)·····9999\n○ 산림청 공고제3호(마바 공고)·····10000"
    pages = [("g", 2, toc), ("g", 3, "가나 고시"), ("g", 10001, "다라 공고"), ("g", 10002, "마바 공고")]
    got = gazette.items(spark.createDataFrame(pages, "source string, page_no int, text string")).orderBy("seq").collect()
    assert [(r["no"], tuple(r["pdf_pages"]), r["body"]) for r in got] == [("1", (3, 10000), "가나 고시"), ("2", (10001, 10001), "다라 공고"), ("3", (10002, 10002), "마바 공고")]


@pytest.mark.parametrize("with_vectors", [False, True])
def test_search_report(spark, with_vectors):
    words = ["도로", "하천", "산림", "공원"]
    found = spark.createDataFrame([(f"g#{i}", "고시" if i < 2 else "공고", "g", f"{w} 관리 " * 60) for i, w in enumerate(words)], "item_id string, kind string, source string, body string")
    queries = spark.createDataFrame([(f"g#{i}", w, [float(j == i) for j in range(4)]) for i, w in enumerate(words[:3])], "query_id string, query string, embedding array<double>")
    embedded = spark.createDataFrame([(f"g#{i}", [float(j == (i + 1) % 4) for j in range(4)]) for i in range(4)], "doc_id string, embedding array<double>")
    got = {r["retriever"]: (r["cases"], r["self_at_1"]) for r in gazette.search_report(found, queries, embedded if with_vectors else None).collect()}
    assert got["bm25"] == (3, 1.0) and set(got) == ({"bm25", "vector", "hybrid"} if with_vectors else {"bm25"})
    if with_vectors:
        assert got["vector"] == (3, 0.0)


def test_amounts_are_read_once_for_a_row(spark):
    from docketry.operators import predict
    from docketry.plans import flows

    docs = spark.createDataFrame([(i, "1", f"2020-01-0{i}", str(i), "가 나 점검", f"금 {i}00,000원") for i in (1, 2, 3)], "doc_id long, org string, date string, doc_no string, title string, body string")
    cells = spark.createDataFrame([(i, "기안", 0, "AF", "n1") for i in (1, 2, 3)], "doc_id long, role string, pos int, title string, name string")
    plan = predict.layered(docs, cells, flows._layered_bundles(spark))._jdf.queryExecution().optimizedPlan()
    told = plan.toString().split("\n")
    assert any("regexp_extract" in x and "bundle" not in x for x in told)  # in the row, before it meets the rules
    assert not any("regexp_extract" in x and "bundle" in x for x in told)


def test_every_title_is_searched(spark, tmp_path, monkeypatch):
    from docketry.operators import retrieval
    from docketry.plans import flows

    rows = [(f"Brand#{i % 2}", i, i % 7 + 1, f"green part {i}") for i in range(101, 141)]
    spark.createDataFrame(rows, "p_brand string, p_partkey long, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    whole = [tuple(r) for r in flows.gazette_search(spark, str(tmp_path)).collect()]
    assert [r[:2] for r in whole] == [("bm25", 40)]
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 15)  # several blocks
    assert [tuple(r) for r in flows.gazette_search(spark, str(tmp_path)).collect()] == whole


def test_overlap_of_question_and_title(spark):
    row = spark.createDataFrame([("도로 언제 막나", "도로 통제 공고"), ("x", "")], "q string, t string")
    assert [round(r[0], 3) for r in row.select(gazette.question_overlap(F.col("q"), F.col("t"))).collect()] == [0.333, 0.0]


def test_cells_of_pages_of_several_regions_in_one_pass(spark):
    """Many small pages, of all regions, are one step in Python; what a page says doesn't depend on those beside it."""
    titles = [("b", "bottom", [(2, 200.0, 98.0, "기", 190.0), (1, 200.0, 80.0, "출입국관리서", 190.0), (3, 260.0, 99.0, "홍길동", 250.0)]), ("t", "top", [(1, 50.0, 10.0, "과장", 40.0), (2, 52.0, 30.0, "이영희", 42.0)]), ("o", "override", [(1, 50.0, 10.0, "과장", 40.0), (2, 20.0, 30.0, "김철수", 10.0)]), ("n", "top", [(1, 1.0, 1.0, None, 1.0)])]
    rows = [(f"{page}{i}", kind, *w) for page, kind, words in titles for i in range(30) for w in words]
    words = spark.createDataFrame(rows, "doc_id string, kind string, word_id int, xc double, y double, text string, xl double")
    made = layout.approval_cells(words, F.col("kind"))
    assert {(r["doc_id"][0], r["ord"], r["role"], r["title"], r["name"]) for r in made.collect()} == {("b", 0, "기안", "출입국관리서기", "홍길동"), ("t", 0, "기안", "과장", "이영희"), ("o", 0, "기안", "과장", "김철수")} and made.count() == 90
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") >= 1


def test_votes_in_a_row_are_those_by_place(spark):
    """Five references in a row vote as vote_by_place() does among the documents of an organisation, ties and empty lines included."""
    docs = spark.createDataFrame([(i, i // 6, f"2024-01-{i % 6 // 2 + 1:02}", i) for i in range(60)], "doc_id int, org int, date string, doc_no int")
    cells = spark.createDataFrame([(i, role, p, "가나다"[(i * 7 + p) % 3], f"n{(i * 5 + p) % 2}") for i in range(60) for role, n in (("기안", 1), ("검토", i * i % 4), ("결재", i % 2)) for p in range(n)], "doc_id int, role string, pos int, title string, name string")
    packed = cells.groupBy("doc_id").agg(F.collect_list(F.struct("role", "pos", "title", "name")).alias("c"))
    refs = docs.join(packed, "doc_id", "left").select(F.col("doc_id").alias("ref"), "org", F.struct(F.struct("date", "doc_no").alias("r"), F.coalesce("c", F.array().cast(dict(packed.dtypes)["c"])).alias("cells")).alias("x"))
    met = docs.select("doc_id", "org").join(refs, "org").filter("doc_id <> ref").groupBy("doc_id").agg(F.collect_list("x").alias("refs"))
    got = met.select("doc_id", F.explode(predict.votes_of("refs")).alias("c")).select("doc_id", "c.*")
    assert got.count() > 60 and sorted(map(tuple, got.collect())) == sorted(map(tuple, predict.vote_by_place(docs, cells).collect()))


def _lines(spark, n=120, of=7):
    docs = spark.createDataFrame([(i, None if i == 5 else str(i % of), f"2024-01-{i % 9 // 3 + 1:02}", i, "가나 점검", "금 1,000원") for i in range(n)], "doc_id long, org string, date string, doc_no long, title string, body string")
    cells = spark.createDataFrame([(i, role, p, "가나다"[(i * 7 + p) % 3], f"n{(i * 5 + p) % 4}") for i in range(n) for role, k in (("기안", 1), ("검토", i * i % 4), ("결재", i % 2)) for p in range(k)], CELLS.replace("int", "long", 1))
    return docs, cells


def test_large_organisations_vote_as_small_ones(spark, monkeypatch):
    """partial tables of large organisations say what one task says of a small one, and a document's cells are shuffled with it once."""
    docs, cells = _lines(spark)
    small = sorted(map(tuple, predict.vote_by_place(docs, cells).collect()))
    monkeypatch.setattr(predict, "HOT", 17)
    large = predict.vote_by_place(docs, cells)
    assert len(small) > 100 and sorted(map(tuple, large.collect())) == small
    monkeypatch.setattr(predict, "HOT", 3)
    large = predict.vote_by_place(docs, cells)
    assert sorted(map(tuple, large.collect())) == small
    monkeypatch.undo()
    plan = predict.vote_by_place(docs, cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(org") == 2  # the same one, which Spark makes once


def test_leave_one_out_in_a_row(spark, monkeypatch):
    """scores within a document's row are those of approval_match(); other predictors still come in by document."""
    docs, cells = _lines(spark)
    cells = cells.withColumn("name", F.when(F.col("doc_id") % 4 == 0, "?").when(F.col("doc_id") % 9 == 1, "가́").otherwise(F.col("name"))).filter("doc_id % 11 > 0")
    monkeypatch.setitem(predict.PREDICTORS, "own", lambda docs, cells: predict.copy_latest(docs, cells).withColumn("title", F.lit("가")))
    names = ("baseline_copy", "baseline_vote", "own")
    got = {(r["predictor"], r["doc_id"]): tuple(r)[3:] for r in predict.leave_one_out(docs, cells, names).collect()}
    kept = docs.filter("org is not null")
    for name in names:
        want = predict.evaluate.approval_match(kept, cells, predict.PREDICTORS[name](kept, cells))
        assert {r["doc_id"]: tuple(r)[1:] for r in want.collect()} == {i: row for (n, i), row in got.items() if n == name}
    assert "FullOuter" not in predict.leave_one_out(docs, cells)._jdf.queryExecution().executedPlan().toString()


def test_layered_writes_no_tables(spark, monkeypatch):
    """names are found in the document's row; nothing is written to the shared folder, whatever an organisation's size."""
    docs, cells = _lines(spark)
    ruled = spark.createDataFrame([("1", "manual", 1, None, "가", 1, [], [(1, None, None, 200_000, "나", "small")], "다", False, [], None, [])], predict.bundles.SCHEMA)
    monkeypatch.setattr(predict, "stable", None)
    small = sorted(map(tuple, predict.layered(docs, cells, ruled).collect()))
    monkeypatch.setattr(predict, "HOT", 3)
    assert len(small) > 100 and "vote" in {r[-1] for r in small}
    assert sorted(map(tuple, predict.layered(docs, cells, ruled).collect())) == small
