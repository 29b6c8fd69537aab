"""Requests from end to end, bundles of rules, and chains of slots, against literals worked by hand."""

from pyspark.sql import functions as F

from docketry.functions import extract
from docketry.operators import bundles, requests
from docketry.plans import flows

REQUEST = requests.REQUEST


def row(req, **given):
    return (req, *[given.get(c) for c in ("dept", "team", "user_name", "org", "user_title", "title", "body", "attachments", "day")])


def handled(spark, rows, **more):
    people = spark.createDataFrame(flows.PEOPLE, "name string, org string, title string")
    bundled = spark.createDataFrame(flows.BUNDLES, bundles.SCHEMA)
    return requests.handle(spark.createDataFrame(rows, REQUEST), flows._published(spark), bundled, people, **more)


def test_official_lines(spark):
    rows = [
        row(1, dept="행정과", team="총무팀", title="청사 공사 품의", body="도급액 70,000원", day="1998-05-01"),
        row(2, dept="행정과", team="민원팀", title="물품 구매", body="도급액 900,000원", day="1998-05-01"),
        row(3, dept="감사담당관", user_title="감사담당관", title="물품 품의", body="없음", day="1996-06-01"),
        row(4, dept="도로과", user_title="도로팀장", team="도로팀", title="도로 관리 보고", day="1995-01-01"),
        row(5, dept="없는과", title="x"),
        row(6, dept="도로과", title="자전거 길 구매 계획", attachments=["하천 정비 하천"], day="1995-01-01"),
    ]
    out = {r["req"]: r for r in handled(spark, rows).collect()}
    line = lambda i: [(c["role"], c["title"], c["slot"]) for c in out[i]["cells"]]
    needs = lambda i: [(n["what"], n["why"]) for n in out[i]["needs"]]
    # up to the section head; the lead as the chart says
    assert out[1]["branch"] == "amount_bracket" and out[1]["final"]["level"] == 2 and out[1]["final"]["row"] == "가.공사 15만원 이하"
    assert line(1) == [("기안", "주무관", "기안"), ("검토", "총무 팀장", "팀장"), ("결재", "행정과장", "과장")]
    assert needs(1) == [("상향 결재", "과장"), ("초안", "군청")]
    # the bureau's head also stands in for the deputy: one cell; a team without a lead gets its name as a title, which the chart lacks
    assert out[2]["final"]["level"] == 5
    assert line(2) == [("기안", "주무관", "기안"), ("검토", "민원팀장", "팀장"), ("검토", "행정과장", "과장"), ("검토", "행정안전국장", "국장:행정안전국+부군수"), ("결재", "군수", "군수")]
    assert needs(2) == [("팀", "민원팀장"), ("초안", "군청")]
    # no amount: up to the top; the department skips the deputy, and the head drafts; an acting deputy only signs
    assert out[3]["final"]["level"] is None and line(3) == [("기안", "감사담당관", "기안"), ("결재", "군수", "군수")]
    assert needs(3) == [("금액", "그외"), ("직무대리", "군수 → 부군수"), ("초안", "군청")]
    # a drafter above the lowest level has no lead before them
    assert out[4]["branch"] == "row_search" and line(4) == [("기안", "도로팀장", "기안"), ("결재", "도로과장", "과장")]
    assert needs(4) == [("전결 사무", "[도로과] 도로 관리"), ("상향 결재", "과장"), ("초안", "군청")] and out[4]["candidates"][0] == 0
    assert needs(5) == [("부서", "없는과")] and line(5) == [] and out[5]["branch"] == "unknown_dept"
    # attachments count as the body's end
    assert out[6]["final"]["row"] == "[도로과] 하천 정비" and line(6)[-1] == ("결재", "건설도시국장", "국장:건설도시국")


def test_identified_and_unknown_people(spark):
    rows = [
        row(1, user_name="김하나", title="도서 계약", body="금 50,000원 공연"), row(2, user_name="이두리", title="x"), row(3, user_name="없음", title="x"), row(4),
        row(5, org="F", user_title="팀장", title="결과"), row(6, org="Z", user_title="팀장", title="결과"), row(7, user_name="김하나", title="공연 전산 도서"),
    ]
    missing = spark.createDataFrame([(1, "산출", "적는다"), (2, "산출", "적는다")], "req bigint, label string, hint string")
    rejected = spark.createDataFrame([(5,), (5,)], "req bigint")
    out = {r["req"]: r for r in handled(spark, rows, missing=missing, rejected=rejected).collect()}
    line = lambda i: [(c["role"], c["title"], c["evidence"]) for c in out[i]["cells"]]
    needs = lambda i: [(n["what"], n["why"]) for n in out[i]["needs"]]
    assert tuple(out[1]["user"]) == ("O", "주무관", "roster") and out[1]["work_type"] == "계약·검사"
    assert line(1) == [("기안", "주무관", "input"), ("검토", "자료팀장", "team"), ("검토", "회계팀장", "rule:extra"), ("검토", "과장", "rule:extra"), ("결재", "국장", "delegation")]
    assert needs(1) == [("최종 결재자", "induced"), ("산출", "적는다")]
    assert [out[i]["user"]["source"] for i in (2, 3, 4)] == ["ambiguous", "unknown", "unknown"]
    assert needs(2) == [("기안자", "ambiguous")] and line(3) == [] and out[4]["branch"] == "unknown_user"
    assert line(5) == [("기안", "팀장", "input"), ("결재", "관장", "delegation")] and needs(5) == [("요약", "ungrounded")]
    assert line(6) == [] and needs(6) == [("전결규정", "Z")]
    # equal points: the first team; cooperation by its trigger; the fallback
    assert line(7) == [("기안", "주무관", "input"), ("검토", "운영팀장", "team"), ("검토", "과장", "rule:extra"), ("결재", "관장", "fallback"), ("협조", "전산팀장", "rule:cooperation")]


def test_requests_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [row(i, dept=["행정과", "없는과", None][i % 3], title=["도로 관리", "물품 품의"][i % 2], user_name="김하나", day="1998-05-01") for i in range(60)]
    source = spark.createDataFrame(rows, REQUEST).mapInPandas(count, REQUEST)
    people = spark.createDataFrame(flows.PEOPLE, "name string, org string, title string")
    out = requests.handle(source, flows._published(spark), spark.createDataFrame(flows.BUNDLES, bundles.SCHEMA), people)
    assert out.count() == 60 and requests.reasons(out).count() > 60 and requests.lines(out).count() > 60
    assert seen.value == 60
    assert requests.handle(source.limit(0), flows._published(spark), spark.createDataFrame([], bundles.SCHEMA), people).count() == 0


def test_names_and_masks(spark):
    out = handled(spark, [row(1, user_name="김하나", title="김하나 도서", body="x")])
    roster = spark.createDataFrame([("O", "자료팀장", "박세찌")], "org string, title string, name string")
    assert [(r["title"], r["name"]) for r in requests.lines(out, roster).orderBy("ord").collect()][1] == ("자료팀장", "박세찌")
    renamed = out.withColumn("needs", F.array(F.struct(F.lit("요약").alias("what"), F.lit("박 세찌 확인").alias("why"))))
    assert "○○○ 확인" in requests.public(renamed, ["박세찌"]).first()["public"]


def test_lookups_of_a_bundle(spark):
    rules = [(2, ["a"], None, 10, "x", "n2"), (1, None, 20, None, "y", "n1"), (3, ["*"], 12, 15, "z", "n3")]
    data = spark.createDataFrame([(k, a, rules) for k, a in (("a", 10), ("a", 11), ("b", 20), ("b", 10), ("b", None), ("b", 15))], f"k string, a bigint, rules {bundles.RULES}")
    got = [tuple(r[0]) for r in data.select(bundles.final(bundles.by_priority(F.col("rules")), F.lit(""), F.lit("top"), F.col("k"), F.col("a"))).collect()]
    assert got == [("x", True, "n2"), ("top", False, None), ("y", True, "n1"), ("top", False, None), ("top", False, None), ("z", True, "n3")]
    teams = [("one", ["도서", "책"], 2), ("two", ["공연"], 5), ("three", [], 5)]
    texts = [("도 서 축제", ""), ("공연", "도서 책"), ("축제", "공 연"), ("도서 공연", ""), ("없음", "")]
    data = spark.createDataFrame([(t, b, teams) for t, b in texts], f"t string, b string, teams {bundles.TEAMS}")
    got = [tuple(r[0]) for r in data.select(bundles.route(F.col("teams"), F.col("t"), F.col("b"))).collect()]
    assert got == [("one", "one", False, "two"), ("two", "two", False, "two"), ("two", "two", False, "two"), (None, "one", True, "two"), (None, None, True, "two")]


def test_induced_bundle(spark):
    docs = [(i, "A", f"2024-01-0{i}", str(i), t, b) for i, t, b in ((1, "도서 점검", "금 1,000원"), (2, "도서 정리 임금 지출", ""), (3, "공연 점검", "금 9,000원"), (4, "공연 무대", ""))] + [(9, "B", "2024-01-01", "9", "행사", "")]
    cells = []
    for i, lead, names in ((1, "자료팀장", "ㄱ"), (2, "자료팀장", ""), (3, "운영팀장", ""), (4, "운영팀장", "-")):
        cells += [(i, "기안", 0, "주무관", "ㄴ", None), (i, "검토", 0, lead, "ㄷ", None), (i, "결재", 0, "관장", names, None)]
    cells += [(2, "검토", 1, "회계팀장", "ㄹ", None), (3, "협조", 0, "전산팀장", "ㅁ", "대결"), (9, "기안", 0, "주사", "ㅂ", None)]
    got = bundles.induce(spark.createDataFrame(docs, "doc_id int, org string, date string, doc_no string, title string, body string"), spark.createDataFrame(cells, "doc_id int, role string, pos int, title string, name string, note string"))
    assert [f"{n} {t}" for n, t in got.dtypes] == [f"{n} {t}" for n, t in spark.createDataFrame([], bundles.SCHEMA).dtypes]
    out = {r["org"]: r for r in got.collect()}
    a = out["A"]
    assert (a["observed_docs"], a["draft"], a["approve"], a["review_slots"], a["name_empty"], a["fallback"]) == (4, "주무관", "관장", 1, True, "관장")
    assert [(t["lead"], t["keywords"], t["observed_docs"]) for t in a["teams"]] == [("운영팀장", ["공연", "무대"], 2), ("자료팀장", ["도서", "임금", "정리", "지출"], 2)]
    assert [tuple(r) for r in a["rules"]] == [(1, None, None, None, "관장", "observed 4, amounts 1000~9000")]
    assert [(x["work_types"], x["title"]) for x in a["extra_review"]] == [(["회계지출"], "회계팀장")]
    assert [(c["titles"], c["work_types"], c["triggers"]) for c in a["cooperation"]] == [(["전산팀장"], ["결과보고"], [])]
    assert [tuple(x) for x in a["acting"]] == [("관장", "전산팀장", 1)]
    assert out["B"]["teams"] == [] and out["B"]["rules"] == [] and out["B"]["name_empty"] is False


def test_labelled_amounts_as_the_text_stands(spark):
    texts = {
        "도급액 5,000원": (5000, "도급액"), "기도급액 3,000원\n도급액 5,000원": (5000, "도급액"), "기 도급액 3,000원": (None, None), "기\n도급액 5,000원": (None, None), "기 도급액 도급액 5,000원": (None, None),
        "도급액 기도급액 5,000원": (5000, "도급액"), "사업비 7천원\n도 급 액 12,000천원": (12_000_000, "도급액"), "(단위: 천원)\n도 급 액(원)\n설명\n835,174원": (835_174_000, "도급액(표)"), "": (None, None),
        "사업비\n1\n2\n3\n4\n5\n6\n12,345": (None, None), "도급액\n예산\n사업비\n12,345": (12_345, "도급액(표)"),
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["amount"], r["label"]) for r in extract.labelled_amount(docs, ["도급액", "사업비"]).collect()}
    assert got == dict(enumerate(texts.values()))


def test_rule_tables_of_any_size(spark, monkeypatch):
    from docketry.operators import rules

    bands = spark.createDataFrame([(i, float(10 * i) if i else None, float(10 * i + 15), f"b{i}") for i in range(30)], "rid int, amount_min double, amount_max double, level string")
    rows = spark.createDataFrame([(i, i * 7.5) for i in range(50)] + [(99, None)], "k int, amount double")
    want = sorted((r["k"], r["band"] and r["band"]["level"]) for r in rules.band(rows, bands, "amount").collect())
    assert want[0] == (0, "b0") and want[-1] == (99, None) and want[4] == (4, "b2")
    monkeypatch.setattr(rules, "MOST_RULES", 5)
    got = rules.band(rows, bands, "amount")
    assert sorted((r["k"], r["band"] and r["band"]["level"]) for r in got.collect()) == want and got.columns == ["k", "amount", "band"]


def test_teams_listed_twice(spark):
    from dataclasses import replace

    twice = replace(flows._published(spark), teams=spark.createDataFrame([("도로과", 2, "도로팀", "둘째팀장"), ("도로과", 1, "도로팀", "첫째팀장"), ("도로과", 3, None, "없음팀장")], "dept string, ord int, team string, lead string"))
    rows = spark.createDataFrame([("도로과", "도로팀"), ("도로과", "하천팀"), ("없는과", "도로팀")], "dept string, team string")
    got = requests.with_department(rows, twice).select("dept", "team", requests.team_title(F.col("team"), F.col("_d.by_team")).alias("lead"), F.array_contains("_d.leads", "없음팀장").alias("known")).collect()
    assert sorted((r["dept"], r["team"], r["lead"], r["known"]) for r in got if r["dept"] == "도로과") == [("도로과", "도로팀", "첫째팀장", True), ("도로과", "하천팀", "하천팀장", True)]
