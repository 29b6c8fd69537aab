"""Literal cases for text, extraction and masking expressions."""

from pyspark.sql import functions as F

from docketry.functions import extract, masking, text


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("v")).first()["v"]


def test_normalise(spark):
    assert one(spark, text.normalize, " “가”  【나】·•다 ") == '"가" [나]··다'
    assert one(spark, lambda c: text.normalize(c, no_leader=True), "제목 ······· 3") == "제목 3"
    assert one(spark, text.normalize, "한") == "한"
    assert one(spark, text.normalize_field, "(총 무.과)") == "총무과"
    assert one(spark, text.normalize_token, "과 장·(대결)") == "과장대결"
    assert one(spark, text.strip_spaces, "a　b c") == "abc"


def test_tokens(spark):
    assert one(spark, text.tokenize, "가나 다") == ["가나", "다", "가나", "나다"]
    assert one(spark, text.tokenize, "a") == ["a"]
    assert one(spark, text.tokenize, "  ") == []
    assert one(spark, lambda c: text.title_words(c), "환경 보전에 관한 규정") == ["환경", "보전에"]
    assert one(spark, text.topic_words, "도서관 7월 운영 계획 홍길동 의원 방문") == ["도서관", "의원"]


def test_page_types(spark):
    assert one(spark, text.page_type, "가 ············ 3") == "toc"
    assert one(spark, text.page_type, "\n".join(["짧다"] * 12)) == "table"
    assert one(spark, text.page_type, "긴 문장 하나가 있는 본문입니다. " * 3) == "body_1col"
    assert one(spark, text.leader_ratio, "") == 0.0
    assert tuple(one(spark, text.short_line_ratio, "")) == (0.0, 0)


def test_ordered_rules(spark):
    assert one(spark, text.doc_type, "지출 계획") == "지출"
    assert one(spark, text.doc_type, "무관") == "기타"
    assert one(spark, text.work_type, "도서 구입 지출") == "회계지출"
    assert [one(spark, text.title_level, t) for t in ("부군수", "군수", "사업소장", "보건소장", "주무관")] == [4, 5, 2, 1, 0]


def test_amounts(spark):
    assert one(spark, extract.amount, "총액 3,000원, 금 1,250,000 원") == 1_250_000
    assert one(spark, extract.amount, "총액 3,000원") == 3_000
    assert one(spark, extract.amount, "없음") is None
    assert tuple(one(spark, extract.amount_range, "5천만원 초과 4억원 이하")) == (50_000_000, 400_000_000)
    assert tuple(one(spark, extract.amount_range, "제한 없음")) == (None, None)


def test_labelled_amounts(spark):
    docs = spark.createDataFrame([(1, "도 급 액: 5,000천원"), (2, "기도급액 9,000원 도급액 7,000원"), (3, "단위:천원\n도 급 액\n항목\n835,174"), (4, "없음")], "doc_id int, text string")
    got = {r["doc_id"]: (r["amount"], r["label"]) for r in extract.labelled_amount(docs, ["도급액", "사업비"]).collect()}
    assert got == {1: (5_000_000, "도급액"), 2: (7_000, "도급액"), 3: (835_174_000, "도급액(표)"), 4: (None, None)}


def test_dates_and_numbers(spark):
    assert one(spark, extract.earliest_date, "2026. 9. 7. 시행 2026-08-31") == "2026-08-31"
    assert one(spark, extract.earliest_date, "없음") == ""
    assert one(spark, extract.doc_no, "총무과 - 0123") == "총무과-123"
    assert one(spark, lambda c: extract.dept(extract.doc_no(c)), "총무과-7") == "총무과"
    assert one(spark, extract.subject, "제 목: 계획 보고\n다음") == "계획 보고"
    assert one(spark, extract.issuer, "법 무 부 장 관") == "법무부"
    assert one(spark, extract.vendors, "주식회사 한빛과 계약") == ["한빛"]
    assert one(spark, extract.check_tokens, "2026. 9. 7. 금 1,234원 5") == ["202697", "1234"]
    assert one(spark, extract.lenient_int, "제 12 호") == 12


def test_first_on_page(spark):
    pages = spark.createDataFrame([("d", 2, "5,000원"), ("d", 1, "7,000원 5,000원")], "doc_id string, page_no int, text string")
    got = {(r["value"], r["page"]) for r in extract.first_on_page(pages, extract.all_amounts(F.col("text"))).collect()}
    assert got == {("7,000", 1), ("5,000", 1)}


def test_contents_lines(spark):
    body = "○환경부고시제2026-1호(시행 규칙(안) 고시) ······ 12\n○쪽 없음\n○총리령 제7호(가) …… 3\n"
    rows = extract.toc_entries(spark.createDataFrame([("g", body)], "source string, text string"), ["source"]).collect()
    assert [(r["kind"], r["no"], r["title"], r["page"], r["issuer"]) for r in rows][0] == ("고시", "2026-1", "시행 규칙(안) 고시", 12, "환경부")


def test_masks(spark):
    assert one(spark, lambda c: masking.mask_names(c, ["김철", "김철수", "가"]), "김 철 수와 김철 가") == "○○○와 ○○○ 가"
    assert tuple(one(spark, lambda c: masking.replace_names(c, {"김철수": "과장", "이영희": ""}), "과장 김철수, 이영희")) == ("과장 , ○○○", 2)
    assert one(spark, masking.first_json_object, 'x {bad {"a": 1} {"b": 2}') == '{"a": 1}'
    df = spark.createDataFrame([("총무과-12 「지방법」 김철수", "총무과-12")], "t string, s string")
    got = df.select(masking.sanitize(F.col("t"), F.col("s"), F.lit(""), ["김철수"]).alias("v")).first()["v"]
    assert tuple(got) == ("총무과-12 [근거 확인 필요] ○○○", 0, 1, 0, 1)
