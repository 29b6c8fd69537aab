"""Queries of the extractors, rules, predictors and scores, with their SQL equivalents.

Texts are built from the tables' numbers, so that SQL can state what has to be found in them by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import extract, masking, text
from docketry.operators import drafts, evaluate, history, layout, predict, retrieval, rules
from docketry.plans.catalogue import _rows, _t, query


def _orders(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("cust"), F.floor("o_totalprice").cast("long").alias("amount"), F.col("o_orderpriority").alias("org"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("day"))


_O = "SELECT o_orderkey AS doc_id, o_custkey AS cust, CAST(floor(o_totalprice) AS BIGINT) AS amount, o_orderpriority AS org, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders"


def _said(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _n(c: str = "doc_id") -> Column:
    return F.col(c).cast("string")


# ---------------------------------------------------------------- predictors
_CELLS = """
l AS (SELECT l_orderkey AS doc_id, l_returnflag || l_linestatus AS title, 'n' || CAST(l_suppkey % 4 AS VARCHAR) AS name,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
cells AS (SELECT doc_id, CASE WHEN i = 1 THEN '기안' WHEN i = m THEN '결재' ELSE '검토' END AS role, CAST(CASE WHEN i = 1 OR i = m THEN 0 ELSE i - 2 END AS INTEGER) AS pos, title, name FROM l),
docs AS (SELECT o_orderkey AS doc_id, o_custkey AS org, o_orderdate AS date FROM orders)
"""


def _docs_cells(spark, d, *more: Column) -> tuple[DataFrame, DataFrame]:
    # the key has its name before the windows, so that Spark knows that what they leave lies by doc_id
    w, named = Window.partitionBy("doc_id"), _t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    i, m = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")), F.count("*").over(w)
    lines = named.select("doc_id", F.concat("l_returnflag", "l_linestatus").alias("title"), F.concat(F.lit("n"), (F.col("l_suppkey") % 4).cast("string")).alias("name"), i.alias("i"), m.alias("m"))
    role = F.when(F.col("i") == 1, "기안").when(F.col("i") == F.col("m"), "결재").otherwise("검토")
    pos = F.when((F.col("i") == 1) | (F.col("i") == F.col("m")), 0).otherwise(F.col("i") - 2)
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("org"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("doc_no"), *more)
    return docs, lines.select("doc_id", role.alias("role"), pos.cast("int").alias("pos"), "title", "name")


_VOTED = f"""{_CELLS},
pairs AS (SELECT a.doc_id AS target, b.doc_id, b.date FROM docs a JOIN docs b ON a.org = b.org AND a.doc_id <> b.doc_id),
roles AS (SELECT unnest(['기안', '검토', '결재', '협조']) AS role), counts AS (SELECT doc_id, role, count(*) AS n FROM cells GROUP BY 1, 2),
sizes AS (SELECT target, p.doc_id, date, roles.role, coalesce(n, 0) AS n FROM pairs p CROSS JOIN roles LEFT JOIN counts c ON c.doc_id = p.doc_id AND c.role = roles.role),
usual AS (SELECT target, role, n, row_number() OVER (PARTITION BY target, role ORDER BY count(*) DESC, max(struct_pack(d := date, k := doc_id)) DESC) AS z FROM sizes GROUP BY 1, 2, 3),
seen AS (SELECT target, date, c.* FROM pairs p JOIN cells c USING (doc_id) JOIN usual u USING (target, role) WHERE u.z = 1 AND pos < u.n),
titles AS (SELECT target, role, pos, title, row_number() OVER (PARTITION BY target, role, pos ORDER BY count(*) DESC, max(struct_pack(d := date, k := doc_id)) DESC) AS z FROM seen GROUP BY 1, 2, 3, 4),
names AS (SELECT target, role, pos, name, row_number() OVER (PARTITION BY target, role, pos ORDER BY count(*) DESC, max(struct_pack(d := date, k := doc_id)) DESC) AS z FROM seen GROUP BY 1, 2, 3, 4),
voted AS (SELECT t.target AS doc_id, t.role, t.pos, t.title, n.name FROM titles t JOIN names n USING (target, role, pos) WHERE t.z = 1 AND n.z = 1),
latest AS (SELECT target, doc_id, row_number() OVER (PARTITION BY target ORDER BY date DESC, doc_id DESC) AS z FROM pairs),
copied AS (SELECT target AS doc_id, role, pos, title, name FROM latest JOIN cells USING (doc_id) WHERE z = 1)"""


@query(f"WITH {_VOTED} SELECT * FROM voted")
def vote_by_place(spark, d):
    return predict.vote_by_place(*_docs_cells(spark, d))


@query(f"WITH {_VOTED} SELECT * FROM copied")
def copy_cells(spark, d):
    return predict.copy_latest(*_docs_cells(spark, d))


@query(f"""
WITH {_VOTED}, kept AS (SELECT doc_id, org FROM docs WHERE org IN (SELECT org FROM docs GROUP BY 1 HAVING count(*) >= 2)),
guess AS (SELECT 'baseline_vote' AS predictor, * FROM voted UNION ALL SELECT 'baseline_copy', * FROM copied), who AS (SELECT unnest(['baseline_copy', 'baseline_vote']) AS predictor),
j AS (SELECT w.predictor, c.doc_id, coalesce(g.title = c.title, false) AS t, coalesce(g.name = c.name, false) AS n FROM cells c JOIN kept USING (doc_id) CROSS JOIN who w LEFT JOIN guess g ON g.predictor = w.predictor AND g.doc_id = c.doc_id AND g.role = c.role AND g.pos = c.pos),
s AS (SELECT predictor, doc_id, count(*) FILTER (WHERE t) / count(*) AS tm, count(*) FILTER (WHERE n) / count(*) AS nm FROM j GROUP BY 1, 2),
sizes2 AS (SELECT w.predictor, kept.doc_id, roles.role, coalesce(c.n, 0) AS a, (SELECT count(*) FROM guess g WHERE g.predictor = w.predictor AND g.doc_id = kept.doc_id AND g.role = roles.role) AS b FROM kept CROSS JOIN who w CROSS JOIN roles LEFT JOIN counts c ON c.doc_id = kept.doc_id AND c.role = roles.role),
m AS (SELECT predictor, doc_id, count(*) FILTER (WHERE a = b) / 4 AS cm FROM sizes2 GROUP BY 1, 2),
x AS (SELECT m.predictor, m.doc_id, org % 5 AS grp, coalesce(tm, 0) AS tm, coalesce(nm, 0) AS nm, cm FROM m JOIN kept USING (doc_id) LEFT JOIN s USING (predictor, doc_id))
SELECT predictor, coalesce(grp, -1) AS grp, count(*) AS cases, round(avg(tm), 4) AS title_match_mean, round(avg(nm), 4) AS name_match_mean, round(avg(cm), 4) AS count_match_mean, count(*) FILTER (WHERE tm = 1) AS title_perfect FROM x GROUP BY GROUPING SETS ((predictor), (predictor, grp))
""")
def leave_one_out_scores(spark, d):
    docs, cells = _docs_cells(spark, d)
    cases = predict.leave_one_out(docs, cells).withColumn("grp", F.col("org") % 5)
    return evaluate.case_summaries(cases, "predictor", "grp").withColumn("grp", F.coalesce("grp", F.lit(-1).cast("long")))


@query(f"""
WITH {_CELLS}, p AS (SELECT doc_id, role, pos, title, CASE WHEN doc_id % 3 = 0 THEN 'n9' ELSE name END AS name FROM cells WHERE doc_id % 7 <> 0 OR pos = 0), g AS (SELECT doc_id, role, pos, title AS gt, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE name END AS gn FROM cells WHERE doc_id % 11 <> 0)
SELECT p.*, coalesce(title = gt, false) AS title_ok, CASE WHEN gn IS NULL THEN 'false' WHEN gn = '?' THEN 'open' ELSE CAST(name = gn AS VARCHAR) END AS name_ok FROM p LEFT JOIN g USING (doc_id, role, pos)
""")
def cell_outcomes(spark, d):
    _, cells = _docs_cells(spark, d)
    pred = cells.filter("doc_id % 7 <> 0 or pos = 0").withColumn("name", F.when(F.col("doc_id") % 3 == 0, "n9").otherwise(F.col("name")))
    gold = cells.filter("doc_id % 11 <> 0").withColumn("name", F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.col("name")))
    return evaluate.cell_outcomes(gold, pred).select("doc_id", "role", "pos", "title", "name", "title_ok", F.coalesce(F.col("name_ok").cast("string"), F.lit("open")).alias("name_ok"))


@query(f"""
WITH {_CELLS}, n AS (SELECT o.doc_id, org, date, coalesce(r.n, 0) AS n FROM docs o LEFT JOIN (SELECT doc_id, count(*) AS n FROM cells WHERE role = '검토' GROUP BY 1) r USING (doc_id)),
f AS (SELECT org, arg_max(v, struct_pack(c := c, r := r)) AS v FROM (SELECT org, title AS v, count(*) AS c, max(struct_pack(d := date, k := doc_id)) AS r FROM cells JOIN docs USING (doc_id) WHERE role = '기안' GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT org, arg_max(v, struct_pack(c := c, r := r)) AS v FROM (SELECT org, title AS v, count(*) AS c, max(struct_pack(d := date, k := doc_id)) AS r FROM cells JOIN docs USING (doc_id) WHERE role = '결재' GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT org, arg_max(n, struct_pack(c := c, r := r)) AS n FROM (SELECT org, n, count(*) AS c, max(struct_pack(d := date, k := doc_id)) AS r FROM n GROUP BY 1, 2) GROUP BY 1)
SELECT d.org, count(*) AS observed_docs, max(f.v) AS draft, max(a.v) AS approve, max(s.n) AS review_slots, false AS name_empty FROM docs d LEFT JOIN f USING (org) LEFT JOIN a USING (org) LEFT JOIN s USING (org) GROUP BY 1
""")
def induced_chains(spark, d):
    return history.induce_chains(*_docs_cells(spark, d))


@query(f"""
WITH {_CELLS}, o AS (SELECT doc_id, org, title AS work_type FROM docs JOIN cells USING (doc_id) WHERE role = '기안'),
c AS (SELECT o.org, o.work_type, k.title FROM cells k JOIN o USING (doc_id) WHERE k.role = '검토' AND k.pos >= 2)
SELECT org, work_type, title, count(*) AS observed_docs FROM c GROUP BY 1, 2, 3
""")
def induced_extra_review(spark, d):
    docs, cells = _docs_cells(spark, d)
    typed = docs.join(cells.filter("role = '기안'").select("doc_id", F.col("title").alias("work_type")), "doc_id")
    return history.induce_extra_review(typed, cells, docs.select("org", F.lit(2).alias("review_slots")).distinct())


@query(f"""
WITH {_CELLS}, t AS (SELECT doc_id, list(title ORDER BY pos) AS titles FROM cells WHERE role = '검토' AND doc_id % 2 = 0 GROUP BY 1), w AS (SELECT doc_id, org % 10 AS org, (SELECT title FROM cells x WHERE x.doc_id = docs.doc_id AND x.role = '기안') AS work_type, list_distinct(['w' || (doc_id % 13), 'v' || (doc_id % 5)]) AS ws FROM docs),
plain AS (SELECT DISTINCT org, unnest(ws) AS x FROM w WHERE doc_id NOT IN (SELECT doc_id FROM t)), j AS (SELECT w.*, titles FROM w JOIN t USING (doc_id)),
r AS (SELECT org, titles, list_sort(list(DISTINCT work_type)) AS work_types, count(*) AS observed_docs FROM j GROUP BY 1, 2), e AS (SELECT org, titles, unnest(ws) AS x FROM j),
g AS (SELECT org, titles, list_sort(list(DISTINCT x)) AS triggers FROM e WHERE (org, x) NOT IN (SELECT org, x FROM plain) GROUP BY 1, 2)
SELECT org, array_to_string(r.titles, '+') AS titles, array_to_string(work_types, '+') AS work_types, coalesce(array_to_string(triggers, '+'), '') AS triggers, observed_docs FROM r LEFT JOIN g USING (org, titles)
""")
def induced_cooperation(spark, d):
    docs, cells = _docs_cells(spark, d)
    first = cells.filter("role = '기안'").select("doc_id", F.col("title").alias("work_type"))
    typed = docs.withColumn("org", F.col("org") % 10).join(first, "doc_id", "left").withColumn("words", F.array(F.concat(F.lit("w"), (F.col("doc_id") % 13).cast("string")), F.concat(F.lit("v"), (F.col("doc_id") % 5).cast("string"))))
    coop = cells.filter("role = '검토' and doc_id % 2 = 0").withColumn("role", F.lit("협조"))
    found = history.induce_cooperation(typed, coop)
    joined = lambda c: F.array_join(c, "+").alias(c)
    return found.select("org", joined("titles"), joined("work_types"), joined("triggers"), "observed_docs")


# ---------------------------------------------------------------- extractors
@query(f"SELECT doc_id, amount * 1000 AS amount, '도급액' AS label FROM ({_O}) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN amount ELSE -1 END, CASE WHEN doc_id % 3 = 0 THEN '사업비' END FROM ({_O}) WHERE doc_id % 2 = 1")
def labelled_amounts(spark, d):
    money = F.format_number("amount", 0)
    body = F.when(F.col("doc_id") % 2 == 0, _said("사업비 500,000원\n기 도급액 9,999원, 도 급 액: 금 ", money, "천원")).when(F.col("doc_id") % 3 == 0, _said("기도급액 7,777원 사업비 ", money, " 원")).otherwise("기 사업비 1,234원")
    return extract.labelled_amount(_orders(spark, d).select("doc_id", body.alias("text")), ["도급액", "사업비"]).na.fill(-1, ["amount"])


@query(f"SELECT doc_id, (amount + 10000) * 1000 AS amount, '사업비(표)' AS label FROM ({_O}) WHERE doc_id % 4 <> 0")
def table_amounts(spark, d):
    money = F.format_number(F.col("amount") + 10_000, 0)
    body = F.when(F.col("doc_id") % 4 == 0, _said("사업비(계)\n가\n나\n다\n라\n마\n바\n", money)).otherwise(_said("(단위: 천원)\n구분\n\n사 업 비(계)\n비고\n", money, "\n99,999,999"))
    return extract.table_amount(_orders(spark, d).select("doc_id", body.alias("text")), ["도급액", "사업비"])


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 90 + 1) * 10000000 ELSE -1 END AS lo, CASE WHEN doc_id % 3 <> 1 THEN (doc_id % 7 + 1) * 100000000 ELSE -1 END AS hi FROM ({_O})")
def amount_ranges(spark, d):
    low, high = _said((F.col("doc_id") % 90 + 1).cast("string"), "천만원 초과"), _said((F.col("doc_id") % 7 + 1).cast("string"), ".0억원 이하")
    said = F.when(F.col("doc_id") % 3 == 0, high).when(F.col("doc_id") % 3 == 1, low).otherwise(F.concat_ws(" ", low, high))
    return _orders(spark, d).select("doc_id", extract.amount_range(said).alias("r")).select("doc_id", "r.lo", "r.hi").na.fill(-1)


@query(f"SELECT doc_id, 'ABC' || chr(CAST(65 + cust % 26 AS INTEGER)) || '상사' AS vendor FROM ({_O}) WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, '가나물산' FROM ({_O}) WHERE doc_id % 3 = 1")
def vendor_names(spark, d):
    name = _said("ABC", F.char(F.col("cust") % 26 + 65), "상사")
    body = F.when(F.col("doc_id") % 3 == 0, _said("(주) ", name, "와 계약")).when(F.col("doc_id") % 3 == 1, _said("업체명: ", name, "\n가나물산 주식회사")).otherwise("업체 없음")
    body = F.when(F.col("doc_id") % 3 == 1, _said("업체명: ", name, "\n㈜ 가나물산으로")).otherwise(body)
    return _orders(spark, d).select("doc_id", F.explode(extract.vendors(body)).alias("vendor"))


@query(f"SELECT doc_id, '총무과-' || cust AS doc_no, '총무과' AS dept, '주문 ' || doc_id || ' 처리' AS subject, '법무부' AS issuer FROM ({_O})")
def document_fields(spark, d):
    body = _said("법 무 부 장 관\n문서 총무과 - 0", _n("cust"), "\n제  목 : 주문 ", _n(), " 처리  \n끝")
    found = _orders(spark, d).select("doc_id", extract.doc_no(body).alias("doc_no"), extract.subject(body).alias("subject"), extract.issuer(body).alias("issuer"))
    return found.select("doc_id", "doc_no", extract.dept(F.col("doc_no")).alias("dept"), "subject", "issuer")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN amount || '원정' ELSE '금' || format('{{:,}}', amount + 1000) || '원' END AS amount, CASE WHEN doc_id % 2 = 0 THEN '고객 ' || cust ELSE '' END AS payee, '' AS attachments FROM ({_O})")
def attachment_fields(spark, d):
    body = F.when(F.col("doc_id") % 2 == 0, _said("지 급 액 : ", _n("amount"), "원정\n지급대상: 고객 ", _n("cust"))).otherwise(_said("총 ", F.format_number(F.col("amount") + 1000, 0), " 원 지출"))
    return _orders(spark, d).select("doc_id", *[extract.from_attachment(k, body).alias(k) for k in ("amount", "payee", "attachments")])


@query(f"SELECT doc_id, '고시' AS kind, CAST(cust AS VARCHAR) AS no, '시행 규칙(안) ' || doc_id || ' 고시' AS title, CAST(doc_id % 900 + 1 AS INTEGER) AS page, '환경부' AS issuer FROM ({_O}) WHERE doc_id % 5 <> 0")
def contents_entries(spark, d):
    page = F.when(F.col("doc_id") % 5 == 0, "쪽 없음").otherwise(_said("······ ", (F.col("doc_id") % 900 + 1).cast("string")))
    body = _said("머리말\n○환경부고시제", _n("cust"), "호(시행  규칙(안) ", _n(), " 고시) ", page, "\n맺음말")
    return extract.toc_entries(_orders(spark, d).select("doc_id", body.alias("text")), ["doc_id"]).drop("seq")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN cust ELSE -1 END AS cust, CASE WHEN doc_id % 2 = 0 THEN CAST(NULL AS VARCHAR) ELSE '없음' END AS none FROM ({_O})")
def json_objects(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, _said("생각 {틀림 {\"a\": {\"cust\": ", _n("cust"), "}} 뒤 {\"a\": 1}")).otherwise("[1, 2] {x}")
    found = _orders(spark, d).select("doc_id", masking.first_json_object(raw).alias("o"))
    return found.select("doc_id", F.coalesce(F.get_json_object("o", "$.a.cust").cast("long"), F.lit(-1)).alias("cust"), F.when(F.col("o").isNull(), "없음").alias("none"))


@query(f"SELECT doc_id, '검토' AS role, 't' || cust % 9 AS title, 'n' || doc_id % 7 AS name FROM ({_O}) WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '결재', 'last', '' FROM ({_O}) WHERE doc_id % 2 = 0")
def answered_cells(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, _said("[1] [{\"role\": \"x\"}] [{\"role\": \"모름\", \"title\": \" t", (F.col("cust") % 9).cast("string"), "\", \"name\": \"n", (F.col("doc_id") % 7).cast("string"), "\"}, {\"role\": \"결재\", \"title\": \"last\"}] [")).otherwise("없음 [1, 2, 3]")
    return _orders(spark, d).select("doc_id", F.explode(masking.cells_of_answer(raw)).alias("c")).select("doc_id", "c.role", "c.title", "c.name")


@query(f"SELECT doc_id, unnest(['요점 ' || cust, '둘']) AS text, unnest([CAST(doc_id % 9 AS INTEGER), -1]) AS page FROM ({_O})")
def key_points(spark, d):
    raw = _said('[{"text": "요점 ', _n("cust"), '", "page": ', (F.col("doc_id") % 9).cast("string"), '}, "둘", " "]')
    return _orders(spark, d).select("doc_id", F.explode(drafts.points(raw)).alias("p")).select("doc_id", F.col("p.text").alias("text"), F.coalesce("p.page", F.lit(-1)).alias("page"))


_TITLES = ["부군수", "군 수", "복지국장", "회계과장", "문화 담당관", "공원사업소장", "예산팀장", "보건소장", "주무관"]


@query(f"SELECT doc_id, ([4, 5, 3, 2, 2, 2, 1, 1, 0])[CAST(doc_id % 9 + 1 AS INTEGER)] AS level FROM ({_O})")
def title_levels(spark, d):
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("doc_id") % 9 + 1).cast("int"))
    return _orders(spark, d).select("doc_id", text.title_level(title).alias("level"))


_WORKS = ["도서 구입 계획", "준공 검사 결과", "인사위원회 개최 알림", "호봉 승급 제출", "연간 계획", "자료 제출", "출장 복명", "그 밖"]


@query(f"""SELECT doc_id, (['회계지출', '계약·검사', '회의·심의', '인사·복무', '사업계획', '대외제출·통보', '결과보고', '결과보고'])[CAST(doc_id % 8 + 1 AS INTEGER)] AS work_type,
  (['계획', '기타', '알림', '알림', '계획', '알림', '기타', '기타'])[CAST(doc_id % 8 + 1 AS INTEGER)] AS doc_type, amount FROM ({_O})""")
def work_and_document_types(spark, d):
    title = F.element_at(F.array(*[F.lit(t) for t in _WORKS]), (F.col("doc_id") % 8 + 1).cast("int"))
    found = _orders(spark, d).select("doc_id", extract.classified(title, _said("금 ", F.format_number("amount", 0), "원")).alias("c"), text.doc_type(title).alias("doc_type"))
    return found.select("doc_id", "c.work_type", "doc_type", "c.amount")


# ---------------------------------------------------------------- masks and predicates
@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '과장 , ○○○ ' ELSE '팀에서 과장 보고 ' END || cust AS text, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS replaced FROM ({_O})")
def replaced_names(spark, d):
    said = F.when(F.col("doc_id") % 2 == 0, _said("과장 김 철수, 이영희 ", _n("cust"))).otherwise(_said("팀에서 김철수 보고 ", _n("cust")))
    return _orders(spark, d).select("doc_id", masking.replace_names(said, {"김철수": "과장", "이영희": ""}).alias("r")).select("doc_id", "r.text", "r.replaced")


@query(f"""SELECT doc_id, CASE WHEN cust % 2 = 0 THEN '총무과-' || (cust + 10) ELSE '[확인 필요]' END || ' [근거 확인 필요] 「지방법」 ○○○ 다른기관' AS text, CAST(cust % 2 AS INTEGER) AS refs, 1 AS laws, 1 AS other_orgs, 1 AS names_masked FROM ({_O})""")
def sanitised(spark, d):
    number = _said("총무과-", (F.col("cust") + 10).cast("string"))
    allowed = F.when(F.col("cust") % 2 == 0, _said("붙임 ", number)).otherwise("붙임")
    made = masking.sanitize(_said(number, " 『없는법』 「지방법」 김 철수 다른기관 "), allowed, F.lit("지방법 따라"), ["김철수"], F.array(F.lit("다른기관"), F.lit("또기관")))
    return _orders(spark, d).select("doc_id", made.alias("s")).select("doc_id", "s.*")


@query(f"SELECT '{{\"doc_id\":' || doc_id || ',\"who\":\"○○○ ' || cust || '\"}}' AS public FROM ({_O})")
def public_rows(spark, d):
    return masking.masked_json(_orders(spark, d).select("doc_id", _said("홍 길동 ", _n("cust")).alias("who")), ["홍길동"], "doc_id", "who")


@query(f"SELECT doc_id, doc_id % 4 IN (0, 3) AS executes, doc_id % 3 = 0 AS contents, doc_id % 2 = 1 AS leak, doc_id % 2 = 0 AS on_topic FROM ({_O})")
def predicates(spark, d):
    title = F.element_at(F.array(F.lit("노트북 구 매"), F.lit("구매 계획 수립"), F.lit("회의 안내"), F.lit("공사 시행 계획")), (F.col("doc_id") % 4 + 1).cast("int"))
    page = F.when(F.col("doc_id") % 3 == 0, "○ 하나\n○ 둘\n○ 셋").otherwise("○ 하나 ○ 둘")
    draft = F.when(F.col("doc_id") % 2 == 1, "참고 문서 1 형식").otherwise("도서관 사업을 한다")
    return _orders(spark, d).select(
        "doc_id", rules.is_execution(title, ("공사 시행",), ("구매",), "(계획|계획수립)$").alias("executes"), extract.is_contents_page(page).alias("contents"),
        drafts.has_prompt_leak(draft, ("참고 문서",)).alias("leak"), drafts.on_topic(draft, F.lit("도서관 운영")).alias("on_topic"),
    )


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc_no' WHEN 1 THEN 'number' END AS reason FROM ({_O})")
def ungrounded_items(spark, d):
    source = _said("총무과-", (F.col("cust") + 100).cast("string"), " 금 12,345원")
    item = F.when(F.col("doc_id") % 3 == 0, "재무과-12 관련").when(F.col("doc_id") % 3 == 1, "금 98,765원").otherwise(_said("총무과-", (F.col("cust") + 100).cast("string"), "의 12345원"))
    return _orders(spark, d).select("doc_id", drafts.ungrounded_reason(item, source).alias("reason"))


# ---------------------------------------------------------------- rules
@query(f"""
WITH o AS ({_O}), k AS (SELECT *, CASE cust % 3 WHEN 0 THEN '공사' WHEN 1 THEN '용역' ELSE '기타' END AS category, CASE WHEN doc_id % 5 <> 0 THEN amount END AS sum FROM o)
SELECT doc_id, category, coalesce(sum, -1) AS amount, CASE WHEN sum IS NOT NULL THEN '사업비' END AS amount_label, CASE WHEN category = '기타' THEN NULL WHEN sum <= 100000 THEN category || ' 하' WHEN sum > 100000 THEN category || ' 상' END AS "row",
  CAST(CASE WHEN category = '기타' THEN -1 WHEN sum <= 100000 THEN 1 WHEN sum > 100000 THEN CASE category WHEN '공사' THEN 4 ELSE 3 END ELSE -1 END AS INTEGER) AS level FROM k
""")
def execution_amounts(spark, d):
    table = _rows(spark, [(0, "총무과", "공사 하", None, 10**9, 0), (1, "(공통) 집행", "공사 하", None, 100_000, 1), (2, "(공통) 집행", "공사 상", 100_000, None, 4), (3, "(공통) 집행", "용역 하", None, 100_000, 1), (4, "(공통) 집행", "용역 상", 100_000, None, 3), (5, "(공통) 집행", "용역", None, None, 5)],
                  "rid int, sheet string, item string, amount_min long, amount_max long, final_level int")
    title = F.when(F.col("cust") % 3 == 0, "용역 포함 도로 공사").when(F.col("cust") % 3 == 1, "공사 감리 용역").otherwise("물건")
    body = F.when(F.col("doc_id") % 5 == 0, "금액 미정").otherwise(_said("사업비 ", _n("amount"), "원"))
    docs = _orders(spark, d).select("doc_id", title.alias("title"), body.alias("body"))
    return rules.execution(docs, table, [("공사", ("공사",), "공사"), ("용역", ("용역",), "용역"), ("기타", (), "그 외")], ["사업비"]).na.fill(-1, ["amount", "level"])


@query(f"""
WITH o AS ({_O}), l AS (SELECT doc_id, day, CASE status WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 2 END AS level FROM o)
SELECT doc_id AS req, string_agg(s, '>' ORDER BY i) AS line FROM (
  SELECT doc_id, 0 AS i, '주무관' AS s FROM l UNION ALL SELECT doc_id, 1, '팀장' FROM l UNION ALL
  SELECT doc_id, 2, CASE WHEN day < DATE '1997-01-01' THEN '팀 장' ELSE '과장' END FROM l WHERE day >= DATE '1997-01-01' UNION ALL
  SELECT doc_id, 3, '국장' FROM l WHERE level >= 3 AND NOT (day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND level = 5) UNION ALL
  SELECT doc_id, 5, '군수' || CASE WHEN day BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' THEN '(국장)' ELSE '' END FROM l WHERE level = 5) GROUP BY 1
""")
def slot_chains(spark, d):
    chart = _rows(spark, [("d", "t", "기안", "주무관", 0), ("d", "t", "팀장", "팀장", 1), ("d", "u", "팀장", "다른팀장", 1), ("d", None, "과장", "과장", 2), ("d", None, "국장", "국장", 3), ("d", None, "부군수", "부군수", 4), ("d", None, "군수", "군수", 5)], "dept string, team string, slot string, title string, level int")
    spells = _rows(spark, [(0, "과장", "팀 장", None, "1996-12-31", "replace"), (1, "군수", "국장", "1998-01-01", "1999-12-31", "annotate")], "ord int, slot string, by string, f string, t string, mode string")
    spells = spells.select("ord", "slot", "by", F.col("f").cast("date").alias("from_date"), F.col("t").cast("date").alias("to_date"), "mode")
    level = F.when(F.col("status") == "F", 5).when(F.col("status") == "O", 3).otherwise(2)
    asked = _orders(spark, d).select(F.col("doc_id").alias("req"), F.lit("d").alias("dept"), F.lit("t").alias("team"), "day", level.alias("final_level"))
    chain = rules.slot_chain(asked, chart, spells, ["d"])
    said = F.concat("title", F.when(F.col("acting_by").isNotNull(), F.concat(F.lit("("), "acting_by", F.lit(")"))).otherwise(""))
    return chain.groupBy("req").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", said.alias("s")))), lambda x: x["s"]), ">").alias("line"))


@query(f"""
WITH o AS ({_O}), c AS (SELECT doc_id, org, 1 AS o, '주무관' AS title, 'drafter' AS evidence FROM o UNION ALL SELECT doc_id, org, 2, '도서팀장', 'team' FROM o WHERE cust % 2 = 0 UNION ALL
  SELECT doc_id, org, 3, '예산팀장', 'extra' FROM o WHERE status = 'F' UNION ALL SELECT doc_id, org, 4, CASE WHEN amount <= 100000 THEN '과장' ELSE '국장' END, CASE WHEN amount <= 100000 THEN 'rule' ELSE 'fallback' END FROM o UNION ALL SELECT doc_id, org, 5, '재무과장', 'cooperation' FROM o WHERE cust % 5 = 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) AS INTEGER) AS ord, CASE o WHEN 1 THEN '기안' WHEN 4 THEN '결재' WHEN 5 THEN '협조' ELSE '검토' END AS role, title, CASE WHEN title = '국장' THEN '김국장' END AS name, evidence FROM c
""")
def approval_lines(spark, d):
    orgs = [f"{i}-{n}" for i, n in enumerate(["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"], 1)]
    docs = _orders(spark, d).select("doc_id", "org", F.lit("x").alias("dept"), F.when(F.col("cust") % 2 == 0, "도서 구입").otherwise("기타").alias("title"), F.when(F.col("cust") % 5 == 0, "경리 협조").otherwise("").alias("body"), F.col("status").alias("work_type"), "amount", F.lit("주무관").alias("drafter"))
    teams = _rows(spark, [(o, 0, "도서팀장", ["도서"]) for o in orgs], "org string, ord int, lead string, keywords array<string>")
    extra = _rows(spark, [(o, ["F"], "예산팀장") for o in orgs], "org string, work_types array<string>, title string")
    table = _rows(spark, [(o, 1, None, None, 100_000, "과장") for o in orgs], "org string, priority int, work_types array<string>, amount_min long, amount_max long, final_title string")
    rest = _rows(spark, [(o, "국장") for o in orgs], "org string, final_title string")
    coop = _rows(spark, [(o, 0, None, ["재무과장"], False, ["경리"]) for o in orgs], "org string, ord int, work_types array<string>, titles array<string>, required boolean, triggers array<string>")
    roster = _rows(spark, [(o, "국장", "김국장") for o in orgs], "org string, title string, name string")
    return rules.build_line(docs.withColumn("title", F.concat_ws(" ", "title", "body")), teams, extra, table, rest, coop, roster)


@query("""
WITH u AS (SELECT lang, list_contains(list_distinct(string_split(lower(text), ' ')), 'the') AS x, doc_id, source, split_part(source, 'c', 2) AS n FROM documents),
a AS (SELECT lang AS org, '결재' AS item, max(source) AS value FROM u GROUP BY 1 UNION ALL SELECT DISTINCT lang, '팀장', source FROM u WHERE doc_id % 2 = 0),
b AS (SELECT lang AS org, '결재' AS item, min(source) AS value FROM u WHERE lang <> 'es' GROUP BY 1 UNION ALL SELECT DISTINCT lang, '팀장', source FROM u WHERE doc_id % 3 = 0 AND lang <> 'es'),
j AS (SELECT coalesce(a.org, b.org) AS org, coalesce(a.item, b.item) AS item, coalesce(a.value, b.value) AS value, a.value IS NOT NULL AS x, b.value IS NOT NULL AS y FROM a FULL JOIN b ON a.org = b.org AND a.item = b.item AND a.value = b.value),
g AS (SELECT org, item, count(*) FILTER (WHERE x AND y) AS xy, count(*) FILTER (WHERE x AND NOT y) AS oi, count(*) FILTER (WHERE y AND NOT x) AS oo FROM j WHERE org <> 'es' GROUP BY 1, 2)
SELECT CAST(sum(xy + oo) AS BIGINT) AS official_items, round(sum(xy) / sum(xy + oo), 4) AS coverage_ratio, CAST(sum(oi) AS BIGINT) AS overgeneralised, count(*) FILTER (WHERE item = '결재' AND oi > 0 AND oo > 0) AS conflict FROM g
""")
def rule_set_totals(spark, d):
    docs = _t(spark, d, "documents").select(F.col("lang").alias("org"), "doc_id", "source")
    none = lambda schema: docs.sparkSession.createDataFrame([], schema)

    def items(of: DataFrame, approver, teams: DataFrame) -> DataFrame:
        chains = of.groupBy("org").agg(F.lit(None).cast("string").alias("draft"), approver.alias("approve"))
        return evaluate.rule_items(chains, teams.select("org", F.col("source").alias("lead")), none("org string, work_type string, title string"), none("org string, titles array<string>"), none("org string, work_type string, amount_min long, amount_max long, final_title string"))

    official = docs.filter("org <> 'es'")
    diff = evaluate.items_diff(items(docs, F.max("source"), docs.filter("doc_id % 2 = 0")), items(official, F.min("source"), official.filter("doc_id % 3 = 0")))
    return evaluate.diff_totals(diff)


# ---------------------------------------------------------------- scores
@query(f"WITH {_CELLS} SELECT title, count(*) AS n FROM cells GROUP BY 1")
def title_counts(spark, d):
    return evaluate.title_counts(_docs_cells(spark, d)[1])


@query(f"""
WITH o AS ({_O}), x AS (SELECT org, doc_id % 4 AS hits, doc_id % 4 + cust % 3 AS wanted FROM o)
SELECT org, round(sum(hits) / sum(wanted), 4) AS micro, round(avg(CASE WHEN wanted > 0 THEN hits / wanted ELSE 0 END), 4) AS macro FROM x GROUP BY 1
""")
def micro_and_macro(spark, d):
    rows = _orders(spark, d).withColumns({"hits": F.col("doc_id") % 4, "wanted": F.col("doc_id") % 4 + F.col("cust") % 3})
    return evaluate.micro_macro(rows, "hits", "wanted", "org")


@query(f"""
WITH o AS ({_O}), m AS (SELECT cust % 50 AS r, status, avg(amount) AS m FROM o GROUP BY 1, 2), w AS (SELECT r, max(m) FILTER (WHERE status = 'F') AS own, max(m) FILTER (WHERE status <> 'F') AS best FROM m GROUP BY 1)
SELECT count(*) AS rounds, count(*) FILTER (WHERE own >= best OR (best IS NULL AND own IS NOT NULL)) AS won FROM w
""")
def rounds_won(spark, d):
    return evaluate.wins(_orders(spark, d).withColumn("r", F.col("cust") % 50), "r", "status", "amount", "F")


@query("""
WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END AS g, CASE WHEN o_totalprice > 400000 THEN 5 WHEN o_totalprice > 250000 THEN 4 WHEN o_totalprice > 100000 THEN 3 ELSE 1 END AS p FROM orders)
SELECT count(*) FILTER (WHERE p >= 4) AS n, count(*) FILTER (WHERE p >= 4 AND g = p) AS correct FROM c
""")
def decidable_finals(spark, d):
    o, p = F.col("o_orderpriority"), F.col("o_totalprice")
    gold, pred = F.when(o == "1-URGENT", 5).when(o == "2-HIGH", 4).when(o == "3-MEDIUM", 3).when(o == "5-LOW", 1), F.when(p > 400000, 5).when(p > 250000, 4).when(p > 100000, 3).otherwise(1)
    return evaluate.decidable(evaluate.final_verdict(_t(spark, d, "orders").select(gold.alias("gold_level"), pred.alias("pred_level"))))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[가-힣A-Za-z]{2,}')) AS ws, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
p AS (SELECT a.conv_id, a.turn, (a.turn * 7) % a.m AS said, b.turn AS t, len(list_intersect(a.ws, b.ws)) AS o FROM w a JOIN w b ON a.conv_id = b.conv_id WHERE a.m > 1),
s AS (SELECT conv_id, turn, max(o) AS best, max(CASE WHEN t = said THEN o END) AS own FROM p GROUP BY 1, 2)
SELECT conv_id AS doc_id, count(*) AS checked, count(*) FILTER (WHERE own = best AND best > 0) AS correct, 0 AS missing_page FROM s GROUP BY 1
""")
def location_checks(spark, d):
    """Each turn as a claim about the page, another turn of its conversation, that it comes from."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.regexp_replace("text", "[0-9]", "x").alias("text"), F.count("*").over(Window.partitionBy("conv_id")).alias("m"))
    pages = turns.select("doc_id", (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    points = turns.select("doc_id", F.col("turn").alias("n"), F.col("text").alias("value"), ((F.col("turn") * 7) % F.col("m") + 1).cast("int").alias("page"))
    return evaluate.location_check(points, pages).withColumn("missing_page", F.col("missing_page").cast("int"))


@query("""
WITH p AS (SELECT a.p_partkey // 4 AS doc_id, string_agg(a.p_name, chr(10) || chr(10) ORDER BY a.p_partkey) AS r, string_agg(coalesce(b.p_name, ''), chr(10) || chr(10) ORDER BY a.p_partkey) AS h FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 GROUP BY 1),
n AS (SELECT doc_id, trim(regexp_replace(r, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS h FROM p)
SELECT doc_id, levenshtein(r, h) / length(r) AS cer FROM n
""")
def document_error_rates(spark, d):
    part = _t(spark, d, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("ref")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("hyp")), "p_partkey", "left")
    pages = pairs.select(F.floor(F.col("p_partkey") / 4).alias("doc_id"), F.col("p_partkey").alias("page_no"), "ref", "hyp")
    return evaluate.document_scores(pages).select("doc_id", "cer")


@query("""
WITH s AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS kind, n_chars % 100 / 100 AS a, doc_id % 10 / 10 AS b FROM documents)
SELECT kind, count(*) AS pages, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM s GROUP BY 1
""")
def means_by_kind(spark, d):
    kind = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    rows = _t(spark, d, "documents").select(kind.alias("kind"), (F.col("n_chars") % 100 / 100).alias("a"), (F.col("doc_id") % 10 / 10).alias("b"))
    return evaluate.type_means(rows, "kind", "a", "b")


@query(f"SELECT doc_id, 2 AS sections, CASE WHEN cust % 3 = 0 THEN 2 WHEN cust % 3 = 1 THEN 1 ELSE 0 END AS section_hits, 2 AS phrases, CASE WHEN cust % 2 = 0 THEN 2 ELSE 1 END AS phrase_hits FROM ({_O})")
def draft_scores(spark, d):
    actual = _said("1. 추진 배경 및 목적\n2024. 1. 3. 시행\n2) 예산 집행 계획 ", _n(), "\n3. 시행 일자\n4. 12")
    draft = _said(F.when(F.col("cust") % 3 != 2, "1. 추진 배경\n1. 추진 배경 등\n").otherwise("1. 다른 말\n"), F.when(F.col("cust") % 3 == 0, "○ 2. 예산 집행 내역\n").otherwise("예산 집행 계획\n"), F.when(F.col("cust") % 2 == 0, "도서관").otherwise(""))
    made = evaluate.draft_score(draft, actual, F.array(F.lit("도서관"), F.lit("1.")))
    return _orders(spark, d).select("doc_id", made.alias("s")).select("doc_id", "s.sections", "s.section_hits", "s.phrases", "s.phrase_hits")


@query(f"SELECT doc_id, cust % 4 = 0 OR cust % 4 = 3 AS has_gutter FROM ({_O})")
def gutters(spark, d):
    block = lambda a, b: F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    two = [block(5, 44), block(56, 95), block(5, 40), block(60, 95)]
    spans = F.when(F.col("cust") % 4 == 0, F.array(*two)).when(F.col("cust") % 4 == 1, F.array(*two[:3])).when(F.col("cust") % 4 == 2, F.array(*two, block(30, 70))).otherwise(F.array(*[block(5, 29), block(10, 30), block(5, 20), block(96, 99)]))
    rows = _orders(spark, d).select("doc_id", F.lit(100.0).alias("page_width"), F.explode(spans).alias("s")).select("doc_id", "page_width", "s.*")
    return layout.gutter(rows, ["doc_id"])


@query(f"""
WITH o AS ({_O}) SELECT doc_id, 0 AS ord, '기안' AS role, '주무관' AS title, '김' || CASE WHEN cust % 2 = 0 THEN '철수' ELSE '영희' END AS name FROM o UNION ALL SELECT doc_id, 1, '검토', '출입국관리서기', '' FROM o UNION ALL SELECT doc_id, 2, '결재', '총무과장', '홍길동' FROM o UNION ALL SELECT doc_id, 3, '협조', '재무과장', '이몽룡' FROM o WHERE cust % 3 = 0
""")
def cells_of_pages(spark, d):
    word = lambda i, x, y, t: F.struct(F.lit(i).alias("word_id"), F.lit(float(x)).alias("xc"), F.lit(float(y)).alias("y"), t.alias("text"), F.lit(float(x) - 10).alias("xl"))
    name = F.when(F.col("cust") % 2 == 0, "김철수").otherwise("김영희")
    line = [word(0, 20, 100, F.lit("주무관")), word(1, 70, 101, name), word(2, 200, 80, F.lit("출입국관리서")), word(3, 200, 98, F.lit("기")), word(4, 300, 100, F.lit("총무과장")), word(5, 350, 102, F.lit("홍길동")), word(6, 500, 100, F.lit("2024."))]
    also = [word(7, 20, 140, F.lit("협조자")), word(8, 80, 150, F.lit("재무과장")), word(9, 130, 150, F.lit("이몽룡"))]
    words = _orders(spark, d).select("doc_id", F.explode(F.when(F.col("cust") % 3 == 0, F.array(*line, *also)).otherwise(F.array(*line))).alias("w")).select("doc_id", "w.*")
    return layout.approval_cells(words)


# ---------------------------------------------------------------- retrieval
@query("""
WITH i AS (SELECT doc_id, source, lang, text FROM documents WHERE length(text) >= 300) SELECT doc_id AS chunk_id, doc_id, source AS org, lang AS doc_type, length(substr(text, 1, 4000)) AS n FROM i
""")
def item_chunks(spark, d):
    items = _t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", F.col("lang").alias("kind"), F.col("text").alias("body"))
    return retrieval.item_chunks(items).select("chunk_id", "doc_id", "org", "doc_type", F.length("text").cast("long").alias("n"))


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS ql, x.vec_id, x.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, x.e), 6) DESC, x.vec_id) AS rank FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM s WHERE rank <= 15 AND vec_id % 4 <> 0)
SELECT query_id, count(*) FILTER (WHERE r <= 3 AND vec_id % 3 = query_id % 3) AS same_org_at_3, coalesce(bool_or(r <= 3 AND label = ql), false) AS same_type_at_3, count(DISTINCT vec_id // 2) AS distinct_docs_at_5 FROM h WHERE r <= 5 GROUP BY 1
""")
def draft_search(spark, d):
    """Hits fetched deeper than needed, filtered, cut and scored."""
    data = _t(spark, d, "embeddings")
    hits = retrieval.vectors(data.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), data, 15)
    kept = retrieval.filtered_hits(hits, F.col("vec_id") % 4 != 0, 5)
    of = data.select("vec_id", F.col("label").alias("doc_type"), (F.col("vec_id") % 3).alias("org"))
    named = kept.join(of, "vec_id").join(of.select(F.col("vec_id").alias("query_id"), F.col("doc_type").alias("target_type"), F.col("org").alias("target_org")), "query_id")
    return retrieval.draft_search_scores(named.withColumn("doc_id", F.floor(F.col("vec_id") / 2)))


@query("""
WITH w AS (SELECT item_id, unnest(list_distinct(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '))) AS w FROM benchmark), p AS (SELECT a.item_id AS query_id, b.item_id AS doc_id, count(*) AS score FROM w a JOIN w b USING (w) WHERE a.item_id % 10 = 0 AND a.item_id <> b.item_id GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id % 7 DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p QUALIFY rank <= 3
""")
def search_past(spark, d):
    """Overlap of words, ties to the latest, here the larger remainder."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text", (F.col("item_id") % 7).alias("at"))
    asked = items.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    hits = retrieval.word_overlap(asked, items, 4, text.words, recency="at")
    return retrieval.filtered_hits(hits, F.col("query_id") != F.col("doc_id"), 3).select("query_id", "rank", "doc_id", "score")


@query(f"""
WITH o AS ({_O}) SELECT count(*) AS labelled, count(*) FILTER (WHERE cust % 3 <> 2) AS candidate_recall, count(*) FILTER (WHERE cust % 3 = 0) AS pick_correct FROM o WHERE doc_id % 2 = 0
""")
def candidate_recall(spark, d):
    base = _orders(spark, d)
    gold = base.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(7), F.lit(8))).otherwise(F.array().cast("array<int>")).alias("rids"))
    rids = F.when(F.col("cust") % 3 == 0, F.array(F.lit(8), F.lit(1))).when(F.col("cust") % 3 == 1, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(1), F.lit(2)))
    hits = base.select(F.col("doc_id").alias("query_id"), F.posexplode(rids).alias("rank", "rid"))
    return retrieval.candidate_recall(gold, hits)


@query(f"SELECT doc_id, CASE WHEN status = 'F' THEN '도서팀' WHEN status = 'O' THEN '도로팀' ELSE '총무팀' END AS team FROM ({_O})")
def routes_by_duties(spark, d):
    teams = _rows(spark, [("d", 0, "총무팀", "일반 서무 관리"), ("d", 1, "도서팀", "도서 대출 독서 모임"), ("d", 2, "도로팀", "도로 보수 포장"), ("d", 3, "복지팀", "복지 상담 지원"), ("d", 4, "환경팀", "환경 정화 점검")], "dept string, ord int, team string, duties string")
    title = F.when(F.col("status") == "F", "독서 모임").when(F.col("status") == "O", "도로 포장").otherwise("xyz")
    docs = _orders(spark, d).select("doc_id", F.lit("d").alias("dept"), title.alias("title"), F.lit("").alias("body"))
    return retrieval.route_by_duties(docs, teams).select("doc_id", "team")
