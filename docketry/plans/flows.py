"""Queries of whole flows: requests handled, lines resolved in layers, tables filled, with their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docketry.functions.shared import drop_folder, shared_folder, stable
from docketry.operators import bundles, drafts, evaluate, gazette, layout, predict, requests, retrieval, sampling, tracks
from docketry.plans.catalogue import _TOKENS, _rows, _t, query
from docketry.plans.more import _O, _VOTED, _docs_cells, _n, _orders, _said
from docketry.sources import documents, engines, matrix, side_table

# ---------------------------------------------------------------- requests
DEPARTMENTS = [("도로과", "건설도시국", "도로과장"), ("행정과", "행정안전국", "행정과장"), ("감사담당관", None, "감사담당관")]
TEAMS_OF = [("도로과", 1, "도로팀", "도로팀장"), ("행정과", 1, "총무팀", "총무 팀장"), ("행정과", 2, "민원팀", "")]
TABLE = [
    (0, "도로과", "도로", "도로 관리", None, None, 2), (1, "도로과", "하천", "하천 정비", None, None, 3), (2, "행정과", "도로", "도로 관리", None, None, 4), (3, "(공통) 집행", "집행", "가.공사 5만원 이하", None, 50_000, 1),
    (4, "(공통) 집행", "집행", "가.공사 15만원 이하", 50_000, 150_000, 2), (5, "(공통) 집행", "집행", "다. 그 외 20만원 이하", None, 200_000, 3), (6, "(공통) 집행", "집행", "다. 그 외 20만원 초과", 200_000, None, 5),
    (7, "(공통) 관리", "민원", "민원 답변", None, None, 1),
]
SPELLS = [(0, "부군수", "행정안전국장", "1998-01-01", None, "replace"), (1, "군수", "부군수", "1996-01-01", "1997-06-30", "annotate")]
PEOPLE = [("김하나", "O", "주무관"), ("이두리", "F", "주무관"), ("이두리", "O", "팀장")]


def _published(spark) -> requests.Published:
    return requests.Published(
        "군청", _rows(spark, DEPARTMENTS, "dept string, bureau string, head string"), _rows(spark, TEAMS_OF, "dept string, ord int, team string, lead string"),
        _rows(spark, TABLE, "rid int, sheet string, `group` string, item string, amount_min bigint, amount_max bigint, final_level int"), _rows(spark, SPELLS, "ord int, slot string, by string, from_date string, to_date string, mode string"),
        [("공사", ("공사",), "가.공사"), ("그외", (), "다. 그 외")], ["도급액"], ("품의",), ("구매",), "계획$", ["감사담당관"],
    )


BUNDLES = [
    ("O", "induced", 9, "주무관", "관장", 1, [("운영팀장", ["공연"], 3), ("자료팀장", ["도서"], 6)], [(2, None, None, 100_000, "과장", "r2"), (1, ["계약·검사"], None, None, "국장", "r1")], "관장", False, [(["계약·검사"], "회계팀장"), (None, "과장")], [(["전산팀장"], None, False, ["전산"])], []),
    ("F", "official", 4, "주무관", "관장", 1, [], [(1, None, None, None, "관장", "r")], "관장", False, [], [], []),
]


def _requests(spark, d) -> DataFrame:
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("req"), F.floor("o_totalprice").cast("long").alias("amount"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    pick = lambda of, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values) + 1).cast("int"))
    k, m = F.col("req") % 6, F.floor(F.col("req") / 6)
    title = F.when(k < 4, pick(m, "도로 공사 품의", "물품 구매", "도로 관리 보고", "하천 정비 구매 계획", "민원 답변")).otherwise(pick(m, "도서 계약 체결", "공연 전산 계획", "행사 결과"))
    amount = F.when(m % 4 > 0, _said("도급액 ", F.format_number("amount", 0), "원")).otherwise("금액 미정")
    body = F.when(k < 4, _said(amount, "\n", pick(m, "첨부", "도면"))).otherwise(_said("금 ", F.format_number("amount", 0), "원"))
    return o.select(
        "req", F.when(k < 4, pick(k, "도로과", "행정과", "감사담당관", "없는과")).alias("dept"), F.when(k < 2, pick(m, "도로팀", "총무팀", "체육팀장", "")).alias("team"), F.when(k == 4, pick(m, "김하나", "이두리", "박세찌")).alias("user_name"),
        F.when(k == 5, F.col("status")).alias("org"), F.when(k == 5, "주무관").alias("user_title"), title.alias("title"), body.alias("body"), F.array(_said("붙임 ", _n("req"))).alias("attachments"), "day",
    )


def _handled(spark, d) -> DataFrame:
    missing = _requests(spark, d).filter("req % 9 = 0").select("req", F.lit("산출 내역").alias("label"), F.lit("금액을 적는다").alias("hint"))
    rejected = _requests(spark, d).filter("req % 7 = 0").select("req")
    return requests.handle(_requests(spark, d), _published(spark), _rows(spark, BUNDLES, bundles.SCHEMA), _rows(spark, PEOPLE, "name string, org string, title string"), missing, rejected)


_REQUESTS = """
r AS (SELECT o_orderkey AS req, CAST(floor(o_totalprice) AS BIGINT) AS amount, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 6 AS k, o_orderkey // 6 AS m FROM orders),
q AS (SELECT req, k, m, day, status, CASE WHEN k < 4 THEN (['도로과', '행정과', '감사담당관', '없는과'])[k + 1] END AS dept, CASE WHEN k < 2 THEN (['도로팀', '총무팀', '체육팀장', ''])[m % 4 + 1] ELSE '' END AS team,
  CASE WHEN k < 4 THEN (['도로 공사 품의', '물품 구매', '도로 관리 보고', '하천 정비 구매 계획', '민원 답변'])[m % 5 + 1] ELSE (['도서 계약 체결', '공연 전산 계획', '행사 결과'])[m % 3 + 1] END AS title,
  CASE WHEN k > 3 OR m % 4 > 0 THEN amount END AS amount FROM r),
d(dept, bureau, head) AS (VALUES ('도로과', '건설도시국', '도로과장'), ('행정과', '행정안전국', '행정과장'), ('감사담당관', NULL, '감사담당관')),
b AS (SELECT q.*, bureau, head, CASE WHEN k = 3 THEN 'unknown_dept' WHEN k > 3 THEN 'other' WHEN title LIKE '%품의%' OR (title LIKE '%구매%' AND title NOT LIKE '%계획') THEN 'amount_bracket' ELSE 'row_search' END AS branch,
  CASE WHEN title LIKE '%공사%' THEN '공사' ELSE '그외' END AS category,
  CASE WHEN team = '' THEN NULL WHEN team LIKE '%팀장' THEN team WHEN team = '도로팀' AND dept = '도로과' THEN '도로팀장' WHEN team = '총무팀' AND dept = '행정과' THEN '총무 팀장' ELSE team || '장' END AS lead FROM q LEFT JOIN d USING (dept)),
f AS (SELECT b.*, CASE WHEN branch = 'amount_bracket' THEN CASE WHEN amount IS NULL THEN NULL WHEN category = '공사' THEN CASE WHEN amount <= 50000 THEN 1 WHEN amount <= 150000 THEN 2 END WHEN amount <= 200000 THEN 3 ELSE 5 END
    WHEN branch = 'row_search' THEN CASE WHEN dept = '행정과' THEN 4 WHEN dept = '도로과' AND title LIKE '도로%' THEN 2 WHEN dept = '도로과' AND title LIKE '하천%' THEN 3 ELSE 1 END END AS level,
  CASE WHEN dept = '행정과' THEN '[행정과] 도로 관리' WHEN dept = '도로과' AND title LIKE '도로%' THEN '[도로과] 도로 관리' WHEN dept = '도로과' AND title LIKE '하천%' THEN '[도로과] 하천 정비' ELSE '[(공통) 관리] 민원 답변' END AS found FROM b),
u AS (SELECT req, title, amount, m, CASE WHEN k = 5 THEN status WHEN m % 3 = 0 THEN 'O' END AS org, k FROM q WHERE k > 3),
w AS (SELECT u.*, CASE WHEN title LIKE '%계약%' THEN '계약·검사' WHEN title LIKE '%계획%' THEN '사업계획' ELSE '결과보고' END AS kind FROM u)"""


@query(f"""
WITH {_REQUESTS}, names AS (SELECT * FROM (VALUES (0, '주무관'), (1, '팀장'), (2, '과장'), (3, '국장'), (4, '부군수'), (5, '군수')) t(level, said)),
acts AS (SELECT req, day, coalesce(level, 5) AS up, dept FROM f WHERE branch IN ('amount_bracket', 'row_search')),
n AS (
  SELECT req, '부서' AS what, dept AS why FROM f WHERE branch = 'unknown_dept'
  UNION ALL SELECT req, '금액', category FROM f WHERE branch = 'amount_bracket' AND level IS NULL
  UNION ALL SELECT req, '전결 사무', found FROM f WHERE branch = 'row_search'
  UNION ALL SELECT req, '상향 결재', said FROM f JOIN names USING (level) WHERE level < 5
  UNION ALL SELECT req, '팀', lead FROM f WHERE branch IN ('amount_bracket', 'row_search') AND lead IS NOT NULL AND NOT ((dept = '도로과' AND lead = '도로팀장') OR (dept = '행정과' AND lead = '총무 팀장'))
  UNION ALL SELECT req, '초안', '군청' FROM f WHERE branch IN ('amount_bracket', 'row_search')
  UNION ALL SELECT req, '직무대리', '부군수 → 행정안전국장' FROM acts WHERE day >= '1998-01-01' AND up >= 4 AND dept = '도로과'
  UNION ALL SELECT req, '직무대리', '군수 → 부군수' FROM acts WHERE day BETWEEN '1996-01-01' AND '1997-06-30' AND up >= 5
  UNION ALL SELECT req, '기안자', CASE WHEN m % 3 = 1 THEN 'ambiguous' ELSE 'unknown' END FROM u WHERE org IS NULL
  UNION ALL SELECT req, '전결규정', org FROM u WHERE org NOT IN ('O', 'F')
  UNION ALL SELECT req, '최종 결재자', 'induced' FROM u WHERE org = 'O'
  UNION ALL SELECT req, '산출 내역', '금액을 적는다' FROM u WHERE org IS NOT NULL AND req % 9 = 0
  UNION ALL SELECT req, '요약', 'ungrounded' FROM u WHERE org IS NOT NULL AND req % 7 = 0
) SELECT * FROM n
""")
def request_reasons(spark, d):
    """What drafters should confirm, over all branches: unknown departments, missing amounts, searched rows, raised approvals, strange teams, acting
    persons, unknown people, missing or induced rules, drafts and summaries."""
    return requests.reasons(_handled(spark, d)).select("req", "what", "why")


@query(f"""
WITH {_REQUESTS}, s AS (
  SELECT req, 0 AS o, '주무관' AS title FROM f WHERE branch IN ('amount_bracket', 'row_search')
  UNION ALL SELECT req, 1, lead FROM f WHERE branch IN ('amount_bracket', 'row_search') AND lead IS NOT NULL AND coalesce(level, 5) >= 1
  UNION ALL SELECT req, 2, head FROM f WHERE branch IN ('amount_bracket', 'row_search') AND coalesce(level, 5) >= 2
  UNION ALL SELECT req, 3, bureau || '장' FROM f WHERE branch IN ('amount_bracket', 'row_search') AND coalesce(level, 5) >= 3 AND bureau IS NOT NULL
  UNION ALL SELECT req, 4, CASE WHEN day >= '1998-01-01' THEN '행정안전국장' ELSE '부군수' END FROM f WHERE branch IN ('amount_bracket', 'row_search') AND coalesce(level, 5) >= 4 AND dept <> '감사담당관' AND NOT (coalesce(level, 5) = 5 AND day BETWEEN '1996-01-01' AND '1997-06-30')
  UNION ALL SELECT req, 5, '군수' FROM f WHERE branch IN ('amount_bracket', 'row_search') AND coalesce(level, 5) >= 5
), g AS (SELECT *, lag(title) OVER (PARTITION BY req ORDER BY o) AS before FROM s), kept AS (SELECT * FROM g WHERE before IS NULL OR before <> title),
i AS (SELECT req, row_number() OVER (PARTITION BY req ORDER BY o) - 1 AS ord, count(*) OVER (PARTITION BY req) AS n, title FROM kept),
official AS (SELECT req, CAST(ord AS INTEGER) AS ord, CASE WHEN ord = 0 THEN '기안' WHEN ord = n - 1 THEN '결재' ELSE '검토' END AS role, title FROM i),
e AS (SELECT *, CASE WHEN org = 'F' THEN '관장' WHEN kind = '계약·검사' THEN '국장' WHEN amount <= 100000 THEN '과장' ELSE '관장' END AS fin,
  CASE WHEN org = 'O' AND title LIKE '%도서%' THEN '자료팀장' WHEN org = 'O' AND title LIKE '%공연%' THEN '운영팀장' END AS team FROM w WHERE org IN ('O', 'F')),
x AS (
  SELECT req, 0 AS o, '기안' AS role, '주무관' AS title FROM e UNION ALL SELECT req, 1, '검토', team FROM e WHERE team IS NOT NULL
  UNION ALL SELECT req, 2, '검토', '회계팀장' FROM e WHERE org = 'O' AND kind = '계약·검사' UNION ALL SELECT req, 3, '검토', '과장' FROM e WHERE org = 'O' AND fin <> '과장'
  UNION ALL SELECT req, 4, '결재', fin FROM e UNION ALL SELECT req, 5, '협조', '전산팀장' FROM e WHERE org = 'O' AND title LIKE '%전산%')
SELECT req, ord, role, title FROM official UNION ALL SELECT req, CAST(row_number() OVER (PARTITION BY req ORDER BY o) - 1 AS INTEGER), role, title FROM x
""")
def request_lines(spark, d):
    """Approval lines of all branches."""
    return requests.lines(_handled(spark, d)).select("req", "ord", "role", "title")


# ---------------------------------------------------------------- layered lines
LAYERED = [
    ("1", "manual", 1, None, "AF", 1, [], [(1, None, None, 200_000, "NO", "small")], "RF", False, [], None, []),
    ("2", "manual", 1, "NO", "AF", 2, [("RF", ["가나"], 2), ("AF", ["다라"], 5)], [(1, None, None, None, "NO", "all")], None, True, [(None, "RF"), (["결과보고"], "NO")], [(["AF", "RF"], None, False, ["협의"])], []),
]


def _layered_bundles(spark) -> DataFrame:
    of_all = F.transform(F.sequence(F.lit(0), F.lit(132)), lambda i: (i * 3 + F.col("org").cast("int")).cast("string"))
    return _rows(spark, LAYERED, bundles.SCHEMA).withColumn("org", F.explode(of_all))


def _titled(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, cells = _docs_cells(spark, d, F.floor("o_totalprice").cast("long").alias("amount"))
    pick = F.element_at(F.array(F.lit("가 나 점검"), F.lit("다라 협 의"), F.lit("가나 다라"), F.lit("점검")), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = docs.withColumns({"org": (F.col("org") % 400).cast("string"), "title": pick, "body": _said("금 ", F.format_number("amount", 0), "원")}).drop("amount")
    return docs, cells


_LAYERED = f"""
{_VOTED.replace("o_custkey AS org", "o_custkey % 400 AS org")},
x AS (SELECT o_orderkey AS doc_id, o_custkey % 400 AS org, CAST(floor(o_totalprice) AS BIGINT) AS amount, o_custkey % 400 % 3 AS b, (['가나점검', '다라협의', '가나다라', '점검'])[o_orderkey % 4 + 1] AS title FROM orders),
e AS (SELECT *, CASE WHEN b = 2 THEN 'NO' WHEN amount <= 200000 THEN 'NO' ELSE 'RF' END AS fin, CASE WHEN title = '가나점검' THEN 'RF' WHEN title = '다라협의' THEN 'AF' END AS lead FROM x WHERE b > 0),
one AS (SELECT e.*, v.title AS voted FROM e LEFT JOIN voted v ON v.doc_id = e.doc_id AND v.role = '기안' AND v.pos = 0),
rev AS (
  SELECT doc_id, 0 AS o, coalesce(lead, 'AF') AS title, CASE WHEN lead IS NULL THEN 'vote' ELSE 'rule' END AS src FROM e WHERE b = 2
  UNION ALL SELECT doc_id, 1, 'RF', 'rule' FROM e WHERE b = 2 AND coalesce(lead, 'AF') <> 'RF'),
got AS (SELECT doc_id, count(*) AS n FROM rev GROUP BY 1),
more AS (SELECT e.doc_id, v.pos, v.title, row_number() OVER (PARTITION BY e.doc_id ORDER BY v.pos) AS i, coalesce(got.n, 0) AS n, CASE WHEN e.b = 2 THEN 2 ELSE 1 END AS want
  FROM e JOIN voted v ON v.doc_id = e.doc_id AND v.role = '검토' AND v.title <> e.fin AND NOT (e.b = 2 AND v.title IN ('RF', 'AF')) LEFT JOIN got ON got.doc_id = e.doc_id),
slots AS (
  SELECT doc_id, '기안' AS role, 0 AS o, CASE WHEN b = 2 THEN 'NO' ELSE coalesce(voted, '') END AS title, CASE WHEN b = 2 THEN 'rule' ELSE 'vote' END AS src FROM one
  UNION ALL SELECT doc_id, '검토', o, title, src FROM rev UNION ALL SELECT doc_id, '검토', 100 + pos, title, 'vote' FROM more WHERE i <= want - n
  UNION ALL SELECT doc_id, '결재', 0, fin, 'rule' FROM e
  UNION ALL SELECT doc_id, '협조', i, t, 'rule' FROM e CROSS JOIN (VALUES (0, 'AF'), (1, 'RF')) c(i, t) WHERE b = 2 AND title = '다라협의'
  UNION ALL SELECT e.doc_id, '협조', v.pos, v.title, 'vote' FROM e JOIN voted v ON v.doc_id = e.doc_id AND v.role = '협조' WHERE b = 1),
placed AS (SELECT doc_id, role, CAST(row_number() OVER (PARTITION BY doc_id, role ORDER BY o) - 1 AS INTEGER) AS pos, title, src FROM slots),
known AS (SELECT p.target AS doc_id, c.title, c.name, max(struct_pack(d := p.date, k := p.doc_id)) AS last_at FROM pairs p JOIN cells c USING (doc_id) GROUP BY 1, 2, 3),
roster AS (SELECT doc_id, title, count(*) AS n, max(last_at) AS top FROM known GROUP BY 1, 2),
best AS (SELECT k.doc_id, k.title, min(k.name) AS name FROM known k JOIN roster r ON r.doc_id = k.doc_id AND r.title = k.title AND r.top = k.last_at GROUP BY 1, 2),
lines AS (
  SELECT p.doc_id, p.role, p.pos, p.title, CASE WHEN x.b = 2 AND p.role = '결재' THEN '' ELSE coalesce(best.name, '') END AS name, p.src AS title_source,
    CASE WHEN x.b = 2 AND p.role = '결재' THEN 'rule' WHEN r.n = 1 THEN 'roster' WHEN r.n > 1 THEN 'vote' ELSE 'none' END AS name_source
  FROM placed p JOIN x ON x.doc_id = p.doc_id LEFT JOIN roster r ON r.doc_id = p.doc_id AND r.title = p.title LEFT JOIN best ON best.doc_id = p.doc_id AND best.title = p.title
  UNION ALL SELECT v.doc_id, v.role, v.pos, v.title, v.name, 'vote', 'vote' FROM voted v JOIN x ON x.doc_id = v.doc_id WHERE x.b = 0)"""


@query(f"WITH {_LAYERED} SELECT * FROM lines")
def layered_lines(spark, d):
    """Lines by rules, votes and rosters, each cell with its evidence; organisations without rules by votes alone."""
    return predict.layered(*_titled(spark, d), _layered_bundles(spark))


@query(f"""
WITH {_LAYERED}, j AS (SELECT l.title_source, l.name_source, coalesce(l.title = c.title, false) AS t, CASE WHEN c.doc_id IS NULL THEN false ELSE l.name = c.name END AS n FROM lines l LEFT JOIN cells c USING (doc_id, role, pos)),
k AS (SELECT 'title' AS kind, title_source AS evidence, t AS ok FROM j UNION ALL SELECT 'name', name_source, n FROM j)
SELECT kind, evidence, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM k GROUP BY 1, 2
""")
def layered_evidence(spark, d):
    """How often each kind of evidence is right."""
    docs, cells = _titled(spark, d)
    return evaluate.by_evidence(evaluate.cell_outcomes(cells, predict.layered(docs, cells, _layered_bundles(spark))), {"title": ("title_source", "title_ok"), "name": ("name_source", "name_ok")})


# ---------------------------------------------------------------- sources
def _sheets(spark, d) -> DataFrame:
    """A workbook made of parts: a sheet for each brand, a row for each part."""
    p = _t(spark, d, "part")
    lines = p.withColumn("row", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 3)
    kind, lit = F.col("p_size") % 4, lambda c, t: F.struct(F.lit(c).alias("col"), t.alias("text"))
    band = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("만원 초과 "), (F.col("p_size") % 9 + 20).cast("string"), F.lit("만원  이하"))
    text = F.when(kind == 3, band).otherwise(F.concat(F.lit(" "), "p_name"))
    mark = lambda c: F.when((kind >= 2) & ((F.col("p_partkey") % 3 + 4 == c) | (F.col("p_partkey") % 5 + 4 == c)), "○").when((kind == 2) & (F.col("p_partkey") % 2 + 4 == c), "기안 ").otherwise("-")
    made = F.array(lit(1, F.when(kind == 0, "1")), lit(2, text), *[lit(c, mark(c)) for c in range(4, 9)])
    rows = lines.select(F.lit("b").alias("book"), F.col("p_brand").alias("sheet"), "row", F.explode(made).alias("c")).select("book", "sheet", "row", "c.*")
    heads = [(1, 2, "사 무 명"), (1, 4, "담 당 자"), (1, 5, "팀 장"), (2, 4, "과장"), (2, 6, "과 장"), (2, 7, "국장"), (3, 8, "부군수 (군수)"), (3, 3, "비고")]
    top = p.select("p_brand").distinct().crossJoin(F.broadcast(_rows(spark, heads, "row int, col int, text string")))
    return rows.unionByName(top.select(F.lit("b").alias("book"), F.col("p_brand").alias("sheet"), "row", "col", "text"))


@query("""
WITH l AS (SELECT p_brand AS sheet, p_partkey AS k, p_size % 9 AS z, p_size % 4 AS kind, trim(p_name) AS name, 3 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row FROM part),
t AS (SELECT *, CASE WHEN kind = 3 THEN CAST(z + 1 AS VARCHAR) || '만원 초과 ' || CAST(z + 20 AS VARCHAR) || '만원 이하' ELSE name END AS text, CASE WHEN kind = 0 THEN row END AS g,
  CASE WHEN kind < 3 THEN row END AS i FROM l),
c AS (SELECT *, max(g) OVER w AS g_row, max(i) OVER w AS i_row FROM t WINDOW w AS (PARTITION BY sheet ORDER BY row)),
f AS (SELECT c.*, CASE WHEN p.kind = 0 THEN '' ELSE coalesce(p.text, '') END AS parent, coalesce(q.text, '') AS "group", greatest(c.k % 3, c.k % 5) AS final_level FROM c LEFT JOIN t p ON p.sheet = c.sheet AND p.row = c.i_row LEFT JOIN t q ON q.sheet = c.sheet AND q.row = c.g_row)
SELECT sheet, CAST(row AS INTEGER) AS row, "group", CASE WHEN kind = 3 AND parent <> '' THEN parent || ' ' || text ELSE text END AS item, CASE WHEN kind = 3 THEN (z + 1) * 10000 ELSE -1 END AS amount_min, CASE WHEN kind = 3 THEN (z + 20) * 10000 ELSE -1 END AS amount_max,
  CASE WHEN kind = 2 AND k % 2 <> k % 3 AND k % 2 <> k % 5 THEN CAST(k % 2 AS INTEGER) ELSE -1 END AS drafter_level, CAST(final_level AS INTEGER) AS final_level, (['주무관', '팀장', '과장', '국장', '부군수'])[final_level + 1] AS final_title FROM f WHERE kind >= 2
""")
def delegation_matrix_rows(spark, d):
    """Tasks, amounts and deciding grades of sheets, with their groups and parents carried down."""
    return matrix.delegation(_sheets(spark, d)).drop("book").na.fill(-1, ["amount_min", "amount_max", "drafter_level"])


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS value, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 3 ELSE 2 END AS made_by, (SELECT count(*) FILTER (WHERE doc_id % 3 = 0) || '+' || count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0) || '+' || count(*) FILTER (WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0) || '+0' FROM documents) AS fills FROM documents")
def side_table_fills(spark, d):
    """A side table filled four times: with a third of the documents, with all while an engine fails for some, with all, and again."""
    path = f"{shared_folder(spark)}/side-{uuid.uuid4().hex}"
    docs = _t(spark, d, "documents").select(side_table.content_key("v1", F.col("doc_id")).alias("key"), "doc_id", "text")
    schema, counts = "key string, value bigint, made_by int", []
    for turn in (1, 2, 3, 4):
        wanted = docs.filter("doc_id % 3 = 0") if turn == 1 else docs
        make = lambda todo, turn=turn: todo.filter(F.lit(turn != 2) | (F.col("doc_id") % 5 != 0)).select("key", F.length("text").cast("bigint").alias("value"), F.lit(turn).alias("made_by"))
        table, n = side_table.fill(wanted, path, make, schema)
        counts.append(str(n))
    side_table.compact(spark, path, schema)
    out = stable(side_table.looked_up(docs, side_table.read(spark, path, schema)).select("doc_id", "value", "made_by", F.lit("+".join(counts)).alias("fills")))
    drop_folder(spark, path)
    return out


def _lengths(asks: list[str]) -> list[int | None]:
    """An engine that fails whole batches over some texts, some texts always, and answers with a text's length."""
    if len(asks) > 1 and any(a.startswith("T") for a in asks):
        raise TimeoutError("batch")
    return [None if a.startswith("W") else len(a) for a in asks]


@query("SELECT doc_id, CASE WHEN text NOT LIKE 'W%' THEN CAST(length(text) AS INTEGER) ELSE -1 END AS answer, text LIKE 'W%' AS failed FROM documents")
def engine_answers(spark, d):
    """Answers of an engine that fails at times: each row once, failures as data."""
    return engines.called(_t(spark, d, "documents").select("doc_id", "text"), "text", _lengths, "answer", IntegerType()).select("doc_id", F.coalesce("answer", F.lit(-1)).alias("answer"), F.col("error").isNotNull().alias("failed"))


# ---------------------------------------------------------------- gazette
def _issues(spark, d) -> DataFrame:
    """Issues made of parts: one for each brand, with a contents page behind a cover, and an item for each part of one to three pages."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    length, before = F.col("p_size") % 3 + 1, w.rowsBetween(Window.unboundedPreceding, -1)
    parts = _t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_brand").alias("source"), F.row_number().over(w).alias("i"), length.alias("pages"), (F.coalesce(F.sum(length).over(before), F.lit(0)) + 1).alias("page"), (F.col("p_partkey") % 2).alias("kind"), "p_name")
    kind, title = F.when(F.col("kind") == 0, "고시").otherwise("공고"), F.concat(F.lit("제목("), "p_name", F.lit(") 번호 "), F.col("p_partkey").cast("string"))
    line = F.concat(F.lit("○ 도로청"), kind, F.lit("제"), F.col("p_partkey").cast("string"), F.lit("호("), title, F.lit(")·····"), F.col("page").cast("string"))
    contents = parts.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))
    bodies = parts.select("source", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("k"), "page", title.alias("title"), "p_partkey").select(
        "source", (F.col("page") + F.col("k") + 2).cast("int").alias("page_no"), F.concat(F.when(F.col("k") == 0, F.col("title")).otherwise("이어서"), F.lit(" 내용 "), F.repeat(F.concat(F.col("p_partkey").cast("string"), F.lit(" ")), F.lit(30))).alias("text"),
    )
    cover = contents.select("source", F.lit(1).alias("page_no"), F.lit("표지").alias("text"))
    return bodies.unionByName(contents.select("source", F.lit(2).alias("page_no"), "text")).unionByName(cover)


@query("""
WITH p AS (SELECT p_brand AS source, p_partkey AS k, p_name, p_size % 3 + 1 AS n, row_number() OVER w AS i, count(*) OVER (PARTITION BY p_brand) AS m, coalesce(sum(p_size % 3 + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS page FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
t AS (SELECT *, CASE WHEN k % 2 = 0 THEN '고시' ELSE '공고' END AS kind, '제목(' || p_name || ') 번호 ' || k AS title FROM p)
SELECT source, CAST(i AS INTEGER) AS seq, source || '#' || kind || k AS item_id, title, CAST(page + 2 AS INTEGER) AS first, CAST(page + 1 + n AS INTEGER) AS last,
  CAST(length(title) + (n - 1) * 3 + n * 4 + n * 30 * (length(CAST(k AS VARCHAR)) + 1) + n - 1 AS INTEGER) AS body_chars FROM t
""")
def gazette_items(spark, d):
    """Items of issues whose printed pages start behind a cover and the contents."""
    return gazette.items(_issues(spark, d)).select("source", "seq", "item_id", "title", "pdf_pages.*", "body_chars")


@query("""
WITH p AS (SELECT p_brand || '#' || CASE WHEN p_partkey % 2 = 0 THEN '고시' ELSE '공고' END || p_partkey AS id, p_partkey % 2 AS kind, '제목(' || p_name || ') 번호 ' || p_partkey AS title, repeat(p_partkey || ' ', 30) AS said, p_size % 3 AS more FROM part),
texts AS (SELECT id, title AS text, true AS asks FROM p UNION ALL SELECT id, title || ' 내용 ' || said || repeat(chr(10) || '이어서 내용 ' || said, CAST(more AS BIGINT)) || repeat('쪽', 300), false FROM p),
flat AS (SELECT id, asks, regexp_replace(text, '\\s+', '', 'g') AS f, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w FROM texts),
tok AS (SELECT id, asks, unnest(string_split(w, ' ')) AS term FROM flat UNION ALL SELECT id, asks, substr(f, i, 2) FROM (SELECT id, asks, f, unnest(range(1, greatest(length(f), 1))) AS i FROM flat)),
both_ AS (SELECT id, asks, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY 1, 2, 3), post AS (SELECT id, term, tf FROM both_ WHERE NOT asks), len AS (SELECT id, sum(tf) AS dl FROM post GROUP BY 1),
stat AS (SELECT count(*) AS n, sum(dl) / count(*)::DOUBLE AS avgdl FROM len), raw AS (SELECT term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stat GROUP BY 1),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw), q AS (SELECT id AS query_id, term, tf AS qtf FROM both_ WHERE asks),
worth AS (SELECT id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS v FROM post JOIN idf USING (term) JOIN len USING (id), stat),
sc AS (SELECT query_id, id, round(sum(qtf * v), 6) AS score FROM q JOIN worth USING (term) GROUP BY 1, 2),
hits AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 3),
o AS (SELECT query_id, max(CAST(query_id = hits.id AND rank = 1 AS INT)) AS a, max(CAST(query_id = hits.id AS INT)) AS b, max(CAST(x.kind = y.kind AS INT)) AS c FROM hits JOIN p x ON x.id = query_id JOIN p y ON y.id = hits.id GROUP BY 1)
SELECT 'bm25' AS retriever, count(*) AS cases, avg(coalesce(a, 0))::DOUBLE AS self_at_1, avg(coalesce(b, 0))::DOUBLE AS self_at_3, avg(coalesce(c, 0))::DOUBLE AS same_kind_at_3 FROM p LEFT JOIN o ON query_id = id
""")
def gazette_search(spark, d):
    """Searches by all titles among the items: each title has a number that only its own item has."""
    found = gazette.items(_issues(spark, d)).withColumn("body", F.concat("body", F.rpad(F.lit(""), 300, "쪽"))).cache()
    asked = found.select(F.col("item_id").alias("query_id"), F.col("title").alias("query"))
    return gazette.search_report(found, asked)


# ---------------------------------------------------------------- candidates among a table's rows
POOL_TEXTS = ["도로 관리 계획", "도로 점검", "하천 정비 공사", "하천 관리", "민원 답변 처리", "예산 편성 관리", "공원 정비", "도로 도로 굴착 허가"]


@query(f"""
WITH q AS (SELECT o_orderkey AS query_id, (['도로과', '하천과', '없는과'])[o_orderkey % 3 + 1] AS dept, (['도로 관리', '하천 정비 점검', '민원 처리 결과', '관리 계획 허가', '도로 점검 도로'])[o_custkey % 5 + 1] AS query FROM orders),
rows_ AS (SELECT i - 1 AS rid, CASE (i - 1) % 3 WHEN 0 THEN '도로과' WHEN 1 THEN '하천과' ELSE '(공통) 관리' END AS sheet, '업무 ' || t AS text FROM (SELECT unnest({POOL_TEXTS}) AS t, unnest(range(1, 9)) AS i)),
kinds AS (SELECT DISTINCT dept, query FROM q), pool AS (SELECT d.dept, rid, text FROM (SELECT DISTINCT dept FROM kinds) d JOIN rows_ ON sheet = dept OR starts_with(sheet, '(공통')),
tok AS (SELECT dept, rid, unnest({_TOKENS.format(c="text")}) AS term FROM pool), post AS (SELECT dept, rid, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), len AS (SELECT dept, rid, sum(tf) AS dl FROM post GROUP BY 1, 2),
stat AS (SELECT dept, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY 1), raw AS (SELECT dept, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN stat USING (dept) GROUP BY dept, term, n),
idf AS (SELECT dept, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY dept) ELSE raw END AS idf FROM raw),
ask AS (SELECT dept, query, unnest({_TOKENS.format(c="query")}) AS term FROM kinds), sc AS (SELECT a.dept, a.query, p.rid, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM ask a JOIN post p USING (dept, term) JOIN idf USING (dept, term) JOIN len USING (dept, rid) JOIN stat USING (dept) GROUP BY 1, 2, 3),
r AS (SELECT k.dept, k.query, pool.rid, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY k.dept, k.query ORDER BY round(coalesce(s, 0), 6) DESC, pool.rid) AS rank FROM kinds k JOIN pool USING (dept) LEFT JOIN sc ON sc.dept = k.dept AND sc.query = k.query AND sc.rid = pool.rid)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(rid AS INTEGER) AS rid FROM q JOIN r USING (dept, query) WHERE rank <= 3
""")
def pool_candidates(spark, d):
    """The three best rows of each request's own sheet and the common ones, by the statistics of that pool."""
    pick = lambda of, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(of) % len(values) + 1).cast("int"))
    asked = _t(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), pick("o_orderkey", "도로과", "하천과", "없는과").alias("dept"), pick("o_custkey", "도로 관리", "하천 정비 점검", "민원 처리 결과", "관리 계획 허가", "도로 점검 도로").alias("query"))
    table = _rows(spark, [(i, ("도로과", "하천과", "(공통) 관리")[i % 3], "업무", t, None, None) for i, t in enumerate(POOL_TEXTS)], "rid int, sheet string, `group` string, item string, amount_min bigint, amount_max bigint")
    return retrieval.candidates(asked, table, 3).select("query_id", "rank", "rid")


# ---------------------------------------------------------------- pages and drafts
@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 'top' WHEN o_orderkey % 4 = 1 THEN 'bottom' ELSE 'override' END AS kind, '기안:주무관:김철수|결재:총무과장:' || CASE WHEN o_custkey % 2 = 0 THEN '홍길동' ELSE '이몽룡' END || CASE WHEN o_orderkey % 4 = 1 THEN '|협조:재무과장:성춘향' ELSE '' END AS line FROM orders
""")
def approval_regions(spark, d):
    """Cells from recognised lines that hold several words each: at the top, below a bar at the bottom, and where an override says."""
    k = F.col("doc_id") % 4
    name = F.when(F.col("o_custkey") % 2 == 0, "홍길동").otherwise("이몽룡")
    at = F.when(k.isin(0, 3), 100.0).when(k == 1, 620.0).otherwise(400.0)
    box = lambda n, text, x, y, w, when=F.lit(True): F.when(when, F.struct(F.lit(n).alias("line_no"), text.alias("text"), F.lit(x).alias("x"), (1 - (y + 10.0) / 800.0).alias("y"), F.lit(w).alias("w"), F.lit(0.0125).alias("h")))
    bottom = k.isin(0, 3)
    # one line holds both titles, the next both names; at the top names stand below their titles, elsewhere beside them
    lines = F.array_compact(F.array(
        box(0, F.rpad(F.lit("주무관"), 40, " "), 0.1, at, 0.5), box(1, F.concat(F.lit("총무과장"), F.lit("      ")), 0.5, at, 0.25), box(2, F.lit("김철수"), F.lit(0.1 + 0.0), at + 20, 0.1, bottom), box(3, name, F.lit(0.52), at + 20, 0.1, bottom),
        box(4, F.lit("김철수"), F.lit(0.15), at, 0.1, ~bottom), box(5, name, F.lit(0.62), at, 0.1, ~bottom), box(6, F.lit("협조자 재무과장 성춘향"), F.lit(0.1), at + 20, 0.3, k == 1), box(7, F.lit("시행 도로과-1"), F.lit(0.1), at + 60, 0.3, k == 1), box(8, F.lit("소장 국장"), F.lit(0.1), at + 90, 0.3, k == 1),
    ))
    pages = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    region = {"x0": F.lit(0.0), "y0": F.lit(0.0), "width": F.lit(600.0), "height": F.lit(800.0)}
    words = layout.token_places(pages.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.*").withColumns(region)).withColumn("y", F.round("y", 3))
    sized = pages.select("doc_id", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    bars = sized.filter("doc_id % 4 = 1").select("doc_id", F.lit(0.0).alias("x0"), F.lit(605.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(610.0).alias("y1"))
    forced = sized.filter("doc_id % 4 = 2").select("doc_id", F.lit(0.45).alias("low"), F.lit(0.6).alias("high"))
    cells = layout.located_cells(sized, words, bars, forced)
    line = cells.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(":", "role", "title", "name").alias("c")))), lambda s: s["c"]), "|").alias("line"))
    return line.join(layout.approval_region(sized, words, bars, forced).select("doc_id", "kind"), "doc_id").select("doc_id", "kind", "line")


@query(f"""
WITH o AS ({_O}), t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 4 WHEN doc_id % 5 = 1 THEN 5 ELSE 7 END AS hits, doc_id % 5 < 2 AS first_bad FROM o)
SELECT count(*) AS cases, round(sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END) / (2.0 * count(*)), 3) AS section_recall, round(sum(hits) / (7.0 * count(*)), 3) AS keyphrase_recall, CAST(sum(CASE WHEN first_bad THEN 2 ELSE 0 END) AS BIGINT) AS retries, count(*) FILTER (WHERE doc_id % 5 = 1) AS leaks FROM t
""")
def best_drafts(spark, d):
    """Two drafts for each request, each with a second attempt: those that leak or miss the topic give way, the best is scored."""
    o = _orders(spark, d).select("doc_id")
    k, actual = F.col("doc_id") % 5, F.lit("1. 사업 개요\n도서관 도서관 이용자 안내문\n2. 추진 일정\n")
    title = F.lit("도서관 안내")
    # the first style: off topic, then thin (0), or leaking both times (1), or whole at once
    first = F.when(k == 0, "날씨가 좋다").when(k == 1, "도서관 본문: 그대로").otherwise("1. 사업 개요\n도서관 이용자 안내문\n2. 추진 일정")
    second = F.when(k == 0, "1. 사업 개요\n도서관 이용자").when(k == 1, "도서관 본문: 다시\n1. 사업 개요\n2. 추진 일정").otherwise("")
    other = F.when(k < 2, "없음").otherwise("도서관")
    again = F.when(k < 2, "도서관").otherwise("")
    attempts = o.select(F.col("doc_id").alias("req"), F.explode(F.array(F.struct(F.lit("a").alias("style"), F.lit(0).alias("ord"), first.alias("first"), second.alias("second")), F.struct(F.lit("b").alias("style"), F.lit(1).alias("ord"), other.alias("first"), again.alias("second")))).alias("x")).select("req", "x.*").withColumn("title", title)
    best = drafts.best_drafts(drafts.chosen_attempts(attempts), o.select(F.col("doc_id").alias("req"), actual.alias("body")))
    return drafts.draft_summary(best).drop("length_ratio_mean")


# ---------------------------------------------------------------- evaluations from end to end
@query(f"""
WITH {_LAYERED}, kept AS (SELECT doc_id, org AS grp FROM docs WHERE org IN (SELECT org FROM docs GROUP BY 1 HAVING count(*) >= 2)),
given AS (SELECT doc_id, role, pos, CASE WHEN doc_id % 3 = 0 THEN 'XX' ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN name ELSE 'n9' END AS name FROM cells WHERE doc_id % 5 > 0 OR role <> '기안'),
guess AS (
  SELECT 'baseline_copy' AS predictor, doc_id, role, pos, title, name FROM copied UNION ALL SELECT 'baseline_vote', doc_id, role, pos, title, name FROM voted UNION ALL SELECT 'layered[manual]', doc_id, role, pos, title, name FROM lines
  UNION ALL SELECT 'engine', doc_id, role, pos, title, name FROM given
  UNION ALL SELECT 'vote_titles+engine', v.doc_id, v.role, v.pos, v.title, coalesce(g.name, '') FROM voted v LEFT JOIN given g USING (doc_id, role, pos)
  UNION ALL SELECT 'vote_titles+engine', g.doc_id, g.role, g.pos, g.title, g.name FROM given g WHERE NOT EXISTS (SELECT 1 FROM voted v WHERE v.doc_id = g.doc_id AND v.role = g.role)),
who AS (SELECT DISTINCT predictor FROM guess), g AS (SELECT * FROM guess SEMI JOIN kept USING (doc_id)), c AS (SELECT predictor, cells.* FROM cells SEMI JOIN kept USING (doc_id) CROSS JOIN who),
j AS (SELECT coalesce(c.predictor, g.predictor) AS predictor, coalesce(c.doc_id, g.doc_id) AS doc_id, coalesce(c.role, g.role) AS role, coalesce(c.pos, g.pos) AS pos, c.title IS NOT NULL AS is_gold, g.title IS NOT NULL AS is_pred, coalesce(c.title = g.title, false) AS t, coalesce(c.name = g.name, false) AS n
  FROM c FULL JOIN g ON c.predictor = g.predictor AND c.doc_id = g.doc_id AND c.role = g.role AND c.pos = g.pos),
d AS (SELECT predictor, doc_id, count(*) FILTER (WHERE is_gold) AS gold, count(*) FILTER (WHERE t) AS ts, count(*) FILTER (WHERE is_gold AND n) AS ns,
  count(*) FILTER (WHERE is_gold AND role = '협조') AS cg, count(*) FILTER (WHERE is_pred AND role = '협조') AS cp, count(*) FILTER (WHERE t AND role = '협조') AS ch, max(CASE WHEN role = '검토' AND pos = 0 AND is_gold THEN CAST(t AS INT) END) AS fr,
  {" + ".join(f"CAST(count(*) FILTER (WHERE is_gold AND role = '{r}') = count(*) FILTER (WHERE is_pred AND role = '{r}') AS INT)" for r in ("기안", "검토", "결재", "협조"))} AS even FROM j GROUP BY 1, 2),
s AS (SELECT who.predictor, grp, coalesce(cg, 0) AS cg, coalesce(cp, 0) AS cp, coalesce(ch, 0) AS ch, fr, CASE WHEN gold > 0 THEN ts / gold ELSE 0 END AS tm, CASE WHEN gold > 0 THEN ns / gold ELSE 0 END AS nm, coalesce(even, 4) / 4 AS cm
  FROM kept CROSS JOIN who LEFT JOIN d ON d.predictor = who.predictor AND d.doc_id = kept.doc_id)
SELECT predictor, coalesce(grp, -1) AS grp, count(*) AS cases, round(avg(tm), 8) AS title_match_mean, round(avg(nm), 8) AS name_match_mean, round(avg(cm), 8) AS count_match_mean, count(*) FILTER (WHERE tm = 1) AS title_perfect, CAST(sum(cg) AS BIGINT) AS coop_gold_cells,
  CAST(sum(ch) AS BIGINT) AS coop_cell_hits, CAST(sum(greatest(cp - cg, 0)) AS BIGINT) AS coop_extra_cells, count(*) FILTER (WHERE cg = cp AND ch = cg) AS coop_case_exact, count(*) FILTER (WHERE fr = 1) AS first_review_ok, count(fr) AS first_review_scored FROM s GROUP BY GROUPING SETS ((predictor), (predictor, grp))
""")
def prediction_report(spark, d):
    """Five predictors, one of them supplied and one made with it, over all documents of groups of two or more."""
    docs, cells = _titled(spark, d)
    given = cells.filter("doc_id % 5 > 0 or role <> '기안'").withColumns({"title": F.when(F.col("doc_id") % 3 == 0, "XX").otherwise(F.col("title")), "name": F.when(F.col("doc_id") % 4 == 0, F.col("name")).otherwise("n9")})
    cases, _ = tracks.prediction_cases(docs.withColumn("dept", F.lit("")), cells, {"manual": _layered_bundles(spark)}, {"engine": given}, ["없는이름"], compose=False)
    return tracks.prediction_summary(cases, digits=8).withColumn("grp", F.coalesce(F.col("grp").cast("bigint"), F.lit(-1).cast("bigint")))


_ROUNDS = 2


@query(f"""
WITH {_VOTED.replace("o_custkey AS org", "o_custkey % 400 AS org").replace("pairs AS (SELECT a.doc_id AS target, b.doc_id, b.date FROM docs a JOIN docs b ON a.org = b.org AND a.doc_id <> b.doc_id)", f'''ring AS (SELECT r.range AS round, docs.*, row_number() OVER (PARTITION BY r.range, org ORDER BY md5('draw:0:' || r.range || ':' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY r.range, org) AS m FROM docs, range({_ROUNDS}) r),
pairs AS (SELECT a.round * 100000000 + a.doc_id AS target, b.doc_id, b.date FROM ring a JOIN ring b ON a.round = b.round AND a.org = b.org AND a.m > 5 AND (b.i - a.i + a.m) % a.m BETWEEN 1 AND 5)''')},
asked AS (SELECT DISTINCT target, target // 100000000 AS round, target % 100000000 AS doc_id FROM pairs),
j AS (SELECT a.round, a.target, coalesce(v.title = c.title, false) AS t, coalesce(v.name = c.name, false) AS n FROM asked a JOIN cells c ON c.doc_id = a.doc_id LEFT JOIN voted v ON v.doc_id = a.target AND v.role = c.role AND v.pos = c.pos),
s AS (SELECT a.round, a.target, coalesce(count(*) FILTER (WHERE t) / nullif(count(j.target), 0), 0) AS tm, coalesce(count(*) FILTER (WHERE n) / nullif(count(j.target), 0), 0) AS nm FROM asked a LEFT JOIN j USING (target) GROUP BY 1, 2)
SELECT CAST(round AS INTEGER) AS round, count(*) AS cases, round(avg(tm), 6) AS title_mean, round(avg(nm), 6) AS name_mean FROM s GROUP BY 1
""")
def resampled_votes(spark, d):
    """The vote's scores on five references drawn anew in each round."""
    docs, cells = _docs_cells(spark, d)
    got = predict.robustness(docs.withColumn("org", F.col("org") % 400), cells, _ROUNDS, compose=False)
    return got.groupBy("round").agg(F.count("*").alias("cases"), F.round(F.avg("title_match"), 6).alias("title_mean"), F.round(F.avg("name_match"), 6).alias("name_mean"))


def _gold_lines(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their lines, and rows that are right: the line reaches level 2 to 5, with or without a team's lead."""
    q = _requests(spark, d).filter("dept in ('도로과', '행정과', '감사담당관')").withColumn("top", (F.col("req") % 4 + 2).cast("int"))
    lead = F.when(F.col("req") % 5 < 3, F.when(F.col("dept") == "도로과", "도로팀장").otherwise("총무 팀장"))
    cell = lambda role, title, when, note="": F.when(when, F.struct(F.lit(role).alias("role"), title.alias("title"), F.lit(note).alias("note")))
    up = F.element_at(F.array(F.lit("x"), F.lit("x"), F.when(F.col("dept") == "감사담당관", F.col("dept")).otherwise(F.concat("dept", F.lit("장"))), F.lit("국장"), F.lit("부군수"), F.lit("군수")), F.col("top") + 1)
    notes = F.col("req") % 7 == 0
    made = F.array_compact(F.array(cell("기안", F.lit("주무관"), F.lit(True)), cell("검토", lead, lead.isNotNull()), cell("결재", up, ~notes), cell("결재", up, notes, "권한대행"), cell("협조", F.lit("전산팀장"), F.col("req") % 2 == 0)))
    gold = q.select(F.col("req").alias("doc_id"), F.posexplode(made).alias("pos", "c")).select("doc_id", "pos", "c.*")
    docs = q.select(F.col("req").alias("doc_id"), _n("req").alias("doc_no"), "dept", "day", "title", F.concat_ws("\n", "body", F.array_join("attachments", "\n")).alias("body"))
    return docs, gold, docs.select("doc_no", F.array(F.lit(0), F.lit(7)).alias("rids"))


@query(f"""
WITH {_REQUESTS}, x AS (SELECT f.*, CAST(req % 4 + 2 AS INT) AS top, CASE WHEN req % 5 < 3 THEN CASE WHEN dept = '도로과' THEN '도로팀장' ELSE '총무 팀장' END END AS boss, req % 7 = 0 AS amb FROM f WHERE dept IN ('도로과', '행정과', '감사담당관')),
gold AS (SELECT req, 0 AS o, '주무관' AS title FROM x UNION ALL SELECT req, 1, boss FROM x WHERE boss IS NOT NULL UNION ALL SELECT req, 2, CASE top WHEN 2 THEN head WHEN 3 THEN '국장' WHEN 4 THEN '부군수' ELSE '군수' END FROM x),
g AS (SELECT req, row_number() OVER (PARTITION BY req ORDER BY o) AS i, title FROM gold),
m AS (SELECT 'path_no_acting' AS mode, req, day, dept, bureau, head, boss, top AS up, false AS act FROM x UNION ALL SELECT 'path_acting', req, day, dept, bureau, head, boss, top, true FROM x UNION ALL SELECT 'agent', req, day, dept, bureau, head, boss, coalesce(level, 5), true FROM x),
s AS (
  SELECT mode, req, 0 AS o, '주무관' AS title FROM m UNION ALL SELECT mode, req, 1, boss FROM m WHERE boss IS NOT NULL AND up >= 1 UNION ALL SELECT mode, req, 2, head FROM m WHERE up >= 2 UNION ALL SELECT mode, req, 3, bureau || '장' FROM m WHERE up >= 3 AND bureau IS NOT NULL
  UNION ALL SELECT mode, req, 4, CASE WHEN act AND day >= '1998-01-01' THEN '행정안전국장' ELSE '부군수' END FROM m WHERE up >= 4 AND dept <> '감사담당관' AND NOT (act AND up = 5 AND day BETWEEN '1996-01-01' AND '1997-06-30') UNION ALL SELECT mode, req, 5, '군수' FROM m WHERE up >= 5),
l AS (SELECT *, lag(title) OVER (PARTITION BY mode, req ORDER BY o) AS before FROM s), p AS (SELECT mode, req, row_number() OVER (PARTITION BY mode, req ORDER BY o) AS i, title FROM l WHERE before IS NULL OR before <> title),
pw AS (SELECT mode, coalesce(p.req, g.req) AS req, p.title AS pt, g.title AS gt FROM p FULL JOIN (SELECT mode, g.* FROM g CROSS JOIN (SELECT DISTINCT mode FROM m)) g USING (mode, req, i)),
a AS (SELECT mode, req, count(*) FILTER (WHERE pt = gt) / count(*) AS acc, count(*) FILTER (WHERE pt = gt) = count(*) AS exact, count(pt) = count(gt) AS even FROM pw GROUP BY 1, 2),
k AS (SELECT mode, round(avg(acc), 4) AS acc, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE even) AS even FROM a GROUP BY 1),
v AS (SELECT x.*, CASE WHEN level IS NULL THEN 'unknown' WHEN (amb AND level IN (4, 5)) OR (NOT amb AND level = top) THEN 'same' WHEN level < CASE WHEN amb THEN 4 ELSE top END THEN 'escalated' ELSE 'violation' END AS verdict, CASE WHEN branch = 'row_search' THEN CASE WHEN dept = '행정과' THEN false WHEN dept = '도로과' AND title LIKE '하천%' THEN false ELSE true END END AS pick FROM x)
SELECT count(*) AS documents, count(*) AS path_docs, count(*) FILTER (WHERE verdict = 'same') AS same, count(*) FILTER (WHERE verdict = 'escalated') AS escalated, count(*) FILTER (WHERE verdict = 'violation') AS violation, count(*) FILTER (WHERE verdict = 'unknown') AS "unknown",
  count(*) FILTER (WHERE level >= 4) AS decidable, count(*) FILTER (WHERE level >= 4 AND verdict = 'same') AS decidable_correct, count(pick) AS labelled, count(pick) AS candidate_recall, count(*) FILTER (WHERE pick) AS pick_correct,
  count(*) FILTER (WHERE boss IS NOT NULL AND dept <> '감사담당관') AS team_cases, count(*) FILTER (WHERE boss IS NOT NULL AND dept <> '감사담당관') AS team_correct,
  {", ".join(f"(SELECT acc FROM k WHERE mode = '{m}') AS {m}_accuracy, (SELECT exact FROM k WHERE mode = '{m}') AS {m}_exact, (SELECT even FROM k WHERE mode = '{m}') AS {m}_count_match" for m in ("path_no_acting", "path_acting", "agent"))} FROM v
""")
def delegation_report(spark, d):
    """Final levels, lines three ways, rows and teams found by the published rules, against gold lines."""
    docs, gold, rids = _gold_lines(spark, d)
    duties = _rows(spark, [("도로과", 1, "도로팀", "도로 하천 청사"), ("행정과", 1, "총무팀", "도로 청사 물품 민원 하천"), ("행정과", 2, "민원팀", "가")], "dept string, ord int, team string, duties string")
    return tracks.delegation_summary(tracks.delegation_cases(docs, gold, rids, _published(spark), duties))


# ---------------------------------------------------------------- documents and their gold
def _portal(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata, files that are there, and gold rows, made of customers and their orders' lines."""
    o = _t(spark, d, "orders")
    meta = o.select(F.col("o_orderkey").alias("row_no"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file"), F.concat("o_orderpriority", F.lit(" 계획")).alias("title"))
    files = o.filter("o_orderkey % 7 > 0").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file"))
    lines = _t(spark, d, "lineitem").filter("l_orderkey % 5 > 0")
    none = F.col("l_orderkey") % 11 == 0
    gold = lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("file"), F.concat(F.lit("org"), (F.col("l_linenumber") % 3).cast("string")).alias("org"),
        F.when(F.col("l_returnflag") == "R", "결재").otherwise("검토").alias("role"), F.when(none, "-").otherwise(F.col("l_linestatus")).alias("title"), F.when(none, "-").otherwise(F.col("l_returnflag")).alias("name"), F.lit("").alias("note"),
    )
    return meta, files, gold.groupBy("row_no", "file").agg(*[F.min_by(c, F.struct("role", "title", "name", "org")).alias(c) for c in ("org", "role", "title", "name", "note")])


@query("""
WITH meta AS (SELECT o_orderkey AS k, o_orderpriority || ' 계획' AS title FROM orders), here AS (SELECT * FROM meta WHERE k % 7 > 0 ORDER BY k LIMIT 1000),
raw AS (SELECT l_orderkey AS k, l_linenumber AS n, 'org' || l_linenumber % 3 AS org, CASE WHEN l_returnflag = 'R' THEN '결재' ELSE '검토' END AS role, CASE WHEN l_orderkey % 11 = 0 THEN '-' ELSE l_linestatus END AS title, CASE WHEN l_orderkey % 11 = 0 THEN '-' ELSE l_returnflag END AS name FROM lineitem WHERE l_orderkey % 5 > 0),
g AS (SELECT k, n, min_by(org, struct_pack(a := role, b := title, c := name, d := org)) AS org, min_by(title, struct_pack(a := role, b := title, c := name, d := org)) AS title, min_by(role, struct_pack(a := role, b := title, c := name, d := org)) AS role, min_by(name, struct_pack(a := role, b := title, c := name, d := org)) AS name FROM raw GROUP BY 1, 2),
o AS (SELECT k, arg_max(org, n) AS org FROM g GROUP BY 1), t AS (SELECT k, string_agg(title, '+' ORDER BY CASE role WHEN '검토' THEN 1 ELSE 2 END, n) AS titles, count(*) AS cells FROM g WHERE NOT (title = '-' AND name = '-') GROUP BY 1)
SELECT 'f' || h.k AS doc_id, o.org, '계획' AS doc_type, CAST(coalesce(cells, 0) AS INTEGER) AS gold_cell_count, coalesce(titles, '') AS gold_titles, (SELECT count(*) FROM meta WHERE k % 7 = 0 AND k < (SELECT max(k) FROM here)) AS skipped FROM here h JOIN o USING (k) LEFT JOIN t USING (k)
""")
def document_cards(spark, d):
    """The first thousand documents whose files are there, of those that gold knows: organisation, type and titles of the line."""
    meta, files, gold = _portal(spark, d)
    kept, skipped = documents.collected(meta, files, 1000)
    known, cells = documents.with_gold(kept, gold)
    typed = documents.with_types(known.drop("org"), gold).withColumns({"doc_no": F.lit(""), "date": F.lit(""), "dept": F.lit(""), "page_count": F.lit(1), "body": F.lit("")})
    shown = documents.cards(typed, cells).select("doc_id", "org", "doc_type", "gold_cell_count", F.array_join("gold_titles", "+").alias("gold_titles"))
    return shown.withColumn("skipped", F.lit(skipped.count()))


@query(f"""
WITH {_REQUESTS}, c AS (SELECT * FROM w WHERE org IS NOT NULL),
e AS (SELECT *, CASE WHEN org = 'F' THEN '관장' WHEN kind = '계약·검사' THEN '국장' WHEN amount <= 100000 THEN '과장' ELSE '관장' END AS fin, CASE WHEN org = 'O' AND title LIKE '%도서%' THEN '자료팀장' WHEN org = 'O' AND title LIKE '%공연%' THEN '운영팀장' END AS team FROM c),
hit AS (SELECT e.*, CASE WHEN org IN ('O', 'F') THEN 1 + CAST(fin = '관장' AS INT) ELSE 0 END AS hits, CASE WHEN org IN ('O', 'F') THEN CAST(coalesce(team, CASE WHEN org = 'O' AND kind = '계약·검사' THEN '회계팀장' WHEN org = 'O' AND fin <> '과장' THEN '과장' END) = '자료팀장' AS INT) ELSE 0 END AS rev,
  CASE WHEN org IN ('O', 'F') THEN 1 ELSE 0 END AS ruled, CASE WHEN org = 'O' THEN CAST(team IS NOT NULL AS INT) + CAST(kind = '계약·검사' AS INT) + CAST(fin <> '과장' AS INT) ELSE 0 END AS reviewers FROM e),
s AS (SELECT kind = '계약·검사' AS ok, (hits + coalesce(rev, 0)) / 3 AS tm, (CASE WHEN ruled = 1 THEN 2 ELSE 0 END + CAST(reviewers = 1 AS INT) + CAST(NOT (org = 'O' AND title LIKE '%전산%') AS INT)) / 4 AS cm FROM hit)
SELECT count(*) AS documents, round(avg(CAST(ok AS INT)), 4) AS work_type_accuracy, round(avg(tm), 4) AS title_accuracy, 0.0::DOUBLE AS name_accuracy, round(avg(cm), 4) AS count_accuracy, count(*) FILTER (WHERE tm = 1) AS title_perfect FROM s
""")
def ruled_lines_report(spark, d):
    """Lines that bundles of rules make, against gold that says the same of every document."""
    handled = _handled(spark, d).filter(F.col("branch") == requests.INDUCED)
    docs = handled.select(F.col("req").alias("doc_id"))
    gold = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(0).alias("pos"), F.lit(t).alias("title"), F.lit("아무개").alias("name")) for r, t in (("기안", "주무관"), ("검토", "자료팀장"), ("결재", "관장"))])).alias("c")).select("doc_id", "c.*")
    return tracks.ruled_summary(tracks.ruled_cases(docs, gold, handled, docs.withColumn("gold", F.lit("계약·검사")), compose=False)).drop("needs_mean")


@query("""
WITH k AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS doc_pages, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r, role, turn) AS p FROM k WHERE r <= 4) SELECT conv_id, turn, role, doc_pages FROM p WHERE p <= 4
""")
def turns_by_role(spark, d):
    """Up to four turns of each conversation, by turns over the roles."""
    c = _t(spark, d, "conversations").withColumn("doc_pages", F.count("*").over(Window.partitionBy("conv_id")))
    return sampling.round_robin_within(c, ["conv_id"], "role", "turn", 4).select("conv_id", "turn", "role", "doc_pages")


@query("""
WITH l AS (SELECT doc_id, page, lines FROM (SELECT doc_id, string_split(text, chr(10)) AS all_lines, unnest(range(0, (len(string_split(text, chr(10))) + 19) // 20)) AS page FROM documents), LATERAL (SELECT [trim(x) FOR x IN all_lines[page * 20 + 1 : page * 20 + 20] IF trim(x) <> ''] AS lines)),
s AS (SELECT doc_id, page, len(lines) AS n, CASE WHEN len(lines) > 0 THEN len([x FOR x IN lines IF length(x) < 20]) / len(lines) ELSE 0 END AS short FROM l)
SELECT doc_id, CAST(page + 1 AS INTEGER) AS page_no, CASE WHEN n >= 10 AND short >= 0.6 THEN 'table' ELSE 'body_1col' END AS page_type, round(short, 4) AS short_line_ratio, CAST(n AS INTEGER) AS lines, count(*) OVER (PARTITION BY doc_id) AS doc_pages FROM s
""")
def document_pages(spark, d):
    """Documents cut into pages of twenty lines, with the type and figures of each page."""
    docs = _t(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") + 19) / 20).cast("int") - 1), lambda i: F.array_join(F.slice("ls", i * 20 + 1, F.lit(20)), "\n"))
    pages = docs.select("doc_id", F.posexplode(cut).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page_no"), "text")
    return documents.page_table(pages).select("doc_id", "page_no", "page_type", "short_line_ratio", "lines", "doc_pages")
