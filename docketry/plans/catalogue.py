"""All registered queries of the document-analytics operators, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import extract, masking, text
from docketry.operators import evaluate, history, retrieval, rules, sampling

FLAGSHIP = "bm25_self_at_k"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- rules
BANDS = [(0, None, 50_000.0, "team"), (1, 50_000.0, 150_000.0, "section"), (2, 150_000.0, 300_000.0, "division"), (3, 300_000.0, None, "head")]


@query("""
SELECT coalesce(CASE WHEN o_totalprice <= 50000 THEN 'team' WHEN o_totalprice <= 150000 THEN 'section' WHEN o_totalprice <= 300000 THEN 'division' WHEN o_totalprice > 300000 THEN 'head' END, 'none') AS level,
       count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def amount_band_lookup(spark, d):
    bands = _rows(spark, BANDS, "rid int, amount_min double, amount_max double, level string")
    found = rules.band(_t(spark, d, "orders"), bands, "o_totalprice")
    return found.groupBy(F.coalesce("band.level", F.lit("none")).alias("level")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


RULES = [
    ("1-URGENT", 1, ["F"], None, 100_000.0, "lead"), ("1-URGENT", 2, None, 200_000.0, None, "director"), ("2-HIGH", 1, ["O", "P"], None, None, "manager"),
    ("2-HIGH", 2, None, 250_000.0, 400_000.0, "director"), ("3-MEDIUM", 1, ["F", "O"], None, 300_000.0, "lead"),
]
FALLBACK = [("1-URGENT", "manager"), ("2-HIGH", "clerk"), ("3-MEDIUM", "clerk")]


@query("""
WITH r(org, priority, types, lo, hi, title) AS (VALUES ('1-URGENT', 1, ['F'], NULL::DOUBLE, 100000::DOUBLE, 'lead'), ('1-URGENT', 2, NULL, 200000, NULL, 'director'), ('2-HIGH', 1, ['O', 'P'], NULL, NULL, 'manager'),
  ('2-HIGH', 2, NULL, 250000, 400000, 'director'), ('3-MEDIUM', 1, ['F', 'O'], NULL, 300000, 'lead')),
f(org, title) AS (VALUES ('1-URGENT', 'manager'), ('2-HIGH', 'clerk'), ('3-MEDIUM', 'clerk')),
h AS (SELECT o_orderkey, arg_min(r.title, r.priority) AS hit FROM orders JOIN r ON r.org = o_orderpriority AND (types IS NULL OR list_contains(types, o_orderstatus))
  AND (lo IS NULL OR o_totalprice >= lo) AND (hi IS NULL OR o_totalprice <= hi) GROUP BY 1)
SELECT o_orderkey, coalesce(hit, f.title) AS final_title, CASE WHEN hit IS NOT NULL THEN 'rule' WHEN f.title IS NOT NULL THEN 'fallback' ELSE 'none' END AS rule_source
FROM orders LEFT JOIN h USING (o_orderkey) LEFT JOIN f ON f.org = o_orderpriority
""")
def priority_rule_fallback(spark, d):
    table = _rows(spark, RULES, "org string, priority int, work_types array<string>, amount_min double, amount_max double, final_title string")
    rest = _rows(spark, FALLBACK, "org string, final_title string")
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("org"), F.col("o_orderstatus").alias("work_type"), F.col("o_totalprice").alias("amount"))
    return rules.delegate(rows, table, rest).select("o_orderkey", "final_title", "rule_source")


SPELLS = [("1-URGENT", "kim", None, "1996-06-30", "replace"), ("1-URGENT", "lee", "1996-01-01", "1998-12-31", "annotate"), ("2-HIGH", "park", "1997-01-01", None, "replace"), ("5-LOW", "choi", "1995-05-05", "1995-05-05", "replace")]


@query("""
WITH s(slot, by_, f, t, mode) AS (VALUES ('1-URGENT', 'kim', NULL::DATE, DATE '1996-06-30', 'replace'), ('1-URGENT', 'lee', DATE '1996-01-01', DATE '1998-12-31', 'annotate'),
  ('2-HIGH', 'park', DATE '1997-01-01', NULL, 'replace'), ('5-LOW', 'choi', DATE '1995-05-05', DATE '1995-05-05', 'replace')),
h AS (SELECT o_orderkey, by_, mode, row_number() OVER (PARTITION BY o_orderkey ORDER BY f NULLS FIRST, by_) AS n FROM orders JOIN s ON slot = o_orderpriority AND (f IS NULL OR CAST(o_orderdate AS DATE) >= f) AND (t IS NULL OR CAST(o_orderdate AS DATE) <= t))
SELECT o_orderkey, by_ AS acting_by, mode AS acting_mode FROM orders LEFT JOIN (SELECT * FROM h WHERE n = 1) USING (o_orderkey)
""")
def acting_interval_join(spark, d):
    spells = _rows(spark, SPELLS, "slot string, by string, f string, t string, mode string").select("slot", "by", F.col("f").cast("date").alias("from_date"), F.col("t").cast("date").alias("to_date"), "mode")
    slots = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slot"), F.to_date("o_orderdate").alias("day"))
    return rules.acting(slots, spells).select("o_orderkey", F.col("acting.by").alias("acting_by"), F.col("acting.mode").alias("acting_mode"))


@query("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq FROM a),
c AS (SELECT user_id, seq, min(event_type) AS event_type, string_agg(CAST(event_id AS VARCHAR), '+' ORDER BY event_id) AS ids, count(*) AS n FROM b GROUP BY 1, 2)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY user_id) = 1 THEN '기안' WHEN row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1 THEN '기안'
  WHEN row_number() OVER (PARTITION BY user_id ORDER BY seq) = count(*) OVER (PARTITION BY user_id) THEN '결재' ELSE '검토' END AS role FROM c
""")
def org_chain_merge(spark, d):
    rows = _t(spark, d, "events").select("user_id", "event_id", "event_type", F.col("event_id").cast("string").alias("ids"))
    return rules.role_by_place(rules.merge_equal(rows, ["user_id"], "event_id", "event_type", "ids").drop("first"), ["user_id"], "seq")


@query("""
SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN '기안' WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN '기안'
  WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = count(*) OVER (PARTITION BY conv_id) THEN '결재' ELSE '검토' END AS role FROM conversations
""")
def role_by_position(spark, d):
    return rules.role_by_place(_t(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


TEAMS = [("en", 0, "health", ["the", "and"]), ("en", 1, "roads", ["token", "er"]), ("fr", 0, "eau", ["eau", "ment"]), ("de", 0, "amt", ["keit", "zqx"]), ("es", 0, "nada", ["zqx"])]


@query("""
WITH t(org, ord, team, ks) AS (VALUES ('en', 0, 'health', ['the', 'and']), ('en', 1, 'roads', ['token', 'er']), ('fr', 0, 'eau', ['eau', 'ment']), ('de', 0, 'amt', ['keit', 'zqx']), ('es', 0, 'nada', ['zqx'])),
k AS (SELECT doc_id, ord, team, unnest(ks) AS k, split_part(text, chr(10), 1) AS title, substr(text, 1, 1500) AS body FROM documents JOIN t ON t.org = lang),
s AS (SELECT doc_id, ord, team, CAST(sum(CASE WHEN contains(title, k) THEN 3 WHEN contains(body, k) THEN 1 ELSE 0 END) AS INTEGER) AS score FROM k GROUP BY 1, 2, 3),
b AS (SELECT doc_id, max(score) AS best FROM s GROUP BY 1)
SELECT doc_id, CASE WHEN best > 0 THEN arg_min(team, ord) END AS team, best AS score, best > 0 AND count(*) > 1 AS tied FROM b JOIN s USING (doc_id) WHERE score = best GROUP BY doc_id, best
""")
def route_team(spark, d):
    teams = _rows(spark, TEAMS, "org string, ord int, lead string, keywords array<string>")
    docs = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("org"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"))
    return rules.pick_team(docs, teams)


@query("""
WITH c AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 1 END AS g,
  CASE WHEN o_totalprice > 400000 THEN 5 WHEN o_totalprice > 250000 THEN 4 WHEN o_totalprice > 100000 THEN 3 ELSE 1 END AS p FROM orders),
v AS (SELECT CASE WHEN g IS NULL OR p IS NULL THEN 'unknown' WHEN g = p THEN 'same' WHEN p > g THEN 'escalated' ELSE 'violation' END AS verdict FROM c)
SELECT verdict, count(*) AS n FROM v GROUP BY 1
""")
def final_verdicts(spark, d):
    gold = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 4).when(F.col("o_orderpriority") == "3-MEDIUM", 3).when(F.col("o_orderpriority") == "5-LOW", 1)
    p = F.col("o_totalprice")
    pred = F.when(p > 400000, 5).when(p > 250000, 4).when(p > 100000, 3).otherwise(1)
    rows = _t(spark, d, "orders").select(gold.alias("gold_level"), pred.alias("pred_level"))
    return evaluate.final_verdict(rows).groupBy("verdict").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- history
_ORDERS = ["o_orderdate", "o_orderkey"]


@query("""
WITH g AS (SELECT * FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)),
p AS (SELECT a.o_orderkey, b.o_orderpriority AS v, count(*) AS c, max(struct_pack(d := b.o_orderdate, k := b.o_orderkey)) AS r FROM g a JOIN g b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1, 2),
w AS (SELECT o_orderkey, v, c, row_number() OVER (PARTITION BY o_orderkey ORDER BY c DESC, r DESC) AS n FROM p)
SELECT o_orderkey, v AS voted, c AS votes FROM w WHERE n = 1
""")
def vote_leave_one_out(spark, d):
    rows = history.grouped_at_least(_t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority"), "o_custkey")
    return history.vote_without_self(rows, ["o_custkey"], "o_orderpriority", *_ORDERS).select("o_orderkey", "voted", F.col("votes").cast("long").alias("votes"))


@query("""
SELECT a.o_orderkey, (SELECT b.o_orderstatus FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey ORDER BY b.o_orderdate DESC, b.o_orderkey DESC LIMIT 1) AS copied FROM orders a
""")
def copy_latest(spark, d):
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return history.copy_latest_other(rows, "o_custkey", "o_orderstatus", *_ORDERS).select("o_orderkey", "copied")


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS r FROM orders GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, r DESC) AS k FROM c)
SELECT o_custkey, v AS o_orderpriority, n AS votes FROM w WHERE k = 1
""")
def mode_recent_tie(spark, d):
    return history.mode(_t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", *_ORDERS)


def _sweep_sql(k: int) -> str:
    return f"""SELECT CAST({k} AS INTEGER) AS size, count(*) AS cases, count(*) FILTER (WHERE own = v) AS hits FROM (
      SELECT k1, own, v, row_number() OVER (PARTITION BY k1 ORDER BY c DESC, best) AS z FROM (
        SELECT k1, own, v, count(*) AS c, min(n2) AS best FROM (
          SELECT a.o_orderkey AS k1, a.o_orderpriority AS own, b.o_orderpriority AS v, b.n AS n2, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.n) AS i
          FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.n <> b.n AND b.n <= 8 WHERE a.m >= 8) WHERE i <= {k} GROUP BY 1, 2, 3)) WHERE z = 1"""


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)
{_sweep_sql(1)} UNION ALL {_sweep_sql(3)} UNION ALL {_sweep_sql(7)}
""")
def ref_sweep(spark, d):
    return history.reference_sweep(_t(spark, d, "orders"), "o_custkey", "o_orderpriority", [1, 3, 7], *_ORDERS)


_INDUCED = """SELECT o_orderpriority AS org, o_orderstatus AS work_type, c_mktsegment AS final_title, count(*) AS n, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey {where} GROUP BY 1, 2, 3"""


@query(f"""
WITH c AS ({_INDUCED.format(where='')}), w AS (SELECT *, row_number() OVER (PARTITION BY org, work_type ORDER BY n DESC, r DESC) AS k, sum(n) OVER (PARTITION BY org, work_type) AS seen FROM c)
SELECT org, work_type, final_title, n AS votes, CAST(seen AS BIGINT) AS seen FROM w WHERE k = 1
""")
def induce_rules(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("org"), F.col("o_orderstatus").alias("work_type"), "c_mktsegment", *_ORDERS)
    return history.induce_final(rows, "org", "work_type", "c_mktsegment", *_ORDERS)


@query(f"""
WITH a AS ({_INDUCED.format(where="WHERE o_orderdate < TIMESTAMP '1998-04-01'")}), b AS ({_INDUCED.format(where="WHERE o_orderdate >= TIMESTAMP '1998-04-01'")}),
x AS (SELECT org, work_type, arg_max(final_title, struct_pack(n := n, r := r)) AS t FROM a GROUP BY 1, 2), y AS (SELECT org, work_type, arg_max(final_title, struct_pack(n := n, r := r)) AS t FROM b GROUP BY 1, 2)
SELECT org, work_type, x.t AS a_value, y.t AS b_value, CASE WHEN y.t IS NULL THEN 'only_a' WHEN x.t IS NULL THEN 'only_b' WHEN x.t = y.t THEN 'same' ELSE 'differs' END AS status FROM x FULL JOIN y USING (org, work_type)
""")
def rules_diff(spark, d):
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderpriority").alias("org"), F.col("o_orderstatus").alias("work_type"), "c_mktsegment", *_ORDERS)
    half = F.lit("1998-04-01").cast("timestamp_ntz")
    learn = lambda part: history.induce_final(part, "org", "work_type", "c_mktsegment", *_ORDERS)
    return evaluate.rules_diff(learn(rows.filter(F.col("o_orderdate") < half)), learn(rows.filter(F.col("o_orderdate") >= half)), ["org", "work_type"], "final_title")


_LETTERS = r"[a-zà-öø-ÿ]{4,}"


@query(f"""
WITH e AS (SELECT lang, source, unnest(list_distinct(regexp_extract_all(lower(text), '{_LETTERS}'))) AS word FROM documents),
n AS (SELECT lang, source, word, count(*) AS n FROM e GROUP BY 1, 2, 3), s AS (SELECT lang, word FROM n GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT n.lang, source, n.word, n, row_number() OVER (PARTITION BY n.lang, source ORDER BY n DESC, n.word) AS rank FROM n JOIN s ON n.lang = s.lang AND n.word = s.word)
SELECT lang, source, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12
""")
def exclusive_words(spark, d):
    docs = _t(spark, d, "documents").select("lang", "source", F.regexp_extract_all(F.lower("text"), F.lit(f"({_LETTERS})"), F.lit(1)).alias("words"))
    return history.exclusive_words(docs, "lang", "source", "words")


@query("""
WITH l AS (SELECT o_orderpriority AS org, o_orderstatus AS title, CAST(o_custkey AS VARCHAR) AS name, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS r FROM orders GROUP BY 1, 2, 3)
SELECT org, title, name, CAST(row_number() OVER (PARTITION BY org, title ORDER BY r DESC, name) AS INTEGER) AS rank FROM l
""")
def roster_recency(spark, d):
    cells = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("org"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").cast("string").alias("name"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("doc_no"))
    return rules.roster_by_recency(cells)


# ---------------------------------------------------------------- evaluation
@query("""
WITH g AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos, split_part(text, ' ', 1) AS gt, CASE WHEN turn % 5 = 4 THEN '?' ELSE split_part(text, ' ', 2) END AS gn FROM conversations),
q AS (SELECT conv_id, role, text, turn FROM conversations WHERE turn % 3 <> 2),
p AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos, split_part(text, ' ', 1) AS pt, split_part(text, ' ', 2) AS pn FROM q),
n AS (SELECT g.conv_id, regexp_replace(gt, '[\\s()\\[\\]·.\\-]', '', 'g') = regexp_replace(pt, '[\\s()\\[\\]·.\\-]', '', 'g') AS t, gn <> '?' AS readable, regexp_replace(gn, '[\\s()\\[\\]·.\\-]', '', 'g') = regexp_replace(pn, '[\\s()\\[\\]·.\\-]', '', 'g') AS n
  FROM g LEFT JOIN p ON g.conv_id = p.conv_id AND g.role = p.role AND g.pos = p.pos),
d AS (SELECT conv_id, count(*) AS c, count(*) FILTER (WHERE t) AS ts, count(*) FILTER (WHERE readable) AS rs, count(*) FILTER (WHERE readable AND n) AS ns FROM n GROUP BY 1),
s AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(*) FILTER (WHERE coalesce(a.c, 0) <> coalesce(b.c, 0)) AS wrong FROM (SELECT conv_id, role, count(*) AS c FROM g GROUP BY 1, 2) a FULL JOIN (SELECT conv_id, role, count(*) AS c FROM p GROUP BY 1, 2) b ON a.conv_id = b.conv_id AND a.role = b.role GROUP BY 1)
SELECT conv_id AS doc_id, ts / c AS title_match, CASE WHEN rs > 0 THEN ns / rs ELSE 0.0::DOUBLE END AS name_match, (3 - coalesce(wrong, 0)) / 3 AS count_match, c AS gold_cells, rs AS scored_names FROM d LEFT JOIN s USING (conv_id)
""")
def approval_match_eval(spark, d):
    from pyspark.sql import Window

    turns = _t(spark, d, "conversations").withColumn("doc_id", F.col("conv_id"))
    pos = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) - 1
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    gold = turns.select("doc_id", "role", pos.alias("pos"), word(1).alias("title"), F.when(F.col("turn") % 5 == 4, "?").otherwise(word(2)).alias("name"))
    pred = turns.filter("turn % 3 <> 2").select("doc_id", "role", pos.alias("pos"), word(1).alias("title"), word(2).alias("name"))
    return evaluate.approval_match(turns, gold, pred, roles=("system", "user", "assistant"))


@query("""
WITH g AS (SELECT conv_id, turn AS pos, role AS t FROM conversations), p AS (SELECT conv_id, turn - 1 AS pos, role AS t FROM conversations WHERE turn > 0)
SELECT coalesce(g.conv_id, p.conv_id) AS doc_id, count(*) FILTER (WHERE coalesce(g.t = p.t, false)) AS correct, count(*) AS places, count(*) FILTER (WHERE coalesce(g.t = p.t, false)) = count(*) AS exact
FROM g FULL JOIN p ON g.conv_id = p.conv_id AND g.pos = p.pos GROUP BY 1
""")
def place_scores(spark, d):
    turns = _t(spark, d, "conversations")
    gold = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("role").alias("title"))
    pred = turns.filter("turn > 0").select(F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("pos"), F.col("role").alias("title"))
    return evaluate.place_score(gold, pred)


_JUDGED = "SELECT quality AS gold, CASE WHEN len(regexp_extract_all(text, '\\|')) > 5 OR n_chars < 200 THEN 0 ELSE 1 END AS pred, lang, toxic FROM labels JOIN documents USING (doc_id)"


def _judged(spark, d):
    rule = F.when((F.regexp_count("text", F.lit(r"\|")) > 5) | (F.col("n_chars") < 200), 0).otherwise(1)
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select(F.col("quality").alias("gold"), rule.alias("pred"), "lang", "toxic")


@query(f"""
WITH j AS ({_JUDGED}), c AS (SELECT gold, pred, count(*) AS n FROM j GROUP BY 1, 2)
SELECT gold, pred, n, CAST(sum(n) OVER (PARTITION BY gold) AS BIGINT) AS gold_total, n / sum(n) OVER (PARTITION BY gold) AS share FROM c
""")
def confusion_matrix(spark, d):
    return evaluate.confusion(_judged(spark, d), "gold", "pred")


@query(f"""
WITH j AS ({_JUDGED}), x AS (SELECT 'language' AS kind, lang AS evidence, gold = pred AS ok FROM j UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), CASE WHEN toxic = 0 THEN gold = pred END FROM j)
SELECT kind, evidence, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM x WHERE ok IS NOT NULL AND evidence IS NOT NULL GROUP BY 1, 2
""")
def evidence_accuracy(spark, d):
    rows = _judged(spark, d).withColumn("ok", F.col("gold") == F.col("pred")).withColumn("clean_ok", F.when(F.col("toxic") == 0, F.col("ok")))
    return evaluate.by_evidence(rows, {"language": ("lang", "ok"), "toxic": ("toxic", "clean_ok")})


@query("""
WITH p AS (SELECT a.p_partkey, a.p_name AS r, b.p_name AS h FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, levenshtein(r, h) / length(r) AS cer, levenshtein(replace(r, ' ', ''), replace(h, ' ', '')) / length(replace(r, ' ', '')) AS cer_nospace FROM p
""")
def cer_pairs(spark, d):
    part = _t(spark, d, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("ref")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("hyp")), "p_partkey")
    return evaluate.text_error(pairs).select("p_partkey", "cer", "cer_nospace")


@query("""
WITH p AS (SELECT a.p_partkey, replace(a.p_name, ' ', '') AS r, replace(b.p_name, ' ', '') AS h FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT p_partkey, r, h, unnest(list_distinct(string_split(r, ''))) AS c FROM p)
SELECT p_partkey, sum(least(length(r) - length(replace(r, c, '')), length(h) - length(replace(h, c, '')))) / max(length(r)) AS char_overlap FROM c WHERE c <> '' GROUP BY 1
""")
def char_overlap(spark, d):
    part = _t(spark, d, "part")
    squeezed = text.strip_spaces(F.col("p_name"))
    pairs = part.select("p_partkey", squeezed.alias("r")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), squeezed.alias("h")), "p_partkey")
    return pairs.select("p_partkey", evaluate.char_overlap(F.col("r"), F.col("h")).alias("char_overlap"))


_BUILT = """SELECT o_orderkey, concat(o_orderkey, ' ', o_custkey, ' 12') AS summary, b.body FROM orders JOIN (SELECT l_orderkey, string_agg(concat(l_orderkey, ' ', l_partkey), ' ' ORDER BY l_linenumber, l_partkey) AS body FROM lineitem GROUP BY 1) b ON l_orderkey = o_orderkey"""


def _built(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    body = F.array_join(F.transform("ls", lambda s: F.concat_ws(" ", F.col("l_orderkey").cast("string"), s["l_partkey"].cast("string"))), " ")
    orders = _t(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", "o_custkey", F.lit("12")).alias("summary"))
    return orders.join(lines.select(F.col("l_orderkey").alias("o_orderkey"), body.alias("body")), "o_orderkey")


@query(f"""
WITH b AS ({_BUILT}), n AS (SELECT o_orderkey, summary, body, list_filter(regexp_extract_all(summary, '\\d[\\d,\\-.]*'), lambda x: length(regexp_replace(x, '\\D', '', 'g')) >= 2) AS ns, regexp_replace(body, '[\\s,]', '', 'g') AS flat FROM b)
SELECT o_orderkey, CASE WHEN len(ns) > 0 THEN len(list_filter(ns, lambda x: contains(flat, x))) / len(ns) ELSE 1.0::DOUBLE END AS grounded_ratio, length(summary) / length(body) AS compression FROM n
""")
def grounded_ratio(spark, d):
    m = evaluate.summary_match(F.col("summary"), F.array().cast("array<string>"), F.col("body"))
    return _built(spark, d).select("o_orderkey", m.alias("m")).select("o_orderkey", "m.grounded_ratio", "m.compression")


@query(f"""
WITH b AS ({_BUILT}), n AS (SELECT o_orderkey, list_filter(regexp_extract_all(summary, '\\d[\\d,.]*\\d|\\d'), lambda x: length(x) >= 2) AS ns, regexp_replace(body, '[\\s,]', '', 'g') AS flat FROM b)
SELECT CAST(sum(len(ns)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(ns, lambda x: NOT contains(flat, x)))) AS BIGINT) AS ungrounded, sum(len(list_filter(ns, lambda x: NOT contains(flat, x)))) / sum(len(ns)) AS rate FROM n
""")
def hallucination_rate(spark, d):
    h = _built(spark, d).select(evaluate.hallucination(F.col("summary"), F.col("body")).alias("h"))
    return h.agg(F.sum("h.tokens").alias("tokens"), F.sum("h.ungrounded").alias("ungrounded")).withColumn("rate", F.col("ungrounded") / F.col("tokens"))


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(b.w) ELSE 0.0::DOUBLE END AS overlap FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def lexical_overlap(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w"))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("z")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", retrieval.lexical_overlap(F.col("w"), F.col("z")).alias("overlap"))


@query("""
WITH x AS (SELECT 'name' AS field, c_name AS g, concat('Customer#', lpad(CAST(c_custkey AS VARCHAR), 9, '0')) AS p FROM customer UNION ALL SELECT 'segment', c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN concat('(', c_mktsegment, ')') ELSE left(c_mktsegment, 5) END FROM customer),
n AS (SELECT *, regexp_replace(g, '[()\\[\\]{}<>.,·:;/#\\-\\s]', '', 'g') AS gn, regexp_replace(p, '[()\\[\\]{}<>.,·:;/#\\-\\s]', '', 'g') AS pn FROM x),
r AS (SELECT *, CASE WHEN gn = pn THEN '일치' WHEN p = '' THEN '미추출' WHEN g = '' THEN '정답없음' WHEN contains(gn, pn) THEN '부분일치(추출값이 정답의 일부)' WHEN contains(pn, gn) THEN '부분일치(추출값이 정답보다 김)' ELSE '불일치' END AS reason FROM n)
SELECT field, reason, count(*) AS n, count(*) FILTER (WHERE g = p) AS exact, count(*) FILTER (WHERE gn = pn) AS normalised FROM r GROUP BY 1, 2
""")
def field_match(spark, d):
    c, k = _t(spark, d, "customer"), F.col("c_custkey")
    segment = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit("("), "c_mktsegment", F.lit(")"))).otherwise(F.left("c_mktsegment", F.lit(5)))
    rows = c.select(F.col("c_name").alias("gold_name"), F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")).alias("pred_name"), F.col("c_mktsegment").alias("gold_segment"), segment.alias("pred_segment"))
    return evaluate.field_match(rows, ["name", "segment"])


# ---------------------------------------------------------------- text
@query("""
SELECT doc_id, trim(regexp_replace(translate(text, '“”„‟«»‘’‚‛【】〔〕［］「」『』〈〉《》ᆞ•∙⋅・·‧', '\"\"\"\"\"\"''''''''[][][][][]<><>·······'), '\\s+', ' ', 'g')) AS normalised FROM documents
""")
def normalised_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalised"))


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, text FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: length(x) < 20)) / len(ls) ELSE 0.0::DOUBLE END AS short_ratio, CAST(len(ls) AS INTEGER) AS lines, text FROM l)
SELECT doc_id, short_ratio, lines, CASE WHEN length(regexp_replace(text, '[·ᆞ•∙⋅・‧․…‥]{3,}', '', 'g')) <= 0.85 * length(text) AND length(text) > 0 THEN 'toc' WHEN lines >= 10 AND short_ratio >= 0.6 THEN 'table' ELSE 'body_1col' END AS page_type FROM s
""")
def page_type_stats(spark, d):
    stats = _t(spark, d, "documents").select("doc_id", text.page_stats(F.col("text")).alias("s"))
    return stats.select("doc_id", F.col("s.short_line_ratio").alias("short_ratio"), "s.lines", "s.page_type")


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws, regexp_replace(text, '\\s+', '', 'g') AS flat FROM documents)
SELECT doc_id, CAST(len(ws) + greatest(length(flat) - 1, 0) AS INTEGER) AS tokens, CAST(len(list_distinct(list_concat(ws, CASE WHEN length(flat) >= 2 THEN list_transform(range(1, length(flat)), lambda i: substr(flat, i, 2)) ELSE [] END))) AS INTEGER) AS distinct_tokens FROM w
""")
def token_counts(spark, d):
    t = text.tokenize(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE regexp_matches(text, '[0-9]')),
n AS (SELECT doc_id, page, unnest(regexp_extract_all(line, '[0-9]{2,}')) AS value FROM l)
SELECT doc_id, value, CAST(min(page) AS INTEGER) AS page FROM n GROUP BY 1, 2
""")
def extract_numbers_first_page(spark, d):
    docs = _t(spark, d, "documents").filter(F.col("text").rlike("[0-9]"))
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("page_no", F.col("p") + 1)
    found = extract.first_on_page(pages, F.regexp_extract_all(F.col("line"), F.lit("([0-9]{2,})"), F.lit(1)))
    return found.select("doc_id", "value", "page")


@query("""
WITH x AS (SELECT o_custkey, string_agg(strftime(o_orderdate, '시행 %Y. %-m. %-d.'), ' ' ORDER BY o_orderkey) AS t, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1)
SELECT o_custkey, CAST(d AS VARCHAR) AS earliest FROM x
""")
def earliest_dates(spark, d):
    day = F.concat(F.lit("시행 "), F.date_format("o_orderdate", "yyyy. M. d."))
    texts = _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", day.alias("t")))), lambda s: s["t"]), " ").alias("text"))
    return texts.select("o_custkey", extract.earliest_date(F.col("text")).alias("earliest"))


@query("""
SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders
""")
def stated_amounts(spark, d):
    body = F.concat(F.lit("1. 소요 예산: 금 "), F.format_number(F.floor("o_totalprice"), 0), F.lit("원 (기준 1,000원)"))
    return _t(spark, d, "orders").select("o_orderkey", extract.amount(body).alias("amount"))


@query("""
SELECT doc_id, regexp_replace(text, 't\\s*h\\s*e\\s*o\\s*r|t\\s*h\\s*e|a\\s*n', '○○○', 'g') AS masked FROM documents
""")
def masked_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", masking.mask_names(F.col("text"), ["the", "theor", "an", "x"]).alias("masked"))


@query(f"""
WITH e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_LETTERS}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '{_LETTERS}'), 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS firstpos FROM e GROUP BY 1, 2), r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, firstpos) AS rank FROM c)
SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20
""")
def keyphrases(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return sampling.keyphrases(docs, "doc_id", "text", _LETTERS)


@query("""
SELECT conv_id, turn, turn AS "first", CASE WHEN lead(turn) OVER w IS NULL THEN turn + 11 ELSE greatest(turn, lead(turn) OVER w - 1) END AS until FROM conversations WHERE role <> 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def toc_segments(spark, d):
    entries = _t(spark, d, "conversations").filter("role <> 'assistant'").select("conv_id", "turn")
    return sampling.segments(entries, "conv_id", "turn", "turn")


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT doc_id, lang FROM r ORDER BY n, lang, doc_id LIMIT 50
""")
def stratified_sample(spark, d):
    return sampling.round_robin(_t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


@query("""
WITH c AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS g FROM events)
SELECT event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM c
""")
def carry_forward(spark, d):
    rows = _t(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("g"))
    return sampling.carry(rows, ["user_id"], "event_id", "g").select("event_id", "g")


@query()
def chunk_documents(spark, d):
    """An order-dependent fold, tested against a plain loop."""
    return retrieval.chunks(_t(spark, d, "documents"), separator="\n")


@query("""
WITH p AS (SELECT a.p_partkey, string_split(a.p_name, ' ') AS r, string_split(b.p_name, ' ') AS h FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), k AS (SELECT *, list_distinct(list_concat(r, h)) AS known FROM p)
SELECT p_partkey, levenshtein(array_to_string(list_transform(r, lambda w: chr(CAST(list_position(known, w) AS INTEGER))), ''), array_to_string(list_transform(h, lambda w: chr(CAST(list_position(known, w) AS INTEGER))), '')) / len(r) AS wer FROM k
""")
def name_word_errors(spark, d):
    """Names have few words, so that SQL, whose distance counts bytes, can make a character of each."""
    part = _t(spark, d, "part")
    pairs = part.select("p_partkey", F.col("p_name").alias("ref")).join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("hyp")), "p_partkey")
    return evaluate.text_error(pairs).select("p_partkey", "wer")


@query()
def word_error_rate(spark, d):
    """Pairs of turns have too many words for SQL's distance, which counts bytes; tested against a plain loop."""
    turns = _t(spark, d, "conversations")
    pairs = turns.select("conv_id", "turn", F.col("text").alias("ref")).join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", (evaluate.word_distance(text.words(F.col("ref")), text.words(F.col("hyp"))) / F.size(text.words(F.col("ref")))).alias("wer"))


# ---------------------------------------------------------------- retrieval
_TOKENS = "list_concat(list_filter(string_split(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), CASE WHEN length(regexp_replace({c}, '\\s+', '', 'g')) >= 2 THEN list_transform(range(1, length(regexp_replace({c}, '\\s+', '', 'g'))), lambda i: substr(regexp_replace({c}, '\\s+', '', 'g'), i, 2)) ELSE [] END)"
# bigrams by a join on positions: cheaper in SQL than a lambda over long texts
_BM25 = """
flat AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS f, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w FROM documents),
tok AS (SELECT doc_id, unnest(string_split(w, ' ')) AS term FROM flat UNION ALL SELECT doc_id, substr(f, i, 2) FROM (SELECT doc_id, f, unnest(range(1, greatest(length(f), 1))) AS i FROM flat)),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term <> '' GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1),
stat AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, stat),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qflat AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS f, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS w FROM benchmark),
qtok AS (SELECT item_id, unnest(string_split(w, ' ')) AS term FROM qflat UNION ALL SELECT item_id, substr(f, i, 2) FROM (SELECT item_id, f, unnest(range(1, greatest(length(f), 1))) AS i FROM qflat)),
q AS (SELECT item_id, term, count(*) AS qtf FROM qtok WHERE term <> '' GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN post USING (term) JOIN len USING (doc_id), stat GROUP BY 1, 2),
hits AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)
"""


def _hits(spark, d, k: int) -> DataFrame:
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.bm25(queries, _t(spark, d, "documents").select("doc_id", "text"), k)


@query(f"WITH {_BM25} SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM hits WHERE rank <= 10")
def bm25_topk(spark, d):
    return _hits(spark, d, 10).select("query_id", "rank", "doc_id")


@query(f"""
WITH {_BM25}, truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), asked AS (SELECT DISTINCT item_id FROM truth),
best AS (SELECT item_id, min(rank) AS r FROM hits JOIN truth USING (item_id, doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT count(*) AS queries, avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS self_at_1, avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS self_at_3 FROM asked LEFT JOIN best USING (item_id)
""")
def bm25_self_at_k(spark, d):
    """How often a passage's own documents rank first, or among the first three."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return retrieval.self_at(_hits(spark, d, 3), retrieval.holders(items, docs), [1, 3])


@query(f"""
WITH {_BM25}, qw AS (SELECT DISTINCT item_id, unnest(string_split(w, ' ')) AS t FROM qflat), dw AS (SELECT DISTINCT doc_id, unnest(string_split(w, ' ')) AS t FROM flat),
ov AS (SELECT item_id, doc_id, count(*) AS c FROM qw JOIN dw USING (t) WHERE t <> '' GROUP BY 1, 2), o AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS rank FROM ov),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s FROM (SELECT item_id, doc_id, rank FROM hits WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM o WHERE rank <= 20) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS rank FROM f)
SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM r WHERE rank <= 5
""")
def hybrid_rrf(spark, d):
    queries = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    overlap = retrieval.word_overlap(queries, docs, 20, text.words)
    return retrieval.fuse([_hits(spark, d, 20), overlap], 5).select("query_id", "rank", "doc_id")


_VECTORS = """
u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, x.vec_id, x.label = q.label AS same, round(list_cosine_similarity(q.e, x.e), 6) AS score FROM u q JOIN u x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


def _vector_hits(spark, d, k: int) -> DataFrame:
    data = _t(spark, d, "embeddings")
    return retrieval.vectors(data.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), data, k)


@query(f"WITH {_VECTORS} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM h WHERE rank <= 10")
def vector_topk(spark, d):
    return _vector_hits(spark, d, 10).select("query_id", "rank", "vec_id")


@query(f"WITH {_VECTORS} SELECT query_id, count(*) FILTER (WHERE same) AS same, count(*) FILTER (WHERE same) > 0 AS any_same FROM h WHERE rank <= 3 GROUP BY 1")
def same_kind_at_k(spark, d):
    return retrieval.same_kind_at(_vector_hits(spark, d, 3), _t(spark, d, "embeddings"), 3)


# ---------------------------------------------------------------- further rules and sources
@query("""
WITH r(org, ord, titles, required, triggers) AS (VALUES ('en', 0, ['finance'], false, ['token', 'zqx']), ('en', 1, ['audit', 'finance'], true, NULL), ('fr', 0, ['achat'], false, ['eau']), ('de', 0, ['amt'], false, ['zqx'])),
h AS (SELECT doc_id, ord, unnest(titles) AS title, generate_subscripts(titles, 1) AS i FROM documents JOIN r ON r.org = lang AND (required OR len(list_filter(coalesce(triggers, []), lambda k: contains(text, k))) > 0)),
f AS (SELECT doc_id, title, min(ord * 100 + i) AS o FROM h GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS ord, title FROM f
""")
def cooperation_titles(spark, d):
    table = _rows(spark, [("en", 0, None, ["finance"], False, ["token", "zqx"]), ("en", 1, None, ["audit", "finance"], True, None), ("fr", 0, None, ["achat"], False, ["eau"]), ("de", 0, None, ["amt"], False, ["zqx"])],
                  "org string, ord int, work_types array<string>, titles array<string>, required boolean, triggers array<string>")
    docs = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("org"), F.col("source").alias("work_type"), F.col("text").alias("title"))
    return rules.cooperation(docs, table)


@query("""
WITH p AS (SELECT concat('n', c_custkey % 1000) AS name, c_mktsegment AS org, CAST(c_nationkey AS VARCHAR) AS title FROM customer), q AS (SELECT o_orderkey, concat('n', o_custkey % 1600) AS name FROM orders),
g AS (SELECT name, count(*) AS n, min(org) AS org, min(title) AS title FROM p GROUP BY 1)
SELECT o_orderkey AS req, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN org END AS org, CASE WHEN n = 1 THEN title END AS title FROM q LEFT JOIN g USING (name)
""")
def identify_people(spark, d):
    people = _t(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_custkey") % 1000).alias("name"), F.col("c_mktsegment").alias("org"), F.col("c_nationkey").cast("string").alias("title"))
    asked = _t(spark, d, "orders").select(F.col("o_orderkey").alias("req"), F.concat(F.lit("n"), F.col("o_custkey") % 1600).alias("name"))
    return rules.identify(people, asked)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL)")
def missing_vectors(spark, d):
    from docketry.sources import files

    cached = _t(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("doc_id"))
    return files.missing(_t(spark, d, "documents").select("doc_id"), cached, "doc_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_row_wins(spark, d):
    from docketry.sources import files

    return files.last_wins(_t(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The windowed counts of the event stream, over the whole table at once."""
    from docketry.streaming import events

    table = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.windowed(table, "1 hour", "10 minutes", "event_type")
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH k AS (SELECT doc_id, lower(text) AS t FROM documents), p AS (SELECT doc_id, unnest([length(t) - strpos(reverse(t), 'eht') - 1, length(t) - strpos(reverse(t), 'dna') - 1, length(t) - strpos(reverse(t), 'tnem') - 2]) AS place, unnest(['the', 'and', 'ment']) AS w, unnest([contains(t, 'the'), contains(t, 'and'), contains(t, 'ment')]) AS has FROM k),
b AS (SELECT doc_id, arg_max(w, place) AS w FROM p WHERE has GROUP BY 1)
SELECT doc_id, CASE w WHEN 'the' THEN 'goods' WHEN 'and' THEN 'works' WHEN 'ment' THEN 'service' ELSE 'other' END AS category FROM documents LEFT JOIN b USING (doc_id)
""")
def execution_category(spark, d):
    kinds = [("goods", ("the",)), ("works", ("and",)), ("service", ("ment",)), ("other", ())]
    return _t(spark, d, "documents").select("doc_id", rules.execution_category(F.lower("text"), kinds).alias("category"))


from docketry.plans import flows, more  # noqa: E402,F401  register their queries
