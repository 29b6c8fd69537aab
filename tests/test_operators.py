"""Rules, history, retrieval, evaluation, layout, sampling and sources on small literals and against plain loops."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from docketry.functions import text
from docketry.operators import evaluate, history, index, layout, predict, retrieval, rules, sampling
from docketry.sources import files, sinks


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_band_edges(spark):
    bands = spark.createDataFrame([(0, None, 10, "a"), (1, 10, 20, "b"), (2, 15, None, "c"), (3, None, None, "d")], "rid int, amount_min long, amount_max long, level string")
    amounts = spark.createDataFrame([(10,), (11,), (20,), (21,), (None,)], "x long")
    assert [r["l"] for r in rules.band(amounts, bands, "x").select(F.col("band.level").alias("l")).collect()] == ["a", "b", "b", "c", None]


def test_delegate(spark):
    table = spark.createDataFrame([("o", 2, None, None, 10, "low"), ("o", 1, ["x"], 10, 20, "mid")], "org string, priority int, work_types array<string>, amount_min long, amount_max long, final_title string")
    rest = spark.createDataFrame([("o", "fall")], "org string, final_title string")
    docs = spark.createDataFrame([(1, "o", "x", 10), (2, "o", "y", 10), (3, "o", "x", None), (4, "z", "x", 1)], "id int, org string, work_type string, amount long")
    got = {r["id"]: (r["final_title"], r["rule_source"]) for r in rules.delegate(docs, table, rest).collect()}
    assert got == {1: ("mid", "rule"), 2: ("low", "rule"), 3: ("fall", "fallback"), 4: (None, "none")}


def test_slot_chain(spark):
    chart = spark.createDataFrame([("d", "t", "s0", "주무관", 0), ("d", "t", "s1", "팀장", 1), ("d", None, "s2", "과장", 2), ("d", None, "s3", "국장", 3)], "dept string, team string, slot string, title string, level int")
    day = "date"
    req = spark.createDataFrame([(1, "d", "t", "2026-01-05", 2), (2, "d", "t", None, 3)], "req int, dept string, team string, day string, final_level int").withColumn("day", F.col("day").cast(day))
    spells = spark.createDataFrame([(0, "s2", "팀장", "2026-01-01", None, "replace")], "ord int, slot string, by string, from_date string, to_date string, mode string").withColumns({c: F.col(c).cast(day) for c in ("from_date", "to_date")})
    got = rules.slot_chain(req, chart, spells).orderBy("req", "seq").collect()
    assert [(r["req"], r["title"], r["slot"], r["role"]) for r in got] == [
        (1, "주무관", "s0", "기안"), (1, "팀장", "s1+s2", "결재"), (2, "주무관", "s0", "기안"), (2, "팀장", "s1", "검토"), (2, "과장", "s2", "검토"), (2, "국장", "s3", "결재"),
    ]


def test_line(spark):
    docs = spark.createDataFrame([(1, "o", "d", "도서 구입", "", "x", 5, "주무관")], "doc_id int, org string, dept string, title string, body string, work_type string, amount long, drafter string")
    teams = spark.createDataFrame([("o", 0, "팀장", ["도서"]), ("o", 1, "다른팀장", ["없음"])], "org string, ord int, lead string, keywords array<string>")
    extra = spark.createDataFrame([("o", None, "과장"), ("o", ["x"], "국장")], "org string, work_types array<string>, title string")
    table = spark.createDataFrame([("o", 1, None, None, None, "국장")], "org string, priority int, work_types array<string>, amount_min long, amount_max long, final_title string")
    rest = spark.createDataFrame([], "org string, final_title string")
    coop = spark.createDataFrame([("o", 0, None, ["재무과장"], False, ["구입"])], "org string, ord int, work_types array<string>, titles array<string>, required boolean, triggers array<string>")
    roster = spark.createDataFrame([("o", "팀장", "홍길동")], "org string, title string, name string")
    got = rules.build_line(docs, teams, extra, table, rest, coop, roster).orderBy("ord").collect()
    assert [(r["role"], r["title"], r["name"]) for r in got] == [("기안", "주무관", None), ("검토", "팀장", "홍길동"), ("검토", "과장", None), ("결재", "국장", None), ("협조", "재무과장", None)]


def test_execution(spark):
    df = spark.createDataFrame([("공사 물품 구매",), ("안내",)], "t string")
    cats = [("w", ("공사",)), ("g", ("물품",)), ("e", ())]
    assert [r["c"] for r in df.select(rules.execution_category(F.col("t"), cats).alias("c")).collect()] == ["g", "e"]
    got = df.select(rules.is_execution(F.col("t"), ("공사",), ("안내",), "안내$").alias("c")).collect()
    assert [r["c"] for r in got] == [True, False]


def test_identify(spark):
    people = spark.createDataFrame([("a", "o", "t"), ("b", "o", "t"), ("b", "p", "u")], "name string, org string, title string")
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "req int, name string")
    assert [r[1] for r in rows_of(rules.identify(people, req))] == ["unique", "ambiguous", "unknown"]


def test_votes_against_loops(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice("abc"), rng.randint(0, 3)) for i, g in enumerate(rng.choices(range(8), k=120))]
    df = spark.createDataFrame(rows, "g int, i int, v string, d int")

    def mode(refs):
        refs = sorted(refs, key=lambda r: (r[3], r[1]), reverse=True)
        counts = Counter(r[2] for r in refs)
        top = max(counts.values(), default=0)
        return next((r[2] for r in refs if counts[r[2]] == top), None)

    others = {r[1]: [x for x in rows if x[0] == r[0] and x[1] != r[1]] for r in rows}
    got = {r["i"]: r["voted"] for r in history.vote_without_self(df, ["g"], "v", "d", "i").collect()}
    assert got == {i: mode(o) for i, o in others.items()}
    copied = {r["i"]: r["copied"] for r in history.copy_latest_other(df, "g", "v", "d", "i").collect()}
    assert copied == {i: max(o, key=lambda r: (r[3], r[1]))[2] if o else None for i, o in others.items()}
    modes = {r["g"]: r["v"] for r in history.mode(df, ["g"], "v", "d", "i").collect()}
    assert modes == {g: mode([r for r in rows if r[0] == g]) for g in {r[0] for r in rows}}
    sweep = {r["size"]: (r["cases"], r["hits"]) for r in history.reference_sweep(df, "g", "v", [1, 3], "d", "i").collect()}
    cases = [r for r in rows if len(others[r[1]]) >= 3]
    latest = lambda r, n: sorted(others[r[1]], key=lambda x: (x[3], x[1]), reverse=True)[:n]
    assert sweep == {n: (len(cases), sum(mode(latest(r, n)) == r[2] for r in cases)) for n in (1, 3)}


def test_empty_history(spark):
    none = spark.createDataFrame([], "g int, i int, v string, d int")
    assert history.vote_without_self(none, ["g"], "v", "d", "i").count() == 0
    assert history.mode(none, ["g"], "v", "d", "i").count() == 0


def test_induced_teams(spark):
    docs = spark.createDataFrame([("o", "a", ["x", "z"]), ("o", "b", ["y", "z"]), ("p", "a", ["q"])], "org string, reviewer string, words array<string>")
    assert rows_of(history.induce_teams(docs)) == [("o", "a", ["x"], 1), ("o", "b", ["y"], 1)]


def test_chunks_against_a_loop(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("가" * rng.choice([3, 30, 200, 700]) for _ in range(rng.randint(0, 8))) for _ in range(30)]

    def loop(body):
        out, held = [], ""
        for p in [x for x in body.split("\n\n") if x]:
            if held and len(held) + len(p) > 600:
                out += [held] if len(held) >= 40 else []
                held = ""
            held = f"{held}\n{p}" if held else p
        return out + ([held] if len(held) >= 40 else [])

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in retrieval.chunks(df).orderBy("doc_id", "n").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := loop(t))}


def test_bm25_against_a_loop(spark):
    docs = {1: "사과 배", 2: "사과 사과 포도", 3: "감", 4: "감"}
    asked = {1: "사과", 2: "없는말"}
    tok = lambda t: t.split() + [("".join(t.split()))[i : i + 2] for i in range(len("".join(t.split())) - 1)]
    ts = {i: tok(t) for i, t in docs.items()}
    n, avg = len(ts), sum(map(len, ts.values())) / len(ts)
    df = Counter(w for t in ts.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    score = lambda q, t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in tok(q))
    want = {(q, r): i for q, s in asked.items() for r, i in enumerate(sorted(ts, key=lambda i: (-round(score(s, ts[i]), 6), i))[:3], 1)}
    d = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    q = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in retrieval.bm25(q, d, 3).collect()}
    assert got == want


def test_candidates_use_their_own_pool(spark):
    table = spark.createDataFrame([(0, "총무과", "가", "도서 구입", None, None), (1, "(공통)", "나", "도서 대출", None, None), (2, "재무과", "다", "도서", None, None), (3, "총무과", "라", "도서", 1, 2), (4, "총무과", "마", "회계", None, None), (5, "(공통)", "바", "복무", None, None), (6, "총무과", "사", "차량", None, None)], "rid int, sheet string, group string, item string, amount_min long, amount_max long")
    q = spark.createDataFrame([(1, "총무과", "도서 대출")], "query_id int, dept string, query string")
    assert [(r["rank"], r["rid"]) for r in retrieval.candidates(q, table).orderBy("rank").limit(2).collect()] == [(1, 1), (2, 0)]
    assert {r["rid"] for r in retrieval.candidates(q, table, 9).collect()} == {0, 1, 4, 5, 6}


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 20)], "query_id int, rank int, doc_id int")
    b = spark.createDataFrame([(1, 1, 20), (1, 2, 30)], "query_id int, rank int, doc_id int")
    assert [r["doc_id"] for r in retrieval.fuse([a, b], 3).orderBy("rank").collect()] == [20, 10, 30]


def test_text_errors(spark):
    df = spark.createDataFrame([("가나 다", "가다 다"), ("", "x"), ("같다", "같다")], "ref string, hyp string")
    a, b, c = evaluate.text_error(df).collect()
    assert (a["cer"], a["wer"], a["cer_nospace"]) == (0.25, 0.5, 1 / 3) and abs(a["char_overlap"] - 2 / 3) < 1e-12
    assert b["cer"] is None and c["cer"] == 0.0


def test_word_distance(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(60)]

    def slow(x, y):
        d = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            d, last = [i] + d[1:], d
            for j, b in enumerate(y, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (a != b))
        return d[-1]

    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "i int, x array<string>, y array<string>")
    got = {r["i"]: r["d"] for r in df.select("i", evaluate.word_distance(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got == {i: slow(x, y) for i, (x, y) in enumerate(pairs)}


def test_approval_scores(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    cell = "doc_id int, role string, pos int, title string, name string"
    gold = spark.createDataFrame([(1, "기안", 0, "주무관", "김"), (1, "결재", 0, "과 장", "?")], cell)
    pred = spark.createDataFrame([(1, "기안", 0, "주무관", "이"), (1, "결재", 0, "과장", "박"), (1, "협조", 0, "x", "y")], cell)
    got = {r["doc_id"]: tuple(r)[1:] for r in evaluate.approval_match(docs, gold, pred).collect()}
    assert got == {1: (1.0, 0.0, 0.75, 2, 1), 2: (0.0, 0.0, 1.0, 0, 0)}
    ok = {r["role"]: (r["title_ok"], r["name_ok"]) for r in evaluate.cell_outcomes(gold, pred).collect()}
    assert ok == {"기안": (True, False), "결재": (True, None), "협조": (False, False)}


def test_grounding(spark):
    df = spark.createDataFrame([("금 1,234원 2026. 9. 7.", "1234 2026-09-07"), ("없음", "본문")], "s string, b string")
    a, b = df.select(evaluate.hallucination(F.col("s"), F.col("b")).alias("h"), evaluate.summary_match(F.col("s"), F.array(), F.col("b")).alias("m")).collect()
    assert tuple(a["h"]) == (2, 0, 0.0) and tuple(b["h"]) == (0, 0, 0.0) and b["m"]["grounded_ratio"] == 1.0


def test_locations(spark):
    pages = spark.createDataFrame([(1, 1, "사과 배"), (1, 2, "감자 고구마"), (2, 1, "하나")], "doc_id int, page_no int, text string")
    points = spark.createDataFrame([(1, 0, "감자 수확", 2), (1, 1, "사과 값", 2), (1, 2, "x", None), (2, 0, "하나", 1)], "doc_id int, n int, value string, page int")
    assert rows_of(evaluate.location_check(points, pages)) == [(1, 2, 1, 1)]


def test_verdicts_and_diff(spark):
    rows = spark.createDataFrame([(3, 3), (3, 4), (3, 2), (3, None)], "gold_level int, pred_level int")
    assert [r["verdict"] for r in evaluate.final_verdict(rows).collect()] == ["same", "escalated", "violation", "unknown"]
    a = spark.createDataFrame([("o", 1), ("p", 1)], "k string, v int")
    b = spark.createDataFrame([("o", 2), ("q", 1)], "k string, v int")
    assert {r["k"]: r["status"] for r in evaluate.rules_diff(a, b, ["k"], "v").collect()} == {"o": "differs", "p": "only_a", "q": "only_b"}


def test_layout(spark):
    words = [(1, 0, 10.0, 0.0, "과장", 0.0), (1, 1, 12.0, 20.0, "김철수", 0.0), (1, 2, 60.0, 0.0, "팀장", 50.0), (1, 3, 55.0, 25.0, "이 영희", 50.0), (1, 4, 200.0, 20.0, "먼이름", 190.0), (1, 5, 300.0, 0.0, "국장", 290.0)]
    words = spark.createDataFrame(words, "doc_id int, word_id int, xc double, y double, text string, xl double")
    got = [(r["role"], r["title"], r["name"]) for r in layout.approval_cells(words, "top").orderBy("ord").collect()]
    assert got == [("기안", "과장", "김철수"), ("검토", "팀장", "이영희"), ("결재", "국장", "")]
    block = lambda p, a, b: (p, 100.0, float(a), float(b))
    columns = [block(1, 5, 45), block(1, 55, 95), block(1, 5, 40), block(1, 58, 95)]
    spans = [*columns, *[(2, *c[1:]) for c in columns[:3]], *[(3, *c[1:]) for c in columns], block(3, 5, 95), *[block(4, 60 + i, 95) for i in range(4)], *[block(5, 90 + i, 95) for i in range(4)]]
    spans = spark.createDataFrame(spans, "p int, page_width double, x0 double, x1 double")
    assert rows_of(layout.gutter(spans, ["p"])) == [(1, True), (2, False), (3, False), (4, True), (5, True)]


def test_sampling(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "k string, i int")
    assert [r["i"] for r in sampling.round_robin(df, "k", "i", 3).collect()] == [1, 4, 2]
    rows = spark.createDataFrame([("s", 1, 3), ("s", 2, 3), ("s", 3, 9)], "s string, seq int, page int")
    assert [r["until"] for r in sampling.segments(rows, "s", "seq", "page").orderBy("seq").collect()] == [3, 8, 20]
    moved = sampling.segments(rows.withColumns({"offset": F.lit(2), "pages": F.lit(12)}), "s", "seq", "page", offset="offset", page_count="pages").orderBy("seq").collect()
    assert [(r["first"], r["until"]) for r in moved] == [(5, 5), (5, 10), (11, 12)]
    held = spark.createDataFrame([(1, "g", "x"), (2, None, None), (3, "h", ""), (4, None, None)], "n int, g string, i string").withColumn("k", F.lit(1))
    assert [(r["g"], r["i"]) for r in sampling.carry(held, ["k"], "n", "g", "i").orderBy("n").collect()] == [("g", "x"), ("g", "x"), ("h", ""), ("h", "")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b" ")
    (tmp_path / "a.txt").write_text("정답", encoding="utf-8")
    pairs, skipped = files.text_pairs(spark, str(tmp_path))
    assert [(r["stem"], r["truth"]) for r in pairs.collect()] == [("a", "정답")] and [r["stem"] for r in skipped.collect()] == ["b"]
    pages = files.pages(spark, str(tmp_path), lambda content: content.decode().split("\f"))
    good, blank = files.with_text(pages, 5)
    assert good.count() == 2 and [r["doc_id"] for r in blank.collect()] == ["b"]
    (tmp_path / "t.json").write_text('[{"item": "x", "amount_min": 1}, {"item": "y"}]')
    assert rows_of(files.json_table(spark, str(tmp_path / "t.json"), "item string, amount_min long")) == [(0, "x", 1), (1, "y", None)]
    raw = spark.createDataFrame([(1, "f", "기안", "주무관", "김", ""), (2, "f", "협조", "-", "-", ""), (3, "e", "협조", "-", "-", "")], "row_no int, file string, role string, title string, name string, note string")
    docs, cells = files.gold_cells(raw, "file")
    assert docs.count() == 2 and cells.count() == 1
    lists = spark.createDataFrame([("a", "1, 2,x,1"), ("b", None)], "k string, v string")
    assert rows_of(files.id_lists(lists, "k", "v")) == [("a", [1, 2]), ("b", [])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b")], "x int, y string")
    path = sinks.result_json(df, str(tmp_path / "out"), "r1")
    assert spark.read.json(path).count() == 1
    assert df.select(sinks.markdown_row("x", "y").alias("m")).first()["m"] == "| 1 | a b |"


def test_stream(spark, tmp_path):
    from docketry.streaming import events

    rows = spark.sql("select id as event_id, timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)*20,0) as ts, id % 2 as user_id, 'a' as event_type, cast(id as double) as value, '{}' as props from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    counted = events.windowed(events.read_events(spark, str(tmp_path / "in")))
    q = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 9


def test_page_type_with_gutter(spark):
    df = spark.createDataFrame([("긴 본문입니다 " * 5, True)], "t string, g boolean")
    assert df.select(text.page_type(F.col("t"), F.col("g")).alias("p")).first()["p"] == "body_2col"


def test_holders_of_all_queries_in_blocks(spark, monkeypatch):
    queries = spark.createDataFrame([(i, f"passage {i}.") for i in range(30)], "query_id long, query string")
    docs = spark.createDataFrame([(100 + i, f"text with passage {i}. and passage {i + 1}.") for i in range(30)], "doc_id long, text string")
    want = sorted([(i, 100 + i) for i in range(30)] + [(i + 1, 100 + i) for i in range(29)])
    for most in (4, 100):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        assert sorted(map(tuple, retrieval.holders(queries, docs).collect())) == want
    assert sorted(retrieval._finder(["", "ab", "b"])("xab")) == ["", "ab", "b"] and retrieval._finder([""])("x") == [""]


def test_bm25_with_negative_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "x y"), (4, "q"), (5, None)][:4], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "x"), (2, "q"), (3, "")], "query_id long, query string")
    monkeypatch.setattr(retrieval, "tokenize", None)
    for most, cells in ((20_000, 4_000_000), (1, 1), (20_000, 2)):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        monkeypatch.setattr(retrieval, "MOST_CELLS", cells)
        got = {}
        for r in retrieval.bm25(asked, docs.repartition(3), 2).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert got[1][0] == (4, 0.0) and got[1][1][0] == 1 and got[1][1][1] < 0
        assert got[2][0][0] == 4 and got[2][0][1] > 0 and got[2][1] == (1, 0.0) and got[3] == [(1, 0.0), (2, 0.0)]


def test_terms_agree(spark):
    texts = ["가나 다", "a", "  ", "", "x\ty\u3000z", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.tokenize(F.col("t")).alias("ts")).collect()
    assert {r["i"]: r["ts"] or [] for r in rows} == {i: index.terms_of(t) for i, t in enumerate(texts)}


def test_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(2 + i % 2)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((math.hypot(*a) or 1) * (math.hypot(*b) or 1))
    want = sorted((q, r, i) for q, v in rows if v and q % 5 == 0 for r, i in enumerate(sorted((i for i, w in rows if w and len(w) == len(v) and i != q), key=lambda i: (-round(cos(v, rows[i][1]), 6) + 0.0, i))[:4], 1))
    for most in (3, 20_000):
        monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
        got = retrieval.vectors(data.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), data.repartition(3), 4)
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == want


def test_chain_annotations(spark):
    chart = spark.createDataFrame([("d", None, "s0", "주무관", 0), ("d", None, "s3", "국장", 3), ("d", None, "s4", "부군수", 4), ("d", None, "s5", "군수", 5)], "dept string, team string, slot string, title string, level int")
    req = spark.createDataFrame([(1, "d", "t", "2026-01-05", 5)], "req int, dept string, team string, day string, final_level int").withColumn("day", F.col("day").cast("date"))
    spells = spark.createDataFrame([(0, "s4", "국 장", None, None, "replace"), (1, "s5", "국장", None, None, "annotate")], "ord int, slot string, by string, from_date string, to_date string, mode string").withColumns({c: F.col(c).cast("date") for c in ("from_date", "to_date")})
    got = rules.slot_chain(req, chart, spells).orderBy("seq").collect()
    assert [(r["title"], r["slot"], r["evidence"], r["acting_by"], r["role"]) for r in got] == [("주무관", "s0", "org_chart", None, "기안"), ("국 장", "s4", "acting:s4", None, "검토"), ("군수", "s5", "org_chart+acting:국장", "국장", "결재")]


def test_robustness(spark):
    docs = spark.createDataFrame([(i, i % 2, f"2026-01-{i + 1:02}", i) for i in range(16)], "doc_id int, org int, date string, doc_no int")
    cells = spark.createDataFrame([(i, "기안", 0, f"t{i % 2}", "n") for i in range(16)], "doc_id int, role string, pos int, title string, name string")
    got = predict.robustness(docs, cells, 3)
    assert got.count() == 48 and got.filter("title_match = 1.0 and name_match = 1.0").count() == 48
    again = sorted(map(tuple, got.collect()))
    assert again == sorted(map(tuple, predict.robustness(docs.repartition(5), cells, 3).collect()))
