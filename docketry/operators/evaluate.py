"""Scores: text error rates, fields, approval cells, grounding, confusion, rule differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.extract import check_tokens, grounded, number_tokens
from docketry.functions.text import drop_leaders, flat, nfc, normalize, normalize_field, normalize_token, sections, strip_spaces, words


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes a character of its own, from
    U+10000 on, and Spark's own distance of the two texts is that of the words."""
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(i + F.lit(0xFFFF)), 8, "0")), "UTF-32")
    spelt = lambda words, known: F.array_join(F.transform(words, lambda w: letter(F.array_position(known, w).cast("int"))), "")
    return once(F.array_distinct(F.concat(a, b)), lambda known: F.levenshtein(spelt(a, known), spelt(b, known)))


def text_error(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp", compose: bool = True) -> DataFrame:
    """Adds cer, cer_no_leader, cer_nospace, wer, char_overlap and raw_cer; a blank reference gives nulls."""
    r, h = normalize(F.col(ref), compose=compose), normalize(F.col(hyp), compose=compose)
    t = pairs.withColumns({"_r": r, "_h": h})
    t = t.withColumns({"_rl": normalize(drop_leaders(F.col("_r")), compose=False), "_hl": normalize(drop_leaders(F.col("_h")), compose=False), "_rs": strip_spaces(F.col("_r")), "_hs": strip_spaces(F.col("_h")), "_rw": words(F.col("_r")), "_hw": words(F.col("_h"))})
    rate = lambda a, b: F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a))
    out = t.withColumns({
        "cer": rate("_r", "_h"), "cer_no_leader": rate("_rl", "_hl"), "cer_nospace": rate("_rs", "_hs"), "raw_cer": rate(ref, hyp),
        "wer": F.when(F.size("_rw") > 0, word_distance(F.col("_rw"), F.col("_hw")) / F.size("_rw")), "char_overlap": char_overlap(F.col("_rs"), F.col("_hs")),
    })
    return out.drop("_r", "_h", "_rl", "_hl", "_rs", "_hs", "_rw", "_hw")


def char_overlap(ref: Column, hyp: Column) -> Column:
    """Multiset intersection of characters over the reference's length; texts without white space.

    What is left of the reference's length when, for each distinct character, the surplus is taken off.
    """
    chars = F.filter(F.array_distinct(F.split(ref, "")), lambda c: c != "")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(chars, F.lit(0), lambda a, c: a + F.least(count(ref, c), count(hyp, c)))
    return F.when(F.length(ref) > 0, common / F.length(ref)).otherwise(F.lit(0.0))


def field_match(pairs: DataFrame, fields: list[str], compose: bool = True) -> DataFrame:
    """Wide rows with gold_<f> and pred_<f> -> (field, exact, normalised, reason, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"gold_{f}"), F.lit("")).alias("g"), F.coalesce(F.col(f"pred_{f}"), F.lit("")).alias("p")) for f in fields])).alias("x")
    rows = pairs.select(each).select("x.*").withColumns({"gn": normalize_field(F.col("g"), compose), "pn": normalize_field(F.col("p"), compose)})
    said = fixed.REASONS
    reason = F.when(F.col("gn") == F.col("pn"), said["same"]).when(F.col("p") == "", said["missing"]).when(F.col("g") == "", said["no_truth"]).when(F.col("gn").contains(F.col("pn")), said["part"]).when(F.col("pn").contains(F.col("gn")), said["more"]).otherwise(said["other"])
    scored = rows.withColumn("reason", reason)
    return scored.groupBy("field", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("g") == F.col("p")).alias("exact"), F.count_if(F.col("gn") == F.col("pn")).alias("normalised"))


def approval_match(docs: DataFrame, gold: DataFrame, pred: DataFrame, id_col: str = "doc_id", roles: tuple[str, ...] = fixed.ROLES, compose: bool = True) -> DataFrame:
    """-> (id, title_match, name_match, count_match, gold_cells, scored_names), one row for each document.

    Cells (id, role, pos, title, name) are compared place by place. Denominators are gold cells: a cell
    too many only costs count_match; unreadable names are left out; a document without gold scores 0.
    """
    g = gold.select(id_col, "role", "pos", F.col("title").alias("gt"), F.col("name").alias("gn"))
    p = pred.select(id_col, "role", "pos", F.col("title").alias("pt"), F.col("name").alias("pn"))
    same = lambda a, b: F.coalesce(normalize_token(F.col(a), compose) == normalize_token(F.col(b), compose), F.lit(False))
    cells = g.join(p, [id_col, "role", "pos"], "left").withColumns({"t": same("gt", "pt"), "readable": F.coalesce(F.col("gn") != fixed.UNREADABLE, F.lit(False)), "n": same("gn", "pn")})
    by_doc = cells.groupBy(id_col).agg(F.count("*").alias("gold_cells"), F.count_if("t").alias("titles"), F.count_if("readable").alias("scored_names"), F.count_if(F.col("readable") & F.col("n")).alias("names"))
    sizes = g.groupBy(id_col, "role").count().withColumnRenamed("count", "a").join(p.groupBy(id_col, "role").count().withColumnRenamed("count", "b"), [id_col, "role"], "full_outer")
    wrong = sizes.filter((F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))) & F.col("role").isin(*roles)).groupBy(id_col).agg(F.count("*").alias("wrong"))
    out = docs.select(id_col).distinct().join(by_doc, id_col, "left").join(wrong, id_col, "left").na.fill(0, ["gold_cells", "titles", "scored_names", "names", "wrong"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(id_col, ratio("titles", "gold_cells").alias("title_match"), ratio("names", "scored_names").alias("name_match"), ((len(roles) - F.col("wrong")) / len(roles)).alias("count_match"), "gold_cells", "scored_names")


def both_lines(rows: DataFrame, gold: str, pred: str, compose: bool = True) -> DataFrame:
    """rows with _g and _p: their two lines, array<struct(role, pos, title, name)>, each cell with its title and name as t and n for comparing."""
    values = lambda line: F.flatten(F.transform(line, lambda c: F.array(c["title"], c["name"])))

    def normal(line: str) -> Column:
        """title and name of each cell; the whole line is composed at once."""
        if not compose:
            return F.transform(values(line), lambda v: normalize_token(v, False))
        composed = F.split(nfc(F.array_join(F.transform(values(line), lambda v: F.coalesce(F.translate(v, "\0", ""), F.lit(""))), "\0")), "\0", -1)
        return F.zip_with(values(line), composed, lambda v, n: F.when(v.isNotNull(), normalize_token(n, False)))

    at = lambda all_, i, k: F.get(F.col(all_), 2 * i + k)
    cells = lambda line, all_: F.transform(line, lambda c, i: F.struct(c["role"].alias("role"), c["pos"].alias("pos"), c["title"].alias("title"), c["name"].alias("name"), at(all_, i, 0).alias("t"), at(all_, i, 1).alias("n")))
    return rows.withColumns({"_gn": normal(gold), "_pn": normal(pred)}).withColumns({"_g": cells(gold, "_gn"), "_p": cells(pred, "_pn")}).drop("_gn", "_pn")


def placed_alike(c: Column, same: Callable[[Column], Column]) -> Column:
    """Whether _p of both_lines() has a cell in the place of c that is the same."""
    return F.exists("_p", lambda p: F.coalesce((p["role"] == c["role"]) & (p["pos"] == c["pos"]) & same(p), F.lit(False)))


def of_role(line: str, role: str) -> Column:
    """How many cells of a role a line has."""
    return F.size(F.filter(line, lambda c: c["role"] == role))


def line_match(rows: DataFrame, gold: str, pred: str, roles: tuple[str, ...] = fixed.ROLES, compose: bool = True) -> DataFrame:
    """approval_match() of rows that hold both lines, array<struct(role, pos, title, name)>: adds its columns, without a shuffle."""
    t = both_lines(rows, gold, pred, compose)
    found = lambda c, k: placed_alike(c, lambda p: p[k] == c[k])
    readable = F.filter("_g", lambda c: F.coalesce(c["name"] != fixed.UNREADABLE, F.lit(False)))
    even = sum(((of_role("_g", r) == of_role("_p", r)).cast("int") for r in roles), F.lit(0))
    t = t.withColumns({"gold_cells": F.size("_g").cast("long"), "scored_names": F.size(readable).cast("long"), "_titles": F.size(F.filter("_g", lambda c: found(c, "t"))), "_names": F.size(F.filter(readable, lambda c: found(c, "n"))), "count_match": even / len(roles)})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return t.withColumns({"title_match": ratio("_titles", "gold_cells"), "name_match": ratio("_names", "scored_names")}).drop("_g", "_p", "_titles", "_names")


def cell_outcomes(gold: DataFrame, pred: DataFrame, id_col: str = "doc_id", compose: bool = True) -> DataFrame:
    """Each predicted cell against the gold cell in its place; an unreadable gold name gives a null name_ok."""
    g = gold.select(id_col, "role", "pos", F.col("title").alias("gt"), F.col("name").alias("gn"))
    same = lambda a, b: F.coalesce(normalize_token(F.col(a), compose) == normalize_token(F.col(b), compose), F.lit(False))
    joined = pred.join(g, [id_col, "role", "pos"], "left")
    name_ok = F.when(F.col("gn").isNull(), False).when(F.col("gn") == fixed.UNREADABLE, F.lit(None)).otherwise(same("name", "gn"))
    return joined.withColumns({"title_ok": same("title", "gt"), "name_ok": name_ok}).drop("gt", "gn")


def line_outcomes(rows: DataFrame, gold: str, pred: str, compose: bool = True) -> DataFrame:
    """cell_outcomes() of rows that hold both lines -> one row for each predicted cell: the other columns, the cell's, title_ok and name_ok."""
    t = both_lines(rows, gold, pred, compose)
    rest = [c for c in rows.columns if c not in (gold, pred)]
    cells = F.zip_with(pred, "_p", lambda c, p: F.struct(c.alias("c"), p["t"].alias("t"), p["n"].alias("n"), F.get(F.filter("_g", lambda g: (g["role"] == c["role"]) & (g["pos"] == c["pos"])), F.lit(0)).alias("g")))
    each = t.select(*rest, F.explode_outer(cells).alias("x")).filter("x is not null")
    same = lambda k: F.coalesce(F.col(f"x.{k}") == F.col(f"x.g.{k}"), F.lit(False))
    name_ok = F.when(F.col("x.g.name").isNull(), False).when(F.col("x.g.name") == fixed.UNREADABLE, F.lit(None)).otherwise(same("n"))
    return each.select(*rest, "x.c.*", same("t").alias("title_ok"), name_ok.alias("name_ok"))


def place_score(gold: DataFrame, pred: DataFrame, id_col: str = "doc_id", compose: bool = True) -> DataFrame:
    """-> (id, correct, places, exact): titles by place over the longer of both lists."""
    g, p = gold.select(id_col, "pos", F.col("title").alias("g")), pred.select(id_col, "pos", F.col("title").alias("p"))
    both = g.join(p, [id_col, "pos"], "full_outer").withColumn("ok", F.coalesce(normalize_token(F.col("g"), compose) == normalize_token(F.col("p"), compose), F.lit(False)))
    return both.groupBy(id_col).agg(F.count_if("ok").alias("correct"), F.count("*").alias("places")).withColumn("exact", F.col("correct") == F.col("places"))


def final_verdict(rows: DataFrame, gold: str = "gold_level", pred: str = "pred_level", accepted: str | None = None) -> DataFrame:
    """Adds verdict: same, escalated (higher), violation (lower) or unknown; accepted: an array of further levels."""
    right = F.col(gold) == F.col(pred)
    if accepted:
        right = right | F.array_contains(F.col(accepted), F.col(pred))
    verdict = F.when(F.col(pred).isNull() | F.col(gold).isNull(), "unknown").when(right, "same").when(F.col(pred) > F.col(gold), "escalated").otherwise("violation")
    return rows.withColumn("verdict", verdict)


def summary_match(summary: Column, title_words: Column, body: Column) -> Column:
    """struct(title_recall, grounded_ratio, compression): 0 without title words, 1 without numbers."""
    n = number_tokens(summary)
    recall = F.when(F.size(title_words) > 0, F.size(F.filter(title_words, lambda w: summary.contains(w))) / F.size(title_words)).otherwise(F.lit(0.0))
    ratio = F.when(F.size(n) > 0, F.size(grounded(n, body)) / F.size(n)).otherwise(F.lit(1.0))
    return F.struct(recall.alias("title_recall"), ratio.alias("grounded_ratio"), F.when(F.length(body) > 0, F.length(summary) / F.length(body)).otherwise(F.lit(0.0)).alias("compression"))


def hallucination(item: Column, source: Column) -> Column:
    """struct(tokens, ungrounded, rate): number and date tokens that the source lacks; 0 without tokens."""
    tokens, body, days = check_tokens(item), flat(source), check_tokens(source)
    bad = F.size(F.filter(tokens, lambda t: ~body.contains(t) & ~F.array_contains(days, t)))
    return F.struct(F.size(tokens).alias("tokens"), bad.alias("ungrounded"), F.when(F.size(tokens) > 0, bad / F.size(tokens)).otherwise(F.lit(0.0)).alias("rate"))


def location_check(points: DataFrame, pages: DataFrame, pattern: str = "[가-힣A-Za-z]{2,}", id_col: str = "doc_id") -> DataFrame:
    """-> (id, checked, correct, missing_page): a point's page must share the most words with it, at least one.

    points: (id, n, value, page); pages: (id, page_no, text). Documents of one page aren't scored.
    """
    vocabulary = lambda c: F.array_distinct(F.concat(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), check_tokens(c)))
    several = pages.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("page_no", vocabulary(F.col("text")).alias("w")))).alias("ps")).filter(F.size("ps") > 1)
    joined = points.join(several, id_col).withColumn("own", vocabulary(F.col("value")))
    shared = joined.withColumn("o", F.transform("ps", lambda p: F.size(F.array_intersect("own", p["w"]))))
    ok = (F.element_at("o", F.col("page")) == F.array_max("o")) & (F.array_max("o") > 0)
    return shared.groupBy(id_col).agg(F.count_if(F.col("page").isNotNull()).alias("checked"), F.count_if(F.coalesce(F.when(F.col("page").isNotNull(), ok), F.lit(False))).alias("correct"), F.count_if(F.col("page").isNull()).alias("missing_page"))


def draft_score(draft: Column, actual: Column, phrases: Column, letter: str = "[가-힣]") -> Column:
    """struct(sections, section_hits, phrases, phrase_hits, length_ratio) of a draft beside the actual text: a heading counts if
    its first six characters stand in the draft's headings."""
    wanted, got = sections(actual, letter=letter), F.array_join(sections(draft, letter=letter), " ")
    heads = F.filter(wanted, lambda s: got.contains(F.substring(s, 1, 6)))
    said = F.filter(phrases, lambda p: draft.contains(p))
    return F.struct(F.size(wanted).alias("sections"), F.size(heads).alias("section_hits"), F.size(phrases).alias("phrases"), F.size(said).alias("phrase_hits"), (F.length(draft) / F.greatest(F.length(actual), F.lit(1))).alias("length_ratio"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """-> (gold, pred, n, gold_total, share)."""
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("gold").agg(F.sum("n").alias("gold_total"))
    return counts.join(totals, "gold").withColumn("share", F.col("n") / F.col("gold_total"))


def by_evidence(cells: DataFrame, kinds: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """kinds: name -> (evidence column, outcome column) -> (by, kind, evidence, n, correct, accuracy); null outcomes don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(e).cast("string").alias("evidence"), F.col(o).alias("ok")) for k, (e, o) in kinds.items()])).alias("x")
    rows = cells.select(*by, each).select(*by, "x.*").filter("ok is not null and evidence is not null")
    return rows.groupBy(*by, "kind", "evidence").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def rules_diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """-> (key, a_value, b_value, status): same, differs, only_a, only_b."""
    both = a.select(*key, F.col(value).alias("a_value")).join(b.select(*key, F.col(value).alias("b_value")), key, "full_outer")
    status = F.when(F.col("b_value").isNull(), "only_a").when(F.col("a_value").isNull(), "only_b").when(F.col("a_value") == F.col("b_value"), "same").otherwise("differs")
    return both.withColumn("status", status)


def delegation_impact(outcomes: DataFrame, diff: DataFrame, org: str = "org", ok: str = "title_ok") -> DataFrame:
    """Wrong cells in organisations whose rules differ -> (org, cells, wrong)."""
    touched = diff.filter("status <> 'same'").select(org).distinct()
    return outcomes.join(touched, org, "left_semi").groupBy(org).agg(F.count("*").alias("cells"), F.count_if(~F.col(ok)).alias("wrong"))


def rule_items(chains: DataFrame, teams: DataFrame, extra: DataFrame, cooperation: DataFrame, bands: DataFrame) -> DataFrame:
    """A set of rules as comparable items -> (org, item, value): drafter, approver, team leads, extra reviews, cooperating
    titles, and amount bands (org, work_type or null, amount_min, amount_max, final_title)."""
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    band = F.concat(text("work_type", "*"), F.lit("|"), text("amount_min", "None"), F.lit("~"), text("amount_max", "None"), F.lit("→"), "final_title")
    of = lambda df, item, value: df.select("org", F.lit(item).alias("item"), value.alias("value"))
    parts = [
        of(chains, fixed.ROLES[0], F.col("draft")), of(chains, fixed.ROLES[2], F.col("approve")), of(teams, "팀장", F.col("lead")), of(extra, "추가경유", F.concat_ws("→", "work_type", "title")),
        of(cooperation, fixed.ROLES[3], F.explode("titles")), of(bands, "전결구간", band),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.coalesce("value", F.lit("")) != "").distinct()


def items_diff(induced: DataFrame, official: DataFrame) -> DataFrame:
    """Two sets of rule_items -> (org, item, both, only_induced, only_official), of organisations that both know."""
    sides = induced.withColumn("a", F.lit(True)).join(official.withColumn("b", F.lit(True)), ["org", "item", "value"], "full_outer")
    of = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("value"))))
    known = induced.select("org").distinct().join(official.select("org").distinct(), "org")
    grouped = sides.groupBy("org", "item").agg(of(F.expr("a and b")).alias("both"), of(F.expr("a and b is null")).alias("only_induced"), of(F.expr("b and a is null")).alias("only_official"))
    return grouped.join(known, "org", "left_semi")


def diff_totals(diff: DataFrame) -> DataFrame:
    """items_diff's rows -> one row (official_items, coverage_ratio, overgeneralised, conflict): a conflict is a drafter or approver that both sides name differently."""
    single = F.col("item").isin(fixed.ROLES[0], fixed.ROLES[2]) & (F.size("only_induced") > 0) & (F.size("only_official") > 0)
    sums = diff.agg(F.sum(F.size("both") + F.size("only_official")).alias("official_items"), F.sum(F.size("both")).alias("covered"), F.sum(F.size("only_induced")).alias("overgeneralised"), F.count_if(single).alias("conflict"))
    return sums.select("official_items", F.when(F.col("official_items") > 0, F.round(F.col("covered") / F.col("official_items"), 4)).alias("coverage_ratio"), "overgeneralised", "conflict")


def diff_table(diff: DataFrame) -> DataFrame:
    """Changed items as lines of a table in markdown -> (org, item, line)."""
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("-")
    changed = diff.filter((F.size("only_induced") > 0) | (F.size("only_official") > 0))
    return changed.select("org", "item", F.concat(F.lit("| "), F.concat_ws(" | ", "org", "item", said("both"), said("only_induced"), said("only_official")), F.lit(" |")).alias("line"))


def summary_checks(items: DataFrame, pages: DataFrame, points: DataFrame, names: list[str], id_col: str = "doc_id") -> DataFrame:
    """items(id, slot, value) of a summary, pages(id, page_no, text), points(id, n, value, page) -> (id, tokens, ungrounded,
    rate, names_in_output, checked, correct, missing_page, length_ratio): everything that is checked of a summary."""
    from docketry.functions.masking import name_pattern

    source = pages.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda s: s["text"]), "\n").alias("source"))
    said = items.join(source, id_col).withColumn("h", hallucination(F.col("value"), F.col("source")))
    out = said.groupBy(id_col).agg(F.sum("h.tokens").alias("tokens"), F.sum("h.ungrounded").alias("ungrounded"), F.array_join(F.array_sort(F.collect_list("value")), " ").alias("text"), F.first("source").alias("source"))
    hits = [F.col("text").rlike("(?U)" + name_pattern([n])).cast("int") for n in names if len(n) >= 2]
    found = out.withColumn("names_in_output", sum(hits, F.lit(0))).join(location_check(points, pages, id_col=id_col), id_col, "left").na.fill(0, ["checked", "correct", "missing_page"])
    rate = F.when(F.col("tokens") > 0, F.col("ungrounded") / F.col("tokens")).otherwise(F.lit(0.0))
    return found.select(id_col, "tokens", "ungrounded", rate.alias("rate"), "names_in_output", "checked", "correct", "missing_page", F.round(F.length("text") / F.greatest(F.length("source"), F.lit(1)), 4).alias("length_ratio"))


def case_summary(cases: DataFrame, *by: str) -> DataFrame:
    """Scores of cases (by, title_match, name_match, count_match) -> one row for each group: cases, means, perfect titles."""
    mean = lambda c: F.round(F.avg(c), 4).alias(f"{c}_mean")
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), mean("title_match"), mean("name_match"), mean("count_match"), F.count_if(F.col("title_match") == 1.0).alias("title_perfect"))


def case_summaries(cases: DataFrame, first: str, second: str) -> DataFrame:
    """case_summary by the first column alone and by both, in one pass; a null second column stands for all."""
    means = [F.round(F.avg(c), 4).alias(f"{c}_mean") for c in ("title_match", "name_match", "count_match")]
    return cases.groupingSets([[first], [first, second]], first, second).agg(F.count("*").alias("cases"), *means, F.count_if(F.col("title_match") == 1.0).alias("title_perfect"))


def type_means(pages: DataFrame, kind: str, *metrics: str) -> DataFrame:
    """Means by kind of page, rounded to four digits."""
    return pages.groupBy(kind).agg(F.count("*").alias("pages"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def micro_macro(cases: DataFrame, hits: str, wanted: str, *by: str) -> DataFrame:
    """Hits over wanted in all (micro), and the mean of the cases' ratios (macro); 0 where nothing was wanted."""
    ratio = F.when(F.col(wanted) > 0, F.col(hits) / F.col(wanted)).otherwise(F.lit(0.0))
    micro = F.when(F.sum(wanted) > 0, F.sum(hits) / F.sum(wanted)).otherwise(F.lit(0.0))
    return cases.groupBy(*by).agg(F.round(micro, 4).alias("micro"), F.round(F.avg(ratio), 4).alias("macro"))


def wins(scores: DataFrame, round_col: str, name: str, score: str, candidate: str) -> DataFrame:
    """How often the candidate's mean score of a round is no less than any other's -> (rounds, won)."""
    means = scores.groupBy(round_col, name).agg(F.avg(score).alias("m"))
    rounds = means.groupBy(round_col).agg(F.max(F.when(F.col(name) == candidate, F.col("m"))).alias("own"), F.max(F.when(F.col(name) != candidate, F.col("m"))).alias("best"))
    return rounds.agg(F.count("*").alias("rounds"), F.count_if(F.coalesce(F.col("own") >= F.col("best"), F.col("own").isNotNull())).alias("won"))


def title_counts(cells: DataFrame, title: str = "title") -> DataFrame:
    return cells.filter(F.coalesce(title, F.lit("")) != "").groupBy(title).agg(F.count("*").alias("n"))


def decidable(rows: DataFrame, level: str = "pred_level", least: int = 4) -> DataFrame:
    """Of final_verdict's rows those that predict a high level -> (n, correct)."""
    high = F.coalesce(F.col(level), F.lit(0)) >= least
    return rows.agg(F.count_if(high).alias("n"), F.count_if(high & (F.col("verdict") == "same")).alias("correct"))


def document_scores(pages: DataFrame, id_col: str = "doc_id", order: str = "page_no", compose: bool = True) -> DataFrame:
    """Scores of whole documents: their pages (ref, hyp) put together and compared once, which is not the mean of the pages."""
    whole = pages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp")))).alias("ps"))
    joined = lambda c: F.array_join(F.transform("ps", lambda p: p[c]), "\n\n")
    return text_error(whole.select(id_col, F.size("ps").alias("pages"), joined("ref").alias("ref"), joined("hyp").alias("hyp")), compose=compose)
