"""Rule tables looked up for every row: amount bands, priorities with fallbacks, intervals, chains.

Rule tables are configuration: some dozens of rows for an organisation. They are turned into one
sorted array for each key and joined on that key alone, so that a row meets its rules once and no row
is multiplied; the array's first entry that applies is taken by a higher-order function in the JVM. A
table without a key becomes a literal, behind a check of its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.extract import labelled_amount

#: Rows that a literal rule table may have, and rows of keyed rules that are broadcast.
MOST_RULES = 2_000
MOST_KEYS = 50_000


def literal_rules(rules: DataFrame, *order: str) -> Column:
    """A small table as a literal array of structs in the given order."""
    rows = rules.orderBy(*order).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; give them a key and use keyed()")
    kind = rules.schema.simpleString()
    if not rows:
        return F.array().cast(f"array<{kind}>")
    made = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema]) for r in rows]
    return F.array(*made).cast(f"array<{kind}>")


def keyed(rules: DataFrame, key: str, *order: str) -> DataFrame:
    """-> (key, rules): the rules of each key, sorted."""
    rest = [c for c in rules.columns if c != key]
    packed = F.struct(*[F.col(c) for c in order], F.struct(*rest).alias("rule"))
    return rules.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(packed)), lambda s: s["rule"]).alias("rules"))


def with_rules(rows: DataFrame, packed: DataFrame, key: str) -> DataFrame:
    """Left join on the key; the rules are broadcast if they were counted to be few."""
    few = packed.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return rows.join(F.broadcast(packed) if few else packed, key, "left")


def with_table(rows: DataFrame, rules: DataFrame, into: str, *order: str) -> DataFrame:
    """Adds all rules, sorted, as an array to every row: as a literal, or, beyond MOST_RULES, as the one row of a join. The rows of a
    rule table are configuration; the array is held once by each task."""
    if rules.limit(MOST_RULES + 1).count() <= MOST_RULES:
        return rows.withColumn(into, literal_rules(rules, *order))
    whole = keyed(rules.withColumn("_every", F.lit(0)), "_every", *order).withColumnRenamed("rules", into)
    return rows.withColumn("_every", F.lit(0)).join(F.broadcast(whole), "_every").drop("_every")


def first(rules: Column, applies) -> Column:
    """First rule that applies, or null."""
    return F.get(F.filter(rules, applies), F.lit(0))


def open_low_closed_high(amount: Column, low: Column, high: Column) -> Column:
    """Over the lower bound, up to the upper one; rules without any bound don't count."""
    return (low.isNotNull() | high.isNotNull()) & (low.isNull() | (amount > low)) & (high.isNull() | (amount <= high))


def closed(amount: Column, low: Column, high: Column) -> Column:
    """Both bounds belong; an unknown amount fails any bound."""
    return (low.isNull() | F.coalesce(amount >= low, F.lit(False))) & (high.isNull() | F.coalesce(amount <= high, F.lit(False)))


def in_interval(day: Column, start: Column, end: Column) -> Column:
    """Closed, with open ends; without a day false."""
    return day.isNotNull() & (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def band(rows: DataFrame, bands: DataFrame, amount_col: str, order: str = "rid", low: str = "amount_min", high: str = "amount_max") -> DataFrame:
    """Adds `band`: the first band, by order, that holds the amount; null without one."""
    joined = with_table(rows, bands, "_bands", order)
    return joined.withColumn("band", first(F.col("_bands"), lambda r: open_low_closed_high(F.col(amount_col), r[low], r[high]))).drop("_bands")


def delegate(rows: DataFrame, rules: DataFrame, fallback: DataFrame, key: str = "org", type_col: str = "work_type", amount_col: str = "amount") -> DataFrame:
    """Adds final_title and rule_source by priority, then the organisation's fallback, then none.

    rules: (key, priority, work_types array or null for any, amount_min, amount_max, final_title);
    fallback: (key, final_title).
    """
    joined = with_rules(rows, keyed(rules, key, "priority", "final_title"), key)
    fits = lambda r: (r["work_types"].isNull() | F.array_contains(r["work_types"], F.col(type_col))) & closed(F.col(amount_col), r["amount_min"], r["amount_max"])
    found = joined.withColumn("_hit", first(F.col("rules"), fits)).drop("rules")
    rest = fallback.select(key, F.col("final_title").alias("_fallback"))
    out = found.join(F.broadcast(rest) if rest.limit(MOST_KEYS + 1).count() <= MOST_KEYS else rest, key, "left")
    source = F.when(F.col("_hit").isNotNull(), "rule").when(F.col("_fallback").isNotNull(), "fallback").otherwise("none")
    return out.withColumn("final_title", F.coalesce("_hit.final_title", "_fallback")).withColumn("rule_source", source).drop("_hit", "_fallback")


def acting(slots: DataFrame, spells: DataFrame, slot_col: str = "slot", day_col: str = "day") -> DataFrame:
    """Adds `acting` (by, mode): the first spell of the slot, by its start, that holds the day."""
    joined = with_rules(slots, keyed(spells.withColumnRenamed("slot", slot_col), slot_col, "from_date", "by"), slot_col)
    return joined.withColumn("acting", first(F.col("rules"), lambda r: in_interval(F.col(day_col), r["from_date"], r["to_date"]))).drop("rules")


def merge_equal(rows: DataFrame, keys: list[str], order: str, value: str, joined: str, separator: str = "+") -> DataFrame:
    """Runs of equal values become one row: (keys, seq, value, joined texts, n, first: the order of its first row)."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = rows.withColumn("_new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = flagged.withColumn("seq", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, joined))), lambda s: s[joined])
    return runs.groupBy(*keys, "seq").agg(F.min(value).alias(value), F.array_join(parts, separator).alias(joined), F.count("*").alias("n"), F.min(order).alias("first"))


def role_by_place(rows: DataFrame, keys: list[str], order: str, single: str = "기안", names: tuple[str, str, str] = ("기안", "검토", "결재")) -> DataFrame:
    """Adds `role`: the first drafts, the last approves, those between review."""
    w = Window.partitionBy(*keys)
    place, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return rows.withColumn("role", F.when(n == 1, single).when(place == 1, names[0]).when(place == n, names[2]).otherwise(names[1]))


def slot_chain(requests: DataFrame, chart: DataFrame, spells: DataFrame, skip_deputy: list[str] = (), deputy_level: int = 4) -> DataFrame:
    """Approval chain of each request up to its final level -> (req, seq, title, slot, evidence, acting_by, n, role).

    requests: (req, dept, team, day, final_level); chart: (dept, team or null, slot, title, level); the drafter
    (level 0) always stays. spells: (ord, slot, by, from_date, to_date, mode), applied in their order: mode
    'annotate' keeps the slot's title, notes who acts, and takes out the slots of that person's title; any other mode
    puts the acting person's title in. Neighbours of equal titles, white space aside, merge.
    """
    slots = requests.join(chart.withColumnRenamed("team", "_team"), "dept").filter(F.col("_team").isNull() | (F.col("_team") == F.col("team")))
    slots = slots.filter((F.col("level") == 0) | (F.col("level") <= F.col("final_level")))
    if skip_deputy:
        slots = slots.filter(~((F.col("level") == deputy_level) & F.col("dept").isin(*skip_deputy)))
    cell = F.struct("level", "slot", "title", F.lit("org_chart").alias("evidence"), F.lit(None).cast("string").alias("acting_by"))
    lines = slots.groupBy("req").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.first("day").alias("day"))
    kind = "array<struct<level: int, slot: string, title: string, evidence: string, acting_by: string>>"

    def applied(cells: Column, s: Column) -> Column:
        mine = lambda c: c["slot"] == s["slot"]
        fields = lambda c, title, evidence, by: F.struct(c["level"].alias("level"), c["slot"].alias("slot"), title.alias("title"), evidence.alias("evidence"), by.alias("acting_by"))
        noted = lambda c: fields(c, c["title"], F.concat(c["evidence"], F.lit("+acting:"), s["by"]), s["by"])
        put = lambda c: fields(c, s["by"], F.concat(F.lit("acting:"), s["slot"]), c["acting_by"])
        stays = F.filter(cells, lambda c: mine(c) | (c["title"] != s["by"]))
        annotated = F.transform(F.when(F.exists(cells, mine), stays).otherwise(cells), lambda c: F.when(mine(c), noted(c)).otherwise(c))
        return F.when(s["mode"] == "annotate", annotated).otherwise(F.transform(cells, lambda c: F.when(mine(c), put(c)).otherwise(c))).cast(kind)

    held = F.filter(literal_rules(spells, "ord"), lambda s: in_interval(F.col("day"), s["from_date"], s["to_date"]))
    done = lines.select("req", F.posexplode(F.aggregate(held, F.col("cells").cast(kind), applied)).alias("place", "c")).select("req", "place", "c.*")
    merged = merge_equal(done.withColumn("_flat", F.regexp_replace("title", r"(?U)\s+", "")), ["req"], "place", "_flat", "slot")
    started = merged.join(done.select("req", F.col("place").alias("first"), "title", "evidence", "acting_by"), ["req", "first"])
    return role_by_place(started.select("req", "seq", "title", "slot", "evidence", "acting_by", "n"), ["req"], "seq")


def pick_team(docs: DataFrame, teams: DataFrame, id_col: str = "doc_id", title_col: str = "title", body_col: str = "body", body_chars: int = 1500) -> DataFrame:
    """-> (id, team, score, tied): a keyword in the title counts 3, else in the body's start 1; ties to the first team.

    teams: (org, ord, lead, keywords array); docs have org. No team if the best score is 0.
    """
    joined = with_rules(docs, keyed(teams, "org", "ord"), "org")
    head = F.substring(F.col(body_col), 1, body_chars)
    points = lambda t: F.aggregate(t["keywords"], F.lit(0), lambda a, k: a + F.when(F.col(title_col).contains(k), 3).when(head.contains(k), 1).otherwise(0))
    scored = F.transform("rules", lambda t: F.struct(points(t).alias("score"), t["lead"].alias("team")))
    best = F.array_max(F.transform(scored, lambda s: s["score"]))
    top = F.filter(scored, lambda s: s["score"] == best)
    return joined.select(id_col, F.when(best > 0, F.get(top, F.lit(0))["team"]).alias("team"), F.coalesce(best, F.lit(0)).alias("score"), ((best > 0) & (F.size(top) > 1)).alias("tied"))


def cooperation(docs: DataFrame, rules: DataFrame, id_col: str = "doc_id", type_col: str = "work_type", text_col: str = "title") -> DataFrame:
    """-> (id, title): of rules that are required or whose trigger occurs; each title once, in rule order.

    rules: (org, ord, work_types, titles, required, triggers).
    """
    joined = with_rules(docs, keyed(rules, "org", "ord"), "org")
    fits = lambda r: (r["work_types"].isNull() | F.array_contains(r["work_types"], F.col(type_col))) & (r["required"] | F.exists(F.coalesce(r["triggers"], F.array().cast("array<string>")), lambda k: F.col(text_col).contains(k)))
    titles = F.array_distinct(F.flatten(F.transform(F.filter("rules", fits), lambda r: r["titles"])))
    return joined.select(id_col, F.posexplode(titles).alias("ord", "title"))


def build_line(docs: DataFrame, teams: DataFrame, extra: DataFrame, rules: DataFrame, fallback: DataFrame, coop: DataFrame, roster: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Approval line by rules -> (id, ord, role, title, name, evidence).

    docs: (id, org, dept, title, body, work_type, amount, drafter). Drafter, the routed team's lead,
    extra reviewers, final approver, cooperation; a reviewer who is also the final approver or came
    before is left out. roster: (org, title, name).
    """
    team = pick_team(docs, teams, id_col).filter("team is not null").join(docs.select(id_col, "org"), id_col)
    final = delegate(docs, rules, fallback).select(id_col, "org", "final_title", "rule_source")
    more = docs.select(id_col, "org", "work_type").join(extra.withColumnRenamed("title", "extra"), "org").filter(F.col("work_types").isNull() | F.array_contains("work_types", F.col("work_type")))
    cell = lambda df, o, role, title, why: df.select(id_col, "org", F.lit(o).alias("o"), F.lit(role).alias("role"), title.alias("title"), why.alias("evidence"))
    cells = cell(docs, 0, "기안", F.col("drafter"), F.lit("drafter"))
    cells = cells.unionByName(cell(team, 1, "검토", F.col("team"), F.when(F.col("tied"), "team_tied").otherwise("team")))
    cells = cells.unionByName(cell(more, 2, "검토", F.col("extra"), F.lit("extra")))
    cells = cells.unionByName(cell(final.filter("final_title is not null"), 3, "결재", F.col("final_title"), F.col("rule_source")))
    also = cooperation(docs, coop, id_col).join(docs.select(id_col, "org"), id_col)
    cells = cells.unionByName(cell(also, 4, "협조", F.col("title"), F.lit("cooperation")))
    # one row for each title among reviewers and approver; the approver's cell wins
    w = Window.partitionBy(id_col, F.when(F.col("o").isin(1, 2, 3), F.lit("line")).otherwise(F.col("role")), "title").orderBy(F.desc(F.col("o") == 3), "o")
    unique = cells.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    named = unique.join(roster.groupBy("org", "title").agg(F.min("name").alias("name")), ["org", "title"], "left")
    place = Window.partitionBy(id_col).orderBy("o", "title")
    return named.select(id_col, (F.row_number().over(place)).alias("ord"), "role", "title", "name", "evidence")


def execution_category(title: Column, categories: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Key of the category whose keyword starts furthest to the right; the last category without one."""
    start = lambda k: F.when(title.contains(k), F.length(F.substring_index(title, k, -1)) + len(k))  # noqa: E731  characters from its start to the end
    spots = [F.struct((-start(k)).alias("at"), F.lit(-i).alias("i"), F.lit(key).alias("key")) for i, (key, ks) in enumerate(categories) for k in ks]
    found = [F.when(s["at"].isNotNull(), s) for s in spots]
    return F.coalesce(F.array_max(F.array(*found))["key"], F.lit(categories[-1][0]))


def is_execution(title: Column, strong: tuple[str, ...], weak: tuple[str, ...], excluded_ending: str | None = None) -> Column:
    """A strong keyword decides; a weak one unless the title ends with what excludes it."""
    from docketry.functions.text import has_any, strip_spaces

    flat, bare = strip_spaces(title), lambda ks: tuple("".join(k.split()) for k in ks)
    out = has_any(flat, bare(weak))
    if excluded_ending:
        out = out & ~flat.rlike(excluded_ending)
    return has_any(flat, bare(strong)) | out


def roster_by_recency(cells: DataFrame) -> DataFrame:
    """(org, title, name, date, doc_no) -> (org, title, name, rank): distinct names, latest first."""
    last = cells.groupBy("org", "title", "name").agg(F.max(F.struct("date", "doc_no")).alias("at"))
    w = Window.partitionBy("org", "title").orderBy(F.desc("at"), "name")
    return last.select("org", "title", "name", F.row_number().over(w).alias("rank"))


def with_prior(routed: DataFrame, teams: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pick_team's rows with lead and prior: no lead on ties and without a hit; prior is the organisation's team with the
    most documents (teams: with observed_docs), the first on ties."""
    often = teams.groupBy("org").agg(F.max_by("lead", F.struct("observed_docs", -F.col("ord"))).alias("prior"))
    placed = routed.join(docs.select(id_col, "org"), id_col).join(often, "org", "left")
    return placed.withColumn("lead", F.when(~F.col("tied"), F.col("team")))


def execution(docs: DataFrame, bands: DataFrame, categories: list[tuple[str, tuple[str, ...], str]], labels: list[str], id_col: str = "doc_id") -> DataFrame:
    """docs(id, title, body) of execution requests -> (id, category, amount, amount_label, row, level).

    categories: (key, keywords, what the table's items say); bands: (rid, sheet, item, amount_min, amount_max,
    final_level), of which the common sheets count; the first that holds the amount, over its lower bound and up to the upper one.
    """
    kind = execution_category(F.col("title"), [(key, words) for key, words, _ in categories])
    found = labelled_amount(docs, labels, id_col, "body").withColumnRenamed("label", "amount_label")
    said = F.create_map(*[F.lit(x) for key, _, table in categories for x in (key, table)])
    rows = docs.select(id_col, kind.alias("category")).join(found, id_col, "left").withColumn("_said", said[F.col("category")])
    rows = with_table(rows, bands.filter(F.col("sheet").startswith(fixed.COMMON_SHEET)), "_bands", "rid")
    hit = first(F.col("_bands"), lambda r: r["item"].contains(F.col("_said")) & F.coalesce(open_low_closed_high(F.col("amount"), r["amount_min"], r["amount_max"]), F.lit(False)))
    return rows.withColumn("_hit", F.when(F.col("amount").isNotNull(), hit)).select(id_col, "category", "amount", "amount_label", F.col("_hit.item").alias("row"), F.col("_hit.final_level").alias("level"))


def decide_final(docs: DataFrame, executes: Column, executed: DataFrame, ranked: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """-> (id, source, category, amount, rid, row, level): execution requests by their amount, others by the best row of a search.

    executes tells the branch; executed: what execution() gives; ranked: (id, rank, rid); table: (rid, sheet, item, final_level).
    """
    kinds = dict(executed.dtypes)
    by_amount = docs.filter(executes).select(id_col).join(executed, id_col).select(id_col, F.lit("amount_bracket").alias("source"), "category", "amount", F.lit(None).cast("int").alias("rid"), "row", "level")
    named = table.select("rid", F.concat(F.lit("["), "sheet", F.lit("] "), "item").alias("row"), F.col("final_level").alias("level"))
    top = docs.filter(~executes).select(id_col).join(ranked.filter("rank = 1").select(id_col, "rid"), id_col).join(named, "rid")
    by_row = top.select(id_col, F.lit("top1").alias("source"), F.lit(None).cast("string").alias("category"), F.lit(None).cast(kinds["amount"]).alias("amount"), F.col("rid").cast("int").alias("rid"), "row", "level")
    return by_amount.unionByName(by_row)


def team_lead(teams: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds lead to requests (req, dept, team): a title stays; a team's name gives the chart's lead, or its name as a title.

    teams: (dept, team, lead).
    """
    known = teams.select("dept", "team", F.nullif("lead", F.lit("")).alias("_lead"))
    joined = requests.join(known, ["dept", "team"], "left")
    is_title = F.col("team").endswith("팀장") | F.col("team").endswith("소장")
    return joined.withColumn("lead", F.when(F.col("team") == "", None).when(is_title, F.col("team")).otherwise(F.coalesce("_lead", F.concat("team", F.lit("장"))))).drop("_lead")


def team_of_lead(teams: DataFrame, requests: DataFrame) -> DataFrame:
    """Adds team to requests (req, dept, lead): the department's first team (by ord) with that lead, white space aside."""
    flat = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    by_lead = teams.groupBy("dept", flat("lead").alias("_flat")).agg(F.min_by("team", "ord").alias("team"))
    return requests.withColumn("_flat", flat("lead")).join(by_lead, ["dept", "_flat"], "left").drop("_flat")


def confirmations(finals: DataFrame, cells: DataFrame, requests: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a drafter should confirm -> (id, what, why), from decide_final's rows, slot_chain's cells (by id) and requests
    (id, dept_known, lead, lead_team)."""
    level = F.create_map(*[F.lit(x) for kv in fixed.LEVEL_NAMES.items() for x in kv])[F.col("level")]
    asks = F.array_compact(F.array(
        F.when(F.col("level").isNull(), F.struct(F.lit("금액").alias("what"), F.col("category").alias("why"))),
        F.when(F.col("level").isNotNull() & (F.col("source") != "amount_bracket"), F.struct(F.lit("전결 사무").alias("what"), F.col("row").alias("why"))),
        F.when(F.col("level") < 5, F.struct(F.lit("상향 결재").alias("what"), level.alias("why"))),
    ))
    known = requests.filter("dept_known")
    of_final = finals.join(known.select(id_col), id_col, "left_semi").select(id_col, F.explode(asks).alias("a")).select(id_col, "a.*")
    of_team = known.filter("lead is not null and lead_team is null").select(id_col, F.lit("팀").alias("what"), F.col("lead").alias("why"))
    of_cells = cells.filter(F.col("evidence").contains("acting")).select(id_col, F.lit("직무대리").alias("what"), F.concat("slot", F.lit(" → "), F.coalesce("acting_by", "title")).alias("why"))
    return requests.filter("not dept_known").select(id_col, F.lit("부서").alias("what"), F.col("dept").alias("why")).unionByName(of_final).unionByName(of_team).unionByName(of_cells)


def identify(people: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (req, name) against people (name, org, title) -> (req, status, org, title)."""
    found = requests.join(people.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("org", "title")).alias("p")), "name", "left")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    one = F.col("n") == 1
    return found.select("req", status.alias("status"), F.when(one, F.col("p.org")).alias("org"), F.when(one, F.col("p.title")).alias("title"))
