"""Requests handled from end to end: who asks, who finally approves, the approval line, and what the drafter should confirm.

A table of requests is read once. One projection tells each request's branch and works out all that its own row and small,
broadcast rule tables can tell; its slim rows, without bodies, are written to the shared folder. Branches are disjoint: execution
requests take their final level from an amount band, other requests of the published rules from a search among the delegation table's
rows, requests of other organisations from their bundle of rules, and those of unknown people from nothing. Only the search
shuffles, and only its own rows. Chains of slots and reasons for confirmation are expressions over arrays within the row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.extract import amount as stated_amount
from docketry.functions.extract import labelled
from docketry.functions.shared import stable
from docketry.functions.text import strip_spaces, title_level, work_type
from docketry.operators import bundles, retrieval, rules
from docketry.operators.bundles import once

OFFICIAL, SEARCHED, BAND, NO_DEPT, INDUCED, UNKNOWN = "official", "row_search", "amount_bracket", "unknown_dept", "identified", "unknown_user"
#: The columns of requests; texts may be null.
REQUEST = "req bigint, dept string, team string, user_name string, org string, user_title string, title string, body string, attachments array<string>, day string"
CHAIN = "array<struct<slot: string, title: string, level: int, evidence: string, acting_by: string>>"
LINE = "array<struct<role: string, title: string, slot: string, evidence: string, acting_by: string>>"
FINAL = "struct<source: string, category: string, amount: bigint, amount_label: string, rid: int, row: string, level: int>"
NEEDS = "array<struct<what: string, why: string>>"
#: Characters of a body that go into a search among the table's rows, and the title that a request has that states none.
QUERY_CHARS, DEFAULT_TITLE = 300, "주무관"


@dataclass(frozen=True)
class Published:
    """The published rules of one organisation.

    departments: (dept, bureau, head); teams: (dept, ord, team, lead); table: (rid, sheet, group, item, amount_min, amount_max,
    final_level); spells: (ord, slot, by, from_date, to_date, mode); categories: (key, keywords, what the table's items say).
    """

    name: str
    departments: DataFrame
    teams: DataFrame
    table: DataFrame
    spells: DataFrame
    categories: list[tuple[str, tuple[str, ...], str]]
    labels: list[str]
    strong: tuple[str, ...]
    weak: tuple[str, ...]
    excluded_ending: str | None = None
    skip_deputy: list[str] = field(default_factory=list)


def _cells(kind: str, *made: Column) -> Column:
    """An array of those of the structs that are not null."""
    return F.array_compact(F.array(*made)).cast(kind)


def chain(dept: Column, head: Column, bureau: Column, drafter: Column, lead: Column, day: Column, level: Column, spells: Column, skip_deputy: list[str] = ()) -> Column:
    """The slots of a department's chain up to the level, merged and with roles: array<struct(role, title, slot, evidence, acting_by)>.

    The drafter always stays. Spells (an array, in order) that hold on the day put the acting person's title into a slot; those of
    mode 'annotate' only note who acts, and take out the slots of that person's title. Neighbours of equal titles, white space
    aside, are one cell. The first drafts, the last approves.
    """
    slot = lambda name, title, n, why, ok=F.lit(True): F.when(ok & (F.lit(n) <= level), F.struct(name.alias("slot"), title.alias("title"), F.lit(n).alias("level"), F.lit(why).alias("evidence"), F.lit(None).cast("string").alias("acting_by")))
    first = F.array(F.struct(F.lit(fixed.ROLES[0]).alias("slot"), drafter.alias("title"), title_level(drafter).alias("level"), F.lit("input").alias("evidence"), F.lit(None).cast("string").alias("acting_by"))).cast(CHAIN)
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    rest = _cells(
        CHAIN, slot(F.lit("팀장"), lead, 1, "input:team", some(lead) & (lead != drafter)), slot(F.lit("과장"), head, 2, "org_chart", head != drafter),
        slot(F.concat(F.lit("국장:"), bureau), F.concat(bureau, F.lit("장")), 3, "org_chart", some(bureau)),
        slot(F.lit("부군수"), F.lit("부군수"), 4, "org_chart", ~dept.isin(*skip_deputy) if skip_deputy else F.lit(True)), slot(F.lit("군수"), F.lit("군수"), 5, "org_chart"),
    )

    def applied(cells: Column, s: Column) -> Column:
        mine = lambda c: c["slot"] == s["slot"]
        again = lambda c, title, why, by: F.struct(c["slot"].alias("slot"), title.alias("title"), c["level"].alias("level"), why.alias("evidence"), by.alias("acting_by"))
        noted = lambda c: again(c, c["title"], F.concat(c["evidence"], F.lit("+acting:"), s["by"]), s["by"])
        put = lambda c: again(c, s["by"], F.concat(F.lit("acting:"), s["slot"]), c["acting_by"])
        stays = F.when(F.exists(cells, mine), F.filter(cells, lambda c: mine(c) | (c["title"] != s["by"]))).otherwise(cells)
        return F.when(s["mode"] == "annotate", F.transform(stays, lambda c: F.when(mine(c), noted(c)).otherwise(c))).otherwise(F.transform(cells, lambda c: F.when(mine(c), put(c)).otherwise(c))).cast(CHAIN)

    def merged(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(F.concat(last["slot"], F.lit("+"), c["slot"]).alias("slot"), *[last[f].alias(f) for f in ("title", "level", "evidence", "acting_by")])
        same = (F.size(done) > 0) & (strip_spaces(F.try_element_at(done, F.lit(-1))["title"]) == strip_spaces(c["title"]))
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined).cast(CHAIN))).otherwise(F.concat(done, F.array(c))).cast(CHAIN)

    held = F.filter(spells, lambda s: rules.in_interval(day, s["from_date"], s["to_date"]))
    cells = F.aggregate(F.aggregate(held, F.concat(first, rest), applied), F.array().cast(CHAIN), merged)
    role = lambda i, n: F.when(i == 0, fixed.ROLES[0]).when(i == n - 1, fixed.ROLES[2]).otherwise(fixed.ROLES[1])
    return once(cells, lambda cs: F.transform(cs, lambda c, i: F.struct(role(i, F.size(cs)).alias("role"), c["title"].alias("title"), c["slot"].alias("slot"), c["evidence"].alias("evidence"), c["acting_by"].alias("acting_by")))).cast(LINE)


def with_department(requests: DataFrame, published: Published) -> DataFrame:
    """Adds _d: null, or the department's struct(bureau, head, by_team: team -> lead, leads: flat titles of all leads)."""
    # a team that is listed twice has the first lead
    listed = published.teams.filter(F.coalesce("lead", F.lit("")) != "").groupBy("dept", "team").agg(F.min_by("lead", "ord").alias("lead"))
    own = listed.groupBy("dept").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("team").isNotNull(), F.struct("team", "lead")))).alias("by_team"), F.collect_set(strip_spaces(F.col("lead"))).alias("leads"),
    )
    known = published.departments.join(own, "dept", "left").select("dept", F.struct("bureau", "head", "by_team", F.coalesce("leads", F.array().cast("array<string>")).alias("leads")).alias("_d"))
    few = known.limit(rules.MOST_KEYS + 1).count() <= rules.MOST_KEYS
    return requests.join(F.broadcast(known) if few else known, "dept", "left")


def team_title(team: Column, by_team: Column) -> Column:
    """The title of a team's lead: a title stays; else what the chart says; else the team's name as a title. Null without a team."""
    named = F.coalesce(F.try_element_at(by_team, team), F.concat(team, F.lit("장")))
    return F.when(F.coalesce(team, F.lit("")) == "", None).when(team.endswith("팀장") | team.endswith("소장"), team).otherwise(named)


def _official(rows: DataFrame, published: Published, any_dept: bool = False) -> DataFrame:
    """Adds _branch, _lead, final and query to rows with _d, drafter, text: all that the row itself can tell. any_dept: departments that the
    chart lacks are decided too, by the common sheets."""
    title = F.col("title")
    kind = rules.execution_category(title, [(key, words) for key, words, _ in published.categories])
    says = F.create_map(*[F.lit(x) for key, _, table in published.categories for x in (key, table)])
    bands = published.table.filter(F.col("sheet").startswith(fixed.COMMON_SHEET) & (F.col("amount_min").isNotNull() | F.col("amount_max").isNotNull()))
    table = rules.literal_rules(bands.select("rid", "item", "amount_min", "amount_max", "final_level"), "rid")

    def by_amount(x: Column) -> Column:
        n = x["hit"]["amount"]
        fits = lambda r: r["item"].contains(says[x["kind"]]) & rules.open_low_closed_high(n, r["amount_min"], r["amount_max"])
        row = F.when(n.isNotNull(), rules.first(table, fits))
        return once(row, lambda r: F.struct(F.lit(BAND).alias("source"), x["kind"].alias("category"), n.alias("amount"), x["hit"]["label"].alias("amount_label"), F.lit(None).cast("int").alias("rid"), r["item"].alias("row"), r["final_level"].alias("level"))).cast(FINAL)

    executes = rules.is_execution(title, published.strong, published.weak, published.excluded_ending)
    branch = F.when(F.col("_d").isNull() & F.lit(not any_dept), NO_DEPT).when(executes, BAND).otherwise(SEARCHED)
    lead = F.when(title_level(F.col("drafter")) == 0, team_title(F.col("team"), F.col("_d.by_team")))
    found = rows.withColumn("_branch", branch).withColumn("_lead", lead)
    banded = once(F.struct(kind.alias("kind"), labelled(F.col("text"), published.labels).alias("hit")), by_amount)
    query = F.concat(title, F.lit(" "), F.substring("text", 1, QUERY_CHARS))
    return found.withColumn("final", F.when(F.col("_branch") == BAND, banded)).withColumn("query", F.when(F.col("_branch") == SEARCHED, query))


def _searched(rows: DataFrame, published: Published, k: int) -> DataFrame:
    """Adds what the best of k candidate rows says, and the candidates' ids, to the requests of that branch."""
    asked = rows.select(F.col("req").alias("query_id"), "dept", "query")
    hits = retrieval.candidates(asked, published.table, k)
    best = hits.groupBy(F.col("query_id").alias("req")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rid"))), lambda h: h["rid"]).alias("candidates"))
    said = published.table.select(F.col("rid").alias("_rid"), F.concat(F.lit("["), "sheet", F.lit("] "), "item").alias("_row"), F.col("final_level").alias("_level"))
    few = said.limit(rules.MOST_KEYS + 1).count() <= rules.MOST_KEYS
    told = best.withColumn("_rid", F.col("candidates")[0]).join(F.broadcast(said) if few else said, "_rid")
    none = F.lit(None).cast("string")
    final = F.struct(F.lit("top1").alias("source"), none.alias("category"), F.lit(None).cast("bigint").alias("amount"), none.alias("amount_label"), F.col("_rid").cast("int").alias("rid"), F.col("_row").alias("row"), F.col("_level").alias("level")).cast(FINAL)
    found = told.select("req", final.alias("_final"), "candidates")
    bare = F.struct(F.lit("top1").alias("source"), *[F.lit(None).alias(f) for f in ("category", "amount", "amount_label", "rid", "row", "level")]).cast(FINAL)
    return rows.join(found, "req", "left").withColumn("final", F.coalesce("_final", bare)).drop("_final")


def _finished(rows: DataFrame, published: Published) -> DataFrame:
    """Adds cells and needs by the final level."""
    level = F.col("final.level")
    names = F.create_map(*[F.lit(x) for kv in fixed.LEVEL_NAMES.items() for x in kv])
    spells = rules.literal_rules(published.spells, "ord")
    made = chain(F.col("dept"), F.col("_d.head"), F.col("_d.bureau"), F.col("drafter"), F.col("_lead"), F.col("day"), F.coalesce(level, F.lit(5)), spells, published.skip_deputy)
    known = F.col("_branch") != NO_DEPT
    need = lambda what, why, when: F.when(when, F.struct(F.lit(what).alias("what"), why.alias("why")))
    strange = F.col("_lead").isNotNull() & ~F.array_contains("_d.leads", strip_spaces(F.col("_lead")))
    out = rows.withColumn("cells", F.when(known, made).otherwise(F.array().cast(LINE)))
    acting = F.transform(F.filter("cells", lambda c: c["evidence"].contains("acting")), lambda c: F.struct(F.lit("직무대리").alias("what"), F.concat(c["slot"], F.lit(" → "), F.coalesce(c["acting_by"], c["title"])).alias("why")))
    asked = _cells(
        NEEDS, need("부서", F.col("dept"), ~known), need("금액", F.col("final.category"), known & level.isNull() & (F.col("_branch") == BAND)),
        need("전결 사무", F.coalesce("final.row", F.col("title")), known & (F.col("_branch") == SEARCHED)), need("상향 결재", names[level], known & (level < 5)),
        need("팀", F.col("_lead"), known & strange),
    )
    return out.withColumn("needs", F.concat(asked, acting.cast(NEEDS))).withColumn("final_title", names[level])


def decided(rows: DataFrame, published: Published, k: int = 5) -> DataFrame:
    """rows(req, dept, team, drafter, title, text, ...) -> the same with _d, _branch, _lead, final and candidates: the final level of each
    request by the published rules, those of departments that the chart lacks too. The rows are written to the shared folder once; each branch is worked on by itself."""
    told = stable(_official(with_department(rows, published), published, any_dept=True).drop("text"))
    rest = told.filter(F.col("_branch") != SEARCHED).withColumn("candidates", F.lit(None).cast("array<int>"))
    return rest.unionByName(_searched(told.filter(F.col("_branch") == SEARCHED), published, k).withColumn("candidates", F.col("candidates").cast("array<int>"))).drop("query")


def _texts(requests: DataFrame) -> DataFrame:
    """Requests without nulls in their texts; `text` is the body with the attachments behind."""
    filled = requests.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("body", F.coalesce("body", F.lit("")))
    return filled.withColumn("text", F.concat("body", F.lit("\n"), F.coalesce(F.array_join("attachments", "\n"), F.lit("")))).withColumn("day", F.coalesce(F.col("day").cast("string"), F.current_date().cast("string")))


_OUT = ["req", "branch", "user", "work_type", "final", "final_title", "candidates", "cells", "needs"]
_USER = "struct<org: string, title: string, source: string>"


def handle(requests: DataFrame, published: Published, bundled: DataFrame, people: DataFrame, missing: DataFrame | None = None, rejected: DataFrame | None = None, k: int = 5) -> DataFrame:
    """-> one row for each request: (req, branch, user, work_type, final, final_title, candidates, cells, needs).

    Requests that name a department go by the published rules. Others are asked for their user: organisation and title as given, else by
    a name that one row of people (name, org, title) has; an unknown or ambiguous one ends there. Their line comes from their
    organisation's bundle. missing: (req, label, hint) of required sections that a draft lacks, and rejected: (req) of summaries
    that lost items for want of a source, add their reasons. Ids of requests are unique.
    """
    told = F.struct("org", F.col("user_title").alias("title"), F.lit("input").alias("source")).cast(_USER)
    named = people.filter(F.coalesce("name", F.lit("")) != "").groupBy(F.col("name").alias("user_name")).agg(F.count("*").alias("_n"), F.min(F.struct("org", "title")).alias("_p"))
    few = named.limit(rules.MOST_KEYS + 1).count() <= rules.MOST_KEYS
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    met = _texts(requests).join(F.broadcast(named) if few else named, "user_name", "left")
    by_name = F.struct(F.col("_p.org").alias("org"), F.col("_p.title").alias("title"), F.lit("roster").alias("source")).cast(_USER)
    nobody = F.struct(F.lit(None).alias("org"), F.lit(None).alias("title"), F.when(F.col("_n") > 1, "ambiguous").otherwise("unknown").alias("source")).cast(_USER)
    asks = F.struct(F.lit(published.name).alias("org"), F.coalesce(F.nullif("user_title", F.lit("")), F.lit(DEFAULT_TITLE)).alias("title"), F.lit("input").alias("source")).cast(_USER)
    user = F.when(some("dept"), asks).when(some("org") & some("user_title"), told).when(F.col("_n") == 1, by_name).otherwise(nobody)
    met = with_department(met.withColumn("user", user).withColumn("drafter", F.col("user.title")), published)
    met = _official(met, published)
    ruled = bundles.packed(bundled, "_b")
    small = ruled.limit(rules.MOST_KEYS + 1).count() <= rules.MOST_KEYS
    met = met.withColumn("_org", F.col("user.org")).join((F.broadcast(ruled) if small else ruled).withColumnRenamed("org", "_org"), "_org", "left")
    branch = F.when(some("dept"), F.col("_branch")).when(F.col("user.org").isNotNull(), INDUCED).otherwise(UNKNOWN)
    kind = work_type(F.col("title"))
    cells = bundles.line(F.col("drafter"), kind, F.col("title"), F.col("text"), stated_amount(F.col("text")), "_b")
    own = F.transform(cells, lambda c: F.struct(c["role"].alias("role"), c["title"].alias("title"), F.lit(None).cast("string").alias("slot"), c["evidence"].alias("evidence"), F.lit(None).cast("string").alias("acting_by"))).cast(LINE)
    slim = met.withColumn("branch", branch).select(
        "req", "branch", "_branch", "user", "dept", "drafter", "_lead", "_d", "day", "title", F.when(F.col("branch") == BAND, F.col("final")).alias("final"), F.when(F.col("branch") == SEARCHED, F.col("query")).alias("query"),
        F.when(F.col("branch") == INDUCED, kind).alias("work_type"), F.when(F.col("branch") == INDUCED, own).alias("line"), F.col("_b.provenance").alias("provenance"), F.col("_b").isNotNull().alias("ruled"),
    )
    slim = stable(slim)
    ids = F.lit(None).cast("array<int>")
    by_search = _searched(slim.filter(F.col("branch") == SEARCHED), published, k).withColumn("candidates", F.col("candidates").cast("array<int>"))
    official = _finished(slim.filter(F.col("branch").isin(BAND, NO_DEPT)).withColumn("candidates", ids).unionByName(by_search), published)
    drafts = F.struct(F.lit("초안").alias("what"), F.lit(published.name).alias("why"))
    official = official.withColumn("needs", F.when(F.col("branch") == NO_DEPT, F.col("needs")).otherwise(F.concat("needs", F.array(drafts).cast(NEEDS))))
    need = lambda what, why, when=F.lit(True): F.when(when, F.struct(F.lit(what).alias("what"), why.alias("why")))
    reasons = F.when(F.col("branch") == UNKNOWN, _cells(NEEDS, need("기안자", F.col("user.source")))).otherwise(
        _cells(NEEDS, need("전결규정", F.col("user.org"), ~F.col("ruled")), need("최종 결재자", F.col("provenance"), F.col("ruled") & (F.coalesce("provenance", F.lit("")) != OFFICIAL)))
    )
    other = slim.filter(F.col("branch").isin(INDUCED, UNKNOWN)).withColumns({"candidates": ids, "needs": reasons, "cells": F.coalesce("line", F.array().cast(LINE))})
    other = other.withColumn("final_title", F.get(F.filter("cells", lambda c: c["role"] == fixed.ROLES[2]), F.lit(0))["title"])
    out = official.select(*_OUT).unionByName(other.select(*_OUT))
    for more, what in ((missing, None), (rejected, "요약")):
        if more is not None:
            reason = F.struct((F.lit(what) if what else F.col("label")).alias("what"), (F.lit("ungrounded") if what else F.col("hint")).alias("why"))
            added = more.groupBy("req").agg(F.array_sort(F.array_distinct(F.collect_list(reason))).cast(NEEDS).alias("_more"))
            out = out.join(added, "req", "left").withColumn("needs", F.when(F.col("branch") == INDUCED, F.concat("needs", F.coalesce("_more", F.array().cast(NEEDS)))).otherwise(F.col("needs"))).drop("_more")
    return out


def reasons(handled: DataFrame) -> DataFrame:
    """-> (req, ord, what, why): what each drafter should confirm."""
    return handled.select("req", F.posexplode("needs").alias("ord", "n")).select("req", "ord", "n.what", "n.why")


def lines(handled: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """-> (req, ord, role, title, name, slot, evidence); names by organisation and title where a roster (org, title, name) is given."""
    cells = handled.select("req", F.col("user.org").alias("org"), F.posexplode("cells").alias("ord", "c")).select("req", "org", "ord", "c.role", "c.title", "c.slot", "c.evidence")
    if roster is None:
        return cells.select("req", "ord", "role", "title", F.lit("").alias("name"), "slot", "evidence")
    return cells.join(roster.select("org", "title", "name"), ["org", "title"], "left").select("req", "ord", "role", "title", F.coalesce("name", F.lit("")).alias("name"), "slot", "evidence")


def public(handled: DataFrame, names: list[str]) -> DataFrame:
    """-> (req, public): each result as JSON, with names masked wherever they stand."""
    from docketry.functions.masking import mask_names

    return handled.select("req", mask_names(F.to_json(F.struct(*_OUT)), names).alias("public"))
