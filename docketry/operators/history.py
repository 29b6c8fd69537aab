"""Prediction from history: latest copy, modes with a recency tie, leave-one-out votes, induced rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed


def latest(rows: DataFrame, keys: list[str], *recency: str) -> DataFrame:
    """Latest row of each key; recency columns compare as they are, the last should be unique."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in recency])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def copy_latest_other(rows: DataFrame, group: str, value: str, *recency: str) -> DataFrame:
    """Adds `copied`: the value of the latest other row of the group; null for a row alone. recency tells rows apart.

    Each task hands on its two latest rows of a group; no task orders a group. Rows of the null group are a group.
    """
    r = F.struct(*recency)
    w = Window.partitionBy(group).orderBy(*[F.desc_nulls_last(c) for c in recency])
    two = rows.select(F.col(group).alias("_g"), r.alias("_r"), F.col(value).alias("_v"), F.row_number().over(w).alias("_i")).filter("_i <= 2")
    held = lambda i: F.max(F.when(F.col("_i") == i, F.struct(F.col("_r").alias("r"), F.col("_v").alias("v"))))
    both = two.groupBy("_g").agg(held(1).alias("a"), held(2).alias("b"))
    return rows.join(both, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("copied", F.when(r.eqNullSafe(F.col("a.r")), F.col("b.v")).otherwise(F.col("a.v"))).drop("a", "b", "_g")


def mode(rows: DataFrame, keys: list[str], value: str, *recency: str) -> DataFrame:
    """-> (keys, value, votes): the most frequent value; of equal ones that with the latest row."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.max(F.struct(*recency)).alias("_r"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", "_r")).alias("m")).select(*keys, f"m.{value}", "m.votes")


def vote_without_self(rows: DataFrame, keys: list[str], value: str, *recency: str) -> DataFrame:
    """Adds `voted` and `votes`: the mode of all other rows of the key, ties to the latest; null and 0 for a row alone.

    Totals minus self: a row's own vote can only take the first of its key's values down, below the second at most, so each key
    keeps its two best values with their count and two latest rows. Work is in proportion to the rows. Null keys and values count.
    """
    joined = by_keys(rows, vote_lists(rows, keys, value, *recency), keys)
    return joined.withColumn("_b", best_without("_vs", F.col(value), F.struct(*recency))).withColumn("voted", F.col("_b.v")).withColumn("votes", F.coalesce(F.col("_b.n"), F.lit(0))).drop("_vs", "_b")


def by_keys(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys, of which null matches null."""
    named = table.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def vote_lists(rows: DataFrame, keys: list[str], value: str, *recency: str) -> DataFrame:
    """-> (keys, _vs): each key's two most frequent values, of equal ones the latest, with their count and their two latest rows."""
    r = F.struct(*recency)
    w = Window.partitionBy(*keys, value).orderBy(*[F.desc_nulls_last(c) for c in recency])
    two = rows.select(*keys, value, r.alias("_r"), F.row_number().over(w).alias("_i")).filter("_i <= 2")
    latest_two = two.groupBy(*keys, value).agg(F.max(F.when(F.col("_i") == 1, F.col("_r"))).alias("_r1"), F.max(F.when(F.col("_i") == 2, F.col("_r"))).alias("_r2"))
    counted = by_keys(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), latest_two, [*keys, value])
    best = Window.partitionBy(*keys).orderBy(F.desc("_n"), F.desc("_r1"))
    first = counted.withColumn("_i", F.row_number().over(best)).filter("_i <= 2")
    return first.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_r1").alias("r1"), F.col("_r2").alias("r2"), F.col(value).alias("v"))).alias("_vs"))


def best_without(lists: str | Column, own: Column, r: Column, has: Column | None = None) -> Column:
    """struct(n, r, v): the most frequent value of a list but for the own row; of equal ones the latest. has: whether there is an own row."""
    is_own = lambda s: (s["v"].eqNullSafe(own) if has is None else has & s["v"].eqNullSafe(own))
    left = lambda s: F.struct((s["n"] - is_own(s).cast("int")).alias("n"), F.when(is_own(s) & s["r1"].eqNullSafe(r), s["r2"]).otherwise(s["r1"]).alias("r"), s["v"].alias("v"))
    return F.array_max(F.filter(F.transform(lists, left), lambda s: s["n"] > 0))


def grouped_at_least(rows: DataFrame, key: str | Column, least: int = 2) -> DataFrame:
    """Rows of keys that have `least` rows or more."""
    name = key if isinstance(key, str) else "_k"
    keyed = rows if isinstance(key, str) else rows.withColumn("_k", key)
    return keyed.join(keyed.groupBy(name).count().filter(F.col("count") >= least).select(name), name, "left_semi")


def reference_sweep(rows: DataFrame, group: str, value: str, sizes: list[int], *recency: str) -> DataFrame:
    """-> (size, cases, hits): the mode of the n latest other rows against each row, for each n.

    Only groups with the largest size plus one rows count, so that all sizes share their cases. A
    row's n latest others are among the group's n + 1 latest rows, so a group is cut down to these first.
    """
    most, r = max(sizes), F.struct(*recency)
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in recency])
    ranked = rows.select(group, r.alias("r"), F.col(value).alias("v"), F.row_number().over(w).alias("n")).filter(F.col("n") <= most + 1)
    heads = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("n", "r", "v"))).alias("_h")).filter(F.size("_h") == most + 1)
    cases = rows.select(group, value, r.alias("_r")).join(heads, group)

    def vote(k: int) -> Column:
        # places 0.. of the k latest others; of equal counts the smallest place wins
        others = F.slice(F.filter("_h", lambda h: h["r"] != F.col("_r")), 1, k)
        counted = F.transform(others, lambda h: F.struct(F.size(F.filter(others, lambda o: o["v"] == h["v"])).alias("c"), (-h["n"]).alias("n"), h["v"].alias("v")))
        return F.array_max(counted)["v"]

    wide = cases.select(*[F.sum(F.when(vote(k) == F.col(value), 1).otherwise(0)).alias(f"h{k}") for k in sizes], F.count("*").alias("cases"))
    return wide.select("cases", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"h{k}").alias("hits")) for k in sizes])).alias("s")).select("s.size", "cases", "s.hits")


def induce_final(rows: DataFrame, org: str, work_type: str, value: str, *recency: str) -> DataFrame:
    """-> (org, work_type, final_title, votes, seen): the usual final title of each kind of work."""
    seen = rows.groupBy(org, work_type).agg(F.count("*").alias("seen"))
    return mode(rows, [org, work_type], value, *recency).withColumnRenamed(value, "final_title").join(seen, [org, work_type])


def exclusive_words(docs: DataFrame, org: str, team: str, words: str, most: int = 12) -> DataFrame:
    """-> (org, team, word, n, rank): words that one team alone uses, most frequent first, ties by word."""
    each = docs.select(org, F.col(team).alias("_t"), F.explode(F.array_distinct(words)).alias("word"))
    sole = each.groupBy(org, "word").agg(F.min("_t").alias(team), F.max("_t").alias("_last"), F.count("*").alias("n")).filter(F.col(team) == F.col("_last"))
    w = Window.partitionBy(org, team).orderBy(F.desc("n"), "word")
    return sole.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select(org, team, "word", "n", "rank")


def induce_teams(docs: DataFrame, org: str = "org", reviewer: str = "reviewer", words: str = "words") -> DataFrame:
    """Teams of organisations that show two or more first reviewers, with their exclusive words."""
    several = docs.groupBy(org).agg(F.count_distinct(reviewer).alias("n")).filter("n >= 2").select(org)
    kept = docs.join(several, org, "left_semi")
    keys = exclusive_words(kept, org, reviewer, words).groupBy(org, reviewer).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]).alias("keywords"))
    seen = kept.groupBy(org, reviewer).agg(F.count("*").alias("observed_docs"))
    return seen.join(keys, [org, reviewer], "left").select(org, F.col(reviewer).alias("lead"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "observed_docs")


def mostly_empty(rows: DataFrame, key: str, value: str) -> DataFrame:
    """-> (key, empty): true if over half of the values are empty."""
    return rows.groupBy(key).agg((F.count_if(F.coalesce(F.col(value), F.lit("")) == "") * 2 > F.count("*")).alias("empty"))


def _of_role(cells: DataFrame, role: str) -> DataFrame:
    return cells.filter((F.col("role") == role) & (F.coalesce("title", F.lit("")) != "") & (F.col("title") != fixed.NO_CELL))


def induce_chains(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """docs(doc_id, org, date, doc_no), cells(doc_id, role, pos, title, name) -> (org, observed_docs, draft, approve,
    review_slots, name_empty): the usual drafter and approver, the usual number of reviewers (latest on ties), and whether
    most approvers' names are left empty."""
    own = docs.select("doc_id", "org", "date", "doc_no")
    draft = _of_role(cells, fixed.ROLES[0]).groupBy("doc_id").agg(F.min_by("title", "pos").alias("draft")).join(own, "doc_id")
    last = _of_role(cells, fixed.ROLES[2]).groupBy("doc_id").agg(F.max_by(F.struct("title", "name"), "pos").alias("l")).select("doc_id", F.col("l.title").alias("approve"), F.col("l.name").alias("name")).join(own, "doc_id")
    slots = own.join(_of_role(cells, fixed.ROLES[1]).groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("org", "date", "doc_no", F.coalesce("n", F.lit(0)).alias("review_slots"))
    empty = last.groupBy("org").agg((F.count_if(F.coalesce("name", F.lit("")).isin("", fixed.NO_CELL)) * 2 > F.count("*")).alias("name_empty"))
    out = own.groupBy("org").agg(F.count("*").alias("observed_docs"))
    for part, value in ((draft, "draft"), (last, "approve"), (slots, "review_slots")):
        out = out.join(mode(part, ["org"], value, "date", "doc_no").select("org", value), "org", "left")
    return out.join(empty, "org", "left").na.fill(False, ["name_empty"])


def induce_extra_review(docs: DataFrame, cells: DataFrame, chains: DataFrame) -> DataFrame:
    """docs with work_type -> (org, work_type, title, observed_docs): reviewers beyond the usual number."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    reviews = _of_role(cells, fixed.ROLES[1]).select("doc_id", "title", place.alias("place"))
    beyond = reviews.join(docs.select("doc_id", "org", "work_type"), "doc_id").join(chains.select("org", "review_slots"), "org").filter("place > review_slots")
    return beyond.groupBy("org", "work_type", "title").agg(F.count("*").alias("observed_docs"))


def induce_cooperation(docs: DataFrame, cells: DataFrame, words: str = "words") -> DataFrame:
    """docs with work_type and words -> (org, titles, work_types, triggers, observed_docs): documents of the same
    cooperating titles make one rule; its triggers are words that no document of the organisation without cooperation has."""
    titles = _of_role(cells, fixed.ROLES[3]).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("titles"))
    own = docs.select("doc_id", "org", "work_type", F.array_distinct(words).alias("ws"))
    plain = own.join(titles, "doc_id", "left_anti").select("org", F.explode("ws").alias("w")).distinct()
    with_ = own.join(titles, "doc_id")
    rules = with_.groupBy("org", "titles").agg(F.array_sort(F.collect_set("work_type")).alias("work_types"), F.count("*").alias("observed_docs"))
    triggers = with_.select("org", "titles", F.explode("ws").alias("w")).join(plain, ["org", "w"], "left_anti").groupBy("org", "titles").agg(F.array_sort(F.collect_set("w")).alias("triggers"))
    return rules.join(triggers, ["org", "titles"], "left").select("org", "titles", "work_types", F.coalesce("triggers", F.array().cast("array<string>")).alias("triggers"), "observed_docs")


def induce_acting(docs: DataFrame, cells: DataFrame, chains: DataFrame, mark: str = "대결") -> DataFrame:
    """-> (org, slot, by, observed_docs): who signed in whose place, where a cell's note says so."""
    noted = cells.filter(F.col("note").contains(mark)).join(docs.select("doc_id", "org"), "doc_id").join(chains.select("org", F.col("approve").alias("slot")), "org")
    return noted.groupBy("org", "slot", F.col("title").alias("by")).agg(F.count("*").alias("observed_docs"))
