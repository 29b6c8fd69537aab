"""Values taken out of text, as column expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.text import collapse, flat, lines, strip_spaces

_U = "(?U)"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("bigint")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, _U + pattern, group), F.lit(""))


def amount(body: Column) -> Column:
    """The stated amount, else the first grouped one; null if there is none."""
    return F.coalesce(_number(_group(body, fixed.AMOUNT)), _number(_group(body, fixed.AMOUNT_LOOSE)))


def amount_range(text: Column) -> Column:
    """struct(lo, hi) of a band in words; the last bound of each side counts."""
    found = F.regexp_extract_all(text, F.lit(_U + f"({fixed.RANGE})"), F.lit(1))
    unit = F.create_map(*[F.lit(x) for kv in fixed.RANGE_UNITS.items() for x in kv])
    value = lambda m: F.floor(F.regexp_extract(m, fixed.RANGE, 1).cast("double") * unit[F.regexp_extract(m, fixed.RANGE, 2)]).cast("bigint")
    side = lambda ops: F.element_at(F.transform(F.filter(found, lambda m: m.rlike(f"({ops})$")), value), -1)
    guarded = lambda ops: F.when(F.size(F.filter(found, lambda m: m.rlike(f"({ops})$"))) > 0, side(ops))
    return F.struct(guarded("초과|이상").alias("lo"), guarded("이하|미만").alias("hi"))


def _times(number: Column, unit: Column) -> Column:
    return _number(number) * F.create_map(*[F.lit(x) for kv in fixed.WON_UNITS.items() for x in kv])[unit]


def labelled(text: Column, labels: list[str]) -> Column:
    """struct(amount, label), or null: by priority of the labels, which may be spaced. Amounts already paid, with the mark 기
    among the two characters before the label, are skipped. Texts without a labelled amount in a line fall back on tables,
    where the label and the number stand in lines of their own. All within the row."""
    def hits(label: str) -> Column:
        spaced = r"\s*".join(f"\\Q{c}\\E" for c in label)
        pattern = f"{_U}{spaced}{fixed.LABEL_GAP}"
        part = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
        # what stands between the matches tells what stands before each
        found = F.arrays_zip(part(1).alias("n"), part(2).alias("u"), F.split(text, pattern).alias("before"))
        unpaid = F.filter(found, lambda z: z["n"].isNotNull() & ~F.right(z["before"], F.lit(2)).contains("기"))
        return F.transform(unpaid, lambda z: F.struct(_times(z["n"], z["u"]).alias("amount"), F.lit(label).alias("label")))

    direct = F.get(F.filter(F.concat(*map(hits, labels)), lambda z: z["amount"].isNotNull()), F.lit(0))
    return F.coalesce(direct, in_table(text, labels))


def in_table(text: Column, labels: list[str]) -> Column:
    """struct(amount, label), or null: of a label's line followed within six lines by a line that is a number; in the unit that the
    text states."""
    ranks = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    bare = F.transform(F.filter(F.split(text, "\n"), lambda x: strip_spaces(x) != ""), lambda x: F.regexp_replace(x, r"(?U)\(.*?\)|\s+", ""))
    unit = F.coalesce(_group(text, fixed.TABLE_UNIT), F.lit("원"))

    def found(ls: Column) -> Column:
        after = lambda i: F.get(F.filter(F.slice(ls, i + 2, F.lit(6)), lambda x: x.rlike(fixed.NUMBER_LINE)), F.lit(0))
        spots = F.transform(ls, lambda x, i: F.when(x.isin(*labels), F.struct(ranks[x].alias("rank"), i.alias("at"), x.alias("label"), after(i).alias("n"))))
        return F.array_min(F.filter(spots, lambda s: s["n"].isNotNull()))

    once = F.element_at(F.transform(F.array(bare), found), 1)
    value = _times(F.regexp_replace(once["n"], "원$", ""), unit)
    return F.when(value.isNotNull(), F.struct(value.alias("amount"), F.concat(once["label"], F.lit("(표)")).alias("label")))


def labelled_amount(docs: DataFrame, labels: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, amount, label), null without a labelled amount."""
    return docs.select(id_col, labelled(F.col(text_col), labels).alias("hit")).select(id_col, "hit.amount", "hit.label")


def table_amount(docs: DataFrame, labels: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, amount, label) of the documents that have one in a table."""
    return docs.select(id_col, in_table(F.col(text_col), labels).alias("hit")).filter("hit is not null").select(id_col, "hit.amount", "hit.label")


def dates(text: Column) -> Column:
    """ISO dates in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(_U + f"({fixed.DATE})"), F.lit(1))
    part = lambda m, i: F.regexp_extract(m, fixed.DATE, i)
    return F.transform(found, lambda m: F.concat_ws("-", part(m, 1), F.lpad(part(m, 2), 2, "0"), F.lpad(part(m, 3), 2, "0")))


def earliest_date(text: Column) -> Column:
    return F.coalesce(F.array_min(dates(text)), F.lit(""))


def doc_no(text: Column) -> Column:
    """Department and number, the number without leading zeros."""
    number = F.regexp_extract(text, _U + fixed.DOC_NO, 2).try_cast("bigint")
    return F.when(number.isNotNull(), F.concat_ws("-", F.regexp_extract(text, _U + fixed.DOC_NO, 1), number.cast("string"))).otherwise("")


def dept(number: Column) -> Column:
    return F.when(number.contains("-"), F.trim(F.split_part(number, F.lit("-"), F.lit(1)))).otherwise("")


def subject(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, _U + fixed.SUBJECT, 1))


def issuer(text: Column) -> Column:
    return F.regexp_extract(strip_spaces(text), fixed.ISSUER, 1)


def first_on_page(pages: DataFrame, matches: Column, id_col: str = "doc_id", page_col: str = "page_no") -> DataFrame:
    """-> (id, value, page): each value once, at its first page; ordered by page and place within it."""
    found = pages.select(id_col, F.col(page_col).alias("page"), F.posexplode(matches).alias("pos", "value"))
    return found.groupBy(id_col, "value").agg(F.min(F.struct("page", "pos")).alias("at")).select(id_col, "value", F.col("at.page").alias("page"), F.col("at.pos").alias("pos"))


def all_amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_U + fixed.AMOUNT_ALL), F.lit(1))


def all_doc_numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({fixed.DOC_NO_ALL})"), F.lit(1))


def strip_particle(word: Column) -> Column:
    """Without its grammatical ending, if two characters or more remain."""
    bare = F.regexp_replace(word, fixed.PARTICLE, "")
    return F.when(F.length(bare) >= 2, bare).otherwise(word)


def vendors(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_U + f"({fixed.VENDOR})"), F.lit(1))
    part = lambda m: F.trim(F.coalesce(*[F.nullif(F.regexp_extract(m, _U + fixed.VENDOR, i), F.lit("")) for i in (1, 2, 3)]))
    return F.filter(F.transform(found, lambda m: strip_particle(part(m))), lambda v: v != "")


def number_tokens(text: Column, pattern: str = fixed.NUMBER, least: int = 2) -> Column:
    """Numbers of `least` digits or more, as they stand."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda n: F.length(F.regexp_replace(n, r"\D", "")) >= least)


def grounded(tokens: Column, source: Column) -> Column:
    """Those of the tokens that occur in the source, both without white space and commas."""
    body = flat(source)
    return F.filter(tokens, lambda n: body.contains(flat(n)))


def check_tokens(item: Column) -> Column:
    """Dates as unpadded digits, then the numbers of two digits and more in what is left."""
    part = lambda m, i: F.regexp_extract(m, fixed.DATE, i)
    days = F.transform(F.regexp_extract_all(item, F.lit(f"({fixed.DATE})"), F.lit(1)), lambda m: F.concat(part(m, 1), part(m, 2).cast("int").cast("string"), part(m, 3).cast("int").cast("string")))
    rest = F.regexp_replace(item, fixed.DATE, " ")
    return F.concat(days, F.filter(F.transform(F.regexp_extract_all(rest, F.lit(r"(\d[\d,.]*\d|\d)"), F.lit(1)), flat), lambda n: F.length(n) >= 2))


def lenient_int(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\d\-]", "").try_cast("bigint")


def toc_entries(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """-> (*keys, seq, kind, no, title, page, issuer) of the bulleted lines of a table of contents."""
    found = pages.select(*keys, F.posexplode(lines(F.col(text_col))).alias("seq", "raw")).filter(F.col("raw").startswith(fixed.TOC_BULLET))
    line = F.trim(F.regexp_replace("raw", f"^{fixed.TOC_BULLET}+", ""))
    at = found.withColumn("line", line).withColumn("page", F.regexp_extract("line", fixed.TOC_LEADER, 1).try_cast("int")).filter("page is not null")
    head = at.withColumn("head", collapse(F.regexp_replace("line", fixed.TOC_LEADER, "")))
    whole = f"^(.*?){fixed.TOC_KIND}[^(]*\\((.*)\\)[^)]*$"
    return head.filter(F.col("head").rlike(whole)).select(
        *keys, "seq", F.regexp_extract("head", whole, 2).alias("kind"), F.regexp_extract("head", whole, 3).alias("no"),
        F.trim(F.regexp_extract("head", whole, 4)).alias("title"), "page", F.trim(F.regexp_extract("head", whole, 1)).alias("issuer"),
    )


def from_attachment(key: str, text: Column) -> Column:
    """The value of a slot as an attachment states it, cut off; for amounts else the first grouped one; empty if there is none."""
    body = F.coalesce(text, F.lit(""))
    pattern = fixed.ATTACHMENT_FIELDS.get(key)
    found = F.substring(F.trim(F.regexp_extract(body, _U + pattern, 1)), 1, fixed.ATTACHMENT_CHARS) if pattern else F.lit("")
    if key != "amount":
        return found
    loose = F.regexp_extract(body, _U + fixed.AMOUNT_LOOSE, 1)
    return F.when(body.rlike(_U + pattern), found).when(loose != "", F.concat(F.lit("금"), loose, F.lit("원"))).otherwise("")


def classified(title: Column, body: Column) -> Column:
    """struct(work_type, amount)."""
    from docketry.functions.text import work_type

    return F.struct(work_type(title).alias("work_type"), amount(body).alias("amount"))


def is_contents_page(text: Column, bullets: int = 3) -> Column:
    """True for pages with so many bullets."""
    return F.length(text) - F.length(F.replace(text, F.lit(fixed.TOC_BULLET), F.lit(""))) >= bullets
