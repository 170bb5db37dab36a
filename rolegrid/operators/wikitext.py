"""Constituent tables in wikitext: find the table, split it into rows, read the columns by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrid.functions.base import ColumnOrName, c, let

# The templates that mark a ticker cell, and the header names that are read.
TICKER = r"\{\{(?:NyseSymbol|NasdaqSymbol|BZX link|NYSE Arca|nyse|NASDAQ)\|([A-Za-z0-9.\-]+)\}\}"
ARTICLE_LINK = r"\[\[([^\]|#]+)(?:\|([^\]]+))?\]\]"
HEADERS = {"industry": "GICS Sector", "sub_industry": "GICS Sub-Industry", "headquarters": "Headquarters Location"}
_CELL_BREAK = r"\|\|+|\n[ \t]*\|+"
_LEADING = r'^(?:[ \t\n|]*[A-Za-z-]+="[^"]*")*[ \t\n|]*'


def clean_text(cell: ColumnOrName) -> Column:
    """Cell text without references, comments, templates, links and emphasis."""
    t = F.regexp_replace(c(cell), r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"\{\{[^{}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\[[^\]|#]+\|([^\]]+)\]\]", "$1")
    t = F.regexp_replace(t, r"\[\[([^\]|#]+)\]\]", "$1")
    t = F.regexp_replace(t, r"\[https?://\S+\s+([^\]]+)\]", "$1")
    return F.trim(F.regexp_replace(t, "'''|''", ""))


def article_first(name: ColumnOrName) -> Column:
    """``Name (The)`` as ``The Name``."""
    n = c(name)
    article = F.regexp_extract(n, r"\s*\((The|A|An)\)\s*$", 1)
    base = F.trim(F.regexp_replace(n, r"\s*\((The|A|An)\)\s*$", ""))
    return F.when((article != "") & (base != ""), F.concat(article, F.lit(" "), base)).otherwise(n)


def cells(text: ColumnOrName) -> Column:
    """Trimmed cells of a row in any of the three cell syntaxes; leading attributes are dropped, empty
    cells survive only between filled ones."""
    parts = F.transform(F.split(F.regexp_replace(c(text), _LEADING, ""), _CELL_BREAK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))

    def inner(xs: Column) -> Column:
        filled = F.transform(xs, lambda s: s != "")
        first = F.array_position(filled, True)
        last = F.size(xs) - F.array_position(F.reverse(filled), True) + 1
        return F.when(first > 0, F.slice(xs, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast("array<string>"))

    return let(parts, inner)


def component_table(pages: DataFrame, key: str = "index", wikitext: str = "wikitext") -> tuple[DataFrame, DataFrame]:
    """((key, lines) of each page's first table, NULL where it has a problem; problems). The table runs from the first ``{|`` to where as many
    ``|}`` as ``{|`` were seen; never closed and closed too often are problems. A page is one row throughout, so
    nothing is joined, whatever the number of pages."""
    # Dealt out first: a page takes far longer to parse than to read, and few files may hold many.
    dealt = pages.select(key, wikitext).filter(F.col(wikitext).isNotNull()).repartition(key)
    lines = dealt.select(key, F.split(wikitext, "\n").alias("lines"))
    start = F.array_position(F.transform("lines", lambda x: x.startswith("{|")), True).cast("int")
    begun = lines.select(key, F.when(start > 0, F.slice("lines", start, F.size("lines"))).alias("lines"))
    none = F.lit(None).cast("int")

    def step(seen: Column, line: Column) -> Column:
        depth = seen["depth"] + F.regexp_count(line, F.lit(r"\{\|")) - F.regexp_count(line, F.lit(r"\|\}"))
        read = F.struct(depth.alias("depth"), (seen["read"] + 1).alias("read"), F.when(depth <= 0, seen["read"] + 1).alias("end"))
        return F.when(seen["end"].isNotNull(), seen).otherwise(read)

    first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("read"), none.alias("end"))
    scanned = begun.select(key, "lines", F.aggregate("lines", first, step).alias("scan"))
    problem = (
        F.when(F.col("lines").isNull(), "no table found")
        .when(F.col("scan.end").isNull(), "table is never closed")
        .when(F.col("scan.depth") < 0, "table closes more often than it opens")
    )
    judged = scanned.withColumn("problem", problem)
    table = judged.select(key, F.when(F.col("problem").isNull(), F.slice("lines", F.lit(1), F.col("scan.end"))).alias("lines"))
    return table, judged.filter(F.col("problem").isNotNull()).select(key, "problem")


def table_rows(table: DataFrame, key: str = "index") -> DataFrame:
    """(key, row_no, body, header): the lines between ``|-`` marks, joined, and the cells of the page's first row
    with header cells (NULL without one)."""
    # Each part is empty or begins with the line feed before its first line.
    parts = F.split(F.concat(F.lit("\n"), F.array_join("lines", "\n")), r"\n\|-[^\n]*")
    held = table.select(key, parts.alias("parts"))
    head = F.get(F.filter("parts", lambda x: x.contains("\n!")), F.lit(0))
    headed = held.select(key, "parts", F.when(head.isNotNull(), _header_cells(F.substring(head, F.lit(2), F.length(head)))).alias("header"))
    rows = headed.select(key, "header", F.posexplode("parts").alias("row_no", "part")).filter("part <> ''")
    return rows.select(key, F.col("row_no").cast("bigint").alias("row_no"), F.expr("substring(part, 2)").alias("body"), "header")


def _header_cells(body: Column) -> Column:
    after = F.regexp_replace(body, r"^[^!]*!", "")
    flat = F.replace(F.replace(F.replace(after, F.lit("!!"), F.lit("||")), F.lit("!"), F.lit("|")), F.lit("\n"), F.lit("|"))
    return F.transform(cells(flat), clean_text)


def parse_constituents(rows: DataFrame, key: str = "index") -> DataFrame:
    """(key, ordinal, name, article, industry, sub_industry, headquarters, cik, raw_cik) of the rows
    that carry a ticker template."""
    def column_of(name: str) -> Column:
        return F.array_position("header", name) - 2  # array positions are 1-based; the ticker cell is not among the row's cells

    body = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    # Dealt out again: the rows of one long page are read by many tasks.
    marked = rows.select(key, "row_no", "header", body.alias("__b")).filter(F.regexp_like("__b", F.lit(TICKER))).repartition(key, "row_no")
    cut = F.regexp_replace("__b", r"(?s)^.*?" + TICKER, "")
    split = marked.withColumn("__c", cells(cut)).filter(F.size("__c") > 0).withColumn("__n", F.col("__c")[0])
    link, label = F.regexp_extract("__n", ARTICLE_LINK, 1), F.regexp_extract("__n", ARTICLE_LINK, 2)
    shown = F.when(link != "", F.when(label != "", label).otherwise(link)).otherwise(F.col("__n"))

    def cell(name: str) -> Column:
        at = column_of(name)
        return F.coalesce(F.when(at >= 0, clean_text(F.get("__c", at.cast("int")))), F.lit(""))

    has_cik = F.coalesce(F.array_contains("header", "CIK"), F.lit(False))
    numeric = F.filter("__c", lambda s: s.rlike(r"^\|?\s*(\d{6,10})\s*$"))
    by_column = F.coalesce(F.try_element_at(numeric, F.lit(-1)), F.lit(""))
    by_param = F.regexp_extract("__b", r"(?:\?|&(?:amp;)?)CIK=([A-Za-z0-9.\-]+)", 1)
    raw = F.when(has_cik, by_column).otherwise(by_param)
    return split.select(
        key, F.col("row_no").alias("ordinal"), article_first(clean_text(shown)).alias("name"), F.trim(link).alias("article"),
        *[cell(title).alias(col) for col, title in HEADERS.items()],
        F.coalesce(F.regexp_replace(raw, "^0+", "").try_cast("bigint"), F.lit(0)).alias("cik"), raw.alias("raw_cik"),
    )


def constituents(pages: DataFrame, key: str = "index", wikitext: str = "wikitext") -> tuple[DataFrame, DataFrame]:
    """(constituent rows, problems) of index pages."""
    table, problems = component_table(pages, key, wikitext)
    return parse_constituents(table_rows(table, key), key), problems
