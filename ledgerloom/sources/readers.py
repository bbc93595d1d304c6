"""Inputs: tables, CSV masters, JSON responses, HTML pages, feeds and extracted filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; file statistics prune what can't hold the value."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def by_keys(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Batch lookup as a semi join: the list of keys is data, not a literal."""
    return df.join(wanted.select(F.col(wanted.columns[0]).alias("_wanted")).distinct(), df[key] == F.col("_wanted"), "left_semi")


def csv_masters(spark: SparkSession, paths: dict[str, str], columns: dict[str, tuple[str, ...]]) -> DataFrame:
    """Union of CSV files by board.  ``columns``: name -> headers under which a file may have it, compared without case
    and blanks.  A column that a file lacks is null."""
    parts = []
    for board, path in paths.items():
        raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        found = {"".join(c.lower().split()): c for c in raw.columns}
        picked = []
        for name, headers in columns.items():
            hit = next((found["".join(h.lower().split())] for h in headers if "".join(h.lower().split()) in found), None)
            picked.append((F.trim(F.col(f"`{hit}`")) if hit else F.lit(None).cast("string")).alias(name))
        parts.append(raw.select(*picked, F.lit(board).alias("board")))
    return reduce(DataFrame.unionByName, parts)


def json_records(df: DataFrame, column: str, element: str, fields: list[str] | None = None) -> DataFrame:
    """Rows of JSON responses: a list, the first property that holds a list, or a single object."""
    text = F.trim(F.col(column))
    whole = F.from_json(text, f"array<{element}>")
    named = [F.from_json(F.get_json_object(text, f"$.{f}"), f"array<{element}>") for f in fields or ("data", "Table", "records", "results", "items")]
    single = F.array(F.from_json(text, element))
    items = F.when(text.startswith("["), whole).otherwise(F.coalesce(*named, single))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(items).alias("r")).select(*rest, "r.*")


def plain(fragment: Column) -> Column:
    """A fragment of HTML as text, with the commonest character references read."""
    text = F.regexp_replace(fragment, "<[^>]*>", " ")
    for name, shown in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(shown))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def labelled_cell(page: Column, label: str) -> Column:
    """The table cell after the cell with a label."""
    return F.nullif(plain(F.regexp_extract(page, rf"(?is)<t[dh][^>]*>\s*(?:<[^>]*>\s*)*{label}[^<]*(?:</[^>]*>\s*)*<td[^>]*>(.*?)</td>", 1)), F.lit(""))


def list_after(page: Column, heading: str) -> Column:
    """The entries of the list after a heading."""
    block = F.regexp_extract(page, rf"(?is){heading}.*?<[ou]l[^>]*>(.*?)</[ou]l>", 1)
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit("(?is)<li[^>]*>(.*?)</li>"), F.lit(1)), plain), lambda x: x != "")


def paragraph_after(page: Column, heading: str) -> Column:
    return F.nullif(plain(F.regexp_extract(page, rf"(?is){heading}.*?<p[^>]*>(.*?)</p>", 1)), F.lit(""))


#: A comment, a tag with its quoted attributes (which may hold ``>``), a run of text, or a bracket that begins neither.
#: Each alternative ends at the next ``<`` at the latest, or takes a comment that isn't closed to the end.
TOKEN = r"""<!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->|$)|<[A-Za-z/!][^<>"']*+(?:(?:"[^<"]*+"|'[^<']*+')[^<>"']*+)*+>|[^<]++|<"""


def tokens(page: Column) -> Column:
    """The tags, comments and texts of a page, in order."""
    return F.regexp_extract_all(page, F.lit(TOKEN), F.lit(0))


def table_rows(page: Column, heading: str) -> Column:
    """The rows of the first table after a heading, each as a list of its cells.

    One pass over the page's tokens with a stack's depth: a table inside a cell is part of the cell's text.  End tags of
    cells and rows may be missing, as may that of the table.
    """
    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("depth"), F.array().cast("array<array<string>>").alias("rows"), none.alias("row"), F.lit(None).cast("string").alias("cell"))

    def closed(a: Column) -> Column:
        return F.when(a["cell"].isNotNull(), F.concat(a["row"], F.array(plain(a["cell"])))).otherwise(a["row"])

    def finished(a: Column) -> Column:
        return F.when(F.size(closed(a)) > 0, F.concat(a["rows"], F.array(closed(a)))).otherwise(a["rows"])

    def step(a: Column, x: Column) -> Column:
        tag = F.lower(F.regexp_extract(x, "^<(/?[A-Za-z0-9]+)", 1))
        text = ~x.startswith("<") | (x == "<")
        phase, depth = a["phase"], a["depth"]
        opens = (phase == 1) & (tag == "table")
        inner = (phase == 2) & (depth == 1)
        ends_row, ends_cell = inner & tag.isin("tr", "/tr", "/table"), inner & tag.isin("td", "th", "/td", "/th", "tr", "/tr", "/table")
        more = F.when(text, F.concat(a["cell"], x)).otherwise(F.concat(a["cell"], F.lit(" ")))
        return F.struct(
            F.when((phase == 0) & text & x.rlike(rf"(?i){heading}"), 1).when(opens, 2).when(inner & (tag == "/table"), 3).otherwise(phase).alias("phase"),
            F.when(opens, 1).when((phase == 2) & (tag == "table"), depth + 1).when((phase == 2) & (tag == "/table"), depth - 1).otherwise(depth).alias("depth"),
            F.when(ends_row, finished(a)).otherwise(a["rows"]).alias("rows"),
            F.when(ends_row, none).when(ends_cell, closed(a)).otherwise(a["row"]).alias("row"),
            F.when(inner & tag.isin("td", "th"), "").when(~ends_cell, more).alias("cell"),
        )

    return F.when(page.rlike(rf"(?i){heading}"), F.aggregate(tokens(page), begin, step, finished)).otherwise(begin["rows"])


def detail_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with what their tables and lists say: lot size, registrar, size, ISIN, description, objectives, tables."""
    page = F.col(html)
    isin = F.regexp_extract(page, r"\b(IN[EF][0-9A-Z]{9})\b", 1)
    return pages.withColumns(
        {
            "lot_size": F.regexp_extract(F.replace(labelled_cell(page, "Lot Size"), F.lit(",")), r"(\d+)", 1).try_cast("int"),
            "registrar": labelled_cell(page, "Registrar"),
            "issue_size": labelled_cell(page, "(?:Total )?Issue Size"),
            "isin": F.nullif(isin, F.lit("")),
            "description": paragraph_after(page, "About"),
            "objectives": list_after(page, "Objects? of the Issue"),
            "financials": table_rows(page, "Financial"),
            "peers": table_rows(page, "Peer"),
        }
    )


def title_and_links(pages: DataFrame, html: str = "html") -> DataFrame:
    page = F.col(html)
    return pages.withColumns({"title": plain(F.regexp_extract(page, "(?is)<title[^>]*>(.*?)</title>", 1)), "links": F.regexp_extract_all(page, F.lit(r"""(?is)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))})


# Words of news that announces something.
ANNOUNCEMENT = r"(?i)\b(ipo|public offer|listing|allotment|subscription|price band|drhp|red herring)\b"


FEED = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, pubDate: STRING>>>"


def feed_items(df: DataFrame, column: str = "xml") -> DataFrame:
    """Items of RSS feeds: title, link, description and published (text).

    Well-formed feeds are parsed as XML; of others, what stands between the tags is taken.
    """
    parsed = F.from_xml(F.col(column), FEED, {"mode": "PERMISSIVE"})
    broken = F.regexp_extract_all(F.col(column), F.lit("(?is)<item[^>]*>(.*?)</item>"), F.lit(1))
    inside = lambda item, name: F.regexp_replace(F.regexp_extract(item, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"<!\[CDATA\[|\]\]>", "")
    names = {"title": "title", "link": "link", "description": "description", "pubDate": "published"}
    as_text = F.transform(broken, lambda x: F.struct(*[inside(x, n).alias(n) for n in names]))
    rest = [c for c in df.columns if c != column]
    rows = df.withColumn("_feed", parsed).select(*rest, F.explode(F.coalesce("_feed.channel.item", as_text)).alias("item"))
    return rows.select(*rest, *[F.nullif(plain(F.coalesce(F.col("item")[n], F.lit(""))), F.lit("")).alias(shown) for n, shown in names.items()])


def announcements(items: DataFrame) -> DataFrame:
    return items.filter(F.col("title").rlike(ANNOUNCEMENT) | F.coalesce(F.col("description").rlike(ANNOUNCEMENT), F.lit(False)))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def routed(extracted: DataFrame, confidence: str = "confidence", least: float = 75.0) -> tuple[DataFrame, DataFrame]:
    """Extracted filings that can be used, and those that a person has to look at; unknown confidence is the latter."""
    good = F.coalesce(F.col(confidence) >= least, F.lit(False))
    return extracted.filter(good), extracted.filter(~good)
