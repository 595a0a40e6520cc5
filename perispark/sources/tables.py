"""Reading and writing the observation tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perispark.functions import catalogue, rules
from perispark.functions import scalars as S
from perispark.operators import merge


def load_domain_list(spark: SparkSession, path: str, current: DataFrame | None = None) -> DataFrame:
    """One name a line, cleaned; with a current table that has rows, that table."""
    if current is not None and not current.isEmpty():
        return current
    return spark.read.text(path).select(S.sanitize_domain(F.col("value")).alias("domain")).filter("domain IS NOT NULL").dropDuplicates()


def export_tables(tables: Mapping[str, DataFrame], folder: str, exclude: Sequence[str] = ()) -> list[str]:
    """Each table as Parquet under folder/<name>.parquet; the names written."""
    names = [n for n in tables if n not in exclude]
    for name in names:
        tables[name].write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return names


def import_table(spark: SparkSession, path: str, current: DataFrame, keys: Sequence[str], on_conflict: str = "replace") -> DataFrame:
    """current with the rows of a Parquet table; unknown words for on_conflict mean replace."""
    how = {"ignore": merge.merge_ignore, "abort": merge.merge_abort}.get(on_conflict, merge.merge_replace)
    return how(current, spark.read.parquet(path), list(keys))


def has_table(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def import_tables(
    spark: SparkSession, folder: str, current: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
    exclude: Sequence[str] = (), on_conflict: str = "replace",
) -> dict[str, DataFrame]:
    """import_table() for each table of current that folder has; the others stay as they are."""
    out = dict(current)
    for name, df in current.items():
        path = f"{folder}/{name}.parquet"
        if name not in exclude and has_table(spark, path):
            out[name] = import_table(spark, path, df, keys[name], on_conflict)
    return out


def ingest_kev(feed: DataFrame) -> DataFrame:
    """Catalogue rows of a known-exploited feed (column vulnerabilities) for the technologies we match."""
    v = feed.select(F.explode("vulnerabilities").alias("v")).select("v.*")
    both = F.lower(F.concat_ws(" ", F.coalesce("vendorProject", F.lit("")), F.coalesce("product", F.lit(""))))
    tech = None
    for name in rules.KEV_VENDORS:
        tech = (F if tech is None else tech).when(F.contains(both, F.lit(name)), F.lit("mssql" if name == "sql server" else name))
    rows = v.select(
        F.col("cveID").alias("cve_id"), tech.alias("technology"), F.lit("CRITICAL").alias("severity"), F.lit(True).alias("in_kev"),
        F.col("shortDescription").alias("summary"), F.col("dateAdded").alias("published_at"),
    )
    return rows.filter("technology IS NOT NULL AND coalesce(cve_id, '') != ''")


def ingest_ct(entries: DataFrame) -> DataFrame:
    """Names below the apex from certificate log entries (apex, name_value with lines)."""
    name = F.explode(F.split("name_value", "\n"))
    each = entries.select(F.col("apex").alias("domain"), name.alias("n")).select("domain", F.lower(F.trim("n")).alias("subdomain"))
    return each.filter(F.endswith("subdomain", F.concat(F.lit("."), F.col("domain")))).distinct().withColumn("source", F.lit("ct"))


def read_ns_csv(spark: SparkSession, path: str) -> DataFrame:
    """(domain, host) rows of a quoted CSV; a header line (first cell dominio) is left out, an empty host is null."""
    rows = spark.read.csv(path, schema="domain string, host string", quote='"', escape='"')
    return rows.filter("domain IS NOT NULL AND lower(trim(domain)) != 'dominio'")


def seed_catalog(spark: SparkSession, current: DataFrame | None = None) -> DataFrame:
    """The built-in catalogue; over a current one, in_kev and published_at stay."""
    kinds = ("technology string, cve_id string, severity string, cvss_score double, affected_from string, affected_to string, summary "
        "string")
    seed = spark.createDataFrame(list(catalogue.SEED), kinds)
    seed = seed.withColumns({"in_kev": F.lit(False), "published_at": F.lit(None).cast("string")})
    if current is None:
        return seed
    old = current.select("cve_id", F.col("in_kev").alias("_k"), F.col("published_at").alias("_p"))
    stay = {"in_kev": F.coalesce("_k", "in_kev"), "published_at": F.coalesce("_p", "published_at")}
    kept = seed.join(old, "cve_id", "left").withColumns(stay).select(*seed.columns)
    return merge.merge_replace(current.select(*seed.columns), kept, ["cve_id"])


def show_domain(tables: Mapping[str, DataFrame], domain: str) -> dict[str, DataFrame]:
    """Each table's rows of one domain."""
    return {n: df.filter(F.col("domain") == domain) for n, df in tables.items()}


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


class Markdown(HTMLParser):
    """Headings, paragraphs, list items and links of a page as Markdown-like text."""

    HIDDEN = ("script", "style", "head", "noscript", "template")
    BLOCKS = ("p", "div", "ul", "ol", "article", "section", "header", "footer", "nav", "table", "tr", "blockquote", "main")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden, self.lists = 0, 0
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n" + "  " * max(0, self.lists - 1) + "- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.parts.append("[")
        elif tag in self.BLOCKS and not (tag in ("ul", "ol") and self.lists):
            self.parts.append("\n\n")
        self.lists += tag in ("ul", "ol")

    def handle_endtag(self, tag: str) -> None:
        self.lists = max(0, self.lists - (tag in ("ul", "ol")))
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "a" and self.links:
            self.parts.append(f"]({self.links.pop()})")
        elif tag in self.BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append("\n" if tag in ("ul", "ol") and self.lists else "\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        lines = "".join(self.parts).split("\n")
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() if x.lstrip().startswith("- ") else x.strip() for x in lines)).strip()


def markdown_of(page: str | None) -> str | None:
    if page is None:
        return None
    writer = Markdown()
    writer.feed(page)
    writer.close()
    return writer.text()


def pages_to_markdown(pages: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(page_id, markdown) of pages with a body and, if there is a status_code, a 2xx one, but for those done."""
    todo = pages.filter("html IS NOT NULL AND html != ''")
    if "status_code" in pages.columns:
        todo = todo.filter("status_code BETWEEN 200 AND 299")
    if done is not None:
        todo = todo.join(done.select("page_id"), "page_id", "left_anti")

    @F.pandas_udf("string")
    def markdown(html: pd.Series) -> pd.Series:
        return html.map(markdown_of)

    return todo.select("page_id", markdown("html").alias("markdown"))
