"""Line dedup by site-relative frequency, in DataFrame operations only.

A line (trimmed) is boilerplate on a host if more than `ratio` of the host's pages have it and at least `least`
pages do. The pages of a host that have a line are counted on slim (host, 128-bit line hash) rows, with partial
sums before the shuffle. A host's boilerplate lines number less than its mean distinct lines per page / ratio, so
they travel as one array per host to its pages; texts are never shuffled unless these arrays outgrow a broadcast,
and then hot hosts are spread by a salt.

Null text stays null with no lines; a null host is a host of its own; blank lines are never counted or dropped.
Repeated rows are pages of their own. Extra columns of any name and type pass through, but columns named like the
results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

RATIO, LEAST = 0.1, 5
#: Boilerplate lines (16 bytes each) up to which all hosts' arrays are broadcast, and the salts used beyond.
BROADCAST_LINES, SALTS = 500_000, 32

# ---- fixed values: HTML elements without text, and those that end a line ---------------------------
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
EDGES = r"^[ \t\r\f]+|[ \t\r\f]+$"
#: EDGES' characters, and HIDDEN with its common first character put before the choice, so that it is tried at that alone.
BLANKS = " \t\r\f"
HIDDEN_FIRST = r"(?is)<(?:!--.*?-->|script\b.*?</script>|style\b.*?</style>)"
# ----------------------------------------------------------------------------------------------------


def html_text(html):
    """A page's text, a line per block element."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN_FIRST, "\n"), BREAKS, "\n"), TAGS, "")


def url_host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def trimmed(line):
    """line without the blanks that EDGES finds at its ends."""
    return F.btrim(line, F.lit(BLANKS))


def print_of(line):
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("#"), line).alias("h2"))


def boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """host and its boilerplate lines' prints, from pages (host, text)."""
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), trimmed))).alias("line")).where("line != ''")
    # A host's name goes through the shuffle once per line: as a hash pair too.
    key = F.struct(F.xxhash64("host").alias("a"), F.xxhash64(F.lit("@"), "host").alias("b"))
    counts = lines.select(key.alias("site"), print_of(F.col("line")).alias("p")).groupBy("site", "p").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    totals = pages.select(key.alias("site")).groupBy("site").agg(F.count("*").alias("pages"))
    often = counts.join(totals, "site").where(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("site").agg(F.collect_list("p").alias("lines"))


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST, text: str = "text", host: str = "host") -> DataFrame:
    """pages with `text` cleaned, and n_lines and n_dropped (non-blank lines had and dropped)."""
    rest = [c for c in pages.columns if c not in (text, "n_lines", "n_dropped")]
    slim = pages.select(F.coalesce(F.col(host), F.lit("\0")).alias("host"), F.col(text).alias("text"))
    found = materialize(boilerplate(slim, ratio, least), "boilerplate")
    n = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    site = F.coalesce(F.col(host), F.lit("\0"))
    t, s, own, salt, keep = fresh(pages, "_text", "_site", "_set", "_salt", "_kept")
    marked = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(text).alias(t), F.struct(F.xxhash64(site).alias("a"), F.xxhash64(F.lit("@"), site).alias("b")).alias(s))
    sets = found.select(F.col("site").alias(s), F.col("lines").alias(own))
    if n <= BROADCAST_LINES:
        joined = marked.join(F.broadcast(sets), s, "left")
    else:
        spread = sets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = marked.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(spread, [s, salt], "left")
    lines = F.split(t, "\n", -1)
    kept = F.filter(lines, lambda x: (trimmed(x) == "") | ~F.array_contains(own, print_of(trimmed(x))))
    count = lambda a: F.size(F.filter(a, lambda x: trimmed(x) != "")).cast("long")
    joined = joined.withColumn(keep, F.when(F.col(own).isNotNull() & F.col(t).isNotNull(), kept))
    had = F.when(F.col(t).isNull(), F.lit(0).cast("long")).otherwise(count(lines))
    return joined.select(
        *(F.col(f"`{c}`") for c in rest),
        F.when(F.col(keep).isNull(), F.col(t)).otherwise(F.array_join(keep, "\n")).alias(text),
        had.alias("n_lines"),
        # Blank lines are never dropped, so those dropped are the difference of all lines.
        F.when(F.col(keep).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(keep)).cast("long").alias("n_dropped"),
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, host and text of a table of raw pages (page_id, url, html)."""
    return pages.select("page_id", url_host(F.col("url")).alias("host"), html_text(F.col("html")).alias("text"))
