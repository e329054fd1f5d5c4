"""HTML and URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import pinned, trim_ws
from folioforge.functions.url import link_target

#: What goes from a page, and entities in the order in which they are decoded.
BLOCKS = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"<[^>]+>")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def _bare(html: Column) -> Column:
    for pattern in BLOCKS:
        html = F.regexp_replace(html, pattern, "")
    return html


def _unit(digits: Column) -> Column:
    """The 16-bit unit of a decimal number, as four hex digits: its value as a double, modulo 65536; 0 for one beyond doubles."""
    value = digits.try_cast("double")
    return F.lpad(F.hex(F.when(value < float("inf"), F.pmod(value, F.lit(65536.0))).otherwise(0.0).cast("bigint")), 4, "0")


def _units(run: Column) -> Column:
    """The text of neighbouring ``&#n;``: units of UTF-16, in which two halves that follow each other make one character; a half alone is
    U+FFFD."""
    units = F.array_join(F.transform(F.regexp_extract_all(run, F.lit("&#([0-9]+);"), F.lit(1)), _unit), " ")
    whole = F.regexp_replace(units, r"\bD[89AB]..(?! D[C-F])", "FFFD")
    whole = F.regexp_replace(whole, r"(?<!\bD[89AB].. )\bD[C-F]..", "FFFD")
    return F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), "UTF-16BE")


def _numeric(text: Column) -> Column:
    """``&#n;`` as its character; the text between is left alone."""
    some = "(?:&#[0-9]+;)+"
    gaps, runs = F.split(text, some, -1), F.regexp_extract_all(text, F.lit(some), F.lit(0))
    joined = F.array_join(F.transform(F.arrays_zip(gaps, F.transform(runs, _units)), lambda x: F.concat(x["0"], F.coalesce(x["1"], F.lit("")))), "")
    return F.when(text.rlike(some), joined).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Link text: no tags, scripts or styles; entities decoded; white space as single spaces, none at the ends."""
    text = F.replace(F.replace(_bare(html), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return trim_ws(F.regexp_replace(_numeric(text), "[ \\t\\r\\n]+", " "))


def clean_html(html: Column) -> Column:
    """Page text: as :func:`strip_tags`, but line feeds stay, at most two together."""
    text = F.replace(_bare(html), F.lit("&amp;"), F.lit("&"))
    for a, b in (*ENTITIES, ("&#x27;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(_numeric(text), "[ \\t]+", " ")
    return trim_ws(F.regexp_replace(text, "\\n{3,}", "\n\n"))


#: Fixed value: a link with its text.
ANCHOR = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""


def raw_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, position, href, text)`` of every anchor, as written, but for page-internal and script links."""
    href, text = (F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(i)) for i in (1, 2))
    rows = pages.select("*", F.posexplode(F.arrays_zip(href.alias("href"), text.alias("text"))).alias("position", "_a"))
    rows = rows.select(*pages.columns, F.col("position").cast("bigint").alias("position"), F.trim(F.col("_a.href")).alias("href"), F.col("_a.text").alias("_inner"))
    kept = rows.where((F.col("href") != "") & ~F.startswith("href", F.lit("#")) & ~F.startswith("href", F.lit("javascript:")))
    return kept.withColumn("link_text", strip_tags(F.col("_inner"))).drop("_inner")


def extract_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``(key, position, href, link_text)`` with absolute http(s) links in normal form; what can't be one goes."""
    found = pinned(raw_links(pages.select(key, url, html), key, html).withColumnRenamed("href", "_href"), href=link_target(F.col("_href"), F.col(url)))
    return found.where("href IS NOT NULL").select(key, "position", "href", "link_text")


def article_url(url: Column) -> Column:
    """Whether the path, without query and fragment, ends in a page suffix."""
    return F.regexp_extract(url, "^[^?#]*", 0).rlike(r"(?i)\.(htm|html|shtml|aspx?)\b")


def url_key(url: Column) -> Column:
    """The same for http and https, with and without a slash at the end."""
    return F.regexp_replace(F.regexp_replace(url, "(?i)^https?://", ""), "/+$", "")


def valid_url(url: Column) -> Column:
    return trim_ws(url).rlike("(?i)^https?://.+")
