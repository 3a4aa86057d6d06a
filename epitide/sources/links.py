"""Download links in fetched web pages."""
from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import as_col

HREF = r"""(?i)href=["']([^"']+)["']"""

REFERENCE = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}

# Words that rule a link out.
EXCLUDED_WORDS = ("ecds", "supplementary", "commentary", "growth", "mapping", "quarter")


def character(reference: Column) -> Column:
    """What one character reference, without & and ;, stands for; NULL if nothing."""
    digits = F.regexp_replace(reference, "^#[xX]?", "")
    code = F.when(reference.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(reference.startswith("#"), digits).try_cast("bigint")
    numbered = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), reference)
    return F.when(reference.startswith("#"), numbered).otherwise(named)


def unescape(text: Column) -> Column:
    """Numbered and named character references replaced; unknown ones stay. Ampersands come last, so that they start no other."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)))
    last = F.filter(found, lambda r: r.isin("amp", "#38", "#x26"))

    def put(acc, r):
        whole = F.concat(F.lit("&"), r, F.lit(";"))
        return F.replace(acc, whole, F.coalesce(character(r), whole))
    return F.aggregate(last, F.aggregate(F.array_except(found, last), text, put), put)


def folded(path: Column) -> Column:
    """A path from the root without its . and .. segments."""
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, part: F.when(part == ".", acc).when(
        part == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(part))))
    text = F.array_join(kept, "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}$") & ~text.endswith("/"), F.concat(text, F.lit("/"))).otherwise(text)


def after(text: Column, start: Column) -> Column:
    return F.substring(text, F.length(start) + 1, F.length(text))


def without_dots(path: Column) -> Column:
    """Folds the path and leaves query and fragment as they are."""
    bare = F.regexp_extract(path, "^[^?#]*", 0)
    return F.when(bare.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(folded(bare), after(path, bare))).otherwise(path)


def unquote(text: Column) -> Column:
    """Percent-decoding; a plus sign stays a plus sign and broken escapes stay as they are."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def absolute(page_url: Column, href: Column) -> Column:
    """href seen from page_url: absolute, scheme-relative, root-relative, query-only, fragment or path-relative."""
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(page_url, r"[?#].*$", "")
    folder = F.when(F.length(bare) > F.length(root), F.regexp_extract(bare, r"^(.*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, without_dots(href)))
            .when(href.startswith("?"), F.concat(bare, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, r"#.*$", ""), href))
            .otherwise(F.concat(root, without_dots(F.concat(after(folder, root), href)))))


def url_file_name(url: Column | str) -> Column:
    """Last path segment, decoded, with anything unusual as underscores."""
    path = F.regexp_replace(F.regexp_replace(as_col(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.regexp_replace(F.element_at(F.split(F.rtrim(unquote(path), F.lit("/")), "/"), -1), r"[^A-Za-z0-9._-]+", "_")


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", contains: str | None = ".csv") -> DataFrame:
    """Distinct (url, link) of each page: targets unescaped and made absolute, kept if they contain a text."""
    hrefs = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))))
    links = pages.select(F.col(url).alias("page_url"), hrefs.alias("href")).select(
        "page_url", absolute(F.col("page_url"), unescape(F.col("href"))).alias("link"))
    if contains:
        links = links.where(F.lower("link").contains(contains.lower()))
    return links.distinct()


def keep_link(domain: Column, link: Column, suffix: str = ".csv") -> Column:
    """Keep-rules per domain of source."""
    low = F.lower(unquote(link))
    wanted = low.contains("monthly") & low.contains("ae")
    for word in EXCLUDED_WORDS:
        wanted = wanted & ~low.contains(word)
    rule = (F.when(domain == "nhs111_iuc", low.contains("iucadc") & low.contains("raw"))
            .when(domain == "ae_emergency_admissions", wanted).otherwise(F.lit(True)))
    return low.endswith(suffix) & rule
