"""Accessibility rules over elements: the tags of raw pages, or any table with the same columns.

An element has (page_id, at, name, role, aria_label, aria_labelledby,
aria_hidden, element_id, html_for, tab_index, href, alt, title, scope, type,
on_click, on_key, icon, has_text); absent attributes are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ATTRIBUTES = {
    "role": "role", "aria_label": "aria-label", "aria_labelledby": "aria-labelledby", "aria_hidden": "aria-hidden", "element_id": "id", "html_for": "for", "tab_index": "tabindex",
    "href": "href", "alt": "alt", "title": "title", "scope": "scope", "type": "type", "on_click": "onclick", "on_key": "onkey(?:down|up|press)", "icon": "data-icon",
}

#: Elements that labels belong to, that are focusable, and roles with an element of their own.
LABELABLE = ("input", "select", "textarea", "meter", "progress", "output")
FOCUSABLE = ("button", "input", "select", "textarea", "details", "summary")
SEMANTIC_ROLES = ("banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "article", "button", "link", "list", "listitem", "heading", "img", "table", "row", "cell", "rowheader", "columnheader")

#: Rule, criterion, severity.
RULES = (
    ("wcag-keyboard-accessible", "2.1.1", "error"), ("wcag-accessible-name", "4.1.2", "error"), ("wcag-valid-aria-reference", "1.3.1", "warning"), ("wcag-no-positive-tabindex", "2.4.3", "warning"),
    ("wcag-button-has-text", "4.1.2", "error"), ("wcag-form-label", "1.3.1", "error"), ("wcag-heading-order", "1.3.1", "warning"), ("wcag-semantic-elements", "1.3.1", "warning"),
    ("wcag-aria-hidden-focus", "4.1.2", "error"), ("wcag-list-structure", "1.3.1", "error"), ("wcag-image-alt", "1.1.1", "error"), ("wcag-link-name", "2.4.4", "error"), ("wcag-table-headers", "1.3.1", "warning"),
)


def attribute_pattern(attribute: str) -> str:
    """Group 1 is the attribute's value, quoted or bare."""
    return rf"""(?i)\s{attribute}\s*=\s*["']?([^"'>\s]*)"""


def elements(pages: DataFrame) -> DataFrame:
    """Opening tags of every page, in order, with their attributes and whether text follows."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"<[A-Za-z][^>]*>[^<]*"), F.lit(0))).alias("at", "piece"))
    tag = F.regexp_extract("piece", "^(<[^>]*>)", 1)
    out = found.select("page_id", "at", tag.alias("tag"), F.lower(F.regexp_extract("piece", "^<([A-Za-z][A-Za-z0-9]*)", 1)).alias("name"), F.regexp_like(F.regexp_extract("piece", "^<[^>]*>([^<]*)", 1), F.lit(r"\S")).alias("has_text"))
    return out.withColumns({c: F.when(F.regexp_like("tag", F.lit(attribute_pattern(a))), F.regexp_extract("tag", attribute_pattern(a), 1)) for c, a in ATTRIBUTES.items()})


def given(column: str) -> Column:
    return F.coalesce(F.col(column) != "", F.lit(False))


def checks() -> dict[str, Column]:
    """Rule -> condition, over elements with what() columns added."""
    tab = F.expr("try_cast(tab_index as int)")
    named = (F.trim(F.coalesce("aria_label", F.lit(""))) != "") | F.coalesce(F.array_contains("page_ids", F.col("aria_labelledby")), F.lit(False))
    labelled = given("aria_label") | given("aria_labelledby")
    button = (F.col("name") == "button") | F.coalesce(F.col("role") == "button", F.lit(False))
    native = F.col("name").isin("a", "button", "label", "input", "select", "textarea")
    focusable = F.coalesce(tab >= 0, F.lit(False)) | F.col("name").isin(*FOCUSABLE) | ((F.col("name") == "a") & F.col("href").isNotNull())
    hidden = F.coalesce(F.col("aria_hidden") == "true", F.lit(False))
    role = F.coalesce("role", F.lit(""))
    level = F.expr("try_cast(substring(name, 2, 1) as int)")
    return {
        "wcag-keyboard-accessible": F.col("on_click").isNotNull() & F.col("on_key").isNull() & ~native & F.col("role").isNull(),
        "wcag-accessible-name": F.col("on_click").isNotNull() & ~native & (role != "") & ~named,
        "wcag-valid-aria-reference": given("aria_labelledby") & ~F.coalesce(F.array_contains("page_ids", F.col("aria_labelledby")), F.lit(False)),
        "wcag-no-positive-tabindex": F.coalesce(tab > 0, F.lit(False)),
        "wcag-button-has-text": button & ~named & ~F.col("has_text") & ~labelled & given("icon"),
        "wcag-form-label": F.col("name").isin(*LABELABLE) & (F.coalesce("type", F.lit("")) != "hidden") & ~labelled & ~(given("element_id") & F.coalesce(F.array_contains("labelled_ids", F.col("element_id")), F.lit(False))),
        "wcag-heading-order": F.col("is_heading") & F.coalesce(level > F.col("heading_before") + 1, F.lit(False)),
        "wcag-semantic-elements": F.col("name").isin("div", "span") & role.isin(*SEMANTIC_ROLES),
        "wcag-aria-hidden-focus": focusable & hidden,
        "wcag-list-structure": (F.col("name") == "li") & ~F.col("list_before"),
        "wcag-image-alt": (F.col("name") == "img") & F.col("alt").isNull() & ~labelled & ~role.isin("presentation", "none") & ~hidden,
        "wcag-link-name": (F.col("name") == "a") & given("href") & ~named & ~F.col("has_text") & ~given("title"),
        "wcag-table-headers": (F.col("name") == "th") & ~given("scope") & (F.col("page_headers") > 1),
    }


def in_context(e: DataFrame) -> DataFrame:
    """Adds what rules ask of the page: ids, labelled ids, headers, the heading and the lists before.  A page is one row of input, so its window is bounded."""
    page = Window.partitionBy("page_id")
    so_far = page.orderBy("at")
    heading = F.col("name").rlike("^h[1-6]$")
    before = F.last(F.when(heading, F.expr("try_cast(substring(name, 2, 1) as int)")), ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumns({
        "page_ids": F.collect_set("element_id").over(page),
        "labelled_ids": F.collect_set(F.when(F.col("name") == "label", F.col("html_for"))).over(page),
        "page_headers": F.count_if(F.col("name") == "th").over(page),
        "list_before": F.count_if(F.col("name").isin("ul", "ol", "menu")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)) > 0,
        "is_heading": heading,
        "heading_before": before,
    })


def violations(e: DataFrame) -> DataFrame:
    """(page_id, at, rule_id): one row per element and rule that it breaks, from one pass over the elements."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks().items()]))
    return in_context(e).select("page_id", "at", F.explode(broken).alias("rule_id"))


def issues(pages: DataFrame) -> DataFrame:
    """Issues per rule with criterion and severity, and the pages that have them."""
    found = violations(elements(pages)).groupBy("rule_id").agg(F.count("*").alias("issues"), F.countDistinct("page_id").alias("pages"))
    known = lambda i: F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[i])]), F.col("rule_id"))
    return found.select("rule_id", known(1).alias("criterion"), known(2).alias("severity"), "issues", "pages")
