"""Prices and dates out of posted text, as projections over text tables."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Labels of a posting, price bounds and search distance.
LABELS = {"unleaded": "E10 - UNLEADED", "premium": "E10 - PREMIUM", "diesel": "CLEAR DIESEL"}
PRICE_MIN, PRICE_MAX, REACH = 1.0, 10.0, 60
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
BLANKS = r"[\s ]+"
NAME = "[A-Za-z0-9._%+-]"


def price_near_label(text: Column, label: str) -> Column:
    """First price within reach after the label, on a line that holds the label.

    Most texts lack the label's last word altogether; that test is one plain
    search and spares them the split into lines.
    """
    lines = F.transform(F.split(text, LINE_BREAK), lambda l: F.regexp_replace(l, BLANKS, " "))
    after = F.transform(lines, lambda l: F.regexp_extract(l, f"(?i){label}(.{{0,{REACH}}})", 1))
    found = F.transform(after, lambda a: F.regexp_extract(a, r"\$?([0-9]+\.[0-9]{2,5})", 1))
    price = F.get(F.filter(found, lambda p: p != ""), F.lit(0)).cast("double")
    return F.when(F.contains(F.lower(text), F.lit(label.split()[-1].lower())), price)


def posting_prices(postings: DataFrame) -> DataFrame:
    """All three labelled prices, or the reason the posting is refused."""
    out = postings.withColumns({k: price_near_label(F.col("body"), v) for k, v in LABELS.items()})
    missing, outside = F.lit(False), F.lit(False)
    for k in LABELS:
        missing = missing | F.col(k).isNull()
        outside = outside | ~F.col(k).between(PRICE_MIN, PRICE_MAX)
    return out.withColumn("reason", F.when(missing, "missing_label").when(outside, "out_of_bounds"))


def body_date(body: Column) -> Column:
    """``good from m/d/y`` as a date; two-digit years belong to this century."""
    pattern = r"(?i)good\s+from\s+([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})"
    part = lambda i: F.regexp_extract(body, pattern, i).try_cast("int")
    year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
    return F.format_string("%04d-%02d-%02d", year, part(1), part(2)).try_cast("date")


def effective_dates(postings: DataFrame) -> DataFrame:
    """Candidate sessions of each posting with the rule that gave them.

    A stated date wins.  Otherwise the local header date counts, and the day
    before it for a posting that arrived before nine in the morning.
    """
    stated, header = F.col("stated"), F.to_date("header_ts")
    entry = lambda d, rule: F.struct(d.alias("session"), F.lit(rule).alias("rule"))
    late = F.hour("header_ts") < 9
    rules = F.when(stated.isNotNull(), F.array(entry(stated, "body"))).when(
        late, F.array(entry(header, "header"), entry(F.date_sub(header, 1), "late_morning"))).otherwise(
        F.array(entry(header, "header")))
    return postings.withColumn("stated", body_date(F.col("body"))).select("*", F.inline(rules)).drop("stated")


def import_reason(postings: DataFrame, existing: DataFrame) -> DataFrame:
    """imported, already_present, or why a posting is quarantined.

    Most texts carry no date.  Their null keys would all meet in one partition
    of a shuffled outer join, so the distinct sessions are broadcast instead:
    there are never more of them than calendar days.
    """
    rows = posting_prices(postings).withColumn("session", body_date(F.col("body")))
    have = existing.select("session").distinct().withColumn("present", F.lit(True))
    joined = rows.join(F.broadcast(have), "session", "left")
    status = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(F.col("session").isNull(), "no_date")
              .when(F.col("present"), "already_present").otherwise("imported"))
    return joined.withColumn("status", status)


def unescaped(text: Column) -> Column:
    """Named, decimal and hexadecimal character references as their characters, each once.

    A reference that names no character stays as it is; a hard blank becomes a blank.
    """
    names = {n.removesuffix(";"): c for n, c in html.entities.html5.items() if n.endswith(";")} | {"nbsp": " "}
    known = F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # folded to a constant
    digits = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(
            name.startswith("#"), F.substring(name, 2, 7)).cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(number == 160, " ").when(valid, digits(number))).when(
            name != "", F.try_element_at(known, name))
        return F.coalesce(F.concat(char, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p))

    parts = F.split(text, "&", -1)
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    whole = F.concat(F.get(parts, 0), F.array_join(rest, ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts and styles go first, then the tags."""
    s = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<script\b.*?</script[^>]*>", " ")
    s = F.regexp_replace(s, r"(?is)<style\b.*?</style[^>]*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    s = unescaped(s)
    return F.regexp_replace(F.regexp_replace(s, r"[ \t\r\n\f]+", " "), "^ | $", "")


def mask_contacts(text: Column) -> Column:
    """E-mail names reduced to two letters and the last; short names vanish.

    A text without an at sign holds no address and is passed through as it is.
    """
    domain = r"([A-Za-z0-9.-]+)"
    long = F.regexp_replace(text, f"({NAME}{{2}}){NAME}+({NAME})@{domain}", "$1***$2@$3")
    masked = F.regexp_replace(long, f"(^|[^A-Za-z0-9._%+*-]){NAME}{{1,3}}@{domain}", "$1***@$2")
    return F.when(F.contains(text, F.lit("@")), masked).otherwise(text)


def mask_recipient(value: Column) -> Column:
    """One recipient: an address keeps its domain, anything else its first and last two letters."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    ends = lambda v, keep: F.concat(F.substring(v, 1, 2), F.lit("***"), F.right(v, F.lit(keep)))
    address = F.concat(F.when(F.length(name) <= 3, "***").otherwise(ends(name, 1)), F.lit("@"), domain)
    other = F.when(F.length(value) <= 4, "***").otherwise(ends(value, 2))
    return F.when(F.coalesce(value, F.lit("")) == "", "None").when(F.contains(value, F.lit("@")), address).otherwise(other)


def mask_recipients(value: Column) -> Column:
    """Every recipient of a comma-separated list, in order; blanks between commas count for nothing.

    No list at all is one recipient named None.
    """
    named = F.filter(F.transform(F.split(value, ","), lambda v: F.trim(v)), lambda v: v != "")
    return F.when(F.coalesce(value, F.lit("")) == "", F.array(F.lit("None"))).otherwise(F.transform(named, mask_recipient))


def mask_values(text: Column, values: Sequence[str]) -> Column:
    """Given recipients, numbers and keys masked wherever they stand, the longest first.

    Addresses and numbers count from three letters on, other values from five.
    """
    for v in sorted({v.strip() for v in values}, key=lambda v: (-len(v), v)):
        if "@" in v and len(v) > 2:
            name, domain = v.split("@", 1)
            shown = f"{'***' if len(name) <= 3 else name[:2] + '***' + name[-1]}@{domain}"
        elif len(v) > 4:
            shown = f"{v[:2]}***{v[-2:]}"
        else:
            continue
        text = F.replace(text, F.lit(v), F.lit(shown))
    return F.coalesce(text, F.lit(""))
