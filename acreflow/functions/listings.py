"""Auction listings: texts, dates, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Words and patterns of the classifiers.
SOLD_TITLE = ("sold", "closed")
SOLD_TEXT = ("sold", "sale closed", "auction closed", "contract pending")
REGION_URL = ("-ia", "iowa", "_ia_", "/ia/", "/ia-")
REGION_URL_SHORT = ("-ia", "iowa", "_ia_")
OTHER_LAND = ("residential", "commercial", "commercial building", "auto auction", "personal property auction", "farm equipment auction", "equipment auction", "estate auction", "workshop", "church contents", "livestock")
OTHER_TITLES = ("personal property", "church contents", "sportsman", "gun", "collector")
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DATE_PATTERNS = (
    rf"(?i)\b((?:{MONTH})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})\b",
    rf"(?i)\b((?:{MONTH_SHORT})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})\b",
    r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b",
    r"\b(\d{4}-\d{1,2}-\d{1,2})\b",
    r"(?i)(?:Bids?\s+Due|Sale\s+Date|Auction\s+Date|Bidding\s+Ends?|Closes?):\s*([A-Za-z]+\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})",
)
#: In order: the formats that a date's text may have.
DATE_FORMATS = ("yyyy-M-d", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "M/d/yyyy", "M-d-yyyy", "d/M/yyyy", "d-M-yyyy")


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def sold_in_text(title: Column, description: Column) -> Column:
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    return any_of(t, SOLD_TITLE) | any_of(d, SOLD_TEXT)


def listing_status(sold_status: Column, title: Column, description: Column) -> Column:
    return F.when(F.lower(sold_status).isin("sold", "pending", "closed") | sold_in_text(title, description), "sold").otherwise("active")


def region_url(url: Column, words=REGION_URL) -> Column:
    return any_of(F.lower(url), words)


def non_farm(title: Column, land_type: Column) -> Column:
    t, k = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(land_type, F.lit("")))
    has = lambda w: F.contains(t, F.lit(w))
    return (has("equipment") & ~has("land")) | (has("estate auction") & ~has("land") & ~has("farm") & ~has("acre")) | (has("livestock") & ~has("land")) | any_of(t, OTHER_TITLES) | k.isin(*OTHER_LAND)


def archive_reason(status: Column, date: Column, review: Column, enriched: Column, enrichment: Column, possession: Column, as_of: Column) -> Column:
    """Why a listing goes to the archive, null if it stays."""
    text = F.lower(F.coalesce(enriched, F.lit("")))
    past = F.coalesce(date < F.date_trunc("day", as_of), F.lit(False)) & ~F.coalesce(review, F.lit(False))
    told = F.coalesce(enrichment == "completed", F.lit(False)) & (any_of(text, SOLD_TEXT) | (F.contains(F.lower(F.coalesce(possession, F.lit(""))), F.lit("immediate")) & past))
    goes = (past | F.coalesce(status == "sold", F.lit(False)) | told) & ~F.coalesce(status == "archived", F.lit(False))
    return F.when(goes, F.when(status == "sold", "marked_sold").when(F.contains(text, F.lit("sold")), "ai_detected_sold").when(F.contains(text, F.lit("closed")), "ai_detected_closed").otherwise("past_auction_date"))


def parse_date(text: Column) -> Column:
    """The date of a text in one of ``DATE_FORMATS``; where day and month are unclear the month comes first."""
    clean = F.regexp_replace(F.btrim(text), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    clean = F.regexp_replace(F.regexp_replace(clean, r"(?i)\bsept\b", "Sep"), r"([A-Za-z])\.\s", "$1 ")
    clean = F.regexp_replace(F.initcap(clean), r"\s+", " ")
    return let(clean, lambda c: F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS]))


def extract_date(text: Column, as_of: Column) -> Column:
    """The first date in a text between a year before and two years after ``as_of``."""
    found = F.array(*[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in DATE_PATTERNS])
    days = F.transform(found, parse_date)
    return F.get(F.filter(days, lambda d: d.between(F.add_months(as_of, -12), F.add_months(as_of, 24))), 0)


def next_run(last: Column, cadence: Column, at: Column) -> Column:
    """The timestamp of the next scheduled run at 'HH:MM'; the last one itself if runs are manual."""
    days = F.when(cadence == "daily", 1).when(cadence == "every-other-day", 2).when(cadence == "weekly", 7)
    day = F.date_add(last.cast("date"), days)
    clock = F.split(at, ":")
    when = F.make_timestamp(F.year(day), F.month(day), F.day(day), clock[0].cast("int"), clock[1].cast("int"), F.lit(0))
    return F.when(days.isNull(), last).otherwise(when)


def acreage_text(acreage: Column) -> Column:
    """Two digits at most, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", acreage), r"\.?0+$", "")


def title(enriched: Column, acreage: Column, county: Column, state: Column, plain: Column) -> Column:
    county = F.nullif(county, F.lit(""))
    size = F.nullif(acreage, F.lit(0.0))
    away = F.when((state != "") & (state != "Iowa"), F.concat(F.lit(", "), state)).otherwise(F.lit(""))
    # a whole number keeps its zeros
    text = F.when(size == F.floor(size), F.floor(size).cast("string")).otherwise(acreage_text(size))
    made = F.when(size.isNotNull() & county.isNotNull(), F.concat(text, F.lit(" Acres "), county, F.lit(" County"), away)).when(county.isNotNull(), F.concat(county, F.lit(" County Land Auction"))).when(size.isNotNull(), F.lit("Land Auction"))
    return F.coalesce(F.nullif(enriched, F.lit("")), made, F.nullif(plain, F.lit("")), F.lit("Untitled Auction"))


def money(text: Column, low: float = 500, high: float = 50000) -> Column:
    """The first number of a text, if it lies in a range of prices."""
    first = F.nullif(F.regexp_extract(text, r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", 1), F.lit(""))
    value = F.regexp_replace(first, ",", "").try_cast("double")
    return F.when(value.between(low, high), value)


def comp_prices(text: Column, most: int = 3) -> Column:
    """array<struct<date, price_per_acre, acres, county>> of sales told in a text."""
    sales = F.slice(F.regexp_extract_all(text, F.lit(r"(?i)((?:\d{4}[-/]\d{2}|\w+ \d{4})[^$]*\$[0-9,]+[^a-z]*acre[^.]*\.)"), F.lit(1)), 1, most)

    def one(x: Column) -> Column:
        part = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
        return F.struct(
            part(r"(\d{4}[-/]\d{2}|\w+ \d{4})").alias("date"), F.regexp_replace(part(r"\$([0-9,]+)"), ",", "").try_cast("int").alias("price_per_acre"),
            part(r"(?i)(\d+)\s*acres").try_cast("int").alias("acres"), part(r"(?i)([A-Za-z]+)\s+County").alias("county"),
        )

    return F.filter(F.transform(sales, one), lambda s: s["date"].isNotNull() & s["price_per_acre"].isNotNull())


def yearly_change(text: Column) -> Column:
    """The first percentage told as a change, as a share."""
    value = F.nullif(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*%?\s*(?:increase|decrease|change|growth|appreciation)", 1), F.lit("")).try_cast("double")
    return F.when(value.between(0, 100), value / 100)


def summary_paragraph(text: Column, least: int = 100) -> Column:
    """The first long paragraph that tells no sales, else the first long one, else the beginning."""
    long_ones = F.filter(F.split(text, "\n\n"), lambda p: F.length(p) > least)
    calm = F.filter(long_ones, lambda p: ~F.contains(p, F.lit("comparable sales")) & ~F.contains(p, F.lit("Recent")))
    return F.coalesce(F.btrim(F.get(calm, 0)), F.btrim(F.get(long_ones, 0)), F.concat(F.substring(text, 1, 300), F.lit("...")))


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def section_patterns(township: Column, range_: Column, section: Column) -> Column:
    """LIKE patterns of parcel ids for a township, range and section; null without their numbers."""
    t, r, s = first_number(township), first_number(range_), section.cast("string")
    return F.when(t.isNotNull() & r.isNotNull(), F.array(F.concat(F.lit("%S"), s, F.lit("%T"), t, F.lit("%R"), r, F.lit("%")), F.concat(F.lit("%T"), t, F.lit("%R"), r, F.lit("%S"), s, F.lit("%")), F.concat(F.lit("%-"), s, F.lit("-%"), t, F.lit("-%"), r, F.lit("-%"))))
