"""Queries of text, date, value, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreflow.functions import listings, owners, values
from acreflow.operators import relational

from .base import Tables, register

QUERIES: dict = {}
ORACLES: dict = {}
query = register(QUERIES, ORACLES)


def _parts(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), "*")


#: Part names as owner names of several kinds.
OWNER = """(SELECT p_partkey AS id, CASE WHEN p_partkey % 8 = 0 THEN split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2)
 WHEN p_partkey % 8 = 1 THEN p_name || ' Family Trust' WHEN p_partkey % 8 = 2 THEN upper(p_name) || ' FARMS, LLC' WHEN p_partkey % 8 = 3 THEN p_name || ' & Sons L.L.C.'
 WHEN p_partkey % 8 = 4 THEN p_name || ' Co' WHEN p_partkey % 8 = 5 THEN 'O''' || p_name || ' Ltd.' WHEN p_partkey % 8 = 6 THEN NULL ELSE p_name || ' and  ' || p_type END AS name FROM part) o"""


def _owners(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    word = F.split(n, " ")
    name = (
        F.when(k == 0, F.concat(word[0], F.lit(", "), word[1])).when(k == 1, F.concat(n, F.lit(" Family Trust"))).when(k == 2, F.concat(F.upper(n), F.lit(" FARMS, LLC")))
        .when(k == 3, F.concat(n, F.lit(" & Sons L.L.C."))).when(k == 4, F.concat(n, F.lit(" Co"))).when(k == 5, F.concat(F.lit("O'"), n, F.lit(" Ltd."))).when(k == 7, F.concat(n, F.lit(" and  "), "p_type"))
    )
    return t.part.select(F.col("p_partkey").alias("id"), name.alias("name"))


def _plain_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _owner_sql(suffix: str) -> str:
    cut = f"regexp_replace(upper(name), '{suffix}', '')"
    flipped = f"regexp_replace({cut}, '^([^,]+),\\s*(.+)$', '\\2 \\1')"
    return f"SELECT id, {_plain_sql(flipped)} AS owner FROM {OWNER}"


def _norm(t: Tables, variant: str) -> DataFrame:
    return _owners(t).select("id", owners.normalize_owner(F.col("name"), variant).alias("owner"))


@query(_owner_sql(owners.SERVICE_SUFFIX))
def norm_owner(t: Tables) -> DataFrame:
    return _norm(t, "service")


@query(_owner_sql(owners.LOADER_SUFFIX))
def norm_owner_v2(t: Tables) -> DataFrame:
    return _norm(t, "loader")


@query(f"SELECT id, CASE WHEN coalesce(name, '') = '' THEN 'UNKNOWN' ELSE trim(regexp_replace(regexp_replace(trim(upper(name)), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')) END AS owner FROM {OWNER}")
def norm_owner_v3(t: Tables) -> DataFrame:
    return _norm(t, "bbox")


@query("SELECT id, {} AS owner FROM {}".format(_plain_sql(f"regexp_replace(regexp_replace(upper(name), '\\s+(AND|&)\\s+|&', ' ', 'g'), '{owners.COMPARE_SUFFIX}', '')"), OWNER))
def norm_owner_v4(t: Tables) -> DataFrame:
    return _norm(t, "compare")


@query("SELECT p_partkey, list_extract(string_split(trim(p_name), ' '), -1) AS surname FROM part")
def surname(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", owners.surname(F.col("p_name")).alias("surname"))


@query("""SELECT p_partkey, '%S' || p_size || '%T' || (p_partkey % 90) || '%R' || (p_partkey % 40) || '%' AS a, '%T' || (p_partkey % 90) || '%R' || (p_partkey % 40) || '%S' || p_size || '%' AS b, '%-' || p_size || '-%' || (p_partkey % 90) || '-%' || (p_partkey % 40) || '-%' AS c FROM part""")
def trs_parse(t: Tables) -> DataFrame:
    town = F.concat(F.lit("T"), (F.col("p_partkey") % 90).cast("string"), F.lit("N"))
    range_ = F.concat(F.lit("Range "), (F.col("p_partkey") % 40).cast("string"), F.lit("W"))
    p = listings.section_patterns(town, range_, F.col("p_size"))
    return t.part.select("p_partkey", p[0].alias("a"), p[1].alias("b"), p[2].alias("c"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Given ' || p_name WHEN p_partkey % 10 = 1 THEN p_brand || ' County Land Auction' WHEN p_partkey % 10 = 2 THEN 'Land Auction'
 WHEN p_partkey % 10 = 3 THEN p_name WHEN p_partkey % 10 = 4 THEN p_size || ' Acres ' || p_brand || ' County' WHEN p_partkey % 10 = 5 THEN p_size || ' Acres ' || p_brand || ' County, Nebraska'
 ELSE p_size || '.5 Acres ' || p_brand || ' County' END AS title FROM part""")
def title_build(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 10
    size = F.col("p_size").cast("double")
    acres = F.when(k.isin(1, 3), F.lit(0.0)).when(k.isin(0, 2, 4, 5), size).otherwise(size + 0.5)
    county = F.when(~k.isin(2, 3), F.col("p_brand"))
    state = F.when(k == 5, "Nebraska").otherwise("Iowa")
    return t.part.select("p_partkey", listings.title(F.when(k == 0, F.concat(F.lit("Given "), "p_name")), acres, county, state, F.col("p_name")).alias("title"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN '' END, ''), CASE WHEN p_partkey % 2 = 0 THEN p_brand END, p_type) AS v FROM part")
def coalesce_chain(t: Tables) -> DataFrame:
    first = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.lit(""))
    return t.part.select("p_partkey", F.coalesce(F.nullif(first, F.lit("")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), "p_type").alias("v"))


@query("SELECT o_orderkey, CASE WHEN v BETWEEN 500 AND 50000 THEN v END AS price FROM (SELECT o_orderkey, CAST(replace(format('{:,}', CAST(floor(o_totalprice / 10) AS BIGINT)), ',', '') AS DOUBLE) AS v FROM orders)")
def money_parse(t: Tables) -> DataFrame:
    text = F.concat(F.lit("about $"), F.format_number(F.floor(F.col("o_totalprice") / 10), 0), F.lit(" an acre, or 12"))
    return t.orders.select("o_orderkey", listings.money(text).alias("price"))


@query("SELECT p_partkey, 2 AS sales, '2024-03' AS day, CAST(4000 + p_size * 100 AS INTEGER) AS price, CAST(p_size AS INTEGER) AS acres, 'Story' AS county, CASE WHEN p_size <= 40 THEN p_size / 100.0 END::DOUBLE AS change FROM part")
def comp_parse(t: Tables) -> DataFrame:
    price = F.format_number(4000 + F.col("p_size") * 100, 0)
    size = F.col("p_size").cast("string")
    yearly = F.when(F.col("p_size") <= 40, F.concat(F.lit(" Up "), size, F.lit("% increase"))).otherwise(F.lit(""))
    text = F.concat(F.lit("2024-03 sale of "), size, F.lit(" acres in Story County at $"), price, F.lit("/acre here. May 2023 tract for $7,100/acre."), yearly)
    found = t.part.select("p_partkey", listings.comp_prices(text).alias("s"), listings.yearly_change(text).alias("change"))
    top = F.get("s", 0)
    return found.select("p_partkey", F.size("s").alias("sales"), top["date"].alias("day"), top["price_per_acre"].alias("price"), top["acres"].alias("acres"), top["county"].alias("county"), "change")


@query("SELECT doc_id, coalesce(trim(list_filter(string_split(text, chr(10)), lambda p: length(p) > 100 AND NOT contains(p, 'Recent'))[1]), substr(text, 1, 300) || '...') AS summary FROM documents")
def paragraph_pick(t: Tables) -> DataFrame:
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    summary = listings.summary_paragraph(paragraphs)
    cut = F.concat(F.substring("text", 1, 300), F.lit("..."))
    long_one = F.exists(F.split("text", "\n"), lambda p: F.length(p) > 100)
    return t.documents.select("doc_id", F.when(long_one, summary).otherwise(cut).alias("summary"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def date_parse(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    fmt = lambda f: F.date_format(d, f)
    late = F.dayofmonth(d) > 12
    text = F.when(k == 0, fmt("yyyy-MM-dd")).when(k == 1, fmt("MMMM d, yyyy")).when(k == 2, fmt("MMM d yyyy")).when(k == 3, fmt("M/d/yyyy")).when((k == 4) & late, fmt("d/M/yyyy")).when((k == 5) & late, fmt("d-M-yyyy")).otherwise(fmt("yyyy-M-d"))
    return t.orders.select("o_orderkey", F.date_format(listings.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate BETWEEN TIMESTAMP '1997-06-15' AND TIMESTAMP '2000-06-15' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'none' END AS day FROM orders")
def date_extract(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.concat(F.lit("Sale Date: "), F.date_format(d, "MMM d, yyyy"))).when(k == 1, F.concat(F.lit("Auction on "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"), F.lit(" at 10"))).when(k == 2, F.concat(F.lit("bids until "), F.date_format(d, "MM/dd/yyyy"))).otherwise(F.concat(F.lit("listed "), F.date_format(d, "yyyy-MM-dd"), F.lit(".")))
    day = F.date_format(listings.extract_date(text, F.lit("1998-06-15").cast("date")), "yyyy-MM-dd")
    return t.orders.select("o_orderkey", F.coalesce(day, F.lit("none")).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 1 THEN 'review' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 <> 2 THEN 'scraped' WHEN o_orderkey % 2 = 0 THEN 'regex' ELSE 'none' END AS origin FROM orders")
def date_coalesce(t: Tables) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    fields = [F.when(F.col("o_orderkey") % 3 == i, d) for i in (0, 1)]
    scraped, told = F.coalesce(*[listings.parse_date(f) for f in fields]), listings.parse_date(F.when(F.col("o_orderkey") % 2 == 0, d))
    origin = F.when(scraped.isNotNull(), "scraped").when(told.isNotNull(), "regex").otherwise("none")
    return t.orders.select("o_orderkey", F.coalesce(F.date_format(F.coalesce(scraped, told), "yyyy-MM-dd"), F.lit("review")).alias("day"), origin.alias("origin"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'Date TBD' ELSE strftime(o_orderdate, '%b %d, %Y') END AS shown FROM orders")
def date_fmt(t: Tables) -> DataFrame:
    shown = F.date_format(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")), "MMM dd, yyyy")
    return t.orders.select("o_orderkey", F.coalesce(shown, F.lit("Date TBD")).alias("shown"))


@query("SELECT event_id, strftime(CASE WHEN event_id % 4 = 3 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) + INTERVAL 6 HOUR + INTERVAL 30 MINUTE + CASE event_id % 4 WHEN 0 THEN INTERVAL 1 DAY WHEN 1 THEN INTERVAL 2 DAY ELSE INTERVAL 7 DAY END END, '%Y-%m-%d %H:%M:%S') AS run FROM events")
def next_run(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    cadence = F.when(k == 0, "daily").when(k == 1, "every-other-day").when(k == 2, "weekly").otherwise("manual")
    return t.events.select("event_id", F.date_format(listings.next_run(F.date_trunc("second", "ts"), cadence, F.lit("06:30")), "yyyy-MM-dd HH:mm:ss").alias("run"))


# --- values


@query("SELECT p_partkey, CASE WHEN p_size > 5 THEN floor((p_retailprice / 65.0) * p_size * 100 + 0.5) / 100 ELSE 0 END::DOUBLE AS v FROM part")
def csr2_value(t: Tables) -> DataFrame:
    rating = F.when(F.col("p_size") > 5, F.col("p_size")).otherwise(0).cast("double")
    return t.part.select("p_partkey", values.rating_value(rating, F.col("p_retailprice"), F.lit(65.0)).alias("v"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN 'CRP' WHEN 1 THEN 'Timber' WHEN 2 THEN 'Other' END"
SHARE = "CASE p_partkey % 4 WHEN 0 THEN 0.65::DOUBLE WHEN 1 THEN 0.55::DOUBLE WHEN 2 THEN 0.20::DOUBLE ELSE 1.0::DOUBLE END"


def _kind() -> Column:
    k = F.col("p_partkey") % 4
    return F.when(k == 0, "CRP").when(k == 1, "Timber").when(k == 2, "Other")


@query(f"""SELECT p_partkey, floor(r * 174 * 100 + 0.5) / 100 AS tillable, floor(p_retailprice * share * 100 + 0.5) / 100 AS non_tillable, floor((r * 174 * till + p_retailprice * share * (100.0::DOUBLE - till)) / 100.0::DOUBLE * 100 + 0.5) / 100 AS blended,
floor((r * 174 * till + p_retailprice * share * (100.0::DOUBLE - till)) * 100 + 0.5) / 100 AS total FROM (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS r, (p_size * 2)::DOUBLE AS till, {SHARE} AS share FROM part)""")
def blended(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("double")
    return t.part.select("p_partkey", values.blended(F.lit(100.0), size * 2, size, F.col("p_retailprice"), _kind()).alias("v")).select("p_partkey", "v.*")


@query("SELECT p_partkey, p_size::DOUBLE / CASE WHEN p_partkey % 3 = 0 THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS income, floor(4.25::DOUBLE * p_size * 100 + 0.5) / 100 AS rent FROM part")
def income_cap(t: Tables) -> DataFrame:
    cap = F.when(F.col("p_partkey") % 3 == 0, 0.05).when(F.col("p_partkey") % 3 == 1, 0.0)
    return t.part.select("p_partkey", values.income_value(F.col("p_size").cast("double"), cap).alias("income"), values.suggested_rent(F.lit(4.25), F.col("p_size")).alias("rent"))


@query("""SELECT p_partkey, step, per_acre, land, floor((land + 25000) * 100 + 0.5) / 100 AS total FROM (SELECT *, floor(per_acre * p_size * 100 + 0.5) / 100 AS land FROM
(SELECT *, floor((p_retailprice + step) * 100 + 0.5) / 100 AS per_acre FROM (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size, floor(p_retailprice * least(greatest(CASE WHEN p_partkey % 7 = 0 THEN 0.02::DOUBLE ELSE (p_partkey % 200 - 100) / 100.0::DOUBLE END, -0.2::DOUBLE), 0.5::DOUBLE) * 100 + 0.5) / 100 AS step FROM part)))""")
def final_value(t: Tables) -> DataFrame:
    rate = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 200 - 100) / 100.0)
    v = values.final_value(F.col("p_retailprice"), rate, F.col("p_size").cast("double"), F.lit(25000))
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", F.col("v.adjustment").alias("step"), "v.per_acre", "v.land", "v.total")


@query("SELECT p_partkey, CASE WHEN x > 0 AND x <= 5000 AND x >= 200 THEN x ELSE 1000 END::DOUBLE AS v FROM (SELECT p_partkey, (p_partkey * 7 - 200)::DOUBLE AS x FROM part)")
def value_gate(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", values.gated((F.col("p_partkey") * 7 - 200).cast("double"), F.lit(1000.0)).alias("v"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 3700 WHEN 'LARGE' THEN 2800 ELSE 3000 END AS price, CASE p_type WHEN 'PROMO' THEN 15000 WHEN 'LARGE' THEN 3000 ELSE 2000 END AS improvement FROM part")
def lookup_default(t: Tables) -> DataFrame:
    land = F.when(F.col("p_type") == "PROMO", "Irrigated").when(F.col("p_type") == "LARGE", "Dryland").otherwise("Else")
    built = F.when(F.col("p_type") == "PROMO", "Barn").when(F.col("p_type") == "LARGE", "Fencing").otherwise("Else")
    return t.part.select("p_partkey", values.lookup(land, values.LAND_PRICES, values.LAND_PRICE).alias("price"), values.lookup(built, values.IMPROVEMENT_VALUES, values.IMPROVEMENT_VALUE).alias("improvement"))


@query(f"""SELECT p_partkey, floor(p_retailprice + 0.5) * till + floor(p_retailprice * share + 0.5) * (100.0::DOUBLE - till) + 500 AS total FROM (SELECT p_partkey, p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN 100.0::DOUBLE * 0.9::DOUBLE ELSE p_size::DOUBLE END AS till, {SHARE} AS share FROM part)""")
def report_total(t: Tables) -> DataFrame:
    till = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).otherwise(0).cast("double")
    return t.part.select("p_partkey", values.report_total(F.col("p_retailprice"), F.lit(100.0), till, _kind(), F.lit(500.0)).alias("total"))


# --- JSON and arrays


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def json_fields(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return t.events.select("event_id", k.alias("k"), k.try_cast("bigint").alias("n"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '","source":"centroid"}' AS props FROM events""")
def json_merge(t: Tables) -> DataFrame:
    old = F.from_json("props", "map<string,string>")
    kept = F.map_filter(old, lambda k, _: k != "source")
    return t.events.select("event_id", F.to_json(F.map_concat(kept, F.create_map(F.lit("source"), F.lit("centroid")))).alias("props"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_scan(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.from_json("props", "k bigint").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("total"))


@query("SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS mukey, n_name AS muname FROM nation")
def array_rows(t: Tables) -> DataFrame:
    rows = t.nation.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name"))).alias("rows"))
    return relational.positional_rows(rows, "rows", ["mukey", "muname"])


@query("""SELECT o_custkey, CAST(count(*) FILTER (WHERE p >= 6000) AS INTEGER) AS used, CAST(count(*) FILTER (WHERE p < 6000) AS INTEGER) AS excluded, coalesce(CAST(floor(CAST(sum(CASE WHEN p >= 6000 THEN p END) AS BIGINT)::DOUBLE / count(*) FILTER (WHERE p >= 6000) + 0.5) AS BIGINT), -1) AS average,
count(*) FILTER (WHERE p >= 6000) = 0 AS all_filtered FROM (SELECT o_custkey, CAST(floor(o_totalprice / 40) AS BIGINT) AS p FROM orders) GROUP BY o_custkey""")
def comps_filter(t: Tables) -> DataFrame:
    prices = t.orders.groupBy("o_custkey").agg(F.collect_list(F.floor(F.col("o_totalprice") / 40).cast("double")).alias("p"))
    v = prices.select("o_custkey", values.comps(F.col("p")).alias("v")).select("o_custkey", "v.*")
    return v.withColumn("average", F.coalesce("average", F.lit(-1)))


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN 15000 ELSE 0 END) AS BIGINT)::DOUBLE AS total FROM orders GROUP BY o_custkey")
def improvements_sum(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    item = F.struct(F.lit("Barn").alias("type"), F.when(k == 0, "manual").when(k == 1, "ai").otherwise("none").alias("method"), F.col("o_orderkey").cast("double").alias("manual"))
    return t.orders.groupBy("o_custkey").agg(values.improvements_total(F.collect_list(item)).alias("total"))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def listagg(t: Tables) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda p: p["n_name"]), ", ").alias("names"))


@query("SELECT p_partkey, 'csr2' AS method, p_retailprice AS per_acre, p_retailprice * p_size AS total FROM part UNION ALL SELECT p_partkey, 'income', p_size / 0.03::DOUBLE, p_size / 0.03::DOUBLE * p_size FROM part UNION ALL SELECT p_partkey, 'ai_market', p_retailprice * 1.5::DOUBLE, p_retailprice * 1.5::DOUBLE * p_size FROM part")
def unpivot_methods(t: Tables) -> DataFrame:
    wide = t.part.select("p_partkey", "p_size", F.col("p_retailprice").alias("csr2"), (F.col("p_size") / 0.03).alias("income"), (F.col("p_retailprice") * 1.5).alias("ai_market"))
    tall = wide.unpivot(["p_partkey", "p_size"], ["csr2", "income", "ai_market"], "method", "per_acre")
    return tall.select("p_partkey", "method", "per_acre", (F.col("per_acre") * F.col("p_size")).alias("total"))
