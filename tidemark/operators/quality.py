"""Data-quality passes: URLs, feed configurations, paging and payload shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import _col
from tidemark.sources.custom import FIELDS, MAX_PAGES

# ---------------------------------------------------------------- fixed values

BANNED_HOSTS = ("localhost", "metadata.google.internal", "instance-data.ec2.internal")
BANNED_SUFFIXES = (".localhost", ".local", ".internal", ".lan")

#: IPv4 networks that are not public (0/8, 10/8, 100.64/10, 127/8, 169.254/16,
#: 172.16/12, 192.0.0/24, 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24,
#: 203.0.113/24, 224/4, 240/4) as patterns of the dotted text.
CLOSED_V4 = (
    r"(0|10|127)\.",
    r"100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.",
    r"169\.254\.",
    r"172\.(1[6-9]|2\d|3[01])\.",
    r"192\.0\.[02]\.",
    r"192\.168\.",
    r"198\.1[89]\.",
    r"198\.51\.100\.",
    r"203\.0\.113\.",
    r"(22[4-9]|23\d|24\d|25[0-5])\.",
)
#: Addresses inside a closed network that are public all the same.
OPEN_V4 = ("192.0.0.9", "192.0.0.10")

#: Public IPv6 space is 2000::/3 without these prefixes (as text patterns).
CLOSED_V6 = r"2001:0{0,3}:|2001::|2001:(0?1[0-9a-f]{2}|0{0,2}[0-9a-f]{1,2}):|2001:0?db8:|2002:|3fff:0?[0-9a-f]{0,3}:"
OPEN_V6 = r"2001:0{0,3}3:|2001:0{0,3}4:0?112:|2001:0{0,2}[23][0-9a-f]:"

REQUIRED_FIELDS = ("title", "company")
MAX_PATH = 250
INTERVAL_RANGE = (900, 86_400)
MAX_NAME = 80
PAGE_PARAMETER = r"^[A-Za-z][A-Za-z0-9_]{0,63}$"

# ------------------------------------------------------------------------ URLs

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def url_parts(url: Column | str) -> dict[str, Column]:
    """Scheme, authority, user info, host, port and fragment flag of a URL."""
    u = F.trim(_col(url))
    authority = F.regexp_extract(u, _AUTHORITY, 1)
    host_port = F.regexp_replace(authority, "^.*@", "")
    bracketed = F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_extract(host_port, r"^([^:\[]*)", 1)
    host = F.lower(F.when(bracketed != "", bracketed).otherwise(plain))
    return {
        "scheme": F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)),
        "user_info": F.regexp_extract(authority, "^(.*)@", 1),
        "host": F.regexp_replace(host, r"\.+$", ""),
        "port": F.regexp_extract(host_port, r":([^:\]]*)$", 1),
        "fragment": F.regexp_extract(u, "#(.*)$", 1),
    }


def url_violations(url: Column | str) -> Column:
    """Why a URL may not be fetched (static checks only), as an array of names."""
    part = url_parts(url)
    host = part["host"]
    suffixes = F.lit(False)
    for suffix in BANNED_SUFFIXES:
        suffixes = suffixes | host.endswith(suffix)
    blank = F.coalesce(F.trim(_col(url)), F.lit("")) == ""
    rules: list[tuple[str, Column]] = [
        ("missing", blank),
        ("not_https", ~blank & (part["scheme"] != "https")),
        ("no_host", ~blank & (host == "")),
        ("credentials", part["user_info"].rlike("[^:]")),
        ("fragment", part["fragment"] != ""),
        ("port", ~part["port"].isin("", "443")),
        ("host_not_allowed", host.isin(*BANNED_HOSTS) | suffixes),
        ("address_not_public", ~is_public_address(host)),
    ]
    return violations(rules)


def is_public_address(host: Column) -> Column:
    """False for a literal address in a closed network; names count as public."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = host.rlike(rf"^{octet}(\.{octet}){{3}}$")
    closed = host.rlike(f"^({'|'.join(CLOSED_V4)})") & ~host.isin(*OPEN_V4)
    v6 = host.contains(":")
    open_v6 = host.rlike("^[23][0-9a-f]{3}:") & (
        ~host.rlike(f"^({CLOSED_V6})") | host.rlike(f"^({OPEN_V6})")
    )
    return F.when(v4, ~closed).when(v6, open_v6).otherwise(F.lit(True))


def violations(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that fire, in order."""
    fired = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]
    return F.array_compact(F.array(*fired))


# -------------------------------------------------------------- configurations


def config_rules() -> list[tuple[str, Column]]:
    """Rules over ``source_name``, ``endpoint``, ``records_path``, ``fields`` (map),
    ``pagination_type``, ``page_parameter``, ``start_page``, ``max_pages`` and
    ``crawl_interval`` (the last three as text)."""
    fields = F.col("fields")
    names = F.map_keys(fields)
    paths = F.map_values(fields)
    paging = F.upper(F.coalesce("pagination_type", F.lit("NONE")))
    paged = paging == "PAGE"
    start = F.coalesce(F.col("start_page"), F.lit("1")).try_cast("bigint")
    pages = F.coalesce(
        F.col("max_pages"), F.when(paged, F.lit("3")).otherwise(F.lit("1"))
    ).try_cast("bigint")
    interval = F.coalesce(F.col("crawl_interval"), F.lit("3600")).try_cast("bigint")
    name = F.trim(F.coalesce("source_name", F.lit("")))

    def without(field: str) -> Column:
        return fields.isNotNull() & (F.trim(F.coalesce(fields[field], F.lit(""))) == "")

    return [
        ("source_name", (name == "") | (F.length(name) > MAX_NAME)),
        ("endpoint", F.size(url_violations("endpoint")) > 0),
        ("records_path", F.length(F.coalesce("records_path", F.lit("jobs"))) > MAX_PATH),
        ("fields", fields.isNull()),
        *[(f"no_{f}_path", without(f)) for f in REQUIRED_FIELDS],
        ("unknown_field", F.size(F.array_except(names, F.array(*map(F.lit, FIELDS)))) > 0),
        ("long_path", F.exists(paths, lambda p: F.length(p) > MAX_PATH)),
        ("pagination_type", ~paging.isin("NONE", "PAGE")),
        ("page_parameter", paged & ~F.coalesce("page_parameter", F.lit("page")).rlike(PAGE_PARAMETER)),
        ("page_numbers", start.isNull() | pages.isNull()),
        ("page_range", paged & ((start < 0) | ~pages.between(1, MAX_PAGES))),
        ("crawl_interval", interval.isNull() | ~interval.between(*INTERVAL_RANGE)),
    ]


def config_lint(configs: DataFrame) -> DataFrame:
    """Adds ``violations``; an empty array means the configuration is valid."""
    return configs.withColumn("violations", violations(config_rules()))


# ---------------------------------------------------------- paging and profile


def page_overlap(records: DataFrame, feed: str, page: str, record_id: str) -> DataFrame:
    """Ids of a feed that occur on more than one page (must be empty).

    Grouped by (feed, id): no pair of pages is joined, whatever their number.
    """
    pairs = records.select(feed, page, record_id).distinct()
    groups = pairs.groupBy(feed, record_id).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page")
    )
    return groups.filter(F.col("n_pages") > 1)


def shared_ids(records: DataFrame, page: str, record_id: str, left: object, right: object) -> DataFrame:
    """Distinct ids two given pages share."""
    ids = lambda p: records.filter(F.col(page) == p).select(record_id)
    return ids(left).intersect(ids(right))


def feed_profile(records: DataFrame, by: Sequence[str], body: str) -> DataFrame:
    """Records, size and share of each top-level field per feed.

    One output row per (feed, field); ``kinds`` lists the value types seen.
    """
    v = F.try_parse_json(body)
    typed = records.select(*by, F.octet_length(body).alias("__bytes"), v.alias("__v"))
    totals = typed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum("__bytes").cast("bigint").alias("n_bytes"),
        F.count_if(F.col("__v").isNull()).alias("n_invalid"),
    )
    members = F.try_variant_get("__v", "$", "map<string,variant>")
    fields = typed.select(*by, F.explode(members).alias("field", "value"))
    # The outermost type only: nested shapes may differ without end.
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    kinds = fields.select(*by, "field", kind.alias("kind"))
    counted = kinds.groupBy(*by, "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_field = counted.groupBy(*by, "field").agg(
        F.sum("n").alias("n_with_field"),
        F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"),
    )
    return per_field.join(totals, list(by))


def schema_profile(records: DataFrame, by: Sequence[str], body: str) -> DataFrame:
    """The merged schema of each feed's payloads as one type text."""
    return records.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(body)).alias("schema"))


def samples(records: DataFrame, by: Sequence[str], body: str, order: str) -> DataFrame:
    """The first record of each feed in ``order`` with its fields in order.

    An aggregation that keeps one record per feed and task, not a window over a feed.
    """
    first = records.groupBy(*by).agg(F.min_by(body, order).alias("sample"))
    return first.withColumn("fields", F.array_join(F.json_object_keys("sample"), ","))
