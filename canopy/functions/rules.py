"""Rules that add intents which a decomposition tends to leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, intent, pattern, patterns that must match too), all without regard to case.
RULES = [
    ("calculator", "evaluate arithmetic expressions", r"\b(calculate|compute|how many|total|sum|average|mean|times|multiplied|divided|share of|how much)\b", ()),
    ("calculator", "evaluate arithmetic expressions", r"\bhow long\b.*\bat\b.*\b\d+\s*(km/?h|mph|miles? per hour|kilometers? per hour)\b", ()),
    ("unit_converter", "convert values between common measurement units", r"\b(convert|in)\b", (r"\b\d+\s*(km|kilometers?|miles?|kg|kilograms?|lbs?|pounds?|deg[cf]|celsius|fahrenheit|mph|km/?h|meters?|feet|inches?)\b",)),
    ("unit_converter", "convert values between common measurement units", r"\b\d+\s*(km/?h|mph)\b", ()),
    ("get_current_datetime", "get the current UTC date and time", r"\b(now|today|current (date|time)|right now|what time is it|tonight|tomorrow|yesterday|timestamp)\b", ()),
    ("day_of_week", "get weekday from a date", r"\b(day of (the )?week|what day (is|was)|which weekday)\b", ()),
    ("timezone_convert", "convert a datetime between timezones", r"\b(time ?zone|in (PST|EST|UTC|GMT|JST|CET|PDT|EDT|London))\b|\bconvert .* (time|datetime) to .*\b", ()),
    ("date_diff", "compute time difference between two dates", r"\b(days? (until|till|since|between)|how long until|how many days (until|since|between))\b", ()),
    ("url_parse", "parse a URL into components", r"https?://|\bwww\.|\bURL\b", ()),
    ("http_get", "fetch content from a URL", r"\b(fetch|download|get|grab|pull|hit|call)\b", (r"https?://|\bwww\.|\bURL\b|\bendpoint\b|\bAPI\b",)),
    ("json_query", "extract values from JSON by path", r"\b(extract|pull(?: out)?|pluck|get|read|find)\b.*\b(status|created_at|inventory count|owner fields?|subtotal|price|token|array|field)\b", (r"\b(API response|response|payload|returned products|product API|callback URL|endpoint)\b",)),
    ("json_query", "extract values from JSON by path", r"\b(extract|pull|pluck|get|read|find)\b", (r"\bJSON\b|\bjson\b",)),
    ("json_format", "format JSON", r"\b(pretty[- ]?print|format|readable|show me|display)\b", (r"\bJSON\b|\bjson\b",)),
    ("array_sort", "sort an array", r"\b(sort|order)\b.*\b(by|ascending|descending|alphabetical|asc|desc)\b", ()),
    ("statistics", "compute basic descriptive statistics", r"\b(median|stdev|standard deviation|variance|min(imum)?|max(imum)?)\b", ()),
    ("percentage_calc", "calculate percentages", r"\b(percent|percentage|%)\b.*\b(of|change|increase|decrease|growth|drop)\b|\b(percent|percentage)\b", ()),
    ("encode_decode", "encode or decode text strings", r"\b(base64|url[- ]?encode|url[- ]?decode|hex encode|hex decode|encode this|decode this)\b", ()),
    ("generate_uuid", "generate a random UUID", r"\b(uuid|guid|unique id|unique identifier|new id|case id|ticket id|support id|checkout id|session id|tracking id|confirmation id|receipt id)\b", ()),
    ("visual_document_image_validation", "fetch document image validation result by request ID", r"\b(validate|valid|validation|verify|verification|authentic|actually valid)\b", (r"\b(scan|scanned|image|photo|picture|document|license|driver'?s license|passport|id)\b", r"\b(id|document|license|driver'?s license|passport)\b")),
    ("reward_demo_products_category", "Show me all products in the electronics category", r"\b(product category|category availability|products? in .*category|list category products|same category|snacks category|electronics category)\b", ()),
    ("reward_order_information", "get last redemption order information", r"\b(last (gift card )?redemption|last redeemed reward|redemption order|reward order|gift card redemption|order info|order information)\b", ()),
    ("simple_referral_rewards", "Show me my defined referral rewards.", r"\b(last redeemed reward|earned referral rewards|referral rewards|defined rewards)\b", ()),
    ("spacex_first_endpoint", "Get the SpaceX API reward data", r"\b(SpaceX .*first|first .*SpaceX|all three SpaceX|three SpaceX)\b", ()),
    ("spacex_second_endpoint", "Fetch the reward information from the SpaceX API", r"\b(SpaceX .*second|second .*SpaceX|all three SpaceX|three SpaceX)\b", ()),
    ("spacex_third_endpoint", "Show me the latest SpaceX launch details.", r"\b(SpaceX .*third|third .*SpaceX|third endpoint|all three SpaceX|three SpaceX)\b", ()),
    ("hash_text", "compute a SHA-256 hash of text", r"\b(sha256|sha-256|hash|fingerprint|checksum|digest)\b", ()),
]


def fired(text: Column) -> Column:
    """Array of (pos, name, intent) of the rules that the text fires, in the order of the table: one scan, no join."""
    hits = []
    for pos, (name, intent, pattern, needs) in enumerate(RULES):
        hit = text.rlike("(?i)" + pattern)
        for n in needs:
            hit = hit & text.rlike("(?i)" + n)
        hits.append(F.when(hit, F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(intent).alias("intent"))))
    return F.array_compact(F.array(*hits))


def inject(parts: Column, text: Column) -> Column:
    """parts with the intents of the fired rules behind them, without those that an earlier one equals but for case and blanks."""
    extra = F.transform(fired(text), lambda r: r["intent"])
    new = F.filter(extra, lambda x, i: ~F.exists(F.concat(parts, F.slice(extra, F.lit(1), i)), lambda y: F.lower(F.btrim(y)) == F.lower(F.btrim(x))))
    return F.concat(parts, new)


def sql() -> str:
    """The table as VALUES for a SQL engine; the patterns that must match too as one list."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return ", ".join(f"({p}, {q(n)}, {q(i)}, {q(x)}, [{', '.join(map(q, r))}]::VARCHAR[])" for p, (n, i, x, r) in enumerate(RULES))
