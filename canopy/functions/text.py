"""Text functions: tokens, keywords, classes by word, parsing of provider replies, splitting of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of side effects and the substrings that tell them, first match wins; else "compute".
SIDE_EFFECTS = [
    ("write", ["delete", "remove", "drop", "purge"]),
    ("write", ["create", "insert", "write", "update", "set", "upsert", "send", "publish", "post "]),
    ("transact", ["transact", "transfer", "charge", "payment"]),
    ("read", ["read", "get", "list", "fetch", "search", "find", "query", "scan", "view", "show"]),
]
# Words that are no keywords.
STOP_WORDS = "the a an of to in for on and or by with from as is at be this that it its tool function method api given returns return into using use will can does do if not".split()
# Verbs that a name may begin with or hold, and their siblings.
VERBS = "get list read fetch search find query scan create insert add write update set put upsert delete remove drop truncate send post publish notify download upload open close move copy rename parse compute calculate transform convert render".split()
SIBLINGS = {"get": "read", "list": "read", "fetch": "read", "read": "fetch", "create": "insert", "insert": "create", "add": "create", "update": "set", "set": "update", "delete": "remove", "remove": "delete", "send": "post", "post": "send"}
# Kinds of steps and hints of capabilities, each with its substrings, first match wins.
STEP_KINDS = [
    ("retrieve", ["find", "search", "look up", "retrieve", "inspect", "research"]),
    ("validate", ["check", "validate", "verify", "confirm", "test", "compare"]),
    ("synthesize", ["write", "draft", "summarize", "respond", "recommend"]),
    ("tool", ["run", "call", "update", "create", "build", "execute", "use"]),
]
CAPABILITY_HINTS = [
    ("web_search", ["search", "research", "find", "retrieve"]),
    ("text_generation", ["write", "draft", "summarize", "respond", "recommend"]),
    ("workspace_action", ["run", "execute", "build", "create", "update", "use"]),
    ("validator", ["validate", "check", "verify", "test", "compare"]),
]
# Patterns of constraints, in order, and of pronouns.
CONSTRAINTS = [r"\bmust\b[^.?!;]*", r"\bshould\b[^.?!;]*", r"\bwithout\b[^.?!;]*", r"\bwithin\b[^.?!;]*", r"\bby\b [^.?!;]*"]
PRONOUNS = r"\b(it|this|that|them)\b"
# Markers of sequence and verbs of action of a request with several intents.
SEQUENCE = r"\b(and|and then|then|after that|afterwards|before|finally|also|plus)\b|[,;]"
ACTIONS = r"\b(add|calculate|compare|compress|convert|decode|detect|download|encode|extract|fetch|filter|format|generate|get|hash|parse|pretty[- ]?print|pull|query|read|resize|scan|sort|summari[sz]e|timestamp|transform|translate|validate|write)\b"
# Fixed value: where a request is cut into steps.
STEP_CUTS = r"\bthen\b|\band then\b|\bafter that\b|\bfinally\b|;|\n|[.?!](?=\s+[A-Z]|\s*$)"


def first_class(text: Column, table: list[tuple[str, list[str]]], other: str | None) -> Column:
    """The first class of the table of which the lower-cased text holds a substring."""
    low = F.lower(text)
    out = None
    for name, parts in table:
        hit = low.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(other))


def side_effect(name: Column, doc: Column) -> Column:
    return first_class(F.concat(name, F.lit(" "), doc), SIDE_EFFECTS, "compute")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct words of three letters or more, without stop words, in the order of their first place."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z][a-zA-Z_0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))


def verb_of(name: Column) -> Column:
    """The first part of a name that is a verb; else the first verb that the name begins with; else "perform"."""
    parts = F.filter(F.split(F.lower(name), r"[_\-\.\s]+"), lambda p: p.isin(VERBS))
    begun = F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.startswith(F.lower(name), v))
    return F.coalesce(F.get(parts, F.lit(0)), F.get(begun, F.lit(0)), F.lit("perform"))


def noun_of(words: Column) -> Column:
    return F.coalesce(F.get(F.filter(words, lambda w: ~w.isin(VERBS)), F.lit(0)), F.lit("record"))


def sibling(verb: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SIBLINGS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, verb), verb)


def summary(text: Column, n: int) -> Column:
    """One line of n characters at most, cut with dots."""
    line = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > n, F.concat(F.rtrim(F.substring(line, 1, n - 1)), F.lit("..."))).otherwise(line)


def member_block(members: Column, most: int = 10) -> Column:
    shown = F.transform(F.slice(members, 1, most), lambda m: F.concat(F.lit("- "), m))
    return F.when(F.size(members) > 0, F.array_join(shown, "\n")).otherwise("(none)")


def without_fence(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)^\s*```(?:json)?\s*\n?(.*?)\n?```\s*$", "$1")


def parse_strings(raw: Column, fallback: Column, most: int = 8) -> Column:
    """The scalars of a JSON list as trimmed, non-empty strings, `most` at most; the fallback alone on any failure."""
    items = F.try_variant_get(F.try_parse_json(without_fence(raw)), "$", "array<variant>")
    texts = F.transform(items, lambda v: F.when(F.schema_of_variant(v).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$"), F.btrim(F.try_variant_get(v, "$", "string"))))
    kept = F.slice(F.filter(texts, lambda t: t.isNotNull() & (t != "")), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(fallback))


def parse_steps(raw: Column, fallback: Column, most: int = 8) -> Column:
    """Planned steps of a JSON list, objects or scalars, as (text, expected tools from 1 to 8)."""
    items = F.try_variant_get(F.try_parse_json(without_fence(raw)), "$", "array<variant>")

    def step(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.text", "string")).when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*|BOOLEAN)$"), F.try_variant_get(v, "$", "string"))
        n = F.when(kind.startswith("OBJECT"), F.try_variant_get(v, "$.expected_tools", "int"))
        return F.struct(F.btrim(text).alias("text"), F.when(n.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(8), n))).alias("expected_tools"))

    kept = F.slice(F.filter(F.transform(items, step), lambda s: s["text"].isNotNull() & (s["text"] != "")), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(fallback.alias("text"), F.lit(1).alias("expected_tools"))))


def parse_enrichment(raw: Column, name: Column) -> Column:
    """The enrichment in a reply: intent_phrase, input_kind, output_kind, synonyms, example_queries. Keys beyond these are
    dropped, missing ones are empty; a reply that is no JSON, or null, gives a record made of the name."""
    v = F.try_parse_json(without_fence(raw))
    one = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))
    many = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    given = {"intent_phrase": one("intent_phrase"), "input_kind": one("input_kind"), "output_kind": one("output_kind"), "synonyms": many("synonyms"), "example_queries": many("example_queries")}
    # The record of a reply that cannot be read.
    plain = {"intent_phrase": name, "input_kind": F.lit("input"), "output_kind": F.lit("output"), "synonyms": F.array().cast("array<string>"), "example_queries": F.array(name)}
    return F.struct(*[F.when(v.isNull(), plain[k]).otherwise(x).alias(k) for k, x in given.items()])


def distinct_by_lower(items: Column) -> Column:
    """Items without those equal to an earlier one but for case."""
    # Bound to a name, as each use inside a function of an element would work the items out again.
    once = lambda got, low: F.filter(got, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.transform(F.array(items), lambda got: F.transform(F.array(F.transform(got, F.lower)), lambda low: once(got, low))[0])[0]


def constraints(text: Column) -> Column:
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda x: F.btrim(x)) for p in CONSTRAINTS])
    return distinct_by_lower(found)


def ambiguities(text: Column) -> Column:
    return F.array_compact(F.array(F.when(text.rlike("(?i)" + PRONOUNS), "query contains unresolved pronouns"), F.when(F.contains(F.lower(text), F.lit(" or ")), "query may contain branching choices")))


def one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def split_steps(text: Column, most: int = 8) -> Column:
    parts = F.transform(F.split(text, STEP_CUTS, -1), lambda p: F.btrim(p, F.lit(" ,.")))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def title(part: Column, index: Column) -> Column:
    label = F.array_join(F.slice(F.filter(F.split(part, r"\s+"), lambda w: w != ""), 1, 5), " ")
    return F.when(label == "", F.concat(F.lit("Step "), index)).otherwise(F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1_000_000)))


def many_intents(text: Column) -> Column:
    verbs = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + ACTIONS), F.lit(1)), F.lower))
    return text.rlike("(?i)" + SEQUENCE) & (F.size(verbs) >= 2)


def set_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
