"""Scalar functions as Column expressions: references, tags, tokens, paths, formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH_TOKENS, MEDIUM_TOKENS = 5000, 500
TAG = "context-ref"


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded half up; null and empty count 0."""
    return F.coalesce(F.round(F.length(text) / 4).cast("bigint"), F.lit(0))


def count_tokens_even(text: Column) -> Column:
    """The same with halves rounded to even, as the analytics scripts do."""
    return F.coalesce(F.bround(F.length(text) / 4).cast("bigint"), F.lit(0))


def priority(tokens: Column) -> Column:
    return F.when(tokens >= HIGH_TOKENS, "high").when(tokens >= MEDIUM_TOKENS, "medium").otherwise("low")


def message_ref(index: Column) -> Column:
    """m0001 .. m9999, null outside."""
    return F.when(index.between(1, 9999), F.concat(F.lit("m"), F.lpad(index.cast("string"), 4, "0")))


def block_ref(block_id: Column) -> Column:
    return F.when(block_id >= 1, F.concat(F.lit("b"), block_id.cast("string")))


def parse_message_ref(ref: Column) -> Column:
    """The number of an mNNNN reference in any case and padding, null if it is none."""
    n = F.regexp_extract(F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", "")), r"^m(\d{4})$", 1)
    value = F.when(n != "", n.cast("bigint"))
    return F.when(value >= 1, value)


def parse_block_ref(ref: Column) -> Column:
    n = F.regexp_extract(F.lower(F.regexp_replace(ref, r"(?U)^\s+|\s+$", "")), r"^b([1-9]\d{0,17})$", 1)
    return F.when(n != "", n.cast("bigint"))


def parse_block_argument(arg: Column) -> Column:
    """A positive block number with or without a leading b."""
    n = F.regexp_extract(F.lower(F.regexp_replace(arg, r"(?U)^\s+|\s+$", "")), r"^b?([1-9]\d{0,17})$", 1)
    return F.when(n != "", n.cast("bigint"))


def boundary(ref: Column) -> Column:
    """struct(kind, n): message or block, null if neither."""
    m, b = parse_message_ref(ref), parse_block_ref(ref)
    return F.when(m.isNotNull(), F.struct(F.lit("message").alias("kind"), m.alias("n"))).when(b.isNotNull(), F.struct(F.lit("block").alias("kind"), b.alias("n")))


def escape_attribute(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def stable_id(prefix: str, seed: Column) -> Column:
    """prefix_ and the first 16 hex digits of the seed's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(seed, 256), 1, 16))


def strip_tags(text: Column) -> Column:
    """Text without injected reference tags: paired, then single ones, then a reference on the last line."""
    out = F.regexp_replace(text, rf"(?is)<{TAG}[^>]*>.*?</{TAG}>", "")
    out = F.regexp_replace(out, rf"(?i)</?{TAG}[^>]*>", "")
    return F.regexp_replace(out, r"\n[mM]\d{4}\s*$", "")


def mask_block_tags(text: Column) -> Column:
    """Block numbers inside reference tags turned to BLOCKED."""
    return F.regexp_replace(text, rf"(<{TAG}(?:\s[^>]*)?>)b\d+", "$1BLOCKED")


def protected_bodies(text: Column) -> Column:
    """Trimmed, non-empty bodies of protect tags in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<protect>(.*?)</protect>"), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.filter(found, lambda b: b != "")


def append_once(base: Column, addition: Column) -> Column:
    """``addition`` after a blank line, unless blank or already contained."""
    extra = F.regexp_replace(addition, r"^\n+", "")
    joined = F.concat(F.regexp_replace(base, r"\n+$", ""), F.lit("\n\n"), extra)
    return F.when((F.trim(extra) == "") | F.contains(base, extra), base).when(base == "", extra).otherwise(joined)


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def hit_rate(cache_read: Column, fresh: Column) -> Column:
    """Percent of the prompt served from the cache, 0 for an empty prompt."""
    return F.coalesce(F.try_divide(cache_read * F.lit(100.0), cache_read + fresh), F.lit(0.0))


def duration_text(ms: Column) -> Column:
    """45ms, 12.3s, 4m 5s or 2h 3m."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(F.format_number(ms / 1000, 1), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
    )


def compression_ratio(before: Column, after: Column) -> Column:
    """0 for nothing before, infinite for nothing after, else at least 1."""
    return F.when(before <= 0, F.lit(0.0)).when(after <= 0, F.lit(float("inf"))).otherwise(F.greatest(F.lit(1.0), F.round(before / after)))


def bar(value: Column, most: Column, width: int) -> Column:
    return F.repeat(F.lit("#"), F.when(most > 0, F.round(value * width / most)).otherwise(0).cast("int"))


def normalise_path(path: Column) -> Column:
    """Doubled backslashes become slashes."""
    return F.replace(path, F.lit("\\\\"), F.lit("/"))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression: ** any, **/ any folders, * and ? without slashes."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def wildcard_regex(pattern: str) -> str:
    """The permission language: * any run, ? one character, a final ' *' optional, dots match newlines."""
    tail = ""
    if pattern.endswith(" *"):
        pattern, tail = pattern[:-2], "(?: .*)?"
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.replace("\\", "/"))
    return f"(?s)^{body}{tail}$"


def tool_name_protected(tool: Column, patterns: list[str]) -> Column:
    """Exact names by a set, names with wildcards by one alternation."""
    exact = [p for p in patterns if p and not set(p) & set("*?")]
    globs = [glob_regex(p) for p in patterns if p and set(p) & set("*?")]
    found = F.lit(False)
    if exact:
        found = found | tool.isin(exact)
    if globs:
        found = found | tool.rlike("|".join(globs))
    return F.coalesce(found, F.lit(False))


def parameter_paths(tool: Column, parameters: Column) -> Column:
    """Distinct non-empty file paths named by a call's parameters: of a patch its file headers, of an
    edit list its own path and its edits', else filePath and path."""
    none = F.array().cast("array<string>")
    single = F.array(F.get_json_object(parameters, "$.filePath"), F.get_json_object(parameters, "$.path"))
    patch = F.regexp_extract_all(F.get_json_object(parameters, "$.patchText"), F.lit(r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"), F.lit(1))
    edits = F.transform(F.from_json(F.get_json_object(parameters, "$.edits"), "array<struct<filePath:string>>"), lambda e: e["filePath"])
    listed = F.concat(F.array(F.get_json_object(parameters, "$.filePath")), F.coalesce(edits, none))
    paths = F.when(tool == "apply_patch", F.coalesce(patch, none)).when(tool == "multiedit", listed).otherwise(single)
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))


def canonical_json(text: Column) -> Column:
    """JSON with members sorted at every level and null members of the top level dropped.

    Null where the text is no readable JSON; values that are no object keep their compact form.
    """
    members = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, v: ~F.is_variant_null(v))
    pairs = F.transform(F.array_sort(F.map_keys(members)), lambda k: F.concat(F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", ""), F.lit(":"), F.to_json(members[k])))
    whole = F.to_json(F.try_parse_json(text))
    return F.when(F.startswith(whole, F.lit("{")), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(whole)


def signature(tool: Column, parameters: Column) -> Column:
    """tool::parameters in canonical form; the raw text where unreadable, the tool alone where null."""
    return F.concat_ws("::", tool, F.coalesce(canonical_json(parameters), parameters))
