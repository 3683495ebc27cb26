"""Short texts for listings as Column expressions. Numbers stay the contract of the queries; these only name and round them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as fx

LABEL_CHARS = 50


def _member(parameters: Column, name: str) -> Column:
    """A top-level member as text; blank is absent."""
    v = F.get_json_object(parameters, f"$.{name}")
    return F.when(v != "", v)


def call_label(tool: Column, parameters: Column) -> Column:
    """What a call is about: its file with the lines asked for, pattern, description, address or number of
    items, by tool; for tools without a rule the beginning of its parameters, empty without any."""
    p = lambda n: _member(parameters, n)
    file, offset, limit = p("filePath"), p("offset"), p("limit")
    last = (offset.cast("bigint") + limit.cast("bigint")).cast("string")
    lines = (
        F.when(offset.isNotNull() & limit.isNotNull(), F.concat(F.lit(" (lines "), offset, F.lit("-"), last, F.lit(")")))
        .when(offset.isNotNull(), F.concat(F.lit(" (lines "), offset, F.lit("+)")))
        .when(limit.isNotNull(), F.concat(F.lit(" (lines 0-"), limit, F.lit(")")))
        .otherwise(F.lit(""))
    )
    paths = fx.parameter_paths(F.lit("apply_patch"), parameters)
    n = F.size(paths)
    patch = F.when(n == 0, F.lit("patch")).when(n <= 2, F.array_join(paths, ", ")).otherwise(F.concat(n.cast("string"), F.lit(" files: "), F.get(paths, 0), F.lit(", "), F.get(paths, 1), F.lit("...")))
    where = F.coalesce(F.concat(F.lit(" in "), p("path")), F.lit(""))
    pattern = F.coalesce(F.concat(F.lit('"'), p("pattern"), F.lit('"'), where), F.lit("(unknown pattern)"))
    command = p("command")
    short = F.when(F.length(command) > LABEL_CHARS, F.concat(F.substring(command, 1, LABEL_CHARS), F.lit("..."))).otherwise(command)
    todos = F.concat(F.coalesce(F.json_array_length(p("todos")), F.lit(0)).cast("string"), F.lit(" todos"))
    place = F.coalesce(F.concat(file, F.lit(":"), p("line"), F.lit(":"), p("character")), file)
    asked = F.json_array_length(p("questions"))
    headers = F.filter(F.transform(F.from_json(p("questions"), "array<struct<header:string>>"), lambda q: q["header"]), lambda h: F.coalesce(h, F.lit("")) != "")
    more = F.when(asked > 3, F.concat(F.lit(" (+"), (asked - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    questions = F.concat(asked.cast("string"), F.when(asked > 1, F.lit(" questions")).otherwise(F.lit(" question")), F.when(F.size(headers) > 0, F.concat(F.lit(": "), F.array_join(F.slice(headers, 1, 3), ", "), more)).otherwise(F.lit("")))
    whole = F.get_json_object(parameters, "$")
    rest = F.when(whole.isin("{}", "[]", "null"), F.lit("")).otherwise(F.substring(whole, 1, LABEL_CHARS))
    label = (
        F.when((tool == "read") & file.isNotNull(), F.concat(file, lines))
        .when(tool.isin("write", "edit", "multiedit") & file.isNotNull(), file)
        .when((tool == "apply_patch") & p("patchText").isNotNull(), patch)
        .when(tool == "list", F.coalesce(p("path"), F.lit("(current directory)")))
        .when(tool.isin("glob", "grep"), pattern)
        .when((tool == "bash") & F.coalesce(p("description"), command).isNotNull(), F.coalesce(p("description"), short))
        .when((tool == "webfetch") & p("url").isNotNull(), p("url"))
        .when(tool.isin("websearch", "codesearch") & p("query").isNotNull(), F.concat(F.lit('"'), p("query"), F.lit('"')))
        .when(tool == "todowrite", todos)
        .when(tool == "todoread", F.lit("read todo list"))
        .when((tool == "task") & p("description").isNotNull(), p("description"))
        .when((tool == "skill") & p("name").isNotNull(), p("name"))
        .when(tool == "lsp", F.concat_ws(" ", F.coalesce(p("operation"), F.lit("lsp")), place))
        .when(tool == "question", F.when(F.coalesce(asked, F.lit(0)) > 0, questions).otherwise(F.lit("question")))
        .otherwise(rest)
    )
    return F.coalesce(F.when(whole.isNotNull(), label), F.lit(""))


def token_text(tokens: Column, compact: bool = False) -> Column:
    """1.2K tokens, 3K tokens, 950 tokens; without the unit if compact."""
    unit = F.lit("" if compact else " tokens")
    big = F.regexp_replace(F.concat(F.format_string("%.1f", tokens / 1000), F.lit("K")), r"\.0K$", "K")
    return F.concat(F.when(tokens >= 1000, big).otherwise(tokens.cast("string")), unit)


def removal_text(removed: Column, summary: Column) -> Column:
    """-1.2K removed, +300 summary; the second part only where there is a summary."""
    gone = F.concat(F.lit("-"), token_text(removed, True), F.lit(" removed"))
    return F.when(summary > 0, F.concat(gone, F.lit(", +"), token_text(summary, True), F.lit(" summary"))).otherwise(gone)


def saved_text(saved: Column, counter: Column) -> Column:
    return F.concat(F.lit("~"), token_text(saved + counter), F.lit(" saved total"))


def short_path(text: Column, folder: str) -> Column:
    """A path (or what follows the last ' in ') relative to a folder; the folder itself is a dot."""
    head = F.regexp_extract(text, r"^(.+) in (.+)$", 1)
    path = F.when(head != "", F.regexp_extract(text, r"^(.+) in (.+)$", 2)).otherwise(text)
    inside = F.when(path == folder, F.lit(".")).when(F.startswith(path, F.lit(folder + "/")), F.substring(path, len(folder) + 2, 1 << 30)).otherwise(path)
    return F.when(head != "", F.concat(head, F.lit(" in "), inside)).otherwise(inside)


def duration_brief(ms: Column) -> Column:
    """12.3s, 4m5s, 2h3m; a dash for none."""
    s = ms / 1000
    return (
        F.when(ms.isNull(), F.lit("-"))
        .when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), F.bround(s % 60).cast("bigint").cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
    )


def size_bar(count: Column, most: Column, width: int = 8) -> Column:
    """###.....  38%: at least one cell for anything."""
    share = F.try_divide(count, most)
    filled = F.when((most <= 0) | (count <= 0), 0).otherwise(F.least(F.lit(width), F.greatest(F.lit(1), F.bround(share * width).cast("int"))))
    percent = F.when(most <= 0, 0).otherwise(F.bround(share * 100).cast("int"))
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled), F.lit(" "), F.lpad(percent.cast("string"), 3, " "), F.lit("%"))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_lines(text: Column, most: int) -> Column:
    """The text, or its first lines and how many more there are."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    return F.when(n <= most, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most - 1), "\n"), F.lit("\n... and "), (n - most + 1).cast("string"), F.lit(" more")))


def tag_text(ref: Column, attributes: Column) -> Column:
    """A reference tag on a line of its own with the non-empty attributes (a map) in order of their names."""
    kept = F.map_filter(attributes, lambda k, v: (F.trim(k) != "") & (F.coalesce(v, F.lit("")) != ""))
    one = lambda k: F.concat(F.lit(" "), k, F.lit('="'), fx.escape_attribute(kept[k]), F.lit('"'))
    return F.concat(F.lit(f"\n<{fx.TAG}"), F.array_join(F.transform(F.array_sort(F.map_keys(kept)), one), ""), F.lit(">"), ref, F.lit(f"</{fx.TAG}>"))
