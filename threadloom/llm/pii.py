"""Personal information in free text by bootstrapped contextual extraction.

One pass over the texts finds mentions: every place whose form could be an e-mail address, phone
number, identity number, street address or name. A mention has instance nodes (the words of a name,
the shape of a number, the street type) and a pattern node (the words around it). Seeds are sure by
themselves: lexicon names, numbers with a label, the commonest street types. Then, on tables of
counts, Spark alternates: patterns whose instances are mostly trusted become trusted, and instances
that stand in trusted patterns (or beside a trusted partner) become trusted in turn, until a round
changes nothing. What is trusted stays so, hence the rounds end. At the end a mention is taken if its
instances, or its pattern with one of them, are trusted. Texts are read twice only for redaction; the
rounds work on (instance, pattern) counts.

The lexicon is a fixed table of names; its size is checked before it is broadcast
(``MAX_LEXICON``). Learned words and patterns are joined, not broadcast by hand.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import cut, drop_cut

MAX_LEXICON = 1_000_000
#: A pattern is trusted from this share of trusted mentions, with at least two different instances.
PATTERN_SHARE = 0.5
#: Share of a word's mentions in trusted places from which it is a name word.
WORD_SHARE = 0.6
HALF_KNOWN = 0.8
#: Share of the labelled mentions of a shape that bear one label from which the shape has that kind.
SHAPE_SHARE = 0.8

#: Share of the mentions of a street type in trusted places from which it is one.
TYPE_SHARE = 0.5

# Street types (English, German suffixes, French); SEED_TYPES are sure, the rest are learned.
SEED_TYPES = frozenset("street st avenue ave road rd lane ln straße str weg rue".split())
_STREETS = "street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|square|sq|boulevard|blvd|way|place|pl|terrace|close|crescent"
_SUFFIXES = "straße|strasse|str\\.|weg|allee|gasse|platz|ring|damm|ufer"
_RUES = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours"
# Labels before numbers.
_ID_LABEL = re.compile(
    r"(?i)(?:\bssn|social[ -]security(?: number| no\.?)?|\btax (?:id|number|no\.?)|\btin|passport(?: number| no\.?)?|\bnino\b|\bni (?:number|no\.?)|national insurance(?: number| no\.?)?|national id(?:entity)?(?: number| no\.?)?|"
    r"identity card(?: number| no\.?)?|\bid card(?: number| no\.?)?|personal (?:code|number|id|no\.?)|driv(?:er|ing)[ '\w]{0,4}licen[cs]e(?: number| no\.?)?|(?:credit|debit|bank) card(?: number| no\.?)?|card (?:number|no\.?)|"
    r"steuer-?id|ausweis(?:nummer)?|personalausweis|reisepass|num[ée]ro de s[ée]cu\w*|citizen (?:id|number)|health (?:id|number)|insurance number)\s*(?:is|was|:|=|#)?\s*[\"'(]?$"
)
_PHONE_LABEL = re.compile(r"(?i)(?:\b(?:tel|telephone|phone|mobile|cell|fax|sms|hotline|telefon|handy|t[ée]l)\b\.?\w*|call (?:me|us|him|her|them)?\s*(?:on|at|under)|\bdial|\b(?:on-call|fallback|contact|emergency|support) number(?: is)?|whatsapp)\s*(?:is|:|=|to|on|at)?\s*[\"'(]?$")
_OTHER_LABEL = re.compile(
    r"(?i)(?:\b(?:order|invoice|commit|request|build|version|release[d]?|ip|ports?|started at|part (?:number|no\.?)|article|ticket|issue|pr|sha|hash|checksum|serial(?: number)?|model|sku|isbn|rev(?:ision)?|pinned|epoch|timestamp|pid|error|code|line|lines|offset|size|bytes)\b)\s*(?:is|:|=|#)?\s*[\"'(]?$"
)

_EMAIL = re.compile(r"(?<![\w.+%-])[\w][\w.+-]*(?:@|%40)(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")
_DODGED = re.compile(
    r"(?i)(?<![\w.+-])[\w][\w.+-]*\s*(?:\(at\)|\[at\]|\{at\}|<at>)\s*[a-z0-9-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>|\bdot\b)\s*[a-z0-9-]+)*\s*(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>|\bdot\b)\s*[a-z]{2,}\b"
    r"|(?<![\w.+-])[\w][\w.+-]* at [a-z0-9-]+(?: dot [a-z0-9-]+)* dot [a-z]{2,}\b"
)
_NUMBER = re.compile(
    r"(?<![\w/@.+-])(?:[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|(?=[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{7,14}|(?:\+|\(\+?)?\d(?:[ .()/-]{0,2}\d){6,18})(?:\s?(?:ext\.?|x)\s?\d{1,6})?(?![\w@/]|[.-]\w)"
)
_ADDRESS_EN = re.compile(
    rf"(?<![\w.,/-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?[ \t]+\w{{1,5}},[ \t\n]{{1,2}})?\d{{1,5}}[A-Za-z]?[ \t\n]{{1,2}}(?:[NSEW]\.?[ \t]+)?(?:[A-Z][\w'’-]+[ \t\n]{{1,2}}){{1,3}}?(?P<type>(?i:{_STREETS}))(?![\w'’-])(?![ \t]+View\b)"
)
_ADDRESS_DE = re.compile(rf"(?<![\w/-])(?:[A-ZÄÖÜ][\w-]*(?P<type>{_SUFFIXES})|[A-ZÄÖÜ][\w-]+[ \t\n](?P<type2>Straße|Strasse|Weg|Allee|Platz|Gasse))[ \t\n]{{1,2}}\d{{1,4}}[ \t]?[a-z]?(?![\w])")
_ADDRESS_FR = re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:[ \t]?(?:bis|ter|quater))?,?[ \t\n]{{1,2}}(?P<type>{_RUES})[ \t\n]{{1,2}}(?:(?:de la|de l['’]|des|du|de|d['’])[ \t]*)?[A-ZÀ-Ž][\w'’-]+")
_ADDRESS_ANY = re.compile(r"(?<![\w.,/-])\d{1,4}[A-Za-z]?[ \t](?:[NSEW]\.?[ \t]+)?[A-Z][a-z]+[ \t](?P<type>[A-Z][a-z]{2,11})\.?(?=,|$|\n)")

_W = r"[^\W\d_][^\W\d_'’]*(?:[-'’][^\W\d_]{2,})*"
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Prof|Sir|Herr|Frau|Mme|Mlle)\.?"
_CAP = r"[^\W\d_a-zß-öø-ÿ]"
_TAIL = r"[^\W\d_'’]*(?:[-'’][^\W\d_]{2,})*"
_NAME = re.compile(rf"(?<![\w@./\\-])(?:(?P<title>{_TITLE})[ \t]+)?(?P<a>{_CAP}\.|{_CAP}{_TAIL})[ \t\u00a0](?:{_CAP}\.[ \t])?(?P<b>{_CAP}{_TAIL})(?![\w@/\\]|[.-]\w)")
_LOWER = re.compile(r"(?<![\w@./\\-])(?P<a>[^\W\d_]{3,})[ \t](?P<b>[^\W\d_]{3,}(?:-[^\W\d_]{3,})?)(?![\w@/\\-]|\.\w)")
#: Words as _LOWER reads them, with and without the part after a hyphen.
_LOWER_WORD = re.compile(r"([^\W\d_]+)(?:-[^\W\d_]+)?")
_HAS_NUMBER = re.compile(r"\d[\d .()/-]{5}|[A-Z]\d\d|[A-Z0-9]{7}")
_DODGES = ("dot", "(at)", "[at]", "{at}", "<at>")
#: A number before a capital or a French street word, or a capitalised word before a number.
_HAS_STREET = re.compile(rf"\d[A-Za-z]?[ \t\n]{{1,2}}[A-Z]|\d(?:[ \t]?(?:bis|ter|quater))?,?[ \t\n]{{1,2}}(?:{_RUES})\b|[A-ZÄÖÜ][\w-]*(?:{_SUFFIXES})?[ \t\n]{{1,2}}\d")
_HAS_TITLE = re.compile(_TITLE)
_TITLED = re.compile(rf"(?<![\w@./-])(?P<title>{_TITLE})[ \t]+(?P<b>{_W})(?![\w@/])")
_COMMA = re.compile(rf"(?<![\w@./-])(?P<b>{_W})(?:,[ \t]|;|,)(?P<a>[^\W\d_]\.|{_W})(?![\w@/(]|\.\w)")
_KEYED = re.compile(rf"(?i)\bfirst[ _-]?(?:name)?[\"']?\s*[:=]\s*[\"']?(?P<a>{_W})[\"']?\s*[,;]\s*[\"']?last[ _-]?(?:name)?[\"']?\s*[:=]\s*[\"']?(?P<b>{_W})")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|\n")
_WORD = re.compile(_W)

_SHAPE = "part_id string, line_no bigint, start_at bigint, end_at bigint, family_kind string, a string, b string, pattern string, seed string"


def shape(number: str) -> str:
    """Digits as d, capital letters as A, white space as one blank, extensions left off."""
    body = re.sub(r"\s?(?:ext\.?|x)\s?\d+$", "", number)
    return re.sub(r"\s+", " ", re.sub(r"[A-Z]", "A", re.sub(r"\d", "d", body)))


def _pattern(text: str, start: int, end: int) -> str:
    """The token on each side, two where it is no word; starts and ends of sentences and lines are
    marked, numbers are 0. A place alone on its line takes the end of the line above."""
    left = _TOKEN.findall(text[max(0, start - 60) : start])
    if start < 60:
        left = ["\n", *left]
    right = [*_TOKEN.findall(text[end : end + 60])[:2], "\n"]
    before = ["^" if t in ".?!\n" else t for t in left]
    if left and left[-1] == "\n" and right[0] == "\n":
        before = [*left[-2:-1], "^"]
    elif before and (before[-1] == "^" or before[-1].isalnum()):
        before = before[-1:]
    after = right[: right.index("\n")] + ["$"]
    tidy = lambda ts: " ".join("0" if t.isdigit() else t.lower() for t in ts)
    return f"{tidy(before[-2:])} _ {tidy(after[: 2 if after[0].isalnum() else 1])}"


class Spans:
    """Spans that do not overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


class Finder:
    """Finds mentions in one text; holds the seed lexicon."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self.all = given | family
        self.plain_given = given - _COMMON

    def mentions(self, text: str) -> list[tuple]:
        """(start, end, family_kind, a, b, pattern, seed) of every mention, not overlapping."""
        out: list[tuple] = []
        taken = Spans()
        free = taken.free

        def add(a: int, b: int, kind: str, i: str, j: str, seed: str | None, holds: bool = True) -> None:
            if holds:
                taken.add(a, b)
            out.append((a, b, kind, i, j, _pattern(text, a, b), seed))

        low = text.lower()
        if "@" in text or "%40" in text:
            for m in _EMAIL.finditer(text):
                add(m.start(), m.end(), "email", "plain", "", "email")
        if any(x in low for x in _DODGES):
            for m in _DODGED.finditer(text):
                if free(*m.span()):
                    add(m.start(), m.end(), "email", "dodged", "", "email")
        if _HAS_STREET.search(text):
            for pattern in (_ADDRESS_FR, _ADDRESS_EN, _ADDRESS_DE):
                for m in pattern.finditer(text):
                    if m[0].count("\n") <= 1 and free(*m.span()):
                        kind = (m["type"] or m.groupdict().get("type2") or "").lower().rstrip(".")
                        add(m.start(), m.end(), "address", kind, "", "address" if kind in SEED_TYPES else None)
            for m in _ADDRESS_ANY.finditer(text):
                if free(*m.span()):
                    add(m.start(), m.end(), "address", m["type"].lower(), "", None)
        for m in _NUMBER.finditer(text) if _HAS_NUMBER.search(text) else ():
            if not free(*m.span()):
                continue
            line = text[max(text.rfind("\n", 0, m.start()) + 1, m.start() - 48) : m.start()]
            seed = "id_number" if _ID_LABEL.search(line) else "phone" if _PHONE_LABEL.search(line) else "other" if _OTHER_LABEL.search(line) else None
            if seed == "phone" and not any(c.isdigit() for c in m[0][:4]):
                seed = "other"
            add(m.start(), m.end(), "number", shape(m[0]), "", seed)
        if "last" in low:
            for m in _KEYED.finditer(text):
                if free(*m.span()):
                    self._name(add, m.start("a"), m.end("b"), m["a"], m["b"])
        if "," in text or ";" in text:
            for m in _COMMA.finditer(text):
                i, j = m["a"].lower(), m["b"].lower()
                if m["b"][0].isupper() and m["a"][0].isupper() and (j in self.family or i in self.given or ";" in m[0]) and free(*m.span()):
                    self._name(add, m.start(), m.end(), m["a"], m["b"])
        at = 0
        while m := _NAME.search(text, at):
            at = m.end("a")
            if free(*m.span()):
                a, b = m["a"], m["b"]
                half = a.lower() in self.all or b.lower() in self.all or a[1:] == "."
                self._name(add, m.start(), m.end(), a, b, half)
                if half:
                    at = m.end()
        if _HAS_TITLE.search(text):
            for m in _TITLED.finditer(text):
                if m["b"][0].isupper() and free(*m.span()):
                    self._name(add, m.start(), m.end(), m["title"].rstrip(".") + ".", m["b"])
        words = {w for m in _LOWER_WORD.finditer(low) for w in (m[0], m[1])}
        if not words.isdisjoint(self.family) or not words.isdisjoint(self.plain_given):
            at = 0
            while m := _LOWER.search(text, at):
                at = m.end("a")
                a, b = m["a"], m["b"]
                if a.islower() and b.islower() and (b in self.family or a in self.plain_given) and free(*m.span()):
                    self._name(add, m.start(), m.end(), a, b)
        return out

    def _name(self, add, start: int, end: int, a: str, b: str, holds: bool = True) -> None:
        i, j = a.lower(), b.lower()
        parts = j.split("-")
        known_b = all(p in self.family for p in parts)
        known_a = i in self.given or a[1:] == "." or i.rstrip(".") in ("dr", "mr", "mrs", "ms", "miss", "prof", "sir", "herr", "frau", "mme", "mlle")
        add(start, end, "name", i, j, "name" if known_a and known_b else None, holds)


# Given names that are common words.
_COMMON = frozenset("will grace mark rose june hope max art may april august frank bill sue pat rob drew dawn faith joy summer".split())


def text_parts(parts: DataFrame) -> DataFrame:
    """(part_id, text) of the readable text parts with a text; parts without id are left out."""
    v = F.try_parse_json("data")
    src = parts.where(F.col("id").isNotNull() & F.col("data").contains('"text"')).select(F.col("id").alias("part_id"), v.alias("v"))
    return src.where(F.try_variant_get("v", "$.type", "string") == "text").select("part_id", F.try_variant_get("v", "$.text", "string").alias("text")).where(F.length("text") > 0)


def lexicon(names: DataFrame) -> tuple[set[str], set[str]]:
    """Lower-case given and family names of the fixed lexicon table, its size checked."""
    rows = names.where(F.length(F.trim("name_form")) > 0).select(F.lower(F.trim("name_form")).alias("w"), F.lower(F.trim("kind")).alias("k")).distinct().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ValueError(f"the name lexicon has more than {MAX_LEXICON} entries")
    return {r["w"] for r in rows if r["k"] == "given"}, {r["w"] for r in rows if r["k"] == "family"}


def find_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """All mentions of (part_id, text) rows, in the columns of ``_SHAPE``; offsets in code points."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon(names))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(*held.value)
        for batch in batches:
            rows = []
            for pid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = finder.mentions(text)
                lines = [m.start() for m in re.finditer("\n", text)] if found else []
                for a, b, kind, i, j, pattern, seed in found:
                    rows.append((pid, bisect_left(lines, a) + 1, a, b, kind, i, j, pattern, seed))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _SHAPE.split(", ")])

    return texts.select("part_id", "text").mapInArrow(run, _SHAPE)


def _scored(edges: DataFrame) -> DataFrame:
    """(pattern, share, n_sure): how far the instances of a pattern are names. Both words known count
    as one, one known (a given name that is a common word aside) as HALF_KNOWN."""
    sure = (F.col("known_a") == 1) & (F.col("known_b") == 1)
    half = (F.col("known_b") == 1) | ((F.col("known_a") == 1) & ~F.col("a").isin(*_COMMON) & (F.length("a") > 2))
    weight = F.when(sure, F.lit(1.0)).when(half, F.lit(HALF_KNOWN)).otherwise(F.lit(0.0))
    return edges.groupBy("pattern").agg((F.sum(weight) / F.count("*")).alias("share"), F.count_if(sure).alias("n_sure"))


def _rounds(state: DataFrame, step, rounds: int | None, label: str) -> DataFrame:
    """``step`` applied until no row has ``changed``, or for the given number of rounds."""
    state = cut(state, label)
    while rounds is None or rounds > 0:
        after = cut(step(state), label)
        drop_cut(state)
        state = after.drop("changed")
        if after.where("changed").isEmpty():
            break
        rounds = None if rounds is None else rounds - 1
    return state


def _learn_names(edges: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    """(edges, patterns) once both slots of every edge are known or not.

    edges: a, b, pattern, n, known_a, known_b (0 or 1: in the lexicon, an initial or a title).
    """

    def step(known: DataFrame) -> DataFrame:
        patterns = _scored(known).where((F.col("share") >= PATTERN_SHARE) & (F.col("n_sure") >= 2)).select("pattern", "share")
        at = known.join(patterns, "pattern", "left")
        good = F.col("share").isNotNull()

        def promoted(slot: str, partner: str) -> DataFrame:
            backed = good | (F.col(f"known_{partner}") == 1) & (F.length(partner) > 2)
            return (
                at.groupBy(F.col(slot).alias(slot))
                .agg((F.sum(F.when(good, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.count_if(good).alias("n_good"), F.count_if(backed).alias("n_backed"), F.max(f"known_{slot}").alias("was"))
                .where((F.col("was") == 1) | ((F.col("n_good") >= 1) & (F.col("n_backed") >= 1) & (F.col("share") >= WORD_SHARE)))
                .select(slot, F.lit(1).alias(f"now_{slot}"))
            )

        now = [F.greatest(f"known_{x}", F.coalesce(f"now_{x}", F.lit(0))).alias(f"known_{x}") for x in "ab"]
        changed = (F.coalesce("now_a", F.lit(0)) > F.col("known_a")) | (F.coalesce("now_b", F.lit(0)) > F.col("known_b"))
        return known.join(promoted("a", "b"), "a", "left").join(promoted("b", "a"), "b", "left").select("a", "b", "pattern", "n", *now, changed.alias("changed"))

    known = _rounds(edges, step, rounds, "name-edges")
    return known.select("a", "b", "pattern", "known_a", "known_b"), _scored(known)


def _name_mentions(mentions: DataFrame, names: DataFrame, rounds: int | None) -> DataFrame:
    words = names.select(F.lower(F.trim("name_form")).alias("w"), F.lower(F.trim("kind")).alias("k")).distinct()
    own = mentions.where(F.col("family_kind") == "name")
    flat = own.groupBy("a", "b", "pattern").agg(F.count("*").alias("n"))
    given = words.where(F.col("k") == "given").select(F.col("w").alias("a"), F.lit(1).alias("ga"))
    family = words.where(F.col("k") == "family").select(F.col("w").alias("bf"), F.lit(1).alias("fb"))
    edges = (
        flat.join(given, "a", "left")
        .withColumn("bf", F.regexp_extract("b", r"([^-]+)$", 1))
        .join(family, "bf", "left")
        .select("a", "b", "pattern", "n", F.coalesce(F.col("ga"), F.when(F.col("a").endswith("."), 1), F.lit(0)).alias("known_a"), F.coalesce("fb", F.lit(0)).alias("known_b"))
    )
    known, patterns = _learn_names(edges, rounds)
    trusted = (F.col("share") >= PATTERN_SHARE) & (F.col("n_sure") >= 2)
    taken = (
        known.join(patterns, "pattern")
        .where(
            ((F.col("known_a") == 1) & (F.col("known_b") == 1))
            | (trusted & ((F.col("known_a") == 1) | (F.col("known_b") == 1)))
            | ((F.col("share") >= 0.8) & (F.col("n_sure") >= 5) & (F.length("a") > 1) & (F.length("b") > 2))
        )
        .select("a", "b", "pattern")
    )
    return own.join(taken, ["a", "b", "pattern"]).withColumn("kind", F.lit("name"))


def _form_mentions(mentions: DataFrame, rounds: int | None) -> DataFrame:
    """Numbers and addresses: one graph of forms (shape of a number, street type) and patterns.

    An edge that has no seed takes a label from its pattern or its form. A form or a pattern bears the
    label of at least ``SHAPE_SHARE`` of its labelled mentions; as street types have no counter-examples,
    theirs must also reach ``TYPE_SHARE`` of all their mentions (and a pattern two seeded ones).
    Among the labels of a number ``other`` from the pattern goes before the form.
    """
    own = mentions.where(F.col("family_kind").isin("number", "address")).withColumnRenamed("a", "form")
    edges = own.groupBy("family_kind", "form", "pattern", "seed").agg(F.count("*").alias("n")).withColumn("label", F.col("seed"))

    def best(rows: DataFrame, node: str) -> DataFrame:
        labelled = F.col("label").isNotNull()
        votes = rows.groupBy("family_kind", node, "label").agg(F.sum("n").alias("v"), F.count("*").alias("edges"))
        few = (F.col("family_kind") == "address") & ((F.col("top") < TYPE_SHARE * F.col("every")) | ((F.col("top") < 2) if node == "pattern" else F.lit(False)))
        return (
            votes.groupBy("family_kind", node)
            .agg(F.max_by("label", F.when(labelled, F.struct("v", "label"))).alias("which"), F.max(F.when(labelled, F.col("v"))).alias("top"), F.sum(F.when(labelled, F.col("v"))).alias("told"), F.sum("v").alias("every"))
            .where((F.col("top") >= SHAPE_SHARE * F.col("told")) & ~few)
            .select("family_kind", node, F.col("which").alias(f"{node}_label"))
        )

    def step(state: DataFrame) -> DataFrame:
        known = state.join(best(state, "form"), ["family_kind", "form"], "left").join(best(state, "pattern"), ["family_kind", "pattern"], "left")
        now = F.coalesce("label", F.when(F.col("pattern_label") == "other", F.lit("other")), "form_label", "pattern_label")
        return known.select("family_kind", "form", "pattern", "seed", "n", now.alias("label"), (F.col("label").isNull() & now.isNotNull()).alias("changed"))

    state = _rounds(edges, step, rounds, "form-edges")
    types = best(state, "form").where(F.col("family_kind") == "address").select("family_kind", "form", F.lit(True).alias("typed"))
    taken = state.join(types, ["family_kind", "form"], "left").where(F.col("label").isin("phone", "id_number") | (F.col("label") == "address") & (F.col("typed") | F.col("seed").isNotNull()))
    labels = taken.select("family_kind", "form", "pattern", F.coalesce("seed", F.lit("")).alias("s"), F.col("label").alias("kind"))
    return own.withColumn("s", F.coalesce("seed", F.lit(""))).join(labels, ["family_kind", "form", "pattern", "s"])


def personal_information(texts: DataFrame, names: DataFrame, rounds: int | None = None) -> DataFrame:
    """(part_id, line_no, start_at, end_at, kind) of every taken mention, distinct.

    rounds: at most so many, by default until nothing changes. Null and empty texts have none; repeated rows count once in the result. An empty lexicon leaves
    names to what patterns of the other seeds cannot tell, that is, none. Ties between labels of a
    shape go to the greater label text.
    """
    mentions = cut(find_mentions(texts, names), "mentions")
    cols = ["part_id", "line_no", "start_at", "end_at", "kind"]
    email = mentions.where(F.col("family_kind") == "email").withColumn("kind", F.lit("email"))
    found = [email, _form_mentions(mentions, rounds), _name_mentions(mentions, names, rounds)]
    out = found[0].select(cols)
    for f in found[1:]:
        out = out.unionByName(f.select(cols))
    return out.distinct()


def placeholder(kind: str | Column) -> Column:
    """``[EMAIL]``, ``[PHONE]`` and so on."""
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(part_id, text, n_replaced): texts with a typed placeholder for each found span.

    Spans of one text are gathered (no more than its length), joined by part_id and applied from the
    end; overlapping ones are applied once, the longer winning. All other characters stay.
    """
    spans = found.groupBy("part_id").agg(F.sort_array(F.collect_list(F.struct("start_at", (-F.col("end_at")).alias("e"), "kind"))).alias("spans"))
    own = texts.select("part_id", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pieces, at, n = [], 0, 0
                for s in spans or ():
                    if s["start_at"] >= at:
                        inside, mark = text[s["start_at"] : -s["e"]], f"[{s['kind'].upper()}]"
                        if "last" in inside.lower():  # first and last name under two keys
                            mark += _WORD.sub("", inside, count=1)[: -len(_WORD.findall(inside)[-1])] + mark
                        pieces += [text[at : s["start_at"]], mark]
                        at = -s["e"]
                        n += 1
                out.append("".join(pieces) + text[at:])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int64())], names=["part_id", "text", "n_replaced"])

    return own.join(spans, "part_id", "left").select("part_id", "text", "spans").mapInArrow(run, "part_id string, text string, n_replaced bigint")
