"""Credentials embedded in source code, configuration and command lines.

A keyword automaton passes over each text once; only texts with a keyword go on, and of these only
the lines with one (and the next, where an assignment is left open). On them issuer formats, headers, addresses with user data, assignments to
secret names and key blocks are matched, each match is checked for structure (token headers,
base64 user data, checksums of issuers that publish them, variety, stand-ins, references), and every literal that remains is replaced by
a placeholder of the same length over the same alphabet, so the code around it stays whole.

Everything happens inside one map over the table: no shuffle, no state between rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keywords one of which stands near every credential, lower case.
KEYWORDS = (
    "key", "token", "secret", "passw", "pwd", "pass", "auth", "bearer", "basic", "credential", "login", "://", "_live_", "_test_",
    "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "akia", "asia", "xox", "sk-", "eyj", "aiza", "npm_", "pypi-", "hf_", "_pat", "todo", "remove", "rotate", "revoke", "sign(", "jwt", "hmac", "encrypt", "mysql", "sshpass", "\" + \"", "' + '", "sg.", "fernet", "fixme", "-u ", "--user", "@tcp(", "@unix(", "sign (",
)

# Token formats of issuers.
ISSUERS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"gh[opsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20}|A[KS]IA[0-9A-Z]{16}|xox[abeprs]-[A-Za-z0-9-]{10,}|"
    r"sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|[a-z]{2,12}_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)

_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")

_USERINFO = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`]*:([^\s/\"'`<>]+)@(?=[\w\[])")
_PARAM = re.compile(r"(?i)[?&;](?:api[_-]?key|apikey|key|(?:access|auth|refresh|id)?[_-]?token|(?:client[_-]?)?secret|passw(?:or)?d|pwd|sig|signature)=([^&\s\"'`#;]+)")
_BEARER = re.compile(r"(?i)\b(?:bearer|token)\s+([A-Za-z0-9+/=._~-]{8,})")
_BASIC = re.compile(r"(?i)\bbasic\s+([A-Za-z0-9+/_-]{6,}={0,2})")

_SECRET = r"(?:pass(?:w(?:or)?d|phrase)?|pwd|secret|token|pat|credentials?|auth|key)"
#: A whole name where the place before it is fixed, and the end of a name; ``_full_name`` reads the rest.
_NAME = rf"(?i:(?<![A-Za-z0-9])(?P<name>[A-Za-z0-9_.\-]*?{_SECRET})(?![A-Za-z0-9]))"
_END_OF_NAME = rf"(?i:(?P<name>{_SECRET})(?![A-Za-z0-9]))"
_STRONG = re.compile(r"(?i)pass|pwd|secret|token|api[_-]?key|auth|cred|access[_-]?key|_pat|signing|private")
_QUOTED = re.compile(
    _END_OF_NAME + r"[\"'\]]{0,2}\s*(?::=|=>|==?|:|,)\s*(?:(?:[\w.]+|\[\]byte)\()?[bfru]?(?P<q>[\"'`])(?P<value>[^\"'`\s]+)(?P=q)"
    r"(?P<more>(?:\s*(?:\+|\.)?\s*(?P=q)[^\"'`\s]+(?P=q))*)"
)
_BARE = re.compile(r"^[+\- ]?\s*(?:-\s+)?(?:(?:export|set|setenv|ENV|ARG)\s+)?[\"']?" + _NAME + r"[\"']?\s*[=:]\s*(?P<value>[^\s\"'`,;#()\[\]{}<>$]+)\s*(?:[,;]|\s#.*)?$")
_INLINE = re.compile(r"(?:^|[\s;&|'\"(])[\"']?(?P<name>//[^\s=]*:_?[A-Za-z]*(?i:token|password|auth)|[A-Z][A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|PWD|PAT|KEY|PASS))=(?P<value>[^\s\"'`;&|$<>{}()]+)")
_FLAG = re.compile(r"(?<!\S)--?(?:pass(?:word|wd|phrase)?|token|secret|api-?key|auth-?token|access-?key)(?:=|\s+)[\"']?(?P<value>[^\s\"'`$<>]+)")
_USERFLAG = re.compile(r"(?<!\S)(?:-u|--user)\s+[\"']?[^\s:\"']+:(?P<value>[^\s\"'`$<>]+)")
_SHORTFLAG = re.compile(r"(?<!\S)-p\s*(?P<q>[\"']?)(?P<value>[^\s\"'`$<>]+)(?P=q)(?!\S)")
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+[\"']?(?P<value>[^\s\"'`$<>]+)")
_DRIVER_DSN = re.compile(r"[\"'`][\w.-]+:(?P<value>[^\s@\"'`]+)@\w+\(")
_SIGNING = re.compile(r"(?i)(?:jwt\.\w+|hmac\w*(?:\.new)?|createHmac|fernet|encrypt|\bsign)\((?:[^()\"'`]*,)?\s*b?(?P<q>[\"'`])(?P<value>[^\"'`\s]+)(?P=q)")
_SPLIT = re.compile(r"(?P<q>[\"'`])[^\"'`\s]+(?P=q)(?:\s*\+\s*(?P=q)[^\"'`\s]+(?P=q))+")
_CHORE = re.compile(r"(?i)\b(?:remove|rotate|revoke|todo|fixme)\b[\s:,-]*(?P<value>[A-Za-z0-9+/=._~-]{16,})")
_PROSE = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|secret|token|key)\s+(?:(?:was|is|=|:)\s+)?[\"'`]?(?P<value>[A-Za-z0-9+/=._!@%^*~-]{8,})")
_OPEN = re.compile(_END_OF_NAME + r"[\"'\]]{0,2}\s*(?::=|=>|==?|:|,)\s*(?:(?:[\w.]+|\[\]byte)?\(|\\)?\s*$")
_FIRST = re.compile(r"^[+\- ]?\s*[bfru]?(?P<q>[\"'`])(?P<value>[^\"'`\s]+)(?P=q)")
_BLOCK = re.compile(r"^[+\- ]?\s*(?:-\s+)?[\"']?" + _NAME + r"[\"']?\s*:\s*[>|][+-]?\d?\s*$")

# Parts of stand-ins, lower case.
_STAND_INS = re.compile(
    r"(?i:your[_-]|example|change[_-]?me|placeholder|dummy|redacted|insert[_-]|replace[_-])|x{4,}|X{4,}|\*\*\*|\.\.\.|<|>|(?i:^todo|^sample[_-]|^fake[_-](?!live_)|not[_-]?(?:set|a[_-]?real)|^(?:none|null|nil|undefined|empty|true|false|test|secret|password|token|string|n/?a)$)"
)
_REFERENCE = re.compile(r"\$|\{\{|\{[\w.]+[:}]|%[\w(]+%?s?|^(?:env|file|vault|ssm|secretsmanager|op|arn|ref|keyring|aws|gcp|projects)[:/.]|^![a-z]+$|^@|process\.env|os\.environ|getenv|^/[a-z_.-]+(?:/|$)|^\.{1,2}/|^~/|://")
_HEX_ID = re.compile(r"^(?:sha\d+[-:]|ssh-|data:)")
_NO_SECRET_NAME = re.compile(r"(?i)(?:public|cache|sort|primary|foreign|partition|unique|row|map|dict|object|hot|short|page|next|index|trace|csrf|sub|lookup|group|order|join)[_.-]*(?:key|token)$|(?:^|[_.-])(?:next|page|cursor).*token$")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


def _real(value: str, strong: bool, least: int = 6) -> bool:
    """Whether a literal can be a credential. strong: the place names a secret, so that a plain
    password will do; else the literal must look drawn at random."""
    if len(value) < least or _STAND_INS.search(value) or _REFERENCE.search(value) or _HEX_ID.search(value):
        return False
    if len(set(value)) < 4:
        return False
    digit = any(c.isdigit() for c in value)
    letter = any(c.isalpha() for c in value)
    if strong:
        mixed = value != value.lower() and value != value.upper()
        if not letter:
            return digit and len(value) >= 16 and not value.isdigit()
        return digit or (mixed and len(value) >= 12) or any(c in "!@#%^&*?+=" for c in value)
    if _UUID.fullmatch(value):
        return True
    return digit and letter and len(value) >= 16 and len(set(value)) >= 8 and "/" not in value[:1] and not re.search(r"\.[a-z]{1,5}$", value)


def _token_header(value: str) -> bool:
    head = value.split(".", 1)[0]
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
    except (ValueError, binascii.Error):
        return False


def _basic_pair(value: str) -> bool:
    try:
        user, sep, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=False).decode().partition(":")
    except (ValueError, binascii.Error):
        return False
    return bool(sep) and _real(word, True, 4)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _checksum(value: str) -> bool:
    """Whether a token ends with the CRC-32 of its body in six base-62 digits, as some issuers publish."""
    if not re.fullmatch(r"(?:gh[opsu]|npm)_[A-Za-z0-9]{36}", value):
        return False
    n, out = zlib.crc32(value[4:-6].encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return value.endswith(out)


def _issuer(value: str) -> bool:
    """A checksum that fits settles it; one that does not may be of an older format."""
    if value.startswith("eyJ"):
        return _token_header(value)
    return _checksum(value) or not _STAND_INS.search(value) and len(set(value[4:])) >= 6


def _full_name(text: str, start: int, end: int) -> str:
    """The name that ends at ``end``, from its first letter, digit, underscore, dot or dash."""
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.-") and text[start - 1].isascii():
        start -= 1
    return text[start:end]


def line_spans(line: str) -> list[tuple[int, int]]:
    """Spans of the literal credentials on one line."""
    spans: list[tuple[int, int]] = []
    add = spans.append
    for m in ISSUERS.finditer(line):
        if _issuer(m[0]):
            add(m.span())
    if "://" in line:
        for m in _USERINFO.finditer(line):
            if _real(m[1], True, 4):
                add(m.span(1))
    if "=" in line:
        for m in _PARAM.finditer(line):
            if _real(m[1], True, 8):
                add(m.span(1))
        for m in _INLINE.finditer(line):
            if _real(m["value"], True) and not _NO_SECRET_NAME.search(m["name"]):
                add(m.span("value"))
    low = line.lower()
    if "bearer" in low or "token " in low:
        for m in _BEARER.finditer(line):
            if _real(m[1], False, 12) or _UUID.fullmatch(m[1]):
                add(m.span(1))
    if "basic" in low:
        for m in _BASIC.finditer(line):
            if _basic_pair(m[1]):
                add(m.span(1))
    for m in _QUOTED.finditer(line):
        name, value = _full_name(line, *m.span("name")), m["value"]
        if _NO_SECRET_NAME.search(name) or name.lower().startswith("public"):
            continue
        extra = re.findall(r"[\"'`]([^\"'`\s]+)[\"'`]", m["more"])
        if _real(value + "".join(extra), bool(_STRONG.search(name))):
            add(m.span("value"))
            at = m.start("more")
            for x in extra:
                at = line.index(x, at)
                add((at, at + len(x)))
                at += len(x)
    m = _BARE.match(line)
    if m and not _NO_SECRET_NAME.search(m["name"]):
        value = m["value"]
        strong = bool(_STRONG.search(m["name"]))
        if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+", value) or value.replace(".", "").replace("_", "").isdigit():
            pass
        elif _real(value, strong, 8):
            add(m.span("value"))
    if "+" in line:
        for m in _SPLIT.finditer(line):
            pieces = [(p.start(), p.end()) for p in re.finditer(r"(?<=[\"'`])[^\"'`\s]+(?=[\"'`])", m[0])]
            whole = "".join(m[0][a:b] for a, b in pieces)
            issued = ISSUERS.fullmatch(whole)
            if issued and _issuer(whole) or not issued and len(whole) >= 24 and _real(whole, False):
                spans.extend((m.start() + a, m.start() + b) for a, b in pieces)
    if "login" in low or "mysql" in low or "sshpass" in low:
        for pattern in (_SHORTFLAG, _NETRC):
            for m in pattern.finditer(line):
                if _real(m["value"], True):
                    add(m.span("value"))
    for m in _CHORE.finditer(line):
        if _real(m["value"], False):
            add(m.span("value"))
    for pattern in (_FLAG, _USERFLAG, _DRIVER_DSN, _SIGNING):
        for m in pattern.finditer(line):
            if _real(m["value"], True):
                add(m.span("value"))
    for m in _PROSE.finditer(line):
        value = m["value"].rstrip(".")
        if _real(value, False, 12):
            add((m.start("value"), m.start("value") + len(value)))
    return spans


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, word)
    found.make_automaton()
    return found


def text_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(line from 1, start, end) of every credential that begins in a decoded text."""
    low = text.lower()
    hits = [at for at, _ in automaton.iter(low)] if len(low) == len(text) else [0]
    if not hits:
        return []
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    row_of = lambda at: bisect_left(starts, at + 1) - 1
    begins = list(_BEGIN.finditer(text)) if "PRIVATE KEY" in text else []
    ends = [m.start() for m in _END.finditer(text)] if begins else []
    found: list[tuple[int, int, int]] = []
    inside: set[int] = set()
    for m, after in zip(begins, [*begins[1:], None]):
        last = bisect_left(ends, m.end())
        stop = min(ends[last] if last < len(ends) else len(text), after.start() if after else len(text))
        if _BODY.search(text, m.end(), stop):
            found.append((row_of(m.start()) + 1, m.end(), stop))
            inside.update(range(row_of(m.start()), row_of(max(stop - 1, m.start())) + 1))
    wanted: set[int] = set()
    if len(low) == len(text):
        wanted.update(row_of(hit) for hit in hits)
    else:
        wanted = set(range(len(lines)))
    for row in sorted(wanted - inside):
        line = lines[row]
        spans = line_spans(line)
        below = row + 1
        opened = _OPEN.search(line)
        block = _BLOCK.match(line)
        if opened or block:
            while below < len(lines) and not lines[below].lstrip("+ \t-").strip():
                below += 1
        if below < len(lines) and below not in inside:
            if opened and not _NO_SECRET_NAME.search(name := _full_name(line, *opened.span("name"))):
                m = _FIRST.match(lines[below])
                if m and _real(m["value"], bool(_STRONG.search(name))):
                    found.append((below + 1, starts[below] + m.start("value"), starts[below] + m.end("value")))
            if block and not _NO_SECRET_NAME.search(block["name"]):
                value = lines[below].lstrip("+ \t-").strip()
                if _real(value, True, 8) and " " not in value:
                    a = starts[below] + lines[below].index(value)
                    found.append((below + 1, a, a + len(value)))
        found.extend((row + 1, starts[row] + a, starts[row] + b) for a, b in spans)
    return found


_HEX = re.compile(r"(?=.*\d)(?:[0-9a-f-]{8,}|[0-9A-F-]{8,})")


def _masked(value: str) -> str:
    """Digits as 0 and letters as x or X (a or A where the literal is hexadecimal); the rest stays."""
    small, large = "aA" if _HEX.fullmatch(value) else "xX"
    return "".join("0" if c.isdigit() else large if c.isupper() else small if c.isalpha() else c for c in value)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans over the same alphabets in the same length; the rest stays."""
    pieces, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            pieces += [text[at : max(a, at)], _masked(text[max(a, at) : b])]
            at = b
    return "".join(pieces) + text[at:]


_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_PIECE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|.", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _decoded(piece: str) -> str:
    """The one character that a piece of a JSON literal stands for."""
    if piece[0] != "\\" or len(piece) == 1:
        return piece
    return _ESCAPES.get(piece[1], piece[1]) if piece[1] != "u" else json.loads(f'"{piece}"')


def _rewrite(raw: str, masked: str) -> str:
    """A raw JSON text (the inside of a literal) with the characters that ``masked`` changes replaced."""
    pieces = _PIECE.findall(raw)
    return "".join(p if _decoded(p) == c else c for p, c in zip(pieces, masked))


def _reject(name: str):
    raise ValueError(name)


_NAME_LITERAL = object()


class _Object(list):
    """The members of a JSON object in order, repeated names too."""


def scan_parameters(parameters: str | None, automaton: ahocorasick.Automaton) -> tuple[list[tuple[str, int]], str | None]:
    """((top-level field, line) of each credential, parameters with the credentials masked).

    All bytes but those of the credentials stay as they are. Members of anything but an object, and
    text that is no JSON (cut off, say), are scanned all the same, under the empty field name.
    """
    if not parameters:
        return [], parameters
    rows: list[tuple[str, int]] = []
    try:
        value = json.loads(parameters, parse_constant=_reject, object_pairs_hook=_Object)
    except (ValueError, RecursionError):
        text = "".join(map(_decoded, _PIECE.findall(parameters)))
        spans = text_spans(text, automaton)
        rows.extend(("", line) for line, _, _ in spans)
        return rows, _rewrite(parameters, mask(text, [(a, b) for _, a, b in spans])) if spans else parameters
    changed: dict[int, tuple[str, str]] = {}  # by number of the literal
    count = 0
    stack: list[tuple] = [(value, None, "")]
    while stack:
        x, field, name = stack.pop()
        if isinstance(x, str):
            spans = text_spans(x, automaton)
            if not spans and name and field != name and " " not in x and _STRONG.search(name) and not _NO_SECRET_NAME.search(name) and _real(x, True, 8):
                spans = [(1, 0, len(x))]
            if spans:
                rows.extend((field or "", line) for line, _, _ in spans)
                changed[count] = x, mask(x, [(a, b) for _, a, b in spans])
            count += 1
        elif isinstance(x, _Object):
            for k, y in reversed(x):
                stack.append((y, field or k, k))
                stack.append((_NAME_LITERAL, None, ""))
        elif isinstance(x, list):
            stack.extend((y, field, name) for y in reversed(x))
        elif x is _NAME_LITERAL:
            count += 1
    if not changed:
        return [], parameters
    number = iter(range(count + 1))

    def literal(m: re.Match) -> str:
        found = changed.get(next(number))
        return '"' + _rewrite(m[0][1:-1], found[1]) + '"' if found else m[0]

    return rows, _LITERAL.sub(literal, parameters)


def config_value(value: str | None, automaton: ahocorasick.Automaton, is_key: bool) -> list[tuple[int, int]]:
    """Spans of the credentials in one member of a model configuration."""
    if not value or not value.strip():
        return []
    if not is_key:
        return [(a, b) for _, a, b in text_spans(value, automaton)]
    bare = re.sub(r"(?i)^(?:bearer|basic|token)\s+", "", value.strip())
    a = value.index(bare)
    return [(a, a + len(bare))] if " " not in bare and _real(bare, True, 8) else []


def redact_calls(calls: DataFrame) -> DataFrame:
    """(call_id, parameters, hits array<struct<field_name, line_no>>) of every call row.

    Parameters without a credential, null or empty come back as they are, with one all other bytes do.
    """
    shape = "call_id string, parameters string, hits array<struct<field_name:string,line_no:bigint>>"
    kind = pa.list_(pa.struct([("field_name", pa.string()), ("line_no", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            ids = batch.column(0)
            hits, texts = [], []
            for text in batch.column(1).to_pylist():
                found, masked = scan_parameters(text, automaton)
                hits.append([{"field_name": f, "line_no": n} for f, n in dict.fromkeys(found)])
                texts.append(masked)
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(hits, kind)], names=["call_id", "parameters", "hits"])

    return calls.select("call_id", "parameters").mapInArrow(run, shape)


def found_in_calls(calls: DataFrame) -> DataFrame:
    """(call_id, field_name, line_no) of the credentials in a table of calls, distinct.

    The same scan as :func:`redact_calls` without carrying the texts along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            out = [
                (cid, f, n)
                for cid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for f, n in dict.fromkeys(scan_parameters(text, automaton)[0])
            ]
            ids, fields, lines = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(fields, pa.string()), pa.array(lines, pa.int64())], names=["call_id", "field_name", "line_no"])

    src = calls.where(F.col("call_id").isNotNull() & F.col("parameters").isNotNull()).select("call_id", "parameters")
    return src.mapInArrow(run, "call_id string, field_name string, line_no bigint").distinct()


def redact_configs(configs: DataFrame) -> DataFrame:
    """(config_id, api_key, url, hits array<string>) of every configuration row; hits name the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            keys, urls, hits = [], [], []
            for key, url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                k, u = config_value(key, automaton, True), config_value(url, automaton, False)
                keys.append(mask(key, k) if k else key)
                urls.append(mask(url, u) if u else url)
                hits.append(["api_key"] * bool(k) + ["url"] * bool(u))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.string()), pa.array(urls, pa.string()), pa.array(hits, pa.list_(pa.string()))],
                names=["config_id", "api_key", "url", "hits"],
            )

    return configs.select("config_id", "api_key", "url").mapInArrow(run, "config_id string, api_key string, url string, hits array<string>")
