"""Layered configuration and tool permissions; plain Python on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

from threadloom.functions.text import wildcard_regex

DEFAULTS: dict[str, Any] = {
    "enabled": True,
    "protected_tools": ["task", "todowrite"],
    "protected_patterns": [],
    "deduplication": {"enabled": True, "protected_tools": []},
    "purge_errors": {"enabled": True, "turns": 4, "protected_tools": []},
    "turn_protection": {"enabled": False, "turns": 4},
    "compress": {"mode": "range", "permission": "allow", "min_limit": "50%", "max_limit": "85%", "nudge_frequency": 1, "model_limits": {}, "external_model": {}},
}
#: Members whose keys are data, not settings.
FREE = {"compress.model_limits", "compress.external_model"}


def read_jsonc(text: str) -> Any:
    """JSON with comments and trailing commas."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", out))


def merge(base: Mapping[str, Any], layer: Mapping[str, Any]) -> dict[str, Any]:
    """A layer over a base: scalars replace, lists unite keeping order, mappings merge."""
    out = dict(base)
    for key, value in layer.items():
        old = out.get(key)
        if isinstance(old, Mapping) and isinstance(value, Mapping):
            out[key] = merge(old, value)
        elif isinstance(old, list) and isinstance(value, list):
            out[key] = list(dict.fromkeys([*old, *value]))
        elif value is not None:
            out[key] = value
    return out


def effective(*layers: Mapping[str, Any], env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Defaults under the layers in order, then the external model named by the environment."""
    out: dict[str, Any] = json.loads(json.dumps(DEFAULTS))
    for layer in layers:
        out = merge(out, layer)
    env = os.environ if env is None else env
    url, model = env.get("THREADLOOM_MODEL_URL", "").strip(), env.get("THREADLOOM_MODEL_NAME", "").strip()
    if url and model:
        chosen: dict[str, Any] = {"url": url, "model": model}
        for name, key, least in (("THREADLOOM_MODEL_TIMEOUT", "timeout", 1), ("THREADLOOM_MODEL_RETRIES", "retries", 0)):
            raw = env.get(name, "")
            if re.fullmatch(r"\d{1,9}", raw) and int(raw) >= least:
                chosen[key] = int(raw)
        out["compress"]["external_model"] = merge(out["compress"]["external_model"], chosen)
    return out


def key_paths(config: Mapping[str, Any], prefix: str = "") -> list[str]:
    """Dotted paths of all settings; free mappings are one path."""
    out = []
    for key, value in config.items():
        path = f"{prefix}{key}"
        out.append(path)
        if isinstance(value, Mapping) and path not in FREE:
            out.extend(key_paths(value, path + "."))
    return out


def unknown_keys(config: Mapping[str, Any]) -> list[str]:
    known = set(key_paths(DEFAULTS))
    return [p for p in key_paths(config) if p not in known]


def type_errors(config: Mapping[str, Any], base: Mapping[str, Any] = DEFAULTS, prefix: str = "") -> list[tuple[str, str, str]]:
    """(path, expected, actual) of settings whose type differs from the default's."""
    out = []
    for key, value in config.items():
        if key not in base:
            continue
        want = base[key]
        if isinstance(want, Mapping) and isinstance(value, Mapping):
            out.extend(type_errors(value, want, f"{prefix}{key}."))
        elif type(value) is not type(want):
            out.append((f"{prefix}{key}", type(want).__name__, type(value).__name__))
    return out


def token_limit(limit: int | str | None, window: int | None) -> int | None:
    """A number as it is; a percentage of the window, rounded and held within 0 and 100."""
    if isinstance(limit, int):
        return limit
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*%\s*", limit or "")
    if not m or not window:
        return None
    return round(window * min(100, max(0, round(float(m[1])))) / 100)


def permission_rules(*configs: Mapping[str, Any]) -> list[tuple[str, str, str]]:
    """(permission, pattern, action) in order; a plain action stands for the pattern *."""
    out = []
    for config in configs:
        for name, value in config.items():
            for pattern, action in value.items() if isinstance(value, Mapping) else [("*", value)]:
                out.append((name, pattern, action))
    return out


def permitted(base: str, tool: str, *configs: Mapping[str, Any]) -> str:
    """A base of deny stays; else the last matching rule, of which only a deny on * disables."""
    if base == "deny":
        return base
    hits = [(p, a) for name, p, a in permission_rules(*configs) if re.match(wildcard_regex(name), tool)]
    if hits and hits[-1] == ("*", "deny"):
        return "deny"
    return hits[-1][1] if hits and hits[-1][0] == "*" and hits[-1][1] in ("allow", "ask") else base
