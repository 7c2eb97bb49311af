"""Configuration: validation, profiles overlaid by own settings, the settings of each rule."""

from __future__ import annotations

import json
import math
import os
import re

from .catalogue import ALLOW_TERM_RULES, NAMESPACE, PROFILE_CONFIGS, PROFILES, RULES, default_options, default_severity

SEVERITIES = ("info", "warning", "error")
RANK = {s: i + 1 for i, s in enumerate(SEVERITIES)}
TOP = {"$schema", "rules", "ignoreFiles", "ignorePatterns", "allowTerms", "collapseOccurrences", "occurrenceMergeDistance"}
MERGE_DISTANCE, MAX_PATTERN = 60, 120
DEFAULT_FILES = (f".{NAMESPACE}.json", f"{NAMESPACE}.config.json")


class ConfigError(ValueError):
    """A setting that can't be used."""


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _only(value: dict, keys: set[str], where: str) -> None:
    for k in value:
        _need(k in keys, f"{where}: unknown key {k}")


def short(rule: str) -> str:
    return rule.removeprefix(f"{NAMESPACE}/")


def validate_rule(rule: str, v, source: str) -> None:
    where = f"{source}.rules.{rule}"
    if v is False or v == "off":
        return
    if isinstance(v, str):
        _need(v in SEVERITIES, f"{where}: severity {v}")
    elif isinstance(v, list):
        _need(1 <= len(v) <= 2, f"{where}: one or two items")
        _need(v[0] in SEVERITIES, f"{where}[0]: severity {v[0]}")
        _need(len(v) == 1 or isinstance(v[1], dict), f"{where}[1]: options must be an object")
    elif isinstance(v, dict):
        _only(v, {"severity", "options"}, where)
        _need(bool(v), f"{where}: severity or options needed")
        _need("severity" not in v or v["severity"] in SEVERITIES, f"{where}.severity: {v.get('severity')}")
        _need("options" not in v or isinstance(v["options"], dict), f"{where}.options must be an object")
    else:
        raise ConfigError(f"{where}: neither off, severity, list nor object")


def validate_ignore_patterns(items, source: str = "config") -> list[dict]:
    if items is None:
        return []
    _need(isinstance(items, list), f"{source}.ignorePatterns must be a list")
    from ..functions.jsregex import python

    for i, x in enumerate(items):
        where = f"{source}.ignorePatterns[{i}]"
        _need(isinstance(x, dict), f"{where} must be an object")
        _only(x, {"pattern", "scope", "reason"}, where)
        p = x.get("pattern")
        _need(isinstance(p, str) and 0 < len(p) <= MAX_PATTERN and p.strip() != "", f"{where}.pattern: 1 to {MAX_PATTERN} characters")
        _need(x.get("scope") == "line", f"{where}.scope must be line")
        _need(isinstance(x.get("reason"), str) and len(x["reason"].strip()) >= 6, f"{where}.reason: 6 characters at least")
        try:
            compiled = python(p)
        except Exception as e:
            raise ConfigError(f"{where}.pattern: {e}") from e
        _need(not compiled.search(""), f"{where}.pattern matches the empty text")
    return items


def validate_allow_terms(items) -> list[dict]:
    if items is None:
        return []
    _need(isinstance(items, list), "allowTerms must be a list")
    known = {f"{NAMESPACE}/{r}" for r in ALLOW_TERM_RULES}
    for i, x in enumerate(items):
        where = f"allowTerms[{i}]"
        _need(isinstance(x, dict), f"{where} must be an object")
        _only(x, {"term", "rules", "reason"}, where)
        t = x.get("term")
        _need(isinstance(t, str) and len(t.strip()) >= 2 and t == t.strip(), f"{where}.term: 2 characters at least, none blank at its ends")
        _need(isinstance(x.get("rules"), list) and bool(x["rules"]), f"{where}.rules: one at least")
        _need(isinstance(x.get("reason"), str) and len(x["reason"].strip()) >= 6, f"{where}.reason: 6 characters at least")
        for r in x["rules"]:
            _need(r in known, f"{where}.rules: {r}")
    return items


def validate(config: dict | None, source: str = "config") -> dict:
    if config is None:
        return {}
    _need(isinstance(config, dict), f"{source} must be an object")
    _only(config, TOP, source)
    if "rules" in config:
        _need(isinstance(config["rules"], dict), f"{source}.rules must be an object")
        for r, v in config["rules"].items():
            _need(short(r) in RULES, f"{source}.rules: unknown rule {r}")
            validate_rule(r, v, source)
    if "ignoreFiles" in config:
        _need(isinstance(config["ignoreFiles"], list) and all(isinstance(x, str) and x for x in config["ignoreFiles"]), f"{source}.ignoreFiles must be a list of texts")
    validate_ignore_patterns(config.get("ignorePatterns"), source)
    validate_allow_terms(config.get("allowTerms"))
    _need(isinstance(config.get("collapseOccurrences", False), bool), f"{source}.collapseOccurrences must be true or false")
    d = config.get("occurrenceMergeDistance", 0)
    _need(not isinstance(d, bool) and isinstance(d, (int, float)) and math.isfinite(d) and d >= 0 and d == int(d), f"{source}.occurrenceMergeDistance: an integer, 0 or more")
    return config


def _parts(v) -> tuple[str | None, dict]:
    if isinstance(v, str):
        return v, {}
    if isinstance(v, list):
        return v[0], v[1] if len(v) > 1 else {}
    return (v.get("severity"), v.get("options", {})) if isinstance(v, dict) else (None, {})


def merge(base: dict, own: dict) -> dict:
    """base overlaid by own: rule by rule, options key by key; a rule that either side turns off is own's; other settings are replaced."""
    out = base | {k: v for k, v in own.items() if k != "rules"}
    if "rules" in base or "rules" in own:
        full = lambda d: {f"{NAMESPACE}/{short(k)}": v for k, v in sorted(d.get("rules", {}).items(), key=lambda x: x[0].startswith(NAMESPACE + "/"))}
        rules = full(base)
        for r, v in full(own).items():
            old = rules.get(r)
            if old is None or old in (False, "off") or v in (False, "off"):
                rules[r] = v
                continue
            (s0, o0), (s1, o1) = _parts(old), _parts(v)
            rules[r] = {k: x for k, x in (("severity", s1 or s0), ("options", o0 | o1)) if x}
        out["rules"] = rules
    return out


def profile(name: str) -> dict:
    _need(name in PROFILES, f"unknown profile {name}; one of {', '.join(PROFILES)}")
    return PROFILE_CONFIGS[name]


def load(path: str | None = None, profile_name: str | None = None, directory: str = ".") -> dict:
    """The settings of a file (or the first default file there is) over a profile's."""
    own = {}
    found = path or next((p for p in (os.path.join(directory, f) for f in DEFAULT_FILES) if os.path.exists(p)), None)
    if found:
        with open(found, encoding="utf-8") as f:
            own = validate(json.load(f), found)
    return merge(profile(profile_name), own) if profile_name else own


def rule_settings(config: dict | None) -> dict[str, tuple[str, dict]]:
    """rule: (severity, options), for those that are on, in the order in which they run."""
    rules, out = (config or {}).get("rules", {}), {}
    for r in RULES:
        v = rules.get(f"{NAMESPACE}/{r}", rules.get(r))
        if v is False or v == "off":
            continue
        severity, options = _parts(v)
        out[r] = (severity or default_severity(r), default_options(r) | options)
    return out


def glob_pattern(pattern: str) -> str:
    """A path glob as a Java pattern: **/ any folders, ** anything, * and ? within a name; all else is literal."""
    out, i = "", 0
    while i < len(pattern):
        for token, to in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(token, i):
                out, i = out + to, i + len(token)
                break
        else:
            out, i = out + re.sub(r"[^\w/]", lambda m: "\\" + m[0], pattern[i]), i + 1
    return f"^{out}$"
