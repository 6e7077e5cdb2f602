"""Configuration: defaults, deep merge of a user's file, validation."""

from __future__ import annotations

import copy
import json
import logging
import re
from pathlib import Path

from leakscan.functions import fixed

log = logging.getLogger(__name__)

DEFAULTS = {
    "version": 1,
    "detection": {"sensitivity": "balanced", "minimumConfidenceToWarn": 0.4, "debounceMs": 300, "weights": {"regex": 0.35, "entropy": 0.2, "context": 0.2, "stringGroup": 0.15, "fileContext": 0.1}},
    "git": {"blockCommitOnCritical": True, "blockCommitOnHigh": True, "blockCommitOnMedium": False},
    "ignore": {"paths": [], "patterns": [], "stopwords": [], "inlineMarks": [], "useDefaultIgnorePaths": True, "useDefaultStopwords": True},
    "customRules": [],
    "remediation": {"preferredEnvFileName": ".env"},
    # off as long as results should equal the plain scan's
    "options": {"useCustomRules": False, "useRulePaths": False, "skipFilesMarkedDisabled": False},
}


def validate(config: object) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a configuration as read from a file."""
    if not isinstance(config, dict):
        return ["the configuration is no object"], []
    errors, warnings = [], []

    def section(name):
        v = config.get(name, {})
        if not isinstance(v, dict):
            errors.append(f"{name} is no object")
            return {}
        return v

    def number(v, name, low, high):
        if v is not None and (isinstance(v, bool) or not isinstance(v, int | float) or not low <= v <= high):
            errors.append(f"{name} is no number from {low} to {high}")

    if config.get("version", 1) != 1:
        errors.append("version is not 1")
    d, g, i = section("detection"), section("git"), section("ignore")
    if d.get("sensitivity", "balanced") not in ("strict", "balanced", "relaxed", "low", "medium", "high"):
        errors.append("detection.sensitivity is unknown")
    number(d.get("minimumConfidenceToWarn"), "detection.minimumConfidenceToWarn", 0.1, 1.0)
    number(d.get("debounceMs"), "detection.debounceMs", 0, 10_000)
    weights = d.get("weights")
    if weights is not None:
        if not isinstance(weights, dict) or any(isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1 for v in weights.values()):
            errors.append("detection.weights are no numbers from 0 to 1")
        elif abs(sum({**DEFAULTS["detection"]["weights"], **weights}.values()) - 1) > 0.01:
            warnings.append("detection.weights don't sum to 1 and are scaled")
    for k, v in g.items():
        if k.startswith("blockCommit") and not isinstance(v, bool):
            errors.append(f"git.{k} is no boolean")
    for k in ("paths", "patterns", "stopwords", "inlineMarks"):
        v = i.get(k, [])
        if not isinstance(v, list) or any(not isinstance(x, str) for x in v):
            errors.append(f"ignore.{k} is no list of strings")
        elif k in ("patterns", "inlineMarks"):
            warnings += [f"ignore.{k}: {x} is no pattern and is left out" for x in v if not _compiles(x)]
    rules = config.get("customRules", [])
    if not isinstance(rules, list) or any(not isinstance(r, dict) or not r.get("id") or not _compiles(r.get("regex")) for r in rules):
        errors.append("customRules need an id and a pattern each")
    return errors, warnings


def _compiles(p: object) -> bool:
    try:
        return isinstance(p, str) and re.compile(p) is not None
    except re.error:
        return False


def merge(base: dict, over: dict) -> dict:
    """A deep merge; lists and plain values replace."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str | Path | None = None) -> dict:
    """The merged configuration; defaults where the file is absent, unreadable or not valid (with a warning)."""
    if path is None or not Path(path).exists():
        return copy.deepcopy(DEFAULTS)
    try:
        own = json.loads(Path(path).read_text(encoding="utf-8"))
        errors, warnings = validate(own)
    except (OSError, ValueError) as e:
        errors, warnings, own = [str(e)], [], {}
    for x in errors + warnings:
        log.warning("configuration: %s", x)
    return copy.deepcopy(DEFAULTS) if errors else merge(DEFAULTS, own)


def weights(config: dict) -> dict[str, float]:
    w = config["detection"]["weights"]
    return {"regex": w["regex"], "entropy": w["entropy"], "context": w["context"], "string_group": w["stringGroup"], "file_context": w["fileContext"]}


def stopwords(config: dict) -> list[str]:
    i = config["ignore"]
    return list(dict.fromkeys([*(fixed.DEVELOPER_STOPWORDS if i["useDefaultStopwords"] else []), *i["stopwords"]]))


def patterns(config: dict) -> list[str]:
    return [p for p in config["ignore"]["patterns"] if _compiles(p)]


def marks(config: dict) -> list[str]:
    return [p for p in config["ignore"]["inlineMarks"] if _compiles(p)]


def blocking(config: dict) -> dict[str, bool]:
    g = config["git"]
    return {"critical": g["blockCommitOnCritical"], "high": g["blockCommitOnHigh"], "medium": g["blockCommitOnMedium"], "low": False, "informational": False}
