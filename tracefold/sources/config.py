"""Configuration: defaults, checks of what a file says, names from earlier versions, and environment overrides."""

from __future__ import annotations

import json
import os
from pathlib import Path

#: Defaults (fixed values).
DEFAULTS = {
    "debug": False,
    "sessionFallback": True,
    "compaction": "auto",
    "compactionEngine": "native",
    "tailBehavior": "minimal",
    "observeAfterTokens": 15_000,
    "reflectAfterTokens": 25_000,
    "compactAfterTokens": 81_000,
    "observationsPoolMaxTokens": 20_000,
    "observationsPoolTargetTokens": 10_000,
    "reflectorInputMaxTokens": 80_000,
    "dropperInputMaxTokens": 80_000,
    "dropperPressureThreshold": 0.70,
    "observerChunkMaxTokens": 40_000,
    "observerPreambleMaxTokens": 0,
    "agentMaxTurns": 16,
    "memory": True,
    "debugLog": False,
}
CHOICES = {"compaction": ("auto", "manual", "off"), "compactionEngine": ("native", "host"), "tailBehavior": ("host", "minimal")}
MODELS = ("model", "observerModel", "reflectorModel", "dropperModel")
FALLBACKS = ("observerFallbackModels", "reflectorFallbackModels", "dropperFallbackModels")
OUTPUT_CAP, CONTEXT = 32_000, 128_000


def _model(v) -> dict | None:
    return v if isinstance(v, dict) and all(isinstance(v.get(k), str) and v[k] for k in ("provider", "id")) else None


def checked(raw: dict) -> dict:
    """The settings in ``raw`` that are known and valid."""
    out = {}
    for key, value in raw.items():
        default = DEFAULTS.get(key)
        number = isinstance(value, int | float) and not isinstance(value, bool)
        if key in CHOICES:
            good = value in CHOICES[key]
        elif isinstance(default, bool):
            good = isinstance(value, bool)
        elif key == "dropperPressureThreshold":
            good = number and 0 < value <= 1
        elif default is not None:
            good = number and value == int(value) and value >= (0 if key == "observerPreambleMaxTokens" else 1)
        elif key in MODELS:
            good = _model(value) is not None
        else:
            good = key in FALLBACKS and isinstance(value, list)
            value = [m for m in value if _model(m)] if good else value
            good = good and bool(value)
        if good:
            out[key] = value
    return out


def migrated(raw: dict) -> dict:
    """Names of earlier versions turned into today's, unless one of today's is there."""
    out = dict(raw)
    if "compaction" in out or "compactionEngine" in out:
        return out
    if out.get("passive") is True:
        out |= {"compaction": "off", "memory": False}
    elif out.get("noAutoCompact") is True:
        out["compaction"] = "manual"
    override = out.get("overrideDefaultCompaction")
    if override is True:
        out = {"tailBehavior": "minimal"} | out | {"compactionEngine": "native"}
    elif override is False:
        out["compactionEngine"] = "host"
    return {k: v for k, v in out.items() if k not in ("passive", "noAutoCompact", "overrideDefaultCompaction")}


def load(path: str | os.PathLike, env: dict | None = None) -> dict:
    """Defaults, then the file (none or a broken one says nothing), then TRACEFOLD_<key> in the environment."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        raw = {}
    found = checked(migrated(raw)) if isinstance(raw, dict) else {}
    over = {}
    for key in DEFAULTS:
        if (value := (os.environ if env is None else env).get(f"TRACEFOLD_{key}")) is not None:
            try:
                over[key] = json.loads(value)
            except ValueError:
                over[key] = value
    return DEFAULTS | found | checked(over)


def save(path: str | os.PathLike, changes: dict) -> None:
    """Writes changes and keeps all else that the file says, unknown keys included."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        raw = {}
    Path(path).write_text(json.dumps((raw if isinstance(raw, dict) else {}) | changes, indent=2) + "\n")


def scaffold(path: str | os.PathLike) -> bool:
    """Writes the defaults where there is no file."""
    if Path(path).exists():
        return False
    save(path, DEFAULTS)
    return True


def context_window(override: int | None = None, registered: int | None = None) -> int:
    return override or registered or CONTEXT


def output_tokens(asked: int | None = None) -> int:
    return min(asked, OUTPUT_CAP) if asked else OUTPUT_CAP


def may_compact(config: dict, trigger: str) -> str:
    """``handled``, ``passed`` (to the host) or ``skipped`` for a trigger: threshold, host event or explicit command."""
    if trigger == "command":
        return "handled"
    own = config["compaction"] == "auto" and config["compactionEngine"] == "native"
    return "handled" if own else "skipped" if trigger == "threshold" else "passed"


def candidates(config: dict, stage: str, session: dict | None, cooling: set[str] = frozenset()) -> list[dict]:
    """Models to try for a stage: its own, its fallbacks, the base model, the session's; none twice, none that cools down."""
    listed = [config.get(f"{stage}Model"), *config.get(f"{stage}FallbackModels", []), config.get("model"), session if config["sessionFallback"] else None]
    by_key = {f"{m['provider']}/{m['id']}": m for m in reversed([m for m in listed if m])}
    return [by_key[k] for k in dict.fromkeys(f"{m['provider']}/{m['id']}" for m in listed if m) if k not in cooling]
