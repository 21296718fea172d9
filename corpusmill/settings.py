"""Job settings: a dataclass on the driver, never a table.

``load_settings`` reads a YAML (or JSON) file with sections ``model``,
``dataset``, ``training``, ``special_tokens``, ``preprocessing`` and
``validation``; any error falls back to the built-in defaults, and keys
that are missing keep their defaults.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields, replace

from corpusmill.functions.tokens import KEEP_TOKENS, REMOVE_TOKENS

log = logging.getLogger("corpusmill.settings")


@dataclass(frozen=True)
class Settings:
    max_length: int = 8192
    think_start: str = "<think>"
    think_end: str = "</think>"
    batch_size: int = 4
    grad_accum: int = 4
    epochs: int = 3
    seed: int = 42
    keep_tokens: tuple = field(default=KEEP_TOKENS)
    remove_tokens: tuple = field(default=REMOVE_TOKENS)
    max_think_length: int = 8192
    ensure_think_closure: bool = True
    check_think_balance: bool = True
    think_coverage: float = 0.9


# Sections and keys of the settings file -> Settings field
_KEYS = {
    "model": {"max_length": "max_length"},
    "dataset": {"think_token_start": "think_start", "think_token_end": "think_end"},
    "training": {"per_device_train_batch_size": "batch_size", "gradient_accumulation_steps": "grad_accum",
                 "num_train_epochs": "epochs", "seed": "seed"},
    "special_tokens": {"keep_tokens": "keep_tokens", "remove_tokens": "remove_tokens"},
    "preprocessing": {"max_think_length": "max_think_length", "ensure_think_closure": "ensure_think_closure"},
    "validation": {"check_think_token_balance": "check_think_balance", "think_token_coverage": "think_coverage"},
}


def load_settings(path: str | None) -> Settings:
    """Settings from ``path``; the defaults on any error."""
    base = Settings()
    if not path:
        return base
    try:
        with open(path, encoding="utf-8") as fh:
            text = fh.read()
        try:
            import yaml
            raw = yaml.safe_load(text) or {}
        except ImportError:
            raw = json.loads(text)
        types = {f.name: f.type for f in fields(Settings)}
        values = {}
        for section, keys in _KEYS.items():
            for key, name in keys.items():
                value = (raw.get(section) or {}).get(key)
                if value is None:
                    continue
                values[name] = tuple(value) if types[name] == "tuple" else value
        return replace(base, **values)
    except Exception as exc:  # noqa: BLE001 - fall back like the original loader
        log.warning("settings not loaded from %s (%s); using defaults", path, exc)
        return base
