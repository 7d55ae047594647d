"""Settings: nested values with ${NAME} and ${NAME:-default} filled from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

_PLACE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def fill(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """The value with its placeholders filled; one without a value and default is an error."""
    env = os.environ if env is None else env

    def one(m: re.Match[str]) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(f"the environment lacks {m[1]}")
        return m[2]

    if isinstance(value, str):
        return _PLACE.sub(one, value)
    if isinstance(value, dict):
        return {k: fill(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [fill(v, env) for v in value]
    return value


def get(settings: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path; missing ones and None give the default."""
    at: Any = settings
    for key in path.split("."):
        at = at.get(key) if isinstance(at, Mapping) else None
        if at is None:
            return default
    return at


def load(path: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return fill(yaml.safe_load(f) or {}, env)
