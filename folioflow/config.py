"""Settings from ``KEY=value`` files and the environment; what the environment already has wins."""

from __future__ import annotations

import os
from collections.abc import Mapping, MutableMapping

SECRET = ("KEY", "SECRET", "TOKEN", "PASSWORD")


def parse(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip().strip("'\"")
    return out


def load(path: str = ".env", env: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """Add the settings of a file to the environment; a missing file adds none. Returns what was added."""
    try:
        with open(path, encoding="utf-8") as f:
            found = {k: v for k, v in parse(f.read()).items() if k not in env}
    except FileNotFoundError:
        return {}
    env.update(found)
    return found


def summary(names: list[str], env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Settings for display: secrets are masked, missing ones say so."""
    show = lambda n, v: "(not set)" if not v else f"{v[:3]}...{len(v)} characters" if any(s in n.upper() for s in SECRET) else v
    return {n: show(n, env.get(n, "")) for n in names}
