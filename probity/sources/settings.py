"""Settings of the driver: defaults, then a file's values, then the session's."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

#: ${NAME} or ${NAME:-default}, as a whole value.
REFERENCE = re.compile(r"\$\{([^}:]+)(?::-([^}]*))?\}")
FOLDERS = ("pdf_dir", "figures_dir", "reports_dir")


def substituted(values: Mapping, environment: Mapping[str, str] | None = None) -> dict:
    """Values that are references replaced by the environment's, or by their default (none: null)."""
    env = os.environ if environment is None else environment

    def one(x):
        if isinstance(x, Mapping):
            return substituted(x, env)
        m = REFERENCE.fullmatch(x) if isinstance(x, str) else None
        return env.get(m[1], m[2]) if m else x

    return {k: one(v) for k, v in values.items()}


def merged(*layers: Mapping) -> dict:
    """Later layers win, section by section."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def settings(defaults: Mapping, file_values: Mapping, folder: str, overrides: Mapping[str, str] | None = None, prefix: str = "spark.probity.") -> dict:
    """Defaults under the file's values (references resolved, relative storage folders taken from the
    file's ``folder``) under the session's, such as ``spark.probity.llm.provider``."""
    values = substituted(file_values)
    storage = values.get("storage")
    if isinstance(storage, dict):
        values["storage"] = storage | {k: str(Path(folder, storage[k])) for k in FOLDERS if isinstance(storage.get(k), str)}
    session: dict = {}
    for name, value in (overrides or {}).items():
        if name.startswith(prefix):
            *sections, last = name.removeprefix(prefix).split(".")
            at = session
            for s in sections:
                at = at.setdefault(s, {})
            at[last] = value
    return merged(defaults, values, session)
