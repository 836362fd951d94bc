"""Limits of the query operators."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    max_depth: int = 5
    fts_max: int = 20
    type_depth: int = 20
    debounce: str = "500 milliseconds"

    @classmethod
    def load(cls, path: str | None = None, env: Mapping[str, str] = os.environ, prefix: str = "TRELLIS_") -> Config:
        """Defaults, then a JSON file, then environment variables such as TRELLIS_MAX_DEPTH."""
        out = cls()
        if path and os.path.exists(path):
            with open(path) as f:
                given = json.load(f)
            out = replace(out, **{f.name: given[f.name] for f in fields(cls) if f.name in given})
        for f in fields(cls):
            value = env.get(prefix + f.name.upper())
            if value is not None:
                out = replace(out, **{f.name: type(getattr(out, f.name))(value)})
        return out
