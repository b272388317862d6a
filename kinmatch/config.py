"""Settings: thresholds and columns, which the environment may override; no credentials have defaults."""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Cosine thresholds are inclusive. ``passes`` is how often descriptions are normalised, on both sides alike."""

    item_cluster: float = 0.985
    item_probe: float = 0.75
    vendor_cluster: float = 0.9
    vendor_probe: float = 0.97
    main_code_probe: float = 0.97
    sub_code_probe: float = 0.97
    uom_probe: float = 0.97
    passes: int = 1
    refresh_hours: int = 4
    refresh_gap_s: int = 1800

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "KINMATCH_") -> Settings:
        env = os.environ if env is None else env
        kinds = {"float": float, "int": int}
        return cls(**{f.name: kinds[f.type](env[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in env})


def setup_logging(level: int = logging.INFO) -> None:
    """Messages to standard output, unless the program has set up logging itself."""
    if not logging.getLogger().handlers:
        logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", stream=sys.stdout)


def read_env_file(text: str, env: Mapping[str, str]) -> dict[str, str]:
    """The variables of a ``.env`` text that ``env`` doesn't have; a value that is quoted as a whole loses its quotes."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().partition("=")
        name, value = name.removeprefix("export ").strip(), value.strip()
        if not eq or not name or name.startswith("#") or name in env:
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[name] = value
    return out
