"""Settings of an inspection, from TOML. Unknown fields, and values out of range, are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    mode: str = "redact"
    max_body_bytes: int = 64 << 20
    ttl_secs: int = 7 * 86_400
    max_rows: int = 100_000
    max_artifacts: int = 1 << 30
    max_artifact: int = 64 << 20
    use_entropy: bool = False
    page_redaction: bool = False

    def __post_init__(self):
        if self.mode not in ("redact", "no-go", "advisory"):
            raise ValueError(f"mode: {self.mode}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "int" and (isinstance(value, bool) or not isinstance(value, int) or value <= 0):
                raise ValueError(f"{f.name} must be a number above 0")
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} must be true or false")


def from_toml(text: str) -> Config:
    values = tomllib.loads(text)
    extra = set(values) - {f.name for f in fields(Config)}
    if extra:
        raise ValueError(f"unknown settings: {sorted(extra)}")
    return Config(**values)
