"""Settings of a store: defaults, limits, and the text form (TOML)."""

from __future__ import annotations

import dataclasses
import secrets
import tomllib
from dataclasses import dataclass, field
from datetime import datetime, timezone


@dataclass(frozen=True)
class Config:
    """Sizes in bytes; ``max_size`` 0 is no limit."""

    repo_id: str = field(default_factory=lambda: secrets.token_hex(16))
    encryption_enabled: bool = False
    compression_level: int = 3
    chunk_min_size: int = 64 << 10
    chunk_target_size: int = 512 << 10
    chunk_max_size: int = 8 << 20
    ecc_data_shards: int = 64
    ecc_parity_shards: int = 8
    pack_target_size: int = 20 << 20
    max_size: int = 0
    min_snapshots: int = 3
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self):
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        limits = {
            "the compression level must be 1 to 22": 1 <= self.compression_level <= 22,
            "the least chunk size must be positive": self.chunk_min_size > 0,
            "the greatest chunk size must exceed the least": self.chunk_max_size > self.chunk_min_size,
            "the target chunk size must lie between least and greatest": self.chunk_min_size <= self.chunk_target_size <= self.chunk_max_size,
            "there must be data shards": self.ecc_data_shards > 0,
            "there must be parity shards": self.ecc_parity_shards > 0,
            "a group has 256 shards at most": self.ecc_data_shards + self.ecc_parity_shards <= 256,
        }
        return [problem for problem, holds in limits.items() if not holds]

    def changed(self, **values) -> "Config":
        """A copy with some settings changed; limits hold for it too."""
        return dataclasses.replace(self, **values)

    def dumps(self) -> str:
        def text(v) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            return f'"{v}"' if isinstance(v, str) else v.isoformat() if isinstance(v, datetime) else str(v)

        return "".join(f"{f.name} = {text(getattr(self, f.name))}\n" for f in dataclasses.fields(self))


def loads(text: str) -> Config:
    """Settings from TOML; what is absent has its default, and unknown names are passed over."""
    known = {f.name for f in dataclasses.fields(Config)}
    values = {k: v for k, v in tomllib.loads(text).items() if k in known}
    if isinstance(values.get("created_at"), str):
        values["created_at"] = datetime.fromisoformat(values["created_at"])
    return Config(**values)
