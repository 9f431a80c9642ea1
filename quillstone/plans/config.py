"""Settings of an indexing run."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

KB_TYPES, STRATEGIES = {"text", "neo4j", "graph", "vector"}, {"react", "plan_act", "sense_act"}


@dataclass
class Config:
    """Unknown keys are an error; environment variables QUILLSTONE_<KEY> outweigh a file. ``max_exploration_depth`` (times ten files) and
    ``max_file_size`` (bytes) limit what is indexed where they are set; by default nothing is left out."""

    kb_type: str = "text"
    kb_path: str = "./kb"
    exploration_strategy: str = "react"
    max_exploration_depth: int | None = None
    max_file_size: int | None = None
    excluded_dirs: list[str] = field(default_factory=lambda: [".git", "__pycache__", "node_modules", ".venv", "venv"])
    excluded_extensions: list[str] = field(default_factory=lambda: [".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe"])
    prefix: int | None = None

    def validate(self) -> None:
        if self.kb_type not in KB_TYPES:
            raise ValueError(f"unknown kb_type: {self.kb_type}")
        if self.exploration_strategy not in STRATEGIES:
            raise ValueError(f"unknown exploration_strategy: {self.exploration_strategy}")
        if any(x is not None and x < 1 for x in (self.max_exploration_depth, self.max_file_size)):
            raise ValueError("max_exploration_depth and max_file_size must be at least 1")

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        return cls(**values)

    @classmethod
    def from_file(cls, path: str) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
        known = {f.name: f for f in fields(cls)}
        for name in known:
            got = os.environ.get(f"QUILLSTONE_{name.upper()}")
            if got is not None:
                values[name] = int(got) if got.lstrip("-").isdigit() else got
        return cls.from_dict(values)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=1), encoding="utf-8")


# Names of the variable that holds a service's key, in this order.
KEY_NAMES = ["{upper}_API_KEY", "{upper}_KEY", "{own}_API_KEY", "{own}_KEY", "OPENAI_API_KEY", "API_KEY"]


def setting(key: str, own: dict[str, str], default: str | None = None) -> str | None:
    """A variable of the environment, else of ``own`` settings."""
    return os.environ.get(key, own.get(key, default))


def service_key(service: str, own: dict[str, str]) -> str | None:
    """The first of a service's key variables that is set."""
    found = (setting(name.format(upper=service.upper(), own=service), own) for name in KEY_NAMES)
    return next((x for x in found if x), None)
