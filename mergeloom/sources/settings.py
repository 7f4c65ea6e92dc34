"""A repository's settings: which paths are records, and how their fields merge."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column

from ..functions.paths import matches_any
from ..operators.records import STRATEGIES, Policy


class BadSettings(ValueError):
    """Settings of the wrong shape, or with an unknown strategy."""


def _kind(value: object, kind: type, what: str):
    if not isinstance(value, kind):
        raise BadSettings(f"{what} must be {'an array' if kind is list else 'an object'}")
    return value


@dataclass
class Settings:
    record_paths: list[str] = field(default_factory=list)
    policy: Policy = field(default_factory=Policy)

    @classmethod
    def parse(cls, text: str | None) -> Settings:
        """Settings from JSON; without a text, the defaults. Nothing of the wrong shape is let pass."""
        if text is None:
            return cls()
        try:
            raw = _kind(json.loads(text), dict, "the settings")
        except json.JSONDecodeError as e:
            raise BadSettings("no JSON") from e
        globs = _kind(raw.get("recordPaths", []), list, "recordPaths")
        rules = _kind(raw.get("recordPolicy", {}), dict, "recordPolicy")
        fields = _kind(rules.get("fields", {}), dict, "recordPolicy.fields")
        named = [*fields.items(), *([("fallback", rules["fallback"])] if "fallback" in rules else [])]
        if not all(isinstance(g, str) for g in globs):
            raise BadSettings("recordPaths must hold texts")
        for name, strategy in named:
            if strategy not in STRATEGIES:
                raise BadSettings(f"{name}: no strategy {strategy!r}")
        return cls(list(globs), Policy(dict(fields), rules.get("fallback")))

    def text(self) -> str:
        """JSON that parse() reads back."""
        policy = {"fields": self.policy.fields, **({"fallback": self.policy.fallback} if self.policy.fallback else {})}
        return json.dumps({"recordPaths": self.record_paths, "recordPolicy": policy}, indent=2) + "\n"

    def is_record(self, path: Column) -> Column:
        return matches_any(path, self.record_paths)
