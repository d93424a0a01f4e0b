"""Parameters of a scan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

# What a path may contain to be left out, unless told otherwise.
DEFAULT_IGNORE = ("node_modules", "target", ".git", "dist", "build", ".logs")


@dataclass(frozen=True)
class ScanConfig:
    """directory: root of the scan; min_tokens: shortest clone; languages: names to keep, none for all; ignore_patterns: parts of paths to leave out.

    detect_type2: identifiers and literals count as equal; otherwise their text counts. scan_self: also match a file with itself.
    """

    directory: str = "."
    min_tokens: int = 50
    languages: tuple[str, ...] = ()
    ignore_patterns: tuple[str, ...] = DEFAULT_IGNORE
    detect_type2: bool = True
    scan_self: bool = True
    enable_git_blame: bool = False

    @property
    def k(self) -> int:
        """Tokens of a k-gram."""
        return max(10, self.min_tokens // 2)

    @property
    def w(self) -> int:
        """k-grams of a winnowing window."""
        return self.k + 5

    @classmethod
    def from_json(cls, text: str, strict: bool = False) -> ScanConfig:
        """Parse a JSON object; strict asks for all seven fields, as the HTTP interface does."""
        data = json.loads(text)
        names = cls.__dataclass_fields__
        missing = [n for n in names if n not in data]
        if strict and missing:
            raise ValueError(f"missing fields: {', '.join(missing)}")
        return cls(**{n: tuple(data[n]) if isinstance(data[n], list) else data[n] for n in names if n in data})

    def to_json(self) -> str:
        return json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()})
