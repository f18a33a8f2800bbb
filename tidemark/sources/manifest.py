"""Generations of a table: which files it has, published atomically.

A generation is a JSON file of its own number. Publishing writes it under a
temporary name and renames it, which fails if another writer was first; readers
take the highest number. So a reader sees one generation or the next, never a
mixture, and can pin the one that it has.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from .files import Files

# Versions of the format.
VERSION, LEGACY = 2, 1
NAME = re.compile(r"[A-Za-z0-9_-]+\.parquet")


class ManifestError(ValueError):
    """A manifest that must not be used."""


@dataclass(frozen=True)
class Segment:
    """A sorted file set with its bounds."""

    name: str
    min_key: str
    max_key: str
    records: int
    max_seq: int


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    version: int = VERSION
    segments: tuple[Segment, ...] = field(default=())  # oldest first
    next_id: int = 1
    applied_index: int = 0
    last_seq: int = 0

    def validate(self) -> Manifest:
        if self.version not in (VERSION, LEGACY):
            raise ManifestError(f"version {self.version}")
        names = [s.name for s in self.segments]
        if any(not NAME.fullmatch(n) for n in names):
            raise ManifestError("a segment's name leads elsewhere or isn't a segment's")
        if len(set(names)) != len(names):
            raise ManifestError("a segment is listed twice")
        if min(self.next_id, self.applied_index, self.last_seq) < 0:
            raise ManifestError("a negative number")
        return self

    def overlapping(self, low: str, high: str) -> list[Segment]:
        """Segments that can hold keys from low to high; strings compare as their UTF-8 bytes do."""
        a, z = low.encode(), high.encode()
        return [s for s in self.segments if s.min_key.encode() <= z and s.max_key.encode() >= a]

    def next(self, **changes) -> Manifest:
        return replace(self, generation=self.generation + 1, version=VERSION, **changes).validate()


def _name(generation: int) -> str:
    return f"manifest-{generation:012d}.json"


def load(files: Files) -> Manifest:
    """The newest generation; an empty one where there is none."""
    found = [n for n in files.names() if re.fullmatch(r"manifest-\d{12}\.json", n)]
    if not found:
        return Manifest()
    raw = json.loads(files.read(found[-1]))
    if not isinstance(raw, dict) or "version" not in raw:
        raise ManifestError("not a manifest")
    if raw["version"] == LEGACY:
        raw.setdefault("last_seq", max((s["max_seq"] for s in raw["segments"]), default=0))
    raw["segments"] = tuple(Segment(**s) for s in raw["segments"])
    return Manifest(**raw).validate()


def publish(files: Files, manifest: Manifest) -> None:
    """The commit point of every change."""
    files.write_new(_name(manifest.generation), json.dumps(asdict(manifest.validate())).encode())
