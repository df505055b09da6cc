"""Attribute files: column names, types and roles of a headerless table."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, replace

log = logging.getLogger("sylvan")

#: The format's words.
CONTINUOUS, BOOLEAN, NOMINAL = "cont", "0,1", "nom"
CLASS, WEIGHT, SPLIT, CONTEXTS, NEVER = "(class)", "(weight)", "(split)", "contexts:", "never"
FORBIDDEN = set("\\/*?\"<>|:")


class SchemaError(ValueError):
    """A wrong attribute file; ``code`` names the kind."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


class DataError(ValueError):
    """Data that do not fit the schema; ``code`` names the kind."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    role: str = "feature"  # or class, weight
    active: bool = True
    split: bool = False


@dataclass(frozen=True)
class FeatureSchema:
    """The columns in order."""

    columns: tuple[Attribute, ...]

    @property
    def target(self) -> str:
        return next(a.name for a in self.columns if a.role == "class")

    @property
    def weight(self) -> str | None:
        return next((a.name for a in self.columns if a.role == "weight"), None)

    @property
    def features(self) -> tuple[Attribute, ...]:
        return tuple(a for a in self.columns if a.role == "feature")

    @property
    def active(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.features if a.active)

    @property
    def booleans(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.features if a.active and a.kind == BOOLEAN)

    def column_number(self, name: str) -> int:
        """From 1, as in reports."""
        return next(k for k, a in enumerate(self.columns, 1) if a.name == name)

    def attribute(self, name: str) -> Attribute:
        found = next((a for a in self.features if a.name == name), None)
        if found is None:
            raise SchemaError("unknown attribute", name)
        return found

    def is_active(self, name: str) -> bool:
        return self.attribute(name).active

    def _set(self, name: str, active: bool) -> FeatureSchema:
        self.attribute(name)
        return FeatureSchema(tuple(replace(a, active=active) if a.name == name else a for a in self.columns))

    def without(self, name: str) -> FeatureSchema:
        return self._set(name, False)

    def with_(self, name: str) -> FeatureSchema:
        return self._set(name, True)

    def to_text(self) -> str:
        """The attribute file, ignored attributes listed after the contexts line."""
        marks = {"class": f" {CLASS}", "weight": f" {WEIGHT}", "feature": ""}
        lines = [f"{a.name}: {a.kind}{marks[a.role]}{f' {SPLIT}' if a.split else ''}." for a in self.columns]
        ignored = [f"{a.name} {NEVER}." for a in self.features if not a.active]
        return "\n".join([*lines, CONTEXTS, *ignored]) + "\n"


def parse_schema(text: str) -> FeatureSchema:
    """Read an attribute file.  Errors: several classes, no class, several weights, duplicate name, forbidden character, unknown
    type, active nominal.  ``never`` for an unknown name is a warning.  The class's type is not looked at."""
    head, _, tail = text.partition(CONTEXTS)
    columns: list[Attribute] = []
    for line in (x.strip() for x in head.splitlines()):
        if not line:
            continue
        name, colon, rest = line.partition(":")
        name, rest = name.strip(), rest.strip().removesuffix(".").strip()
        if not colon:
            raise SchemaError("line without a colon", line)
        if FORBIDDEN & set(name):
            raise SchemaError("forbidden character", name)
        if any(a.name == name for a in columns):
            raise SchemaError("duplicate name", name)
        marks = set(re.findall(r"\([a-z]+\)", rest))
        kind = re.sub(r"\([a-z]+\)", "", rest).replace(" ", "")
        role = "class" if CLASS in marks else "weight" if WEIGHT in marks else "feature"
        if role == "class" and any(a.role == "class" for a in columns):
            raise SchemaError("several classes", name)
        if role == "weight" and any(a.role == "weight" for a in columns):
            raise SchemaError("several weights", name)
        if role == "feature" and kind not in (CONTINUOUS, BOOLEAN, NOMINAL):
            raise SchemaError("unknown type", f"{name}: {kind}")
        columns.append(Attribute(name, kind, role, True, SPLIT in marks))
    if not any(a.role == "class" for a in columns):
        raise SchemaError("no class")
    ignored = {line.strip().removesuffix(".").removesuffix(NEVER).strip() for line in tail.splitlines() if line.strip()}
    for name in sorted(ignored - {a.name for a in columns}):
        log.warning("%s is ignored, but there is no such attribute", name)
    columns = [replace(a, active=not (a.role == "feature" and a.name in ignored)) for a in columns]
    if wrong := [a.name for a in columns if a.role == "feature" and a.active and a.kind == NOMINAL]:
        raise SchemaError("active nominal", ", ".join(wrong))
    return FeatureSchema(tuple(columns))
