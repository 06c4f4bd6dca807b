"""The facts of one declaration."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA = (
    "file string, identity string, kind string, name string, start int, throws int, throw_types array<string>, returns int, returns_nullish int, calls array<string>, numbers array<double>, "
    "awaits int, catches int, empty_catches int, params int, modifiers array<string>, callbacks array<string>, shape string, entry_count int, entries array<string>, failed boolean"
)


@dataclass
class Facts:
    name: str
    kind: str
    start: int
    params: int = 0
    throws: int = 0
    returns: int = 0
    returns_nullish: int = 0
    awaits: int = 0
    catches: int = 0
    empty_catches: int = 0
    throw_types: set = field(default_factory=set)
    calls: set = field(default_factory=set)
    numbers: set = field(default_factory=set)
    callbacks: set = field(default_factory=set)
    modifiers: list = field(default_factory=list)
    shape: str | None = None
    entry_count: int | None = None
    entries: list | None = None

    @property
    def identity(self) -> str:
        """name:kind, and static where it is."""
        return ":".join([self.name, self.kind, *(["static"] if "static" in self.modifiers else [])])

    def row(self, file: str, identity: str) -> tuple:
        return (
            file, identity, self.kind, self.name, self.start, self.throws, sorted(self.throw_types), self.returns, self.returns_nullish, sorted(self.calls), sorted(self.numbers), self.awaits, self.catches,
            self.empty_catches, self.params, list(self.modifiers), sorted(self.callbacks), self.shape, self.entry_count, self.entries, False,
        )


def failed_row(file: str) -> tuple:
    return (file, None, None, None, None, 0, [], 0, 0, [], [], 0, 0, 0, 0, [], [], None, None, None, True)
