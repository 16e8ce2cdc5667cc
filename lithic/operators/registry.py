"""What is tried in order of priority and may be added to: call levels, matchers, taggers, parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Registry:
    """Entries (priority, name, build, more), given out by priority, then by when they came. Names are unique."""

    def __init__(self, entries: tuple = ()):
        self._entries: list[tuple[int, str, Callable, dict[str, Any]]] = list(entries)

    def add(self, priority: int, name: str, build: Callable, **more: Any) -> None:
        if any(name == n for _, n, _, _ in self._entries):
            raise ValueError(f"{name} is registered already")
        self._entries.append((priority, name, build, more))

    def register(self, priority: int, name: str, **more: Any) -> Callable:
        """`add` as a decorator."""

        def put(build: Callable) -> Callable:
            self.add(priority, name, build, **more)
            return build

        return put

    def remove(self, name: str) -> None:
        if not any(name == n for _, n, _, _ in self._entries):
            raise KeyError(name)
        self._entries = [e for e in self._entries if e[1] != name]

    def copy(self) -> Registry:
        """One that can be changed without changing this one."""
        return Registry(tuple(self._entries))

    def __iter__(self) -> Iterator[tuple[str, Callable, dict[str, Any]]]:
        for _, name, build, more in sorted(self._entries, key=lambda e: e[0]):
            yield name, build, more

    def __getitem__(self, name: str) -> Callable:
        return next(build for n, build, _ in self if n == name)
