"""Text recognition back ends by name, and the options of a run."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from functools import lru_cache
from importlib import import_module

_FACTORIES: dict[str, Callable[[], object] | str] = {}


def register(name: str, factory: Callable[[], object] | str) -> None:
    """Names a back end: a callable that makes one, or "module:function" that workers import."""
    _FACTORIES[name] = factory


def known() -> list[str]:
    return sorted(_FACTORIES)


@lru_cache(maxsize=None)
def get(name: str):
    """The back end of that name, made when it is first asked for and once a process."""
    factory = _FACTORIES.get(name, name)
    if isinstance(factory, str):
        if ":" not in factory:
            raise ValueError(f"unknown back end {name!r}; known: {known()}")
        module, function = factory.split(":")
        factory = getattr(import_module(module), function)
    return factory()


@dataclass(frozen=True)
class Options:
    """Settings of a run; ``from_mapping`` reads them from an environment or a table of options."""

    backend: str = ""
    min_side: int = 1500
    margin: int = 2
    stages: str = ""

    @classmethod
    def from_mapping(cls, values: Mapping[str, str] = os.environ, prefix: str = "INKVEIL_") -> Options:
        """Options named PREFIX + field in capitals; others keep their defaults."""
        found = {f.name: values[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in values}
        return cls(**{k: int(v) if cls.__annotations__[k] == "int" else v for k, v in found.items()})
