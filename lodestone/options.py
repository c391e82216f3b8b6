"""Options of a run: a dataclass whose fields say what is allowed, filled from properties and arguments."""

from __future__ import annotations

import argparse
import dataclasses
import os
from typing import Any


def option(default: Any = dataclasses.MISSING, *, positive: bool = False, within: tuple[float, float] | None = None, choices: tuple | None = None, exists: bool = False, help: str = ""):
    """A field with its checks; without a default it is required."""
    return dataclasses.field(default=default, metadata={"positive": positive, "within": within, "choices": choices, "exists": exists, "help": help})


def check(values: Any) -> None:
    """Raises ValueError with all that is wrong with a dataclass of options."""
    wrong = []
    for f in dataclasses.fields(values):
        v, m = getattr(values, f.name), f.metadata
        if v is None:
            continue
        if m.get("positive") and not v > 0:
            wrong.append(f"{f.name} must be positive, not {v}")
        if m.get("within") and not m["within"][0] <= v <= m["within"][1]:
            wrong.append(f"{f.name} must lie in {m['within']}, not {v}")
        if m.get("choices") and v not in m["choices"]:
            wrong.append(f"{f.name} is one of {m['choices']}, not {v}")
        if m.get("exists") and not os.path.exists(v):
            wrong.append(f"{f.name}: {v} isn't there")
    if wrong:
        raise ValueError("; ".join(wrong))


def properties(path: str) -> dict[str, str]:
    """``key=value`` lines of a file on the driver; # and ! begin comments."""
    with open(path, encoding="utf-8") as file:
        lines = [x.strip() for x in file]
    pairs = [x.partition("=") for x in lines if x and x[0] not in "#!"]
    return {k.strip(): v.strip() for k, _, v in pairs}


def _typed(field: dataclasses.Field, text: str) -> Any:
    kind = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("true", "1", "yes")}
    return kind[field.type if isinstance(field.type, str) else field.type.__name__](text)


def parse(kind: type, arguments: list[str], settings: dict[str, str] | None = None) -> Any:
    """An instance of the dataclass ``kind``: arguments (--name value) before settings before defaults, checked."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    parser = argparse.ArgumentParser(exit_on_error=False)
    for name, f in fields.items():
        parser.add_argument(f"--{name}", help=f.metadata.get("help"))
    given = {k: v for k, v in vars(parser.parse_args(arguments)).items() if v is not None}
    texts = {k: v for k, v in (settings or {}).items() if k in fields} | given
    missing = [n for n, f in fields.items() if n not in texts and f.default is dataclasses.MISSING]
    if missing:
        raise ValueError(f"required: {', '.join(missing)}")
    values = kind(**{k: _typed(fields[k], v) for k, v in texts.items()})
    check(values)
    return values
