"""Configurations: dataclasses on the driver, read from JSON or YAML, merged with overrides of the same type, and written back."""

from __future__ import annotations

import json
from ast import literal_eval
from dataclasses import asdict, fields, is_dataclass
from pathlib import Path
from typing import Any, TypeVar

C = TypeVar("C")


def to_dict(config: Any) -> dict:
    return asdict(config)


def from_dict(kind: type[C], data: dict[str, Any]) -> C:
    """A configuration of ``data``; keys it doesn't have are left out, nested dataclasses are built from their dictionaries."""
    default, out = kind(), {}
    for f in fields(kind):
        if f.name in data:
            value, old = data[f.name], getattr(default, f.name)
            nested = type(old) if is_dataclass(old) else NESTED.get((kind.__name__, f.name))
            out[f.name] = from_dict(nested, value) if nested and isinstance(value, dict) else tuple(value) if isinstance(old, tuple) else value
    return kind(**out)


#: Fields that are null by default and hold a dataclass otherwise.
NESTED: dict[tuple[str, str], type] = {}


def load(kind: type[C], path: str) -> C:
    text = Path(path).expanduser().read_text(encoding="utf-8")
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("a YAML configuration needs PyYAML, which is not installed") from e
        return from_dict(kind, yaml.safe_load(text) or {})
    return from_dict(kind, json.loads(text))


def save(config: Any, path: str) -> None:
    at = Path(path).expanduser()
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(to_dict(config), indent=2, sort_keys=True), encoding="utf-8")


def merged(base: dict, over: dict, where: str = "") -> dict:
    """``base`` with the values of ``over``: a key that base lacks, or a value of another type, is an error; dictionaries are merged."""
    out = dict(base)
    for k, v in over.items():
        name = f"{where}{k}"
        if k not in base:
            raise KeyError(f"{name} is no configuration key")
        if type(base[k]) is not type(v):
            raise ValueError(f"{name} takes a {type(base[k]).__name__}, not a {type(v).__name__}")
        out[k] = merged(base[k], v, f"{name}.") if isinstance(v, dict) else v
    return out


def overridden(base: dict, pairs: list[str]) -> dict:
    """``base`` with key, value, key, value ... as a command line gives them: dotted keys, values as Python literals or else strings."""
    if len(pairs) % 2:
        raise ValueError("overrides come in pairs of key and value")
    for key, text in zip(pairs[::2], pairs[1::2], strict=True):
        try:
            value = literal_eval(text)
        except (ValueError, SyntaxError):
            value = text
        nested: Any = value
        for part in reversed(key.split(".")):
            nested = {part: nested}
        base = merged(base, nested)
    return base


def output_dir(given: str | None, input_path: str, name: str = "pipeline_output") -> str:
    """The folder given, or ``name`` beside the input."""
    return str(Path(given).expanduser()) if given else str(Path(input_path).expanduser().parent / name)


def barcode_rows(signals: list[list], names: list[str], probabilities: tuple[str, ...] = ()) -> list[tuple[str, int, float]]:
    """(name, frame, value) of signals to be drawn one above the other: as many as names, of one length, 0 or 1 (0 to 1 for ``probabilities``)."""
    if not signals or len(signals) != len(names):
        raise ValueError("signals and names must be as many, and some")
    if len({len(s) for s in signals}) != 1 or not signals[0]:
        raise ValueError("signals must have one length, and not be empty")
    for name, signal in zip(names, signals, strict=True):
        if not all((0 <= v <= 1) if name in probabilities else v in (0, 1) for v in signal):
            raise ValueError(f"{name} has values that are neither 0 nor 1" if name not in probabilities else f"{name} has values outside 0 and 1")
    return [(name, i, float(v)) for name, signal in zip(names, signals, strict=True) for i, v in enumerate(signal)]
