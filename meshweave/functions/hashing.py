"""One stable fingerprint for settings, whatever they are made of."""

from __future__ import annotations

import dataclasses
import enum
import hashlib
import json
from collections.abc import Collection, Mapping
from typing import Any

# The JSON form that is hashed. Another form gives other fingerprints.
JSON_FORM = {"sort_keys": True, "ensure_ascii": False, "separators": (",", ":")}


def _settled(value: Any) -> Any:
    """``value`` in JSON's own types: records as mappings of their fields that say something, what has a digest by that."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return _telling({f.name: _settled(getattr(value, f.name)) for f in dataclasses.fields(value)})
    if isinstance(value, enum.Enum):
        return _settled(value.value)
    if isinstance(value, Mapping):
        return {key: _settled(x) for key, x in value.items()}
    if isinstance(value, (list, tuple)):
        return [_settled(x) for x in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if callable(getattr(value, "sha256", None)):
        return value.sha256().hex()
    raise TypeError(f"a fingerprint can't be taken of {value!r}")


def _telling(settings: Mapping[str, Any]) -> dict[str, Any]:
    """Settings but for those that are None or empty; 0 and False say something."""
    return {key: x for key, x in settings.items() if x is not None and (not isinstance(x, Collection) or len(x) > 0)}


def fingerprint(settings: Any, ignore: Collection[str] = ()) -> bytes:
    """SHA-256 of a mapping or dataclass instance without its empty settings and those named in ``ignore``.

    Empty fields of dataclasses inside go too; mappings inside stay as they are, as their
    keys are values. Anything else than these two is a ValueError.
    """
    if not isinstance(settings, Mapping) and (not dataclasses.is_dataclass(settings) or isinstance(settings, type)):
        raise ValueError("settings must be a mapping or a dataclass instance")
    kept = {key: x for key, x in _telling(_settled(settings)).items() if key not in ignore}
    return hashlib.sha256(json.dumps(kept, **JSON_FORM).encode()).digest()
