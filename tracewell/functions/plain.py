"""Plain values of live objects: what a capture channel inside a running program makes of parameters before they become JSON."""

from __future__ import annotations

import datetime
import decimal
import enum
import math
import os
import re
from collections.abc import Callable, Mapping

from tracewell.functions import fixed

_ADDRESS = re.compile("0x[0-9a-fA-F]+")


def shown(value: object) -> str:
    """repr without addresses, so that the same value reads the same in every process; never fails."""
    try:
        return _ADDRESS.sub("0x…", repr(value))
    except Exception:  # noqa: BLE001
        return f"<no text for {type(value).__name__}>"


def _asked(value: object, name: str) -> object:
    """What the attribute or method `name` of value gives; None if there is none or it fails."""
    try:
        found = getattr(value, name, None)
        return found() if callable(found) else found
    except Exception:  # noqa: BLE001
        return None


def _number(x: float | decimal.Decimal) -> object:
    return float(x) if math.isfinite(x) else str(x)


def _wrapped(value: object, depth: int) -> object:
    """The text inside a wrapper that names a dataset; runs on a selection are other runs, so they say so."""
    for name in ("source", "sink"):
        inner = _asked(value, name)
        if inner is not None and not isinstance(inner, (bool, int, float)):
            text = plain(inner, depth + 1)
            return text + fixed.SELECTED if isinstance(text, str) and _asked(value, "selectedFeaturesOnly") else text
    return None


#: By the value's type, the first that fits.
_KINDS: tuple[tuple[type | tuple[type, ...], Callable[[object, int], object]], ...] = (
    (enum.Enum, lambda v, d: plain(v.value, d + 1)),
    ((bool, int, str, type(None)), lambda v, d: v),
    ((float, decimal.Decimal), lambda v, d: _number(v)),
    (Mapping, lambda v, d: {str(k): plain(x, d + 1) for k, x in v.items()}),
    ((list, tuple, set, frozenset), lambda v, d: [plain(x, d + 1) for x in v]),
    ((bytes, bytearray), lambda v, d: bytes(v).decode("utf-8", "replace")),
    ((datetime.datetime, datetime.date, datetime.time), lambda v, d: v.isoformat()),
    (os.PathLike, lambda v, d: str(v)),
)

#: By what an object answers, the first text that isn't empty: coordinate systems, geometries, expressions.
_TEXTS = ("authid", "toWkt", "asWkt", "expressionString", "expression")


def plain(value: object, depth: int = 0) -> object:
    """value as JSON can have it. Containers deeper than fixed.MAX_DEPTH become text; nothing makes it fail."""
    try:
        if depth >= fixed.MAX_DEPTH and not isinstance(value, (bool, int, str, float, type(None))):
            return shown(value)
        for kind, convert in _KINDS:
            if isinstance(value, kind):
                return convert(value, depth)
        for name in _TEXTS:
            text = _asked(value, name)
            if isinstance(text, str) and text:
                return text
        if _asked(value, "isNull") is True or _asked(value, "authid") == "":
            return None
        static = _asked(value, "staticValue")
        if static is not None:
            return plain(static, depth + 1)
        text = _wrapped(value, depth)
        if text is None:
            text = _asked(value, "toString")
        return text if text is not None else shown(value)
    except Exception:  # noqa: BLE001
        return shown(value)


def plain_parameters(parameters: object) -> dict[str, object]:
    """Always a dictionary: what is none is put under one key."""
    return plain(parameters) if isinstance(parameters, Mapping) else {fixed.WRAPPED: plain(parameters)}
