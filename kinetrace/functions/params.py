"""Nested parameters: defaults, checks, merging and searching."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import Any

DEFAULTS: dict[str, Any] = {
    "steps": ["load", "track", "spectra", "factors"],
    "project": {"directory": None, "overwrite": False, "seed": 0},
    "videos": {"frame_rate_clamp": None, "contiguous": False},
    "points": {"spacing": 16.0},
    "tracker": {"window": 9, "levels": 3, "iterations": 12, "neighbours": 8, "rigidity": 0.02, "relaxation": 0.002, "threshold": 25.0, "before": 3, "after": 3, "most_rewinds": 3},
    "spectra": {"f_low": 1.0, "f_high": 60.0, "bins": 36, "q_low": 4.0, "q_high": 10.0, "taps": 501, "pool": 20, "side": "center", "padding": "valid", "alpha": 0.95, "exponent": 1.0, "gamma": 0.5},
    "factors": {"rank": 10, "iterations": 200, "tolerance": 1e-9, "non_negative": True, "elements": "concatenate", "samples": 0, "penalties": None},
}


def filled(params: dict, defaults: dict = DEFAULTS) -> dict:
    """``params`` with what is missing from ``defaults``, at any depth; neither is changed."""
    out = copy.deepcopy(params)
    for k, v in defaults.items():
        if k not in out:
            out[k] = copy.deepcopy(v)
        elif isinstance(v, dict) and isinstance(out[k], dict):
            out[k] = filled(out[k], v)
    return out


def unknown_keys(params: dict, defaults: dict = DEFAULTS, at: str = "") -> list[str]:
    """Paths of keys that the defaults don't have."""
    found = []
    for k, v in params.items():
        if k not in defaults:
            found.append(f"{at}{k}")
        elif isinstance(v, dict) and isinstance(defaults[k], dict):
            found += unknown_keys(v, defaults[k], f"{at}{k}.")
    return found


def resolved(params: dict, defaults: dict = DEFAULTS) -> dict:
    if unknown := unknown_keys(params, defaults):
        raise KeyError(f"unknown parameters: {', '.join(unknown)}")
    return filled(params, defaults)


def updated(base: dict, path: Iterable[str], value: Any, must_exist: bool = True) -> dict:
    """A copy of ``base`` with one nested value replaced."""
    out, keys = copy.deepcopy(base), list(path)
    at = out
    for k in keys[:-1]:
        if k not in at:
            if must_exist:
                raise KeyError(k)
            at[k] = {}
        at = at[k]
    if must_exist and keys[-1] not in at:
        raise KeyError(keys[-1])
    at[keys[-1]] = value
    return out


def flattened(tree: dict, at: tuple[str, ...] = ()) -> dict[tuple[str, ...], Any]:
    """Leaves by path."""
    out = {}
    for k, v in tree.items():
        out |= flattened(v, (*at, k)) if isinstance(v, dict) and v else {(*at, k): v}
    return out


def find_keys(tree: dict, pattern: str, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Any]]:
    """(path, value) of keys that match a regular expression, at any depth."""
    out = []
    for k, v in tree.items():
        if re.search(pattern, k):
            out.append(((*at, k), v))
        if isinstance(v, dict):
            out += find_keys(v, pattern, (*at, k))
    return out


def merged(base: dict, new: dict) -> dict:
    """Groups are merged, leaves replaced."""
    out = dict(base)
    for k, v in new.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass(frozen=True)
class Repeated(Sequence):
    """One item for every one of ``n`` jobs, held once; without ``n``, for as many as ask."""

    item: Any
    n: int | None = None

    def __getitem__(self, i: int) -> Any:
        if self.n is not None and not -self.n <= i < self.n:
            raise IndexError(i)
        return self.item

    def __len__(self) -> int:
        if self.n is None:
            raise TypeError("an item repeated without end has no length")
        return self.n


def batches(items: Iterable[Any], size: int | None = None, count: int | None = None, least: int = 0) -> Iterator[list[Any]]:
    """Lists of ``size`` items, or ``count`` lists; a last list shorter than ``least`` is dropped."""
    if (size is None) == (count is None):
        raise ValueError("give size or count")
    if size is None:
        items = list(items)
        size = max(1, -(-len(items) // count))
    it = iter(items)
    while part := list(islice(it, size)):
        if len(part) >= least:
            yield part
