"""Consent for model files: what is missing is asked for once, and approvals are remembered by destination."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

_approved: set[str] = set()


@dataclass(frozen=True)
class ModelDownload:
    name: str
    source: str
    destination: str
    expected_bytes: int
    files: tuple[str, ...] = ()


def is_cached(m: ModelDownload) -> bool:
    """Every file is there and none is empty."""
    return bool(m.files) and all(os.path.isfile(p) and os.path.getsize(p) > 0 for p in (os.path.join(m.destination, f) for f in m.files))


def prompt(models: list[ModelDownload]) -> str:
    total = sum(m.expected_bytes for m in models) / (1 << 30)
    return "\n".join([*(f"{m.name} ({m.expected_bytes / (1 << 30):.2f} GiB) from {m.source} to {m.destination}" for m in models), f"Download {total:.2f} GiB? [y/N] "])


def authorize(models: list[ModelDownload], consent: bool | Callable[[list[ModelDownload]], bool]) -> None:
    """Raise unless every model is cached, approved before, or consented to now; nothing is written on refusal."""
    missing = [m for m in models if m.destination not in _approved and not is_cached(m)]
    if not missing:
        return
    if not (consent(missing) if callable(consent) else consent):
        raise PermissionError("model downloads were not allowed: " + ", ".join(m.name for m in missing))
    _approved.update(m.destination for m in missing)


def reset() -> None:
    _approved.clear()
