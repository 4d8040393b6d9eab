"""Tuning constants and runtime options: option, then environment, then default."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from pathlib import PurePosixPath, PureWindowsPath
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Tuning:
    chunk_chars: int = 1800
    overlap_chars: int = 240
    least_page_chars: int = 40
    vector_k: int = 20
    text_k: int = 10
    title_k: int = 8
    title_extra: int = 4
    symbol_k: int = 4
    named_titles: int = 3
    near_titles: int = 2
    prefilter_keep: int = 10
    keep: int = 5
    threshold: float = -4.0


TUNING = Tuning()
_PREFIX = "PASSAGEMILL_"


@dataclass(frozen=True)
class Options:
    cache_dir: str | None = None
    database_path: str | None = None
    llm_base_url: str | None = None
    llm_model: str | None = None
    allow_model_downloads: bool | Callable | None = None
    on_download_progress: Callable | None = None


_set = Options()


def default_cache_dir(platform: str = sys.platform, home: str | None = None) -> str:
    home = home or os.path.expanduser("~")
    if platform.startswith("win"):
        return str(PureWindowsPath(os.environ.get("LOCALAPPDATA") or PureWindowsPath(home, "AppData", "Local"), "passagemill"))
    if platform == "darwin":
        return str(PurePosixPath(home, "Library", "Caches", "passagemill"))
    return str(PurePosixPath(os.environ.get("XDG_CACHE_HOME") or PurePosixPath(home, ".cache"), "passagemill"))


def _absolute(name: str, path: str) -> str:
    if not os.path.isabs(path):
        raise ValueError(f"{name} must be an absolute path")
    return path


def _url(url: str) -> str:
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError("llm_base_url must be an http: or https: URL")
    return url.rstrip("/")


def _environment_flag(name: str) -> bool | None:
    text = os.environ.get(_PREFIX + name)
    if text is None:
        return None
    if text.lower() in ("1", "true", "yes"):
        return True
    if text.lower() in ("0", "false", "no"):
        return False
    raise ValueError(f"{_PREFIX}{name} must be one of 1, true, yes, 0, false, no")


def configure(**options) -> Options:
    """Set options; with a wrong one nothing changes."""
    global _set
    names = {f.name for f in fields(Options)}
    for k, v in options.items():
        if k not in names:
            raise TypeError(f"unknown option: {k}")
        if v is None:
            continue
        if k == "allow_model_downloads":
            if not isinstance(v, bool) and not callable(v):
                raise TypeError(f"{k} must be a boolean or a function")
        elif k == "on_download_progress":
            if not callable(v):
                raise TypeError(f"{k} must be a function")
        elif not isinstance(v, str):
            raise TypeError(f"{k} must be a string")
    before = _set
    _set = replace(_set, **options)
    try:
        return get_options()
    except Exception:
        _set = before
        raise


def reset() -> None:
    global _set
    _set = Options()


def get_options() -> Options:
    env = lambda name: os.environ.get(_PREFIX + name)
    model = (_set.llm_model if _set.llm_model is not None else env("LLM_MODEL") or "local").strip()
    if not model:
        raise ValueError("llm_model must not be empty")
    allow = _set.allow_model_downloads
    flag = _environment_flag("ALLOW_MODEL_DOWNLOADS")
    return Options(
        _absolute("cache_dir", _set.cache_dir or default_cache_dir()),
        _absolute("database_path", _set.database_path or env("DATABASE_PATH") or os.path.join(default_cache_dir(), "chunks")),
        _url(_set.llm_base_url or env("LLM_BASE_URL") or "http://localhost:8080/v1"),
        model,
        allow if allow is not None else bool(flag),
        _set.on_download_progress,
    )
