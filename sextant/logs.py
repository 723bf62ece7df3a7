"""Logging to the console and to a file for each day, and marker lines in it."""

from __future__ import annotations

import logging
import sys
import time
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path

from .config import Config

PREFIX = "##MARK##"


def setup(cfg: Config, name: str = "sextant.log", days: int = 30) -> logging.Logger:
    """Root logger at the configured level (INFO for unknown ones); one that has handlers stays as it is."""
    root = logging.getLogger()
    if root.handlers:
        return root
    Path(cfg.log_dir).mkdir(parents=True, exist_ok=True)
    daily = TimedRotatingFileHandler(Path(cfg.log_dir) / name, when="midnight", backupCount=days, encoding="utf-8")
    daily.suffix = "%Y-%m-%d"
    for handler in (logging.StreamHandler(sys.stdout), daily):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s", "%Y-%m-%d %H:%M:%S"))
        root.addHandler(handler)
    root.setLevel(getattr(logging, cfg.log_level.strip().upper(), logging.INFO))
    return root


def mark(event: str, logger: logging.Logger | None = None, prefix: str = PREFIX, **meta) -> int:
    """Log a marker line that windows.parse_markers reads; returns its time in microseconds."""
    ts_us = time.time_ns() // 1000
    (logger or logging.getLogger(__name__)).info(" ".join([prefix, f"ts_us={ts_us}", f"event={event}", *(f"{k}={v}" for k, v in meta.items())]))
    return ts_us
