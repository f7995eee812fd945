"""Logging to the console and to a file, with levels in colour and a rank if there is one."""

from __future__ import annotations

import logging
import os
import sys

LOGGER = logging.getLogger("tessellum")
_COLOURS = {"DEBUG": 36, "INFO": 32, "WARNING": 33, "ERROR": 31, "CRITICAL": 35}


class _Format(logging.Formatter):
    def __init__(self, colours: bool, rank: bool):
        super().__init__()
        self.colours, self.rank = colours, rank

    def format(self, record: logging.LogRecord) -> str:
        name = record.levelname
        if self.colours:
            name = f"\x1b[{_COLOURS.get(name, 37)}m{name}\x1b[0m"
        where = f"[{os.environ.get('SPARK_EXECUTOR_ID', 'driver')}] " if self.rank else ""
        return f"{self.formatTime(record)} {where}{name} {record.name}: {record.getMessage()}"


def set_logger_config(level: int | str = logging.INFO, log_file: str | None = None, log_to_stdout: bool = True, log_rank: bool = False, colors: bool = True) -> logging.Logger:
    """Replace the handlers of the package's logger."""
    for h in list(LOGGER.handlers):
        LOGGER.removeHandler(h)
        h.close()
    LOGGER.setLevel(level)
    handlers: list[logging.Handler] = []
    if log_to_stdout:
        handlers.append(logging.StreamHandler(sys.stdout))
        handlers[-1].setFormatter(_Format(colors, log_rank))
    if log_file:
        handlers.append(logging.FileHandler(log_file))
        handlers[-1].setFormatter(_Format(False, log_rank))
    for h in handlers:
        LOGGER.addHandler(h)
    LOGGER.propagate = False
    return LOGGER
