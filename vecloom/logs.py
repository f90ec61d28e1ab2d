"""Logging of the library."""

from __future__ import annotations

import logging

logger = logging.getLogger("vecloom")


def configure_logger(level: str | int = "INFO", form: str = "%(asctime)s %(levelname)s %(name)s %(message)s") -> logging.Logger:
    """Sends the library's messages of the level or above to stderr, in the given form; calling it again changes both."""
    for h in list(logger.handlers):
        logger.removeHandler(h)
    handler = logging.StreamHandler()
    handler.setFormatter(logging.Formatter(form))
    logger.addHandler(handler)
    logger.setLevel(level)
    logger.propagate = False
    return logger
