"""Logging to a file and the console, and seeds."""

from __future__ import annotations

import logging
import random

import numpy as np


def get_logger(name: str, file: str | None = None) -> logging.Logger:
    """A logger with a console handler (info) and on demand a file handler (debug); asked for again it is the same one."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        logger.setLevel(logging.DEBUG)
        form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
        for handler, level in [(logging.StreamHandler(), logging.INFO), *([(logging.FileHandler(file), logging.DEBUG)] if file else [])]:
            handler.setLevel(level)
            handler.setFormatter(form)
            logger.addHandler(handler)
    return logger


def seed_all(seed: int) -> np.random.Generator:
    """Seeds Python and NumPy, and returns a generator; Spark expressions and kernels take the seed as an argument."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)
