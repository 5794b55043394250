"""Giving memory back: Python workers outlive their tasks, and what their allocators keep is an executor's memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa


def release() -> None:
    """Return what is free to the operating system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable) -> Callable:
    """A function of batches that gives memory back after each batch and at its end."""

    def between(batches):
        for batch in batches:
            yield batch
            del batch
            release()

    def inner(batches):
        try:
            yield from run(between(batches))
        finally:
            release()

    return inner


def lean_group(run: Callable) -> Callable:
    """A function of a group's frame that gives memory back when it is done."""

    def inner(pdf):
        try:
            return run(pdf)
        finally:
            release()

    return inner
