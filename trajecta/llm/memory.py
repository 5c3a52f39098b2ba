"""Memory of Python workers between tasks.

Workers outlive their tasks, and their allocators keep what a task's arrays
took: over the stages of a long job every worker would come to hold as much as
its largest task, those that wait included.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: Groups of fewer bytes leave their memory to the next one.
LARGE = 1 << 22


def give_back() -> None:
    """Return freed memory of this process to the system (glibc and Arrow)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(scan):
    """A function of ``mapInArrow`` that gives its memory back at the end."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def tidy_group(judge):
    """The same for ``applyInArrow``, after large groups."""

    def run(table):
        try:
            return judge(table)
        finally:
            if table.nbytes >= LARGE:
                give_back()

    return run
