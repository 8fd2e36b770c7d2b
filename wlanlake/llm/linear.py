"""Matrix products inside tasks."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np


@contextmanager
def one_thread() -> Iterator[None]:
    """Matrix products in this block use the calling thread only.

    Each task has a core of its own; a thread pool for each would take them from the other tasks, and can
    hang beside a JVM. Where numpy has no OpenBLAS of its own, nothing is changed.
    """
    changed = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for prefix in ("scipy_openblas", "openblas"):
            for suffix in ("64_", ""):
                name = f"{prefix}_{{}}_num_threads{suffix}"
                if hasattr(library, name.format("set")):
                    read, write = getattr(library, name.format("get")), getattr(library, name.format("set"))
                    changed.append((write, read()))
                    write(1)
    try:
        yield
    finally:
        for write, threads in changed:
            write(threads)
