"""What Python workers give back to the system between batches."""

from __future__ import annotations

import ctypes
import functools
import inspect

import pyarrow as pa


def release() -> None:
    """Return freed memory; workers live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


def lean(run):
    """Wrap the function of a UDF so that it releases memory as it goes."""
    if inspect.isgeneratorfunction(run):
        @functools.wraps(run)
        def wrapped(batches):
            for i, out in enumerate(run(batches)):
                yield out
                if i % 8 == 7:
                    release()
            release()
    else:
        @functools.wraps(run)
        def wrapped(*args):
            out = run(*args)
            release()
            return out
    return wrapped
