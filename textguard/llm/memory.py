"""What reused Python workers keep between tasks: one operator's caches at a time.

Caches of words and pieces make an operator fast, but a worker serves one operator after
the other. An operator claims the worker first; what others kept is then given back.
"""

from __future__ import annotations

import contextlib

_KEPT: dict[str, list] = {}
_OWNER = ""


def keep(owner: str, cache):
    """Register something with ``clear()`` that tasks of ``owner`` fill; returns it."""
    _KEPT.setdefault(owner, []).append(cache)
    return cache


def claim(owner: str) -> None:
    """The worker is ``owner``'s from now on."""
    global _OWNER
    if owner == _OWNER:
        return
    _OWNER = owner
    held = [c for name, caches in _KEPT.items() if name != owner for c in caches if c]
    for cache in held:
        cache.clear()
    if held:
        release()


def release() -> None:
    """Give freed memory back to the system, in a worker or, after a model is trained and sent, in the driver."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
