"""Options of the session: verbosity and the registered index formulas."""

from __future__ import annotations

import sys
from collections.abc import Callable
from contextlib import contextmanager

from .functions import indices

_verbose = False


def set_options(verbose: bool | None = None, idxdb: dict[str, str | Callable] | None = None) -> dict:
    """Change options and give what they were. ``idxdb`` holds index formulas by
    name (texts or functions of bands); they replace those registered before."""
    global _verbose
    old = {"verbose": _verbose, "idxdb": dict(indices.CUSTOM)}
    if verbose is not None:
        _verbose = bool(verbose)
    if idxdb is not None:
        indices.CUSTOM.clear()
        for name, formula in idxdb.items():
            indices.register(name, formula)
    return old


@contextmanager
def options(**new):
    """Options for the length of a block."""
    old = set_options(**new)
    try:
        yield
    finally:
        set_options(**old)


def say(text: str) -> None:
    """A message, where they are wanted."""
    if _verbose:
        print(text, file=sys.stderr)
