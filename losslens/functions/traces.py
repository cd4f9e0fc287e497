"""Traces of registered kernels: one line for each step of a function, as text."""

from __future__ import annotations

import sys
from collections.abc import Callable

CALL, DONE = ">>> Call to", "<<< Return value"


def shown(value, most: int) -> str:
    """A value's text; a longer one is cut, and says by how much."""
    text = repr(value)
    return text if len(text) <= most else f"{text[:most]}... ({len(text) - most} more)"


def traced(kernel: Callable, value, most_lines: int = 3000, most_chars: int = 100) -> str:
    """What was called, line numbers and changed variables of the run, and the returned value, or ``ERROR: `` and what went wrong.

    Steps beyond ``most_lines`` are counted in a line of their own, values beyond
    ``most_chars`` cut with a mark; the returned value is whole.  Only functions of
    this library are run; nothing in the data is executed.
    """
    lines: list[str] = []
    left_out = 0

    def watch(frame, event, arg):
        if frame.f_code is not kernel.__code__:
            return None
        seen: dict[str, str] = {}

        def step(frame, event, arg):
            nonlocal left_out
            if event == "line" and len(lines) >= most_lines:
                left_out += 1
            elif event == "line":
                now = {k: shown(v, most_chars) for k, v in frame.f_locals.items()}
                changed = ", ".join(f"{k} = {v}" for k, v in now.items() if seen.get(k) != v)
                seen.update(now)
                lines.append(f"{frame.f_lineno - kernel.__code__.co_firstlineno}: {changed}")
            return step

        return step

    before = sys.gettrace()
    sys.settrace(watch)
    try:
        found = kernel(value)
    except Exception as e:  # the trace of a failing run says so
        return f"ERROR: {type(e).__name__}: {e}"
    finally:
        sys.settrace(before)
    more = [f"... {left_out} more steps"] if left_out else []
    return "\n".join([f"{CALL} {kernel.__name__}", *lines, *more, f"{DONE} {found!r}"])
