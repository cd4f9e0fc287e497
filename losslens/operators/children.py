"""Registered kernels in child processes that can be killed, whatever they are doing."""

from __future__ import annotations

import json
import os
import pickle
import select
import signal
import struct
import subprocess
import sys
import time
from collections.abc import Callable

from pyspark import cloudpickle


class TimeUp(Exception):
    """A kernel ran longer than it may."""


class ChildDied(Exception):
    """The process of a kernel ended without an answer."""


class KernelFailed(Exception):
    """What a kernel raised, by name."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def serve() -> None:
    """A child's loop: a function, then values; each answer is (True, JSON) or (False, kind, message)."""
    ask, say = sys.stdin.buffer, os.fdopen(os.dup(1), "wb")
    os.dup2(2, 1)  # what a kernel prints is no answer

    def take() -> bytes | None:
        head = ask.read(8)
        return ask.read(struct.unpack("<q", head)[0]) if len(head) == 8 else None

    call = cloudpickle.loads(take())
    while (asked := take()) is not None:
        try:
            answer = True, json.dumps(call(pickle.loads(asked)), ensure_ascii=False) if asked else "null"
        except Exception as e:  # a failing run is a result
            answer = False, type(e).__name__, str(e)
        body = pickle.dumps(answer)
        say.write(struct.pack("<q", len(body)) + body)
        say.flush()


class Child:
    """A process for one kernel, in a group of its own, begun when it is needed.

    A run that takes too long is ended by killing the group, so code that never
    returns to the interpreter, and processes that it has begun, end too.  Works
    in any thread.  Each use of a child is its task's; leave with ``close``.
    """

    def __init__(self, call: Callable):
        self.call, self.process = cloudpickle.dumps(call), None

    def _begin(self) -> None:
        code = "from losslens.operators.children import serve; serve()"
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.process = subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True)
        self._send(self.call)
        self._send(b"")  # its answer says that the child is there; its imports aren't the kernel's time
        self._receive(60.0)

    def _send(self, body: bytes) -> None:
        try:
            self.process.stdin.write(struct.pack("<q", len(body)) + body)
            self.process.stdin.flush()
        except BrokenPipeError:
            pass  # told when the answer is read

    def _receive(self, seconds: float) -> tuple:
        end, got, need = time.monotonic() + seconds, b"", 8
        out = self.process.stdout.fileno()
        while len(got) < need:
            if not select.select([out], [], [], max(0.0, end - time.monotonic()))[0]:
                self.close()
                raise TimeUp
            some = os.read(out, 1 << 16)
            if not some:
                self.close()
                raise ChildDied
            got += some
            if need == 8 and len(got) >= 8:
                need = 8 + struct.unpack("<q", got[:8])[0]
        return pickle.loads(got[8:])

    def run(self, value, seconds: float) -> str:
        """The kernel's value as JSON; TimeUp, ChildDied or KernelFailed."""
        if self.process is None:
            self._begin()
        self._send(pickle.dumps(value))
        answer = self._receive(seconds)
        if not answer[0]:
            raise KernelFailed(*answer[1:])
        return answer[1]

    def close(self) -> None:
        if self.process is not None:
            try:
                os.killpg(self.process.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            self.process.wait()
            for pipe in (self.process.stdin, self.process.stdout):
                try:
                    pipe.close()
                except BrokenPipeError:
                    pass
            self.process = None
