"""A child process that can be killed: what it is given either comes back in time or costs a new child."""

from __future__ import annotations

import contextlib
import fcntl
import multiprocessing
import os
import tempfile
import time


def _serve(pipe, parents, function) -> None:
    parents.close()  # else this process would not see its parent's end
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        pipe.send(function(*args))


class Child:
    def __init__(self, function, timeout: float) -> None:
        self.function, self.timeout = function, timeout
        self.process = None

    def start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.process = context.Process(target=_serve, args=(other, self.pipe, self.function), daemon=True)
        self.process.start()
        other.close()

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def __call__(self, *args) -> dict:
        """The function's result; a row that says `timeout` or `failed` where there is none."""
        if self.process is None or not self.process.is_alive():
            self.stop()
            self.start()
        try:
            self.pipe.send(args)
            if self.pipe.poll(self.timeout):
                return self.pipe.recv()
            self.stop()
            return {"error_kind": "timeout", "error": f"not done in {self.timeout:g} s"}
        except (EOFError, OSError) as e:
            self.stop()
            return {"error_kind": "failed", "error": f"the reader's process died: {type(e).__name__}"}


@contextlib.contextmanager
def slot(most: int):
    """One of `most` places on this machine, waited for where all are taken; the lock goes with the process that holds it."""
    if most <= 0:
        yield
        return
    names = [os.path.join(tempfile.gettempdir(), f"docmill-slot-{os.getuid()}-{k}") for k in range(most)]
    while True:
        for name in names:
            f = os.open(name, os.O_CREAT | os.O_RDWR, 0o600)
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                os.close(f)
                continue
            try:
                yield
            finally:
                # A child that was forked meanwhile has the file open too: closing it here alone would leave it locked.
                fcntl.flock(f, fcntl.LOCK_UN)
                os.close(f)
            return
        time.sleep(0.01)
