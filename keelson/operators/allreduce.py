"""Sums of small vectors over the tasks of a barrier stage, many times per second.

``BarrierTaskContext.allGather`` looks for its answer once a second, which is right for an epoch and not for a step. Here
it is used once, to agree on a name; every further exchange goes through the shared folder: a task puts its vector in a
file that is complete or not there, and reads those of the others as they appear. A task has read all files of a step
before it writes those of the next, so files two steps old can go. If a task is lost Spark ends the others and repeats
the stage, which agrees on a new name and never sees old files."""

from __future__ import annotations

import time
import uuid

import numpy as np

from ..sources.shared import open_shared

#: Seconds that a task waits for another one's file. Spark ends the wait of a stage that has lost a task long before.
PATIENCE = 1800.0


class SharedSum:
    """``gathered`` (from the start) holds what each task passed as ``message``; :meth:`sum` adds up the tasks' vectors in the
    order of the tasks, so all of them get the same bits."""

    def __init__(self, ctx, folder: str, message: str = ""):
        self.own, self.tasks = ctx.partitionId(), len(ctx.getTaskInfos())
        run = uuid.uuid4().hex if self.own == 0 else ""
        both = [m.split("|", 1) for m in ctx.allGather(f"{run}|{message}")]
        self.gathered, self.step = [m for _, m in both], 0
        self.fs, place = open_shared(f"{folder.rstrip('/')}/sums-{both[0][0]}")
        self.place = place
        if self.tasks > 1:
            self.fs.create_dir(place, recursive=True)

    def _name(self, step: int, task: int) -> str:
        return f"{self.place}/{step}-{task}"

    def sum(self, vector: np.ndarray | None) -> np.ndarray | None:
        """None from a task adds nothing; None comes back if no task had a vector."""
        if self.tasks == 1:
            return vector
        at, held = self.step, f"{self.place}/_{self.own}"
        with self.fs.open_output_stream(held) as out:
            out.write(b"" if vector is None else np.ascontiguousarray(vector, np.float64).tobytes())
        self.fs.move(held, self._name(at, self.own))
        total = None
        for task in range(self.tasks):
            part = vector if task == self.own else self._read(self._name(at, task))
            if part is not None:
                total = part if total is None else total + part
        if at >= 2:
            self.fs.delete_file(self._name(at - 2, self.own))
        self.step += 1
        return total

    def _read(self, name: str) -> np.ndarray | None:
        wait, end = 0.0002, time.monotonic() + PATIENCE
        while True:
            try:
                with self.fs.open_input_file(name) as f:
                    data = f.read()
                return np.frombuffer(data) if data else None
            except FileNotFoundError:
                if time.monotonic() > end:
                    raise TimeoutError(f"no sums of another task after {PATIENCE:.0f} s") from None
                time.sleep(wait)
                wait = min(0.02, wait * 1.5)
