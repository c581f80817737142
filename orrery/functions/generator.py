"""Generator programs as a table function: one program to a row per seed, failures as rows too.

Programs are run, so only trusted ones should get here (``functions.source.lint`` is no sandbox).
They run in a process of their own beside the Python worker, with bounds on time, memory and the size
of what they give; one that breaks them is ended and the next gets a fresh process.
"""

from __future__ import annotations

import json
import select
import subprocess
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

INSTANCE = "seed: int, problem: string, answer: string, error: string"

#: Runs in the process beside: a line with a program and its seeds comes in, a line per seed goes out.
_CHILD = r"""
import contextlib, importlib, io, json, resource, sys
memory, chars = int(sys.argv[1]), int(sys.argv[2])
resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
out, sys.stdout = sys.stdout, io.StringIO()
modules = {}
for name in ("math", "random", "fractions", "itertools", "functools", "sympy"):
    with contextlib.suppress(ImportError):
        modules[name] = importlib.import_module(name)

def instance(source, seed):
    space = {"__name__": "generated", **modules}
    exec(compile(source, "generated", "exec"), space)
    if "generate" not in space:
        return None, None, "no generate"
    pair = space["generate"](seed)
    if not isinstance(pair, (tuple, list)) or len(pair) != 2:
        return None, None, "not a pair"
    problem, answer = map(str, pair)
    if not problem.strip() or not answer.strip():
        return None, None, "empty text"
    if len(problem) + len(answer) > chars:
        return None, None, "too long"
    return problem, answer, None

for line in sys.stdin:
    task = json.loads(line)
    for seed in task["seeds"]:
        try:
            row = instance(task["source"], seed)
        except BaseException as e:
            row = None, None, type(e).__name__
        sys.stdout = io.StringIO()
        print(json.dumps([seed, *row]), file=out, flush=True)
"""


class Runner:
    """One process beside this one; started when needed, ended when a program does not come back."""

    def __init__(self, seconds: float, memory_mb: int, chars: int):
        self.seconds, self.args = seconds, [str(memory_mb << 20), str(chars)]
        self.process: subprocess.Popen | None = None

    def stop(self) -> None:
        if self.process:
            self.process.kill()
            self.process.communicate()
            self.process = None

    def _line(self) -> str | None:
        """The next line, or none if it does not come in time or the process ends."""
        ready, _, _ = select.select([self.process.stdout], [], [], self.seconds)
        return self.process.stdout.readline() if ready else None

    def run(self, source: str, seeds: list[int]) -> Iterator[tuple]:
        left = list(seeds)
        while left:
            if self.process is None:
                # Unbuffered, so that select() sees what there is.
                self.process = subprocess.Popen([sys.executable, "-c", _CHILD, *self.args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, bufsize=0)
            try:
                self.process.stdin.write(json.dumps({"source": source, "seeds": left}).encode() + b"\n")
            except BrokenPipeError:
                self.stop()
                yield left.pop(0), None, None, "process ended"
                continue
            while left:
                line = self._line()
                if not line:
                    error = "process ended" if line is not None else "timeout"
                    self.stop()
                    yield left.pop(0), None, None, error
                    break
                yield tuple(json.loads(line))
                left.pop(0)


@udtf(returnType=INSTANCE)
class GenerateInstances:
    """(source_code, seeds[, seconds, memory_mb, chars]) to a row per seed: problem and answer, or why there are none."""

    def __init__(self) -> None:
        self.runner: Runner | None = None

    def eval(self, source: str, seeds: int, seconds: float = 10.0, memory_mb: int = 2048, chars: int = 100_000):
        if source is None or seeds is None:
            return
        self.runner = self.runner or Runner(float(seconds), int(memory_mb), int(chars))
        yield from self.runner.run(source, list(range(seeds)))

    def terminate(self) -> None:
        if self.runner:
            self.runner.stop()


def instances(programs: DataFrame, seeds: int, source: str = "source_code", seconds: float = 10.0, memory_mb: int = 2048, chars: int = 100_000) -> DataFrame:
    """``programs`` and for each seed from 0 its problem and answer, or the error; a null source has no rows."""
    call = GenerateInstances(F.col(source).outer(), F.lit(seeds), F.lit(seconds), F.lit(memory_mb), F.lit(chars))
    return programs.lateralJoin(call)


def register(spark: SparkSession, name: str = "generate_instances") -> None:
    """For SQL: ``SELECT ... FROM programs, LATERAL generate_instances(source_code, 5)``."""
    spark.udtf.register(name, GenerateInstances)
