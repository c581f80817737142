"""The archive as it lives: insertions with gates, reservoirs, and re-evaluations that change, move or evict champions.

Each step depends on all before it, so one archive is one task; work spreads over archives.  The
same fold runs over a table (:func:`live_replay`) and over a stream (``streaming.live``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from .archive import in_order

#: What happens to an archive: ``kind`` is ``insert`` or ``reeval``; ``u`` is the uncertainty, ``h_bin`` and ``div_bin`` the cell that it and the text give.
STEP = (
    "archive_id string, seq long, kind string, program_id string, p_hat double, u double, h_bin int, div_bin int, "
    "generation long, valid boolean, behaviour string, template string"
)
FATE = "archive_id string, seq long, kind string, program_id string, status string, h_bin int, div_bin int, rq double, duplicate_of string, replaced string, promoted string"

Program = dict
Cell = tuple[int, int]


def _text(x: object) -> str | None:
    return None if x is None or x != x else str(x)


class LiveArchive:
    """Champions and reservoirs of one archive.

    ``reservoir`` programs a cell are kept beside its champion, best score and then latest generation
    first.  With ``promote``, the first of them takes a seat that a re-evaluation empties; without it
    the seat stays open for the next insertion.
    """

    def __init__(self, reservoir: int = 4, promote: bool = False, state: str | None = None):
        self.size, self.promote = reservoir, promote
        self.champions: dict[Cell, Program] = {}
        self.reservoirs: dict[Cell, list[Program]] = {}
        if state:
            held = json.loads(state)
            self.champions = {tuple(map(int, k.split(","))): p for k, p in held["champions"].items()}
            self.reservoirs = {tuple(map(int, k.split(","))): p for k, p in held["reservoirs"].items()}

    def state(self) -> str:
        keyed = lambda cells: {f"{h},{d}": v for (h, d), v in cells.items()}
        return json.dumps({"champions": keyed(self.champions), "reservoirs": keyed(self.reservoirs)})

    def step(self, row: dict) -> dict:
        out = {"status": "", "rq": None, "duplicate_of": None, "replaced": None, "promoted": None}
        if row["kind"] == "reeval":
            return out | self._reevaluate(row)
        return out | self._insert(self._program(row))

    @staticmethod
    def _program(row: dict) -> Program:
        p, u = float(row["p_hat"]), float(row["u"])
        return {
            "program_id": row["program_id"], "p_hat": p, "rq": p * (1 - p) * u, "generation": int(row["generation"] or 0), "valid": bool(row["valid"]),
            "behaviour": _text(row["behaviour"]), "template": _text(row["template"]), "cell": [int(row["h_bin"]), int(row["div_bin"])],
        }

    def _twin(self, program: Program, signature: str) -> str | None:
        """Another program of the same signature, cells in grid order, a champion before its reservoir."""
        for cell in sorted(self.champions.keys() | self.reservoirs.keys()) if program[signature] else []:
            held = [self.champions[cell]] if cell in self.champions else []
            for other in held + self.reservoirs.get(cell, []):
                if other[signature] == program[signature] and other["program_id"] != program["program_id"]:
                    return other["program_id"]
        return None

    def _insert(self, program: Program) -> dict:
        name, cell, rq = program["program_id"], tuple(program["cell"]), {"rq": program["rq"]}
        if not program["valid"]:
            return rq | {"status": "seed_variation_rejected"}
        for signature, status in (("behaviour", "duplicate_rejected"), ("template", "template_duplicate_rejected")):
            if twin := self._twin(program, signature):
                return rq | {"status": status, "duplicate_of": twin}
        held = self.champions.get(cell)
        if held is not None and program["rq"] <= held["rq"]:
            elsewhere = any(c["program_id"] == name for k, c in self.champions.items() if k != cell)
            kept = not elsewhere and self._keep(program, cell)
            return rq | {"status": "reservoir" if kept else "rejected"}
        self.champions[cell] = program
        if held is not None and held["program_id"] != name:
            self._keep(held, cell)
        self._leave(name, cell)
        return rq | {"status": "inserted" if held is None else "replaced", "replaced": held and held["program_id"]}

    def _keep(self, program: Program, cell: Cell) -> bool:
        """Into the cell's reservoir, unless it is there or champion there already; whether it is still in it after the cut."""
        pool = self.reservoirs.setdefault(cell, [])
        if self.size <= 0 or program["program_id"] in {self.champions.get(cell, {}).get("program_id"), *(p["program_id"] for p in pool)}:
            return False
        pool.append(program)
        pool.sort(key=lambda p: (-p["rq"], -p["generation"]))
        del pool[self.size :]
        return any(p is program for p in pool)

    def _leave(self, name: str, stay: Cell | None) -> None:
        """A program holds one place: its other seats and reservoir places are given up, no one moves up."""
        for cell in [c for c, p in self.champions.items() if p["program_id"] == name and c != stay]:
            del self.champions[cell]
        for cell, pool in self.reservoirs.items():
            if cell != stay:
                pool[:] = [p for p in pool if p["program_id"] != name]

    def _reevaluate(self, row: dict) -> dict:
        """New measures of a champion: none solved evicts it, another cell moves it through the gates, else its score changes in its seat."""
        old = next((c for c, p in self.champions.items() if p["program_id"] == row["program_id"]), None)
        if old is None:
            return {"status": "no_champion"}
        held = self.champions[old]
        fresh = self._program({**row, "generation": held["generation"], "valid": held["valid"], "behaviour": held["behaviour"], "template": held["template"]})
        cell = tuple(fresh["cell"])
        if fresh["p_hat"] == 0:
            del self.champions[old]
            return {"status": "evicted", "rq": fresh["rq"], "promoted": self._promoted(old)}
        if cell == old:
            self.champions[old] = fresh
            self._leave(fresh["program_id"], old)
            return {"status": "rescored", "rq": fresh["rq"]}
        del self.champions[old]
        out = self._insert(fresh)
        return out | {"status": f"moved_{out['status']}", "promoted": self._promoted(old)}

    def _promoted(self, cell: Cell) -> str | None:
        if not self.promote or cell in self.champions or not self.reservoirs.get(cell):
            return None
        self.champions[cell] = best = self.reservoirs[cell].pop(0)
        return best["program_id"]


def fates(archive: LiveArchive, archive_id: str, rows: list[dict]) -> list[tuple]:
    """What each row does, as rows of ``FATE``."""
    out = []
    for r in rows:
        got = archive.step(r)
        out.append((archive_id, r["seq"], r["kind"], r["program_id"], got["status"], r["h_bin"], r["div_bin"], got["rq"], got["duplicate_of"], got["replaced"], got["promoted"]))
    return out


def live_replay(steps: DataFrame, reservoir: int = 4, promote: bool = False) -> DataFrame:
    """Every step's fate, in order of seq within its archive; ``steps`` has the columns of ``STEP``.  A task holds one archive and one Arrow batch of steps."""

    def start(archive_id: str | None) -> Callable[[dict], tuple]:
        archive = LiveArchive(reservoir, promote)
        number = lambda x: float("nan") if x is None else x
        return lambda r: fates(archive, archive_id, [r | {"p_hat": number(r["p_hat"]), "u": number(r["u"])}])[0]

    return in_order(steps.select([x.split(" ")[0] for x in STEP.split(", ")]), start, FATE)
