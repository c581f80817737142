"""Parents picked one after another: each pick's exploration bonus depends on the picks before it.

Picks of one archive are one task over its champions and reservoir, which the grid bounds; work
spreads over archives.  Draws are hashes of seed, archive and pick, so that reruns agree.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PICK = "archive_id string, pick int, first_id string, first_how string, second_id string, second_how string"


def unit(*key: object) -> float:
    """A number in [0, 1) from a key: the first 32 bits of its MD5 over 2^32."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32


class Picker:
    """Entries in a fixed order: (cell, program_id, rq, whether of the reservoir); counts of picks by cell, which outlive a pick."""

    def __init__(self, entries: list[tuple[object, str, float, bool]], seed: str, epsilon: float, c: float):
        self.entries, self.seed, self.epsilon, self.c = entries, seed, epsilon, c
        self.visits: Counter = Counter()
        self.total = self.reservoir = 0

    def scores(self, entries: list) -> np.ndarray:
        """Rank of the score in [0, 1] plus c * sqrt(ln(picks + 1) / picks of the cell); cells without a pick first."""
        n = len(entries)
        order = np.argsort(np.array([e[2] for e in entries]), kind="stable")
        rank = np.ones(1) if n == 1 else np.empty(n)
        if n > 1:
            rank[order] = np.arange(n) / (n - 1)
        seen = np.array([self.visits[e[0]] for e in entries], float)
        bonus = self.c * np.sqrt(math.log(self.total + 1) / np.maximum(seen, 1))
        return rank + np.where(seen > 0, bonus, np.inf)

    def one(self, tag: str, without: str | None = None) -> tuple[str, str] | None:
        """(program, how) of one pick, which is counted; none if nothing is left."""
        entries = [e for e in self.entries if e[1] != without]
        if not entries:
            return None
        if unit(self.seed, tag, "u") < self.epsilon:
            at, how = int(unit(self.seed, tag, "v") * len(entries)), "uniform"
        else:
            at, how = int(np.argmax(self.scores(entries))), "ucb"
        cell, program, _, spare = entries[at]
        self.visits[cell] += 1
        self.total += 1
        self.reservoir += spare
        return program, how

    def two(self, tag: str) -> tuple[tuple[str, str], tuple[str, str]] | None:
        """Two different programs; none if there are fewer than two."""
        if len({e[1] for e in self.entries}) < 2:
            return None
        first = self.one(f"{tag}a")
        return first, self.one(f"{tag}b", without=first[0])


def pick_parents(material: DataFrame, picks: int, seed: str = "", epsilon: float = 0.2, c: float = 1.0, pairs: bool = False) -> DataFrame:
    """``picks`` parents of each archive, or pairs of them: uniform in a share ``epsilon`` of the picks, else the best rank with its bonus.

    ``material`` has archive_id, h_bin, div_bin, program_id, rq and pool (``champion`` or ``reservoir``).
    Of equals the first in order of cell, champion before reservoir, higher score, smaller id is taken.
    Archives without two programs have no pairs.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(spare=pdf.pool != "champion", low=-pdf.rq).sort_values(["h_bin", "div_bin", "spare", "low", "program_id"])
        entries = [((r.h_bin, r.div_bin), r.program_id, r.rq, r.spare) for r in pdf.itertuples()]
        picker, rows = Picker(entries, f"{seed}|{key[0]}", epsilon, c), []
        for k in range(picks):
            got = picker.two(str(k)) if pairs else (picker.one(str(k)), (None, None))
            if got is not None:
                rows.append((key[0], k, *got[0], *got[1]))
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in PICK.split(", ")])

    return material.groupBy("archive_id").applyInPandas(run, PICK)
