"""States of micro-clusters kept in a pyramid of time, and what was learned within a horizon, by taking an earlier state away.

Ticks that are multiples of alpha^i are of order i; of each order the last alpha^l + 1 snapshots stay. So their number grows with the
logarithm of time, and for any horizon h there is a snapshot that lies no more than h / alpha^(l - 1) before its start.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np

from .regimes import MicroClusters

SUMS = ("n", "lt", "st", "ls", "ss")


@dataclass
class Pyramid:
    alpha: int = 2
    l: int = 2  # noqa: E741  as in the paper
    kept: dict[int, tuple[float, list[dict]]] = field(default_factory=dict)  # tick -> (time, clusters)

    def order(self, tick: int) -> int:
        i = 0
        while tick and tick % self.alpha ** (i + 1) == 0:
            i += 1
        return i

    def add(self, tick: int, time: float, model: MicroClusters) -> None:
        """Keep the state after `tick` (from 1, ascending), whose rows go up to `time`; drop what its order has too many of."""
        self.kept[tick] = (time, [s | {"ls": s["ls"].copy(), "ss": s["ss"].copy()} for s in model.stats])
        own = sorted(t for t in self.kept if self.order(t) == self.order(tick))
        for t in own[: -(self.alpha**self.l + 1)]:
            del self.kept[t]

    def before(self, time: float) -> tuple[float, list[dict]] | None:
        """The last snapshot whose rows are all from before `time`, or of that time."""
        fits = [self.kept[t] for t in sorted(self.kept) if self.kept[t][0] <= time]
        return fits[-1] if fits else None

    def within(self, horizon: float, now: float, model: MicroClusters) -> tuple[float, list[dict]]:
        """(start, clusters): what `model` has learned after `start`, the time of the last snapshot that is `horizon` or more before now.

        A cluster's ids say which of the snapshot's clusters it has taken up since; their sums are taken from it. Clusters that had
        all their rows before the start are left out. Before the first snapshot nothing is taken away.
        """
        found = self.before(now - horizon)
        start, old = found if found else (-np.inf, [])
        out = []
        for s in model.stats:
            left = {k: s[k] for k in SUMS} | {"ids": s["ids"], "last": s["last"]}
            for o in old:
                if set(o["ids"]) <= set(s["ids"]):
                    left |= {k: left[k] - o[k] for k in SUMS}
            if left["n"] > 0:
                out.append(left)
        return start, out

    def dump(self) -> str:
        return json.dumps({t: [time, [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in s.items()} for s in stats]] for t, (time, stats) in self.kept.items()})

    def load(self, text: str) -> None:
        self.kept = {int(t): (time, [{k: np.array(v) if k in ("ls", "ss") else v for k, v in s.items()} for s in stats]) for t, (time, stats) in json.loads(text).items()}
