"""Controlled rounding of a two-way table by maximum flow."""

from __future__ import annotations

from math import floor

import numpy as np


class Flow:
    """Dinic's maximum flow on a small graph."""

    def __init__(self, nodes: int):
        self.next: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.next[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level, queue = {source: 0}, [source]
            for a in queue:
                for e in self.next[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if sink not in level:
                return total
            at = [0] * len(self.next)
            while True:
                path, a = [], source
                while a != sink:
                    while at[a] < len(self.next[a]):
                        e = self.next[a][at[a]]
                        if self.room[e] and level.get(self.to[e]) == level[a] + 1:
                            break
                        at[a] += 1
                    if at[a] < len(self.next[a]):
                        path.append(self.next[a][at[a]])
                        a = self.to[path[-1]]
                    elif path:
                        a = self.to[path.pop() ^ 1]
                        at[a] += 1
                    else:
                        break
                if a != sink:
                    break
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
                total += push


def controlled_rounding(table: np.ndarray) -> np.ndarray:
    """Each cell rounded up or down such that row sums, column sums and the total are rounded up or down too.

    A sum that is whole already is kept. Such a rounding always exists (integral flow); cells are within 1e-9
    of a whole number if they are meant to be whole.
    """
    table = np.asarray(table, float)
    rows, columns = table.shape
    low = np.array([[floor(x + 1e-9) for x in r] for r in table], int).reshape(rows, columns)
    open_cell = table - low > 1e-9

    def bounds(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = np.floor(sums + 1e-7).astype(int)
        return below, below + (sums - below > 1e-7)

    row_low, row_high = (b - low.sum(axis=1) for b in bounds(table.sum(axis=1)))
    col_low, col_high = (b - low.sum(axis=0) for b in bounds(table.sum(axis=0)))
    all_low, all_high = (int(b[0]) - int(low.sum()) for b in bounds(np.array([table.sum()])))
    # Lower bounds become demands between a second source and sink.
    s, t, ss, tt = rows + columns, rows + columns + 1, rows + columns + 2, rows + columns + 3
    flow, demand = Flow(rows + columns + 4), [0] * (rows + columns + 2)

    def bounded(a: int, b: int, least: int, most: int) -> None:
        flow.edge(a, b, most - least)
        demand[a] -= least
        demand[b] += least

    for i in range(rows):
        bounded(s, i, int(row_low[i]), int(row_high[i]))
    for j in range(columns):
        bounded(rows + j, t, int(col_low[j]), int(col_high[j]))
    cells = {(i, j): flow.edge(i, rows + j, 1) for i in range(rows) for j in range(columns) if open_cell[i, j]}
    bounded(t, s, all_low, all_high)
    need = 0
    for v, d in enumerate(demand):
        if d > 0:
            flow.edge(ss, v, d)
            need += d
        elif d < 0:
            flow.edge(v, tt, -d)
    if flow.run(ss, tt) != need:
        raise ValueError("the table has no controlled rounding; its sums are inconsistent")
    for (i, j), e in cells.items():
        low[i, j] += flow.room[e ^ 1]
    return low
