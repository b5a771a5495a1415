"""Rounds of the force layout, by parts of points.

Points of a level are dealt into parts of about PART, by component and along a curve through the plane, so that a part holds neighbours; each spring is known to the
parts of its two ends.  A round takes two exchanges between parts:

* each part sends its points to the owners of their tiles (2**TILE cells wide), sums of its cells to the owners of tiles around that hear them, and the
  ends of its springs that other parts pull at;
* the owner of a tile adds up what its points hear: cells around, one by one, and the pyramid of what lies farther, TILE levels of it; cells of the levels above are
  points of wider tiles with owners of their own.  It returns forces, and parts move their points.

Rows between parts hold arrays: one row for each part, kind and receiver.  No part, tile or row holds more than its share of the points, and all sums are of whole
numbers, so parts do not matter for the result.  A level of one part runs its rounds in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, dealt

#: Points of a part, about.
PART = 40_000
#: Levels of the pyramid in one tile, and of tiles whose owner is the same.
TILE = 5
BLOCK = 2
#: Rounds between two tables in storage.
AT_ONCE = 6

STATE, ARCS, WANTS, ENDS, POINTS, ASKS, HALO, FORCES, HEARD = range(9)
NAMES = "abcdefg"
ROWS = "to int, kind int, frm int, " + ", ".join(f"{c} array<long>" for c in NAMES)
PLACES = "component long, pid long, x long, y long"


# ---------------------------------------------------------------- rows between parts


def sent(kind: int, frm: int, to: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each receiver, with the elements of columns that go there; to: ascending."""
    to = np.asarray(to)
    starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts, len(to)].astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int64())) for c in columns]
    lists += [pa.ListArray.from_arrays(np.zeros(len(ends), dtype=np.int32), pa.array([], pa.int64()))] * (len(NAMES) - len(columns))
    n = len(starts)
    heads = [pa.array(to[starts], pa.int32()), pa.array(np.full(n, kind), pa.int32()), pa.array(np.full(n, frm), pa.int32())]
    return pa.Table.from_arrays(heads + lists, ["to", "kind", "frm", *NAMES])


def kept(kind: int, part: int, *columns: np.ndarray) -> pa.Table:
    """One row of a part to itself."""
    return sent(kind, part, np.full(len(columns[0]), part), *columns)


def taken(table: pa.Table, kind: int, count: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The elements of the rows of one kind, by sender, and each element's sender."""
    table = table.select(["kind", "frm", *NAMES[:count]])
    table = table.filter(pa.array(table["kind"].to_numpy() == kind)).sort_by("frm").combine_chunks()
    lists = [table[c].combine_chunks() for c in NAMES[:count]]
    sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(table["frm"].to_numpy(), sizes), [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]


# ---------------------------------------------------------------- sums


def joint(*columns: np.ndarray) -> np.ndarray:
    """One number for each row, in the order of the columns and equal where all of them are."""
    key, size = np.zeros(len(columns[0]), dtype=np.int64), 1
    for c in columns if len(key) else ():
        low, high = int(c.min()), int(c.max())
        if high - low >= 1 << 31:
            c, low = np.unique(c, return_inverse=True)[1], 0
            high = int(c.max())
        if size * (high - low + 1) >= 1 << 62:
            key, size = np.unique(key, return_inverse=True)[1], len(key)
        key, size = key * (high - low + 1) + (c - low), size * (high - low + 1)
    return key


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A row of each key in ascending order, the place of each row's key there, and the sums by key."""
    order = np.argsort(key)
    found = key[order]
    first = np.r_[True, found[1:] != found[:-1]] if len(found) else np.zeros(0, dtype=bool)
    at, place = np.flatnonzero(first), np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(first) - 1
    return order[at], place, [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def whole(force: np.ndarray) -> np.ndarray:
    return np.floor(force + 0.5).astype(np.int64)


class Setting:
    """What all parts of a level share.  unit: of places; push: strength of repulsion; k: mean length of springs; levels: of the pyramid."""

    def __init__(self, unit: int, push: float, k: float, levels: int, parts: int):
        self.unit, self.levels, self.parts = unit, levels, parts
        self.side = float(2 * k * unit)
        self.strength, self.soft = push * (k * unit) ** 3, k * unit * (k * unit) / 25

    def cell(self, at: np.ndarray) -> np.ndarray:
        return np.floor(at / self.side).astype(np.int64)

    def pushed(self, dx: np.ndarray, dy: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `count` points, dx and dy away, add to a point's move."""
        size = dx * dx + dy * dy + self.soft
        share = count * self.strength / (size * np.sqrt(size))
        return whole(dx * share), whole(dy * share)

    def owner(self, component: np.ndarray, group: int | np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
        """The part that owns each tile."""
        mixed = np.zeros(len(component), dtype=np.uint64)
        for c in (component, tx >> BLOCK, ty >> BLOCK, group):
            mixed = (mixed ^ np.asarray(c, dtype=np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(self.parts)).astype(np.int64)


# ---------------------------------------------------------------- a part and its springs


def begun(part: int, points: pa.Table, arcs: pa.Table) -> tuple[list[np.ndarray], list[pa.Table]]:
    """State (pid, component, x, y, by pid) and the rows that a part keeps: its springs, and which points it sends to whom.

    Springs name their ends by place: first the part's own points, then those of others in the order of their parts.
    """
    pid, component, x, y = (points[c].to_numpy() for c in ("pid", "component", "x", "y"))
    order = np.argsort(pid)
    state = [c[order] for c in (pid, component, x, y)]
    u, v, rest, pu, pv = (arcs[c].to_numpy() for c in ("u", "v", "rest", "pu", "pv"))
    own = state[0]

    def among(names: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, end), max(len(names) - 1, 0))
        return at, (names[at] == end if len(names) else np.zeros(len(end), dtype=bool))

    known = np.ones(len(u), dtype=bool)
    for end, of in ((u, pu), (v, pv)):
        known &= (of != part) | among(own, end)[1]
    u, v, rest, pu, pv = (c[known] for c in (u, v, rest, pu, pv))

    def distinct(of: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = summed(joint(of.astype(np.int64), end))[0]
        return of[rows].astype(np.int64), end[rows]

    a, b = pu != part, pv != part
    _, others = distinct(np.r_[pu[a], pv[b]], np.r_[u[a], v[b]])
    to, wanted = distinct(np.r_[pv[b], pu[a]], np.r_[u[b], v[a]])
    by_name = np.argsort(others)

    def place(end: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = np.searchsorted(own, end)
        out[other] = len(own) + by_name[np.searchsorted(others[by_name], end[other])]
        return out

    return state, [kept(ARCS, part, place(u, a), place(v, b), rest.astype(np.float64).view(np.int64)), kept(WANTS, part, np.searchsorted(own, wanted), to)]


def pulls(x: np.ndarray, y: np.ndarray, own: int, arcs: list[np.ndarray], setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what springs pull at each of the part's own points, which come first in x and y."""
    u, v, rest = arcs[0], arcs[1], arcs[2].view(np.float64)
    dx, dy = x[v] - x[u], y[v] - y[u]
    size = np.hypot(dx, dy) + 1
    share = (size - rest * setting.unit) / size
    out = []
    for d in (whole(dx * share), whole(dy * share)):
        total = np.zeros(len(x), dtype=np.int64)
        np.add.at(total, u, d)
        np.add.at(total, v, -d)
        out.append(total[:own])
    return out[0], out[1]


# ---------------------------------------------------------------- what a part asks


class Questions:
    """Points by owner of their tile; cells of all levels; cells that ask at the first level of each further group of levels.  A function of places alone."""

    def __init__(self, component: np.ndarray, x: np.ndarray, y: np.ndarray, setting: Setting):
        cx, cy = setting.cell(x), setting.cell(y)
        self.to = setting.owner(component, 0, cx >> TILE, cy >> TILE)
        self.order = np.argsort(self.to, kind="stable")
        cells, n, sx, sy, at = [], np.ones(len(x), dtype=np.int64), x, y, np.arange(len(x))
        asks = []
        for level in range(setting.levels):
            if level:
                cx, cy = cx >> 1, cy >> 1
            rows, place, (n, sx, sy) = summed(joint(component, cy, cx), n, sx, sy)
            component, cx, cy, at = component[rows], cx[rows], cy[rows], place[at]
            cells.append((component, cx, cy, n, sx, sy))
            if level and level % TILE == 0:
                asks.append((level // TILE, at))
        self.cells, self.asks = cells, asks
        of = [cells[group * TILE] for group, _ in asks]
        group = np.concatenate([np.full(len(c[0]), g, dtype=np.int64) for (g, _), c in zip(asks, of, strict=True)] or [np.zeros(0, dtype=np.int64)])
        self.asked = [group, *(np.concatenate([c[j] for c in of] or [group]) for j in range(6))]
        self.asked_to = setting.owner(self.asked[1], group, self.asked[2] >> TILE, self.asked[3] >> TILE)
        self.asked_order = np.argsort(self.asked_to, kind="stable")


def around(cells: list[tuple], setting: Setting) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells that tiles other than their own hear, with the receiver; first column: the level, and which of the tiles around."""
    to, out = [], []
    for level, (component, cx, cy, *sums) in enumerate(cells):
        group = level // TILE
        shift = (group + 1) * TILE - level
        low_x, high_x, low_y, high_y = ((2 * (c >> 1) + d) >> shift for c in (cx, cy) for d in (-2, 3))
        for side in range(9):
            tx, ty = low_x + side // 3, low_y + side % 3
            hear = np.flatnonzero((tx <= high_x) & (ty <= high_y) & ((tx != cx >> shift) | (ty != cy >> shift)))
            to.append(setting.owner(component[hear], group, tx[hear], ty[hear]))
            out.append([np.full(len(hear), level * 9 + side), *(c[hear] for c in (component, cx, cy, *sums))])
    to = np.concatenate(to)
    order = np.argsort(to, kind="stable")
    return to[order], [np.concatenate(c)[order] for c in zip(*out, strict=True)]


def asked(part: int, state: list[np.ndarray], rest: list[pa.Table], setting: Setting) -> pa.Table:
    """All rows that a part sends at the start of a round.  rest: rows of springs and wants that it keeps."""
    _, component, x, y = state
    q = Questions(component, x, y, setting)
    _, (places, to) = taken(rest[1], WANTS, 2)
    halo_to, halo = around(q.cells, setting)
    return pa.concat_tables([
        kept(STATE, part, *state), *rest,
        sent(ENDS, part, to, x[places], y[places]),
        sent(POINTS, part, q.to[q.order], *(c[q.order] for c in (component, x, y))),
        sent(ASKS, part, q.asked_to[q.asked_order], *(c[q.asked_order] for c in q.asked)),
        sent(HALO, part, halo_to, *halo),
    ])


# ---------------------------------------------------------------- what owners of tiles answer


#: Cells in a tile have numbers of two times six bits, from EDGE cells before the tile on.
EDGE, WIDE = 4, 64


def row_hits(key: np.ndarray, low: np.ndarray, width: int):
    """Places in sorted keys (with `width` high ones at their end) of up to `width` numbers from each of low on, and whose they are."""
    start = np.searchsorted(key, low)
    for i in range(width):
        who = np.flatnonzero(key[start + i] < low + width)
        yield who, start[who] + i


def tile_forces(group: int, component: np.ndarray, cx: np.ndarray, cy: np.ndarray, sums: list[np.ndarray], halo: list[np.ndarray], setting: Setting, x: np.ndarray | None = None, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What each row hears, in its tile's levels of the pyramid.  With x and y rows are points, which hear cells around them as well."""
    tx, ty = cx >> TILE, cy >> TILE
    first, tile, _ = summed(joint(component, ty, tx))
    tile_of, tile_x, tile_y = component[first], tx[first], ty[first]
    # cells of other tiles
    meta, h_of, hx, hy = halo[:4]
    shift, side = (group + 1) * TILE - meta // 9, meta % 9
    htx, hty = ((2 * (hx >> 1) - 2) >> shift) + side // 3, ((2 * (hy >> 1) - 2) >> shift) + side % 3
    both = joint(*(np.r_[a, b] for a, b in ((tile_of, h_of), (tile_y, hty), (tile_x, htx))))
    tiles, keys = both[: len(first)], both[len(first) :]  # tiles ascend
    at = np.minimum(np.searchsorted(tiles, keys), max(len(tiles) - 1, 0))
    here = np.flatnonzero(tiles[at] == keys) if len(tiles) else np.zeros(0, dtype=np.int64)
    level_of, h_tile = (meta // 9)[here], at[here]
    h_key = (h_tile * WIDE + (hy[here] - (hty[here] << shift[here]) + EDGE)) * WIDE + (hx[here] - (htx[here] << shift[here]) + EDGE)
    h_sums = [c[here] for c in halo[4:]]

    key = (tile * WIDE + (cy - (ty << TILE) + EDGE)) * WIDE + (cx - (tx << TILE) + EDGE)
    back, fx, fy = np.arange(len(key)), np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    for level in range(group * TILE, min((group + 1) * TILE, setting.levels)):
        if level > group * TILE:
            lx, ly = key % WIDE - EDGE, key // WIDE % WIDE - EDGE
            key = (key // WIDE // WIDE * WIDE + (ly >> 1) + EDGE) * WIDE + (lx >> 1) + EDGE
        rows, place, sums = summed(key, *sums)
        key, back = key[rows], place[back]
        h = np.flatnonzero(level_of == level)
        sources = np.r_[key, h_key[h]]
        rows, _, (n, sx, sy) = summed(sources, *(np.r_[a, b[h]] for a, b in zip(sums, h_sums, strict=True)))
        sources = np.r_[sources[rows], np.full(6, np.iinfo(np.int64).max)]
        mid_x, mid_y = sx / n, sy / n
        if x is not None and level == 0:
            for row in (-WIDE, 0, WIDE):
                start = np.searchsorted(sources, key + (row - 1))
                for i in range(3):
                    near = start + i
                    who = np.flatnonzero((sources[near] <= key + (row + 1))[back])
                    s = near[back[who]]
                    own = (sources[s] == key[back[who]]).astype(np.int64)  # without the point itself
                    count = n[s] - own
                    some = np.flatnonzero(count)
                    who, s, own, count = (c[some] for c in (who, s, own, count))
                    px, py = setting.pushed(x[who] - (sx[s] - own * x[who]) / count, y[who] - (sy[s] - own * y[who]) / count, count)
                    fx[who] += px
                    fy[who] += py
        # farther cells: children of what touches the parent, without what touches
        wide, up = setting.side * 2.0**level, (group + 1) * TILE - level
        lx, ly, of = key % WIDE, key // WIDE % WIDE, key // WIDE // WIDE
        at_x, at_y = (((t[of] << up) + c - EDGE) + 0.5 for t, c in ((tile_x, lx), (tile_y, ly)))
        at_x, at_y = at_x * wide, at_y * wide
        gx, gy = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        for row in range(-2, 4):
            qy = (ly & ~1) + row
            for who, s in row_hits(sources, (of * WIDE + qy) * WIDE + (lx & ~1) - 2, 6):
                far = np.flatnonzero((np.abs(sources[s] % WIDE - lx[who]) > 1) | (np.abs(qy[who] - ly[who]) > 1))
                who, s = who[far], s[far]
                px, py = setting.pushed(at_x[who] - mid_x[s], at_y[who] - mid_y[s], n[s])
                gx[who] += px
                gy[who] += py
        fx += gx[back]
        fy += gy[back]
    return fx, fy


def answered(part: int, table: pa.Table, setting: Setting) -> pa.Table:
    """The second half of a round: answers to what others asked, and pulls at the part's own points."""
    out = []
    _, halo = taken(table, HALO, 7)
    group_of = halo[0] // 9 // TILE

    def of(group: int) -> list[np.ndarray]:
        rows = np.flatnonzero(group_of == group)
        return [c[rows] for c in halo]

    to, (component, x, y) = taken(table, POINTS, 3)
    if len(to):
        fx, fy = tile_forces(0, component, setting.cell(x), setting.cell(y), [np.ones(len(x), dtype=np.int64), x, y], of(0), setting, x, y)
        out.append(sent(FORCES, part, to, fx, fy))
    to, asks = taken(table, ASKS, 7)
    if len(to):
        fx, fy = np.zeros(len(to), dtype=np.int64), np.zeros(len(to), dtype=np.int64)
        for group in np.unique(asks[0]):
            rows = np.flatnonzero(asks[0] == group)
            _, component, cx, cy, *sums = (c[rows] for c in asks)
            fx[rows], fy[rows] = tile_forces(int(group), component, cx, cy, sums, of(int(group)), setting)
        out.append(sent(HEARD, part, to, fx, fy))
    _, state = taken(table, STATE, 4)
    if len(state[0]):
        _, (ex, ey) = taken(table, ENDS, 2)
        _, arcs = taken(table, ARCS, 3)
        _, wants = taken(table, WANTS, 2)
        px, py = pulls(np.r_[state[2], ex], np.r_[state[3], ey], len(state[0]), arcs, setting)
        out += [kept(STATE, part, *state, px, py), kept(ARCS, part, *arcs), kept(WANTS, part, *wants)]
    return pa.concat_tables(out) if out else sent(STATE, part, np.zeros(0, dtype=np.int64))


def stepped(table: pa.Table, limit: float, setting: Setting) -> tuple[list[np.ndarray], list[pa.Table]]:
    """State and kept rows of a part at the end of a round; no point moves more than `limit`."""
    part = table["to"][0].as_py()
    _, (pid, component, x, y, px, py) = taken(table, STATE, 6)
    _, arcs = taken(table, ARCS, 3)
    _, wants = taken(table, WANTS, 2)
    q = Questions(component, x, y, setting)
    ends = np.r_[arcs[0], arcs[1]]
    springs = np.maximum(np.bincount(ends[ends < len(pid)], minlength=len(pid)), 1)
    moves = []
    for p, own, heard in zip((px, py), taken(table, FORCES, 2)[1], taken(table, HEARD, 2)[1], strict=True):
        force, far = np.zeros(len(pid), dtype=np.int64), np.zeros(len(q.asked[0]), dtype=np.int64)
        force[q.order] = own
        far[q.asked_order] = heard
        for group, at in q.asks:
            force += far[q.asked[0] == group][at]
        moves.append(p / springs + force)
    size, most = np.hypot(*moves), limit * setting.unit
    short = np.where(size > most, most / np.maximum(size, most), 1.0)
    x, y = (c + whole(m * short) for c, m in zip((x, y), moves, strict=True))
    return [pid, component, x, y], [kept(ARCS, part, *arcs), kept(WANTS, part, *wants)]


def places_of(state: list[np.ndarray]) -> pa.Table:
    pid, component, x, y = state
    return pa.table({"component": component, "pid": pid, "x": x, "y": y})


# ---------------------------------------------------------------- the rounds of a level


def curve(cx: Column, cy: Column) -> Column:
    """A number whose bits are those of both columns in turn: near cells have near numbers."""

    def apart(c: Column) -> Column:
        c = c + F.lit(1 << 30)
        for step, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
        return c

    return apart(cx).bitwiseOR(F.shiftleft(apart(cy), 1))


def dealt_parts(places: DataFrame, springs: DataFrame, side: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """Points with their part, and springs with the parts of both ends, a row for each part that knows them."""
    if parts == 1:
        return places.withColumn("part", F.lit(0)), springs.select("u", "v", "rest", F.lit(0).alias("pu"), F.lit(0).alias("pv"), F.lit(0).alias("part"))
    cx, cy = (F.floor(F.col(c) / side) for c in "xy")
    ranged = cut(places.repartitionByRange(parts, "component", curve(cx, cy), "pid").withColumn("part", F.spark_partition_id()))
    a, b = (ranged.select(F.col("pid").alias(end), F.col("part").alias(f"p{end}")) for end in "uv")
    ends = springs.join(dealt(a), "u").join(dealt(b), "v")
    return ranged, ends.select("u", "v", "rest", "pu", "pv", F.explode(F.array_distinct(F.array("pu", "pv"))).alias("part"))


def rounds(places: DataFrame, springs: DataFrame, limits: list[float], setting: Callable[[int], Setting], size: int = PART) -> DataFrame:
    """component, pid, x, y after a round for each limit.  places: component (long), pid, x, y; springs: u, v, rest; setting: from the number of parts."""
    parts = -(-places.count() // size) or 1
    s = setting(parts)
    points, arcs = dealt_parts(places.select("component", "pid", "x", "y"), springs, s.side, parts)
    both = points.groupBy("part").cogroup(arcs.groupBy("part"))

    def all_rounds(key: tuple, points: pa.Table, arcs: pa.Table) -> pa.Table:
        state, rest = begun(0, points, arcs)
        for limit in limits:
            state, rest = stepped(answered(0, asked(0, state, rest, s), s), limit, s)
        return places_of(state)

    def start(key: tuple, points: pa.Table, arcs: pa.Table) -> pa.Table:
        part = key[0].as_py()
        state, rest = begun(part, points, arcs)
        return asked(part, state, rest, s)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return answered(key[0].as_py(), table, s)

    def step(limit: float, last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            state, rest = stepped(table, limit, s)
            return places_of(state) if last else asked(key[0].as_py(), state, rest, s)

        return run

    if parts == 1:
        return cut(both.applyInArrow(all_rounds, PLACES))
    rows = both.applyInArrow(start, ROWS)
    for n, limit in enumerate(limits):
        last = n == len(limits) - 1
        rows = rows.groupBy("to").applyInArrow(answer, ROWS)
        rows = rows.groupBy("to").applyInArrow(step(limit, last), PLACES if last else ROWS)
        if last or n % AT_ONCE == AT_ONCE - 1:
            rows = cut(rows)
    return rows
