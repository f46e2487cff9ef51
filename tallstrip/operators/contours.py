"""Outlines of masks in order, over bands.

An outline is walked along the sides where a pixel of the mask meets one outside it. Each side has exactly one that
follows, so the sides form closed loops: one around every 8-connected part, and one inside every hole. A band links its own
sides and ranks them along their chains; only chains that leave their band are joined across bands, by doubling pointers,
in a table with a row per chain. A pixel is a point of its outline once for each time the loop comes by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import discard, settle
from .bands import Bands, _joined, _with_halo

#: The sides of a pixel: north, east, south, west, as offsets of the neighbour outside; a side is walked towards the next.
SIDES = ((-1, 0), (0, 1), (1, 0), (0, -1))


def side_ids(y: np.ndarray, x: np.ndarray, side: int | np.ndarray) -> np.ndarray:
    """A number for a side of a pixel of an image."""
    return ((y.astype(np.int64) << 31) + x) * 4 + side


def linked(on: np.ndarray, above: int, rows: int, y0: int) -> dict[str, np.ndarray]:
    """The sides of a band's own pixels (rows `above` to `above + rows` of on): y, x, side, id, the id and the place (here,
    or -1) of what follows, and whether the pixel changes with it."""
    area = np.pad(on, 1)
    own = np.zeros(area.shape, bool)
    own[1 + above : 1 + above + rows, 1:-1] = True
    there = np.full((4, *area.shape), -1, np.int64)
    parts, count = [], 0
    for side, (dy, dx) in enumerate(SIDES):
        y, x = np.nonzero(area & own & ~np.roll(area, (-dy, -dx), (0, 1)))
        there[side, y, x] = np.arange(count, count + len(y))
        count += len(y)
        parts.append((y, x, np.full(len(y), side)))
    y, x, side = (np.concatenate(p) for p in zip(*parts, strict=True))
    normal = np.array(SIDES)
    n, t = normal[side], normal[(side + 1) % 4]
    ahead = area[y + n[:, 0] + t[:, 0], x + n[:, 1] + t[:, 1]]
    level = ~ahead & area[y + t[:, 0], x + t[:, 1]]
    ny = y + np.where(ahead, n[:, 0], 0) + np.where(ahead | level, t[:, 0], 0)
    nx = x + np.where(ahead, n[:, 1], 0) + np.where(ahead | level, t[:, 1], 0)
    nside = np.where(ahead, (side + 3) % 4, np.where(level, side, (side + 1) % 4))
    real = y0 - above - 1  # row of the image at the padded area's first row
    return {"y": y + real, "x": x - 1, "side": side, "id": side_ids(y + real, x - 1, side), "next_id": side_ids(ny + real, nx - 1, nside), "next": np.where(own[ny, nx], there[nside, ny, nx], -1), "turns": ahead | level}


def ranked(following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element of chains (-1: the chain ends) and loops: its chain's first element (a loop's least), how far it is
    from that, and whether it is in a loop. Pointers are doubled, so a chain of any length takes a few passes."""
    n = len(following)
    ends = following < 0
    if n == 0:
        return following, following, ends
    at = np.where(ends, np.arange(n), following)
    least, jump = np.minimum(np.arange(n), at), at
    for _ in range(int(n).bit_length()):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    loop = ~ends[jump]
    cut = loop & (least[at] == at)  # a loop is opened before its least element
    stop = ends | cut
    far, jump = np.where(stop, 0, 1), np.where(stop, np.arange(n), at)
    while True:
        more = far[jump]
        if not more.any():
            break
        far, jump = far + more, jump[jump]
    length = np.zeros(n, np.int64)
    np.maximum.at(length, jump, far)
    head = np.zeros(n, np.int64)
    first = far == length[jump]
    head[jump[first]] = np.flatnonzero(first)
    return head[jump], length[jump] - far, loop


_CHAINS = "chain bigint, follows bigint, n bigint, sy bigint, sx bigint, sat bigint, sside int, chained boolean, off bigint, y int, x int, back int"


def _chains(b: Bands, mask: str) -> DataFrame:
    """A row per chain (chained: its first side's id, the side it leads to or null for a loop, sides, and the first of its
    upright sides in reading order with its distance), and a row for each point of a chain (back: sides of this pixel that
    come before it without a break)."""
    planes = b.pick(mask).planes

    def work(key, table):
        found = _joined(table, planes, (mask,))
        schema = {"chain": pa.int64(), "follows": pa.int64(), "n": pa.int64(), "sy": pa.int64(), "sx": pa.int64(), "sat": pa.int64(), "sside": pa.int32(), "chained": pa.bool_(), "off": pa.int64(), "y": pa.int32(), "x": pa.int32(), "back": pa.int32()}
        img = table.column("img").type

        def out(columns: dict) -> pa.Table:
            size = len(columns["chain"])
            return pa.table({"img": pa.array([key[0].as_py()] * size, img)} | {c: pa.array(columns[c], kind) if c in columns else pa.nulls(size, kind) for c, kind in schema.items()})

        if found is None:
            return out({"chain": []})
        y0, n, above, _, near, _ = found
        s = linked(near[mask] > 0, above, n, y0)
        head, off, loop = ranked(s["next"])
        if not len(head):
            return out({"chain": []})
        chain = s["id"][head]
        last = np.zeros(len(head), np.int64)
        order = np.lexsort((off, head))
        ends = np.append(np.flatnonzero(np.diff(head[order])), len(order) - 1)
        last[head[order][ends]] = order[ends]
        firsts = head[order][ends]
        upright = np.flatnonzero(s["side"] % 2 == 1)
        place = s["x"][upright] + (s["side"][upright] == 1)
        upright = upright[np.lexsort((place, s["y"][upright], head[upright]))]
        new = np.ones(len(upright), bool)
        new[1:] = head[upright][1:] != head[upright][:-1]
        start = np.full(len(head), -1, np.int64)
        start[head[upright[new]]] = upright[new]
        at = start[firsts]
        has = at >= 0
        some = lambda values: pa.array(np.where(has, values, 0), pa.int64(), mask=~has)
        chains = out({
            "chain": s["id"][firsts], "follows": pa.array(s["next_id"][last[firsts]], pa.int64(), mask=loop[firsts]), "n": off[last[firsts]] + 1,
            "sy": some(s["y"][at]), "sx": some(s["x"][at] + (s["side"][at] == 1)), "sat": some(off[at]), "sside": pa.array(np.where(has, s["side"][at], 0), pa.int32(), mask=~has),
            "chained": np.ones(len(firsts), bool),
        })
        same = np.zeros(len(head), np.int32)  # the side that comes before is of the same pixel
        inner = np.flatnonzero(~s["turns"])
        same[s["next"][inner]] = 1
        back, before = same.copy(), np.full(len(head), -1, np.int64)
        before[s["next"][inner]] = inner
        for _ in range(2):
            back = np.where(same > 0, 1 + back[before], 0).astype(np.int32)
        kept = np.flatnonzero(s["turns"])
        points = out({"chain": chain[kept], "chained": np.zeros(len(kept), bool), "off": off[kept], "y": s["y"][kept], "x": s["x"][kept], "back": back[kept]})
        return pa.concat_tables([chains, points])

    return _with_halo(b.pick(mask), 1, (mask,)).groupBy("img", "band").applyInArrow(work, f"img {b.key}, {_CHAINS}")


def _doubled(chains: DataFrame) -> DataFrame:
    """(img, chain, outline, pos): the least chain of each loop of chains (img, chain, follows, n), and the sides between
    its first one and this chain's. Each round doubles how far a chain sees and writes the table anew."""
    state = settle(chains.select("img", "chain", F.col("follows").alias("to"), F.least("chain", "follows").alias("least")), "loops")
    while True:
        ahead = state.select("img", F.col("chain").alias("to"), F.col("least").alias("l2"), F.col("to").alias("t2"))
        after = settle(state.join(ahead, ["img", "to"]).select("img", "chain", F.col("t2").alias("to"), F.least("least", "l2").alias("least")), "loops")
        discard(state)
        state = after
        direct = chains.select("img", "chain", F.col("follows").alias("f")).join(state.select("img", "chain", "least"), ["img", "chain"])
        open_ = direct.join(state.select("img", F.col("chain").alias("f"), F.col("least").alias("l2")), ["img", "f"]).where("least != l2")
        if open_.isEmpty():
            break
    whole = state.select("img", "chain", F.col("least").alias("outline"))
    cut = F.when(F.col("follows") == F.col("outline"), F.lit(None)).otherwise(F.col("follows"))
    left = settle(chains.join(whole, ["img", "chain"]).select("img", "chain", "outline", cut.alias("to"), F.col("n").alias("rest")), "ranks")
    while not left.where("`to` IS NOT NULL").isEmpty():
        ahead = left.select("img", F.col("chain").alias("to"), F.col("rest").alias("r2"), F.col("to").alias("t2"))
        after = settle(left.join(ahead, ["img", "to"], "left").select("img", "chain", "outline", F.col("t2").alias("to"), (F.col("rest") + F.coalesce("r2", F.lit(0))).alias("rest")), "ranks")
        discard(left)
        left = after
    total = left.where(F.col("chain") == F.col("outline")).select("img", "outline", F.col("rest").alias("total"))
    return left.join(total, ["img", "outline"]).select("img", "chain", "outline", (F.col("total") - F.col("rest")).alias("pos"))


def outlines(b: Bands, mask: str) -> DataFrame:
    """(img, outline, ord, y, x, hole): the points of every outline of the mask, in order from the first in reading order,
    parts against the clock and holes with it; neighbours in the order touch, and the last touches the first. outline
    is the number of the side at which it begins, whatever the bands are. Masks without pixels have no outlines; a single
    pixel's has one point."""
    rows = settle(_chains(b, mask), "chains")
    chains = rows.where("chained").select("img", "chain", "follows", "n", "sy", "sx", "sat", "sside")
    joined = _doubled(chains.where("follows IS NOT NULL"))
    placed = chains.join(joined, ["img", "chain"], "left").select("img", "chain", F.coalesce("outline", "chain").alias("outline"), F.coalesce("pos", F.lit(0)).alias("pos"), "n", "sy", "sx", "sat", "sside")
    placed = settle(placed, "placed")
    first = F.min(F.when(F.col("sy").isNotNull(), F.struct("sy", "sx", "sside", (F.col("pos") + F.col("sat")).alias("at"))))
    wholes = placed.groupBy("img", "outline").agg(F.sum("n").alias("size"), first.alias("s"))
    wholes = wholes.select("img", "outline", "size", F.col("s.at").alias("start"), F.col("s.sy").cast("int").alias("sy"), (F.col("s.sx") - (F.col("s.sside") == 1).cast("int")).cast("int").alias("sx"), (F.col("s.sside") == 1).alias("hole"))
    number = (F.shiftleft(F.col("sy").cast("long"), 31) + F.col("sx")) * 4 + F.when(F.col("hole"), 1).otherwise(3)
    wholes = settle(wholes.withColumn("first", number), "wholes")
    points = rows.where("NOT chained").select("img", "chain", "off", "y", "x", "back").join(placed.select("img", "chain", "outline", "pos"), ["img", "chain"]).join(wholes, ["img", "outline"])
    behind = F.pmod(F.col("pos") + F.col("off") - F.col("start"), F.col("size"))  # sides between the first point's and this one
    points = points.withColumn("behind", behind).where((F.col("behind") == 0) | (F.col("y") != F.col("sy")) | (F.col("x") != F.col("sx")) | (F.col("behind") > F.col("back")))
    rest = points.where("behind > 0").select("img", F.col("first").alias("outline"), (F.col("size") - F.col("behind")).alias("ord"), "y", "x", "hole")
    starts = wholes.select("img", F.col("first").alias("outline"), F.lit(0).cast("long").alias("ord"), F.col("sy").alias("y"), F.col("sx").alias("x"), "hole")
    return starts.unionByName(rest)


def resampled(points: DataFrame, stride: float = 40.0) -> DataFrame:
    """(img, outline, k, y, x): points of closed outlines, evenly spaced along their lengths, as many as strides fit in (one
    at least). A target goes to the first point that the length has reached. Outlines of one point have none. Straight and
    slanting steps are counted apart, so lengths don't depend on the order of additions."""
    order = Window.partitionBy("img", "outline").orderBy("ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ny, nx = F.coalesce(F.lead("y").over(order), F.first("y").over(whole)), F.coalesce(F.lead("x").over(order), F.first("x").over(whole))
    steps = points.withColumns({"slant": F.when((ny != F.col("y")) & (nx != F.col("x")), 1).otherwise(0).cast("long"), "straight": F.when((ny != F.col("y")) != (nx != F.col("x")), 1).otherwise(0).cast("long")})
    length = lambda a, b: a + b * F.sqrt(F.lit(2.0))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("img", "outline")
    sums = steps.withColumns({
        "cum": length(F.coalesce(F.sum("straight").over(upto), F.lit(0)), F.coalesce(F.sum("slant").over(upto), F.lit(0))),
        "total": length(F.sum("straight").over(every), F.sum("slant").over(every)),
        "size": F.count("*").over(every),
        "last": F.lead("ord").over(order).isNull(),
    }).where("size >= 2 AND total >= 1")
    along = sums.withColumns({"n": F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / stride)), "before": F.coalesce(F.lag("cum").over(order), F.lit(-1.0))})
    gap = F.col("total") / F.col("n")
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.col("before") / gap))
    high = F.when(F.col("last"), F.col("n") - 1).otherwise(F.least(F.col("n") - 1, F.floor(F.col("cum") / gap) + 1))
    tried = along.withColumns({"gap": gap, "low": low, "high": high}).where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    target = F.col("k") * F.col("gap")
    return tried.where((target > F.col("before")) & (F.col("last") | (target <= F.col("cum")))).select("img", "outline", "k", "y", "x")
