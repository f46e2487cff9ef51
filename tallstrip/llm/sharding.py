"""Shards of nearly equal bytes by a histogram sort.

Documents have a key: 60 bits of their text's MD5, then their id, then a number of their row. Bytes and rows below
candidate boundaries are counted exactly, each partition its own part and the parts summed up; brackets around the wanted
places shrink to where the counts say they lie, until the splitters meet the tolerance. One exchange then brings the rows
to their shards. What is counted again and again is a slim table without texts.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import settle

#: Hex digits of the digest in a key, and of these the ones that make a cell; every bracket lies in one cell.
DIGITS, CELL_DIGITS = 15, 3
CELLS, CELL_WIDTH = 16**CELL_DIGITS, 16 ** (DIGITS - CELL_DIGITS)
#: Numbers of rows are dealt by the first two hex digits and the id, so that a frequent text's rows are numbered in parts.
PARTS = 16
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Params:
    """shards: how many. overhead: bytes that a document counts beyond its text. tolerance: a splitter may be so large a
    share of a shard's bytes away from its place; 0: it is the boundary between two rows that lies nearest. probes:
    boundaries tried in a bracket in each round. few: rows in a bracket that are looked at one by one in the end."""

    shards: int = 40
    overhead: int = 16
    tolerance: float = 0.0
    probes: int = 256
    few: int = 500


@dataclass
class Bracket:
    """Rows with their key's part `level` in [low, high) and the parts before it as in `fixed`; bytes below them, and how
    many rows they are."""

    cell: int
    level: int
    fixed: tuple[int, ...]
    low: int
    high: int
    below: int
    rows: int

    def step(self, probes: int) -> int:
        return max(1, -(-(self.high - self.low) // probes))


KEY = ("k1", "k2", "k3")
BRACKET = "cell int, bracket int, level int, f1 bigint, f2 bigint, low bigint, high bigint, step bigint"


def keyed(documents: DataFrame, params: Params, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2, k3) of each row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    id_ = F.col(id_column).cast("long")
    digest = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    return documents.select(
        id_.alias("doc_id"),
        (F.octet_length(text).cast("long") + params.overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        digest.alias("k1"),
        F.coalesce(id_, F.lit(LEAST)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )


def _cell() -> Column:
    return F.expr(f"cast(k1 div {CELL_WIDTH} as int)")


def _sums() -> list[Column]:
    ends = [f(k).alias(f"{name}_{k}") for k in KEY for name, f in (("min", F.min), ("max", F.max))]
    return [F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends]


def _inside(rows: DataFrame, brackets: list[Bracket], probes: int) -> DataFrame:
    """The rows of the brackets, with bracket and part (which probes they lie between); brackets: a few per shard."""
    held = [(b.cell, i, b.level, *[*b.fixed, 0, 0][:2], b.low, b.high - 1, b.step(probes)) for i, b in enumerate(brackets)]
    table = rows.sparkSession.createDataFrame(held, BRACKET)
    value = F.when(F.col("level") == 0, F.col("k1")).when(F.col("level") == 1, F.col("k2")).otherwise(F.col("k3"))
    met = rows.withColumn("cell", _cell()).join(F.broadcast(table), "cell")
    met = met.where(((F.col("level") < 1) | (F.col("k1") == F.col("f1"))) & ((F.col("level") < 2) | (F.col("k2") == F.col("f2"))) & (value >= F.col("low")) & (value <= F.col("high")))
    return met.withColumn("part", F.expr("0L") + F.floor((value.cast("decimal(20,0)") - F.col("low")) / F.col("step")).cast("long"))


def _narrowed(cell: int, below: int, part) -> Bracket:
    """A bracket as tight as the ends of its rows' keys say."""
    ends = [(part[f"min_{k}"], part[f"max_{k}"]) for k in KEY]
    level = next((i for i, (low, high) in enumerate(ends) if low < high), 2)
    return Bracket(cell, level, tuple(low for low, _ in ends[:level]), ends[level][0], ends[level][1] + 1, below, part["rows"])


def _located(parts: list, below: int, wanted: float, allowed: float) -> tuple[int | None, int]:
    """Which of the parts (in order of keys) holds the wanted place, None if an end of one is near enough, and the bytes
    below that part or end."""
    for i, part in enumerate(parts):
        after = below + part["bytes"]
        if wanted < after or i + 1 == len(parts):
            if allowed and min(wanted - below, after - wanted) <= allowed:
                return (None, below) if wanted - below <= after - wanted else (None, after)
            return i, below
        below = after
    return None, below


def splitters(rows: DataFrame, params: Params = Params()) -> list[tuple[int, int, int] | None]:
    """The key at which each shard but the first begins; None: at the end of all rows.

    The driver sees sums for a fixed number of cells, then for `probes` parts a splitter and round, and in the end
    `few` rows a splitter; none of these grow with the rows.
    """
    cells = sorted(rows.withColumn("cell", _cell()).groupBy("cell").agg(*_sums()).collect(), key=lambda r: r["cell"])
    total = sum(r["bytes"] for r in cells)
    wanted = {j: total * j for j in range(1, params.shards)}  # in bytes times shards
    allowed = params.tolerance * total
    found: dict[int, tuple[int, int, int] | None] = {}
    open_: dict[int, Bracket] = {}

    def settle_on(j: int, parts: list, cell_of, below: int) -> None:
        scaled = [{"bytes": p["bytes"] * params.shards} for p in parts]
        i, at = _located(scaled, below * params.shards, wanted[j], allowed)
        if i is not None:
            open_[j] = _narrowed(cell_of(parts[i]), at // params.shards, parts[i])
            return
        open_.pop(j, None)
        ahead = below
        for p in parts:
            if ahead * params.shards == at:
                found[j] = tuple(p[f"min_{k}"] for k in KEY)
                return
            ahead += p["bytes"]
        after = _first_after(rows, tuple(parts[-1][f"max_{k}"] for k in KEY)) if parts else None
        found[j] = after

    for j in wanted if cells else ():
        settle_on(j, cells, lambda p: p["cell"], 0)
    while any(b.rows > params.few for b in open_.values()):
        wide = {j: b for j, b in open_.items() if b.rows > params.few}
        distinct = list({(b.cell, b.level, b.fixed, b.low, b.high): b for b in wide.values()}.values())
        got = _inside(rows, distinct, params.probes).groupBy("bracket", "part").agg(*_sums()).collect()
        parts: dict[int, list] = {}
        for r in sorted(got, key=lambda r: (r["bracket"], r["part"])):
            parts.setdefault(r["bracket"], []).append(r)
        number = {(b.cell, b.level, b.fixed, b.low, b.high): i for i, b in enumerate(distinct)}
        for j, b in wide.items():
            settle_on(j, parts[number[b.cell, b.level, b.fixed, b.low, b.high]], lambda p, b=b: b.cell, b.below)
    if open_:
        distinct = list({(b.cell, b.level, b.fixed, b.low, b.high): b for b in open_.values()}.values())
        number = {(b.cell, b.level, b.fixed, b.low, b.high): i for i, b in enumerate(distinct)}
        last: dict[int, list] = {}
        for r in _inside(rows, distinct, params.probes).select("bracket", *KEY, "size").collect():
            last.setdefault(r["bracket"], []).append(r)
        for own in last.values():
            own.sort(key=lambda r: (r["k1"], r["k2"], r["k3"]))
        for j, b in open_.items():
            own, below = last[number[b.cell, b.level, b.fixed, b.low, b.high]], b.below
            for r in own:
                if (2 * below + r["size"]) * params.shards >= 2 * wanted[j]:  # its middle lies behind the wanted place
                    found[j] = (r["k1"], r["k2"], r["k3"])
                    break
                below += r["size"]
            else:
                found[j] = _first_after(rows, tuple(own[-1][k] for k in KEY))
    return [found.get(j) for j in wanted]


def _first_after(rows: DataFrame, key: tuple[int, int, int]) -> tuple[int, int, int] | None:
    """The least key behind this one."""
    k = F.struct(*KEY)
    least = rows.where(k > F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(KEY, key, strict=True)])).agg(F.min(k).alias("k")).first()["k"]
    return tuple(least) if least else None


def _with_shard(rows: DataFrame, cuts: list[tuple[int, int, int] | None]) -> DataFrame:
    """Adds shard: how many splitters are not above the key. By cells, so that a row is compared with its cell's only."""
    real = sorted(c for c in cuts if c is not None)
    own: dict[int, list] = {}
    for c in real:
        own.setdefault(c[0] // CELL_WIDTH, []).append(c)
    firsts = [c[0] // CELL_WIDTH for c in real]
    table = rows.sparkSession.createDataFrame([(cell, bisect_right(firsts, cell - 1), own.get(cell, [])) for cell in range(CELLS)], "cell int, before int, cuts array<struct<k1: bigint, k2: bigint, k3: bigint>>")
    met = rows.withColumn("cell", _cell()).join(F.broadcast(table), "cell")
    key = F.struct(*KEY)
    return met.withColumn("shard", F.col("before") + F.size(F.filter("cuts", lambda c: c <= key))).drop("cell", "before", "cuts")


def histogram_shards(documents: DataFrame, params: Params = Params(), *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row, shards of nearly equal sizes, slots from 0 without gaps.

    Shards are ranges of the key, so equal texts are neighbours and a group of them is cut only where a splitter lies in
    it. With tolerance 0 a row belongs to the shard in which the middle of its bytes lies, all rows being laid end to end
    in order of the key. A null text counts as an empty one; a null id comes before others; repeated rows stay, each with
    a place of its own. A document larger than a shard's share leaves the next shards less or nothing. No documents give
    no rows; other columns are not read.
    """
    rows = settle(keyed(documents, params, id_column, text_column), "keys")
    placed = _with_shard(rows, splitters(rows, params)).withColumns({"deal": F.expr(f"cast(k1 div {16 ** (DIGITS - 2)} as int)"), "turn": F.pmod("k2", F.lit(PARTS)).cast("int")})
    counts = placed.groupBy("shard", "deal", "turn").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("deal", "turn")
    starts = counts.select("shard", "deal", "turn", (F.sum("n").over(order) - F.col("n")).alias("start"))
    own = F.row_number().over(Window.partitionBy("shard", "deal", "turn").orderBy(*KEY))
    numbered = placed.withColumn("own", own).join(F.broadcast(starts), ["shard", "deal", "turn"])  # at most 256 * PARTS rows and PARTS a shard
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("own") - 1).cast("long").alias("slot"))


#: The rows that the query returns, as DuckDB has them: rows laid end to end, a shard where a row's middle lies. CRC-32
#: comes from its table, whose entries are eight steps of division.
SQL = """
WITH RECURSIVE division AS (
  SELECT i AS entry, CAST(i AS BIGINT) AS c, 0 AS n FROM range(256) r(i)
  UNION ALL SELECT entry, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM division WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY entry) AS entries FROM division WHERE n = 8
), sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, coalesce(text, '') AS said, substr(md5(coalesce(text, '')), 1, 15) AS k
  FROM documents
), laid AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized
), dealt AS (
  SELECT *, CAST(((2 * before + size) * 40) // (2 * total) AS INTEGER) AS shard, ((coalesce(doc_id, -9223372036854775808) % 16) + 16) % 16 AS turn FROM laid
)
SELECT doc_id, size,
  CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(said)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(k, 1, 2), turn, k, doc_id NULLS FIRST) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, crc
"""
