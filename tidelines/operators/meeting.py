"""Where pairs meet: pairs of histories that agree on some date, found and counted from bits, and both histories beside a pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage_cut import cut
from .order import position

#: Dates in one integer of a mask.
WORD = 62
#: Members of a (date, value) that meet in one tile; a merge join keeps so many rows in memory.
WIDTH = 2000
#: Histories of up to so many entries in all are sent to every task; more are dealt by id.
BROADCAST_ENTRIES = 1_000_000
#: Masks of up to so many integers in all are sent to every task.
BROADCAST_LONGS = 4_000_000
#: Meetings under keys that cost as much as comparing all pairs of a list in memory.
DENSE = 4
#: Equal histories in one unit, which is compared once for all of them.
UNIT = 256


def _tasks(spark: SparkSession) -> int:
    """Partitions for work on pairs, which is larger than the bytes from which Spark would choose them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def tiles(rows: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """rows twice, dealt so that any two rows of a key meet once under (*keys, t1, t2), in tiles of about width rows.

    Tile t meets itself and the later ones, so rows of two tiles meet in one order, and rows of one tile in both.
    """
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("tiles"))
    dealt = rows.join(n, keys).withColumn("t", F.pmod(F.xxhash64("role_id", F.lit(7)), "tiles").cast("int"))
    parts, to = _tasks(rows.sparkSession), [*keys, "t1", "t2"]
    a = dealt.withColumns({"t1": F.col("t"), "t2": F.explode(F.sequence("t", F.col("tiles") - 1))}).drop("t", "tiles")
    b = dealt.withColumns({"t2": F.col("t"), "t1": F.explode(F.sequence(F.lit(0), "t"))}).drop("t", "tiles")
    return a.repartition(parts, *to), b.repartition(parts, *to)


def ordered(one: str = "id1", other: str = "id2") -> tuple[Column, Column, Column]:
    """For rows of two tiles that meet: whether to take them, and the smaller and the greater id."""
    return F.when(F.col("t1") == F.col("t2"), F.col(one) < F.col(other)).otherwise(F.col(one) != F.col(other)), F.least(one, other), F.greatest(one, other)


@dataclass
class Masks:
    """Histories as bits: a row by known cell (role_id, at, code), and a row by role with a mask of its dates and one of each bit of its values' numbers."""

    coded: DataFrame
    rows: DataFrame
    words: range
    bits: int

    @property
    def names(self) -> list[str]:
        return [f"k{w}" for w in self.words] + [f"v{w}_{p}" for w in self.words for p in range(self.bits)]

    def side(self, rows: DataFrame, n: int, *more) -> DataFrame:
        return rows.select(F.col("role_id").alias(f"id{n}"), *[F.col(c).alias(f"{c}_{n}") for c in self.names], *more)

    def both(self) -> list[Column]:
        """By word, the dates on which both sides have a value."""
        return [F.col(f"k{w}_1").bitwiseAND(F.col(f"k{w}_2")) for w in self.words]

    def agree(self) -> list[Column]:
        """By word, the dates on which both sides have the same value."""
        differ = [reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"v{w}_{p}_1").bitwiseXOR(F.col(f"v{w}_{p}_2")) for p in range(self.bits)]) for w in self.words]
        return [x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(self.both(), differ, strict=True)]


def masks(cells: DataFrame) -> Masks:
    """cells: role_id, d, value; one by role and date, a null value equals itself."""
    cells = cut(cells.select("role_id", "d", "value"))
    dates = [r["d"] for r in cells.select("d").distinct().orderBy("d").collect()]  # bounded by the frame
    numbered = position(cells.select("value").distinct(), [F.col("value")], "code")
    bits = max(1, int(numbered.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]).bit_length())
    at = (F.array_position(F.lit(dates).cast("array<date>"), F.col("d")) - 1).cast("int") if dates else F.lit(0)
    coded = cells.join(numbered.withColumnRenamed("value", "v"), F.col("value").eqNullSafe(F.col("v"))).select("role_id", at.alias("at"), "code")
    words = range(-(-len(dates) // WORD) or 1)
    here = lambda w: F.floor(F.col("at") / WORD) == w
    mask = lambda test: F.coalesce(F.bit_or(F.when(test, F.expr(f"shiftleft(1L, at % {WORD})"))), F.lit(0).cast("bigint"))
    rows = coded.groupBy("role_id").agg(*[mask(here(w)).alias(f"k{w}") for w in words], *[mask(here(w) & (F.shiftright("code", p).bitwiseAND(F.lit(1)) == 1)).alias(f"v{w}_{p}") for w in words for p in range(bits)])
    return Masks(coded, rows, words, bits)


def units(rows: DataFrame, keys: list[str]) -> DataFrame:
    """role_id, *keys, ids: a row by roles with equal keys, in units of up to about UNIT; ids has them all, role_id is the smallest."""
    h = rows.withColumn("__h", F.xxhash64(*keys))
    parts = h.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > UNIT).select("__h", F.ceil(F.col("__n") / UNIT).alias("__parts"))
    dealt = h.join(parts, "__h", "left").withColumn("__part", F.pmod(F.xxhash64("role_id", F.lit(11)), F.coalesce("__parts", F.lit(1))))
    return dealt.groupBy("__h", *keys, "__part").agg(F.min("role_id").alias("role_id"), F.collect_list("role_id").alias("ids")).select("role_id", *keys, "ids")


def members(found: DataFrame, selves: bool = False, swapped: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """found: id1, id2 of units, their ids_1 and ids_2, and more; a row by pair of their members, id1 < id2 (selves: or the same).

    swapped: columns of the two sides, which change places where the members' order isn't the units'.
    """
    more = [c for c in found.columns if c not in ("id1", "id2", "ids_1", "ids_2")]
    x = found.select((F.col("id1") == F.col("id2")).alias("__same"), "ids_2", *more, F.explode("ids_1").alias("__x")).select("__same", "__x", *more, F.explode("ids_2").alias("__y"))
    x = x.where(~F.col("__same") | ((F.col("__x") <= F.col("__y")) if selves else (F.col("__x") < F.col("__y"))))
    other = dict(swapped) | {b: a for a, b in swapped}
    keep = [F.when(F.col("__x") <= F.col("__y"), F.col(c)).otherwise(F.col(other[c])).alias(c) if c in other else F.col(c) for c in more]
    return x.select(F.least("__x", "__y").alias("id1"), F.greatest("__x", "__y").alias("id2"), *keep)


def by_histories(lineage: DataFrame, f: Callable[[DataFrame], DataFrame], swapped: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """f's rows for all pairs of roles, made once for any two different histories.

    f gives rows of pairs id1 <= id2 of the histories it gets, a history with itself included; they may depend on the two
    histories, not on their ids. Roles with equal entries are sent to f as one, and its rows are multiplied by their roles at the end.
    """
    fields = [c for c in lineage.columns if c != "role_id"]
    by_role = lineage.groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__e"))
    one = cut(units(by_role, ["__e"]))
    rows = f(one.select("role_id", F.explode("__e").alias("__e")).select("role_id", *[F.col(f"__e.{c}").alias(c) for c in fields]))
    many = one.where(F.size("ids") > 1).select("role_id", "ids")
    n = many.agg(F.sum(F.size("ids"))).first()[0]
    if not n:
        return rows.where("id1 < id2")
    for i in ("1", "2"):
        side = many.select(F.col("role_id").alias(f"id{i}"), F.col("ids").alias(f"ids_{i}"))
        rows = rows.join(F.broadcast(side) if n <= BROADCAST_ENTRIES else side, f"id{i}", "left").withColumn(f"ids_{i}", F.coalesce(f"ids_{i}", F.array(f"id{i}")))
    return members(rows, swapped=swapped)


def agreements(cells: DataFrame, width: int = WIDTH, selves: bool = False) -> DataFrame:
    """id1 < id2, agreed, shared of the pairs that agree: on how many dates both have the same value, and on how many both have one.

    Histories with equal masks meet others as one unit. Units meet under each (date, value) that they share, with their masks; they
    are taken at the first of these, so that no pair is shuffled or counted in a table. Where a large part of all pairs would meet
    so, and the masks are small, each unit is compared with all others instead. selves: a history also agrees with itself.
    """
    m = masks(cells)
    total = lambda xs: reduce(lambda x, y: x + y, [F.bit_count(x) for x in xs]).cast("bigint")
    rows = cut(units(m.rows, m.names).withColumn("n", F.monotonically_increasing_id()))
    coded = m.coded.join(rows.select("role_id"), "role_id", "left_semi")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    n, met = size["n"], coded.groupBy("at", "code").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0
    ids = lambda i: F.col("ids").alias(f"ids_{i}")
    if n * len(m.names) <= BROADCAST_LONGS and size["ids"] <= BROADCAST_ENTRIES and met * DENSE >= n * n:
        some = reduce(lambda x, y: x | y, [x != 0 for x in m.agree()])
        one, other = m.side(rows.repartition(_tasks(rows.sparkSession)), 1, ids(1), F.col("n").alias("n1")), m.side(rows, 2, ids(2), F.col("n").alias("n2"))
        found = one.join(F.broadcast(other), (F.col("n1") <= F.col("n2")) & some)
        return members(found.select("id1", "id2", "ids_1", "ids_2", total(m.agree()).alias("agreed"), total(m.both()).alias("shared")), selves)
    a, b = tiles(coded.join(rows.drop("n"), "role_id"), ["at", "code"], width)
    keys = ["at", "code", "t1", "t2"]
    word = F.floor(F.col("at") / WORD)
    below = [F.when(word > w, F.lit(-1).cast("bigint")).when(word == w, F.expr(f"shiftleft(1L, at % {WORD}) - 1")).otherwise(F.lit(0).cast("bigint")).alias(f"below{w}") for w in m.words]
    take = ordered()[0] | ((F.col("t1") == F.col("t2")) & (F.col("id1") == F.col("id2")))
    first = reduce(lambda x, y: x & y, [x.bitwiseAND(F.col(f"below{w}")) == 0 for w, x in zip(m.words, m.agree(), strict=True)])
    found = m.side(a, 1, *keys, ids(1), *below).join(m.side(b, 2, *keys, ids(2)).hint("merge"), keys).where(first & take)
    return members(found.select("id1", "id2", "ids_1", "ids_2", total(m.agree()).alias("agreed"), total(m.both()).alias("shared")), selves)


def without_conflict(nodes: DataFrame, cells: DataFrame, width: int = WIDTH, alike: DataFrame | None = None) -> DataFrame:
    """id1 < id2: the pairs of each node whose histories are equal wherever both are known.

    nodes: node, two, side, role_id. Of a node with two lists (two, sides L and R) their product is compared, of others the pairs
    of the list. Masks come to the nodes' rows, so that no pair that is compared is shuffled. alike: role_id, ids of the roles that
    a role stands for; pairs between the ids of two roles are given.
    """
    m = masks(cells)
    rows = nodes.join(m.rows, "role_id", "left").fillna(0, m.names)
    rows = rows.withColumn("ids", F.array("role_id")) if alike is None else rows.join(alike.select("role_id", "ids"), "role_id")
    a, b = tiles(rows, ["node", "two"], width)
    keys = ["node", "two", "t1", "t2"]
    take = ordered()[0]
    sides = F.when(F.col("two"), (F.col("side1") != F.col("side2")) & (F.col("id1") != F.col("id2")) & ((F.col("t1") != F.col("t2")) | (F.col("side1") == "L"))).otherwise(take)
    fits = reduce(lambda x, y: x & y, [x == y for x, y in zip(m.both(), m.agree(), strict=True)])
    found = m.side(a, 1, *keys, F.col("ids").alias("ids_1"), F.col("side").alias("side1")).join(m.side(b, 2, *keys, F.col("ids").alias("ids_2"), F.col("side").alias("side2")).hint("merge"), keys)
    return members(found.where(sides & fits).select("id1", "id2", "ids_1", "ids_2"))


@dataclass
class States:
    """Histories as bits over the dates on which any has an entry: by role, one mask of each mark and of each bit of the known values' numbers."""

    rows: DataFrame
    dates: list
    marks: list[str]
    words: range
    bits: int
    values: DataFrame
    small: bool

    @property
    def names(self) -> list[str]:
        return [f"{m}{w}" for m in [*self.marks, *(f"v{p}_" for p in range(self.bits))] for w in self.words]

    def beside(self, pairs: DataFrame, how: str = "inner") -> DataFrame:
        """pairs with the masks (and lists) of both sides; by other joins than inner a side without a history has none."""
        for n in ("1", "2"):
            side = self.rows.select(F.col("role_id").alias(f"id{n}"), *[F.col(c).alias(f"{c}_{n}") for c in self.rows.columns if c != "role_id"])
            pairs = pairs.join(F.broadcast(side) if self.small else side, f"id{n}", how)
        return pairs if how == "inner" else pairs.fillna(0, [f"{c}_{n}" for c in self.names for n in "12"])

    def of(self, mark: str, n: int) -> list[Column]:
        return [F.col(f"{mark}{w}_{n}") for w in self.words]

    def both(self, mark: str) -> list[Column]:
        return [x.bitwiseAND(y) for x, y in zip(self.of(mark, 1), self.of(mark, 2), strict=True)]

    def differ(self) -> list[Column]:
        """By word, the dates on which both sides have a known value and not the same."""
        unlike = [reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"v{p}_{w}_1").bitwiseXOR(F.col(f"v{p}_{w}_2")) for p in range(self.bits)]) for w in self.words]
        return [x.bitwiseAND(y) for x, y in zip(self.both("k"), unlike, strict=True)]

    def has(self, code: int, n: int) -> list[Column]:
        """By word, the dates on which a side has the known value of this number."""
        bit = lambda p, w: F.col(f"v{p}_{w}_{n}") if code >> p & 1 else F.bitwise_not(F.col(f"v{p}_{w}_{n}"))
        return [reduce(lambda x, y: x.bitwiseAND(y), [bit(p, w) for p in range(self.bits)], k) for w, k in zip(self.words, self.of("k", n), strict=True)]


def any_bit(words: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, [x != 0 for x in words])


def count_bits(words: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(x) for x in words]).cast("bigint")


def states(entries: DataFrame, marks: dict[str, tuple[Column, bool]], *lists: Column) -> States:
    """entries: role_id, f, t, value, known: half-open spans; t is null for ever. One without length counts on no date.

    marks: by name, of which entries, and whether on all their dates or on the first alone. The mark k is of known entries.
    lists: aggregates of a role's entries, to be kept beside its masks.
    """
    entries = cut(entries)
    dates = [r["f"] for r in entries.select("f").distinct().orderBy("f").collect()]  # bounded by the frame
    values = position(entries.where("known").select("value").distinct(), [F.col("value")], "code")
    bits = max(1, int(values.agg(F.coalesce(F.max("code"), F.lit(0))).first()[0]).bit_length())
    known = entries.join(values.withColumnRenamed("value", "__v"), F.col("known") & F.col("value").eqNullSafe(F.col("__v")), "left").drop("__v")
    words = range(-(-len(dates) // WORD) or 1)
    kind = entries.schema["f"].dataType.simpleString()
    grid = F.lit(dates).cast(f"array<{kind}>") if dates else F.array().cast(f"array<{kind}>")
    at = known.withColumn("i0", F.array_position(grid, F.col("f")) - 1).withColumn("i1", F.when(F.col("t").isNull(), len(dates)).otherwise(F.size(F.filter(grid, lambda d: d < F.col("t")))))
    bit = lambda c, w: F.greatest(F.least(F.col(c) - w * WORD, F.lit(WORD)), F.lit(0)).cast("int")
    shift = lambda c, w: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(c, w))
    whole = lambda w: shift("i1", w) - shift("i0", w)
    first = lambda w: F.when((F.col("i0") >= w * WORD) & (F.col("i0") < (w + 1) * WORD), shift("i0", w)).otherwise(F.lit(0).cast("bigint"))
    mask = lambda test, value, name: F.coalesce(F.bit_or(F.when(test & (F.col("i0") < F.col("i1")), value)), F.lit(0).cast("bigint")).alias(name)
    marks = {"k": (F.col("known"), True)} | marks
    masked = [mask(test, (whole if all_dates else first)(w), f"{m}{w}") for m, (test, all_dates) in marks.items() for w in words]
    masked += [mask(F.col("known") & (F.shiftright("code", p).bitwiseAND(F.lit(1)) == 1), whole(w), f"v{p}_{w}") for p in range(bits) for w in words]
    rows = cut(at.groupBy("role_id").agg(*masked, *lists))
    n = rows.count()
    small = n * len(masked) <= BROADCAST_LONGS and (not lists or entries.count() <= BROADCAST_ENTRIES)
    return States(rows, dates, list(marks), words, bits, values, small)


def beside(pairs: DataFrame, rows: DataFrame, deal: bool = True) -> DataFrame:
    """pairs with a and b: the rows of id1 and of id2 as lists of structs, of pairs that have both.

    deal: a pair is dealt once, by its ids, so that what follows by pair needs no other exchange.
    """
    fields = [c for c in rows.columns if c != "role_id"]
    by_role = cut(rows.groupBy("role_id").agg(F.collect_list(F.struct(*fields)).alias("e")))
    n = by_role.agg(F.sum(F.size("e"))).first()[0] or 0
    small = n <= BROADCAST_ENTRIES
    side = lambda i, name: by_role.select(F.col("role_id").alias(f"id{i}"), F.col("e").alias(name))
    send = F.broadcast if small else (lambda x: x)
    dealt = pairs.repartition(_tasks(pairs.sparkSession), "id1", "id2") if small and deal else pairs
    return dealt.join(send(side(1, "a")), "id1").join(send(side(2, "b")), "id2")


def met(pairs: DataFrame, rows: DataFrame, test: str) -> DataFrame:
    """id1, id2, x, y: all rows x of id1 and y of id2 that pass the test."""
    one = beside(pairs.select("id1", "id2"), rows).select("id1", "id2", F.explode("a").alias("x"), "b")
    return one.select("id1", "id2", "x", F.explode("b").alias("y")).where(test)
