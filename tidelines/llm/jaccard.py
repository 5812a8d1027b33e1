"""Exact Jaccard join on word shingles by token-combination prefixes.

Documents with equal shingle sets form a class. Tokens (shingles) are ordered rare before frequent, then by hash; a sketch of
token counts over the whole table tells the two apart. Two sets that are similar enough share a rare token, or two frequent
tokens of one group, within prefixes extended accordingly; so each class indexes single rare tokens and 2-combinations of
frequent ones. Classes that meet under a key are candidates if their sizes and parity sketches allow the similarity (both are
bounds, so no link is lost), and an exact count on the whole texts decides.

For components the links of large groups aren't all looked at. A first round meets the members of a key in tiles of bounded
size, and samples of the tiles in one more, and verifies all candidates of small tiles and each member's closest earlier one in
others. The connected parts are then known. A second round does the same in tiles that pair the members outside a key's largest
part with all others, and a third verifies every candidate that is still between different parts. The parts are then exactly
the components of all links. join_links() verifies every candidate instead, and returns all links between different sets.

Sets are never gathered by group. Shingles and classes are 64-bit hashes.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle has its whole
sequence as one shingle; null, empty and blank texts have an empty set and link with nothing; rows that repeat an id share its
links, and each is returned; rows with a null id stay by themselves with a null component; texts of any length are taken whole;
an empty table gives an empty result. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, clean_driver, materialize, memo, release, worker_state

#: Tokens are counted in 2 ** CELL_BITS cells; a token is frequent if its cell stands out from the median one by FREQUENT_FROM, or
#: by more than chance does. The classification steers the work and never changes the result.
CELL_BITS, BLOCKS, FREQUENT_FROM = 21, 64, 64
#: Members of a key that meet in one task; more are split into tiles.
TILE = 512
_MIX = 0x9E3779B97F4A7C15


def shingles(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = text.encode().lower().split() if text else []
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    mix = np.uint64(_MIX)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, n)
    if n < width:
        acc = np.array([n], np.uint64)
        for x in h:
            acc = (acc * mix) ^ x
            acc ^= acc >> np.uint64(29)
    else:
        acc = h[: n - width + 1].copy()
        for j in range(1, width):
            acc *= mix
            acc += h[j : n - width + 1 + j]
            acc ^= acc >> np.uint64(29)
    acc *= mix
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def word_hashes() -> dict:
    import xxhash

    return worker_state("jaccard-words", lambda: memo(xxhash.xxh3_64_intdigest, 100_000, 48))


def class_of(s: np.ndarray) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def sketch_bits(n: int) -> int:
    """Places of a sketch: a power of two, at least as many as tokens, so that it tells large sets apart as well as small ones."""
    return max(512, 1 << (n - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """A bit by hash place, 1 if an odd number of tokens fall there; differing bits never outnumber differing tokens."""
    bits = sketch_bits(len(s))
    odd = np.bincount(((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def slack(n: int, num: int, den: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-n * num // den)


def group_count(c: int, num: int, den: int) -> int:
    """Groups of frequent tokens for sets of 2 ** c to 2 ** (c + 1) - 1 tokens: about as many as the longest prefix has tokens.

    0 where such a set could run out of tokens before its prefix is long enough: there all tokens are indexed singly.
    """
    most = -(-(1 << c) * num // den) - 1
    wanted = 1 << slack((2 << c) - 1, num, den).bit_length()
    while wanted > most and wanted:
        wanted >>= 1
    return wanted


def index_keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Single rare tokens, and combinations of frequent ones, that a set is indexed under.

    Any two sets of at least the similarity share a key (but for equal sets of one token). Let the last token of one prefix come
    no later than that of the other: what the sets share of the former is then in both. If that were no rare token and at most
    one frequent token by group, the set would lack more tokens than its slack allows. Groups depend on the set's size, to a
    power of two; where a similar set may be of a smaller power, combinations of both are indexed.
    """
    n = len(s)
    need = slack(n, num, den) + 1
    is_freq = frequent[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    rare, often = s[~is_freq][:need], s[is_freq]
    need -= len(rare)
    rare &= np.uint64(0xFFFFFFFFFFFFFFFE)
    if need <= 0 or not len(often):
        return rare, often[:0]
    made: list[np.ndarray] = []
    for c in range((-(-n * num // den)).bit_length() - 1, n.bit_length()):
        groups = group_count(c, num, den)
        if not groups:
            made.append(often[:need])
            continue
        seen: dict[int, list[int]] = {}
        pairs, left = [], need
        for token, group in zip(often[: need + groups].tolist(), ((often[: need + groups] >> np.uint64(20)) & np.uint64(groups - 1)).tolist(), strict=True):
            before = seen.setdefault(group, [])
            pairs += [((((a * _MIX) ^ token) + c) * _MIX) & 0xFFFFFFFFFFFFFFFF for a in before]
            left -= bool(before)
            before.append(token)
            if left <= 0:
                break
        made.append(np.array(pairs, np.uint64))
    # the lowest bit tells combinations from rare tokens
    return rare, np.concatenate(made) | np.uint64(1)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


PROFILE_SCHEMA = "id long, n long, cls long, sketch binary, block int, counts binary"


def profile(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One pass: a row by document (id, n, cls, sketch), and from each task its token counts by cell in BLOCKS rows (block, counts)."""

    def run(batches):
        import zlib

        import pyarrow as pa

        names = [x.split()[0] for x in PROFILE_SCHEMA.split(", ")]
        words, held, size, seen = word_hashes(), [], 0, set()
        cells = np.zeros(1 << CELL_BITS, np.uint32)

        def add():
            cells[:] += np.bincount((np.concatenate(held) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)

        for batch in batches:
            ids, ns, classes, sketches = batch.column(0), [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width, words)
                c = class_of(s)
                ns.append(len(s))
                classes.append(c)
                sketches.append(sketch(s) if len(s) else None)
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                if size >= 1_000_000:
                    add()
                    held, size = [], 0
                    if len(seen) > 500_000:
                        seen.clear()
            k = len(ns)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if held:
            add()
        if cells.any():
            blocks = [zlib.compress(x.tobytes(), 1) for x in np.split(cells, BLOCKS)]
            none = [pa.nulls(BLOCKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], names=names)

    source = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return materialize(source.mapInArrow(run, PROFILE_SCHEMA), "shingle-sets")


def frequent_table(profiled: DataFrame) -> np.ndarray:
    """True for each cell that holds a frequent token. Tasks add up the blocks of cells; the driver gets the sums, of fixed size."""

    def add(batches):
        import zlib

        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                now = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
                sums[block] = sums[block] + now if block in sums else now.astype(np.uint64)
        if sums:
            kept = [zlib.compress(np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(kept, pa.binary())], names=["block", "counts"])

    import zlib

    cells = np.zeros((BLOCKS, (1 << CELL_BITS) // BLOCKS), np.uint32)
    for r in profiled.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").collect():
        cells[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    usual = float(np.median(cells))
    return cells.reshape(-1) >= usual + max(FREQUENT_FROM, 8 * usual**0.5)


def index_rows(docs: DataFrame, frequent: np.ndarray, width: int, num: int, den: int, text_col: str) -> DataFrame:
    """key, cls, n: what every class is indexed under; copies within a task are indexed once."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.packbits(frequent).tobytes())

    def run(batches):
        import pyarrow as pa

        words, seen = word_hashes(), set()
        table = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            keys, classes, sizes = [], [], []
            for text in batch.column(0):
                s = shingles(text.as_py(), width, words)
                if len(s) < 2 or (c := class_of(s)) in seen:  # a set of one token is similar to equal sets only
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                k = np.concatenate(index_keys(s, table, num, den))
                keys.append(k)
                classes.append(np.full(len(k), c, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names=["key", "cls", "n"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(run, "key long, cls long, n int")


def key_members(index: DataFrame) -> DataFrame:
    """key, g, salt, cls, n: the members of every key with several classes, dealt to g salts of about TILE members.

    Of keys with the same members one stays: count, least, greatest and exclusive-or of their hashes tell them apart without
    gathering them. A class comes once from each task that holds a copy, and would cancel out, so it counts once for a key. Rare
    tokens have few members by definition, so they are dealt by key, once for all uses; a combination may have any number, so
    those rows are dealt by key and class, and where they meet the kept keys Spark splits a hot one.
    """
    combined = F.col("key").bitwiseAND(1) == 1
    rare, often = index.where(~combined).repartition("key").distinct(), index.where(combined).distinct()
    by_key = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.bit_xor("cls").alias("x")).where("lo < hi")
    kept = by_key(rare).unionByName(by_key(often)).groupBy("m", "lo", "hi", "x").agg(F.min("key").alias("key"))
    kept = kept.select("key", F.ceil(F.col("m") / TILE).cast("int").alias("g"))
    salt = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("g")).cast("int").alias("salt")
    members = rare.join(kept.where(~combined), "key").unionByName(often.join(kept.where(combined), "key"))
    return materialize(members.select("key", "g", salt, "cls", "n"), "members")


def first_tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """key, ti, tj, side, cls, n: the salts of each key, and a sample of a key's salts in a tile of its own (ti = -1).

    Left out of a tile is who finds no other of fitting size there: the neighbour in size is the likeliest to fit.
    """
    sample = (F.col("g") > 1) & (F.pmod(F.xxhash64("cls", F.lit(2)), F.col("g")) == 0)
    at = F.explode(F.when(sample, F.array("salt", F.lit(-1))).otherwise(F.array("salt")))
    rows = members.select("key", at.alias("ti"), F.lit(-1).alias("tj"), F.lit(3).alias("side"), "cls", "n")
    tile, n = Window.partitionBy("key", "ti", "tj").orderBy("n", "cls"), F.col("n").cast("bigint")
    sized = rows.withColumns({"less": F.lag(n).over(tile), "more": F.lead(n).over(tile)})
    return sized.where((F.col("less") * den >= n * num) | (n * den >= F.col("more") * num)).drop("less", "more")


def cross_tiles(members: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """key, ti, tj, side, cls, n, part: the members of each key with several parts, so that all pairs of different parts meet.

    Members outside a key's largest part (side 1) are dealt to groups ti and meet all members (side 2) of each salt tj. A key of
    one salt is one tile. Without parts every class is a part of its own.
    """
    rows = members.withColumn("part", F.col("cls")) if parts is None else members.join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    rows = materialize(rows, "key-parts")
    sizes = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("big"), F.sum("c").alias("m"), F.max("c").alias("most"))
    open_ = sizes.where("m > most").select("key", "big", F.ceil((F.col("m") - F.col("most")) / TILE).cast("int").alias("h"))
    rows = rows.join(open_, "key").select("key", "g", "h", "salt", "cls", "n", "part", (F.col("part") != F.col("big")).alias("small"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda ti, tj, side: F.struct(ti.cast("int").alias("ti"), tj.cast("int").alias("tj"), F.lit(side).alias("side"))
    group = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("h"))
    first = F.transform(upto("g"), lambda j: place(group, j, 1))
    second = F.transform(upto("h"), lambda i: place(i, F.col("salt"), 2))
    places = F.when(F.col("g") == 1, F.array(place(F.lit(0), F.lit(0), 3))).when(F.col("small"), F.concat(first, second)).otherwise(second)
    return rows.withColumn("p", F.explode(places)).select("key", "p.ti", "p.tj", "p.side", "cls", "n", "part")


def tile_pairs(cls, n, side, sketches: list[bytes], part, num: int, den: int, closest: bool):
    """Candidate pairs of a tile as (later, earlier, share of differing tokens), in order of size; and whether it was cut.

    All, or with `closest` each member's closest earlier one if there are many. Pairs need a member of either side (1, 2; 3 is both).
    """
    order = np.lexsort((cls, n))
    cls, n, side, part = cls[order], n[order], side[order], part[order]
    lo = np.searchsorted(n * den, n * num)  # the first member that is not too small
    # members of one sketch size are neighbours; a member also meets those of half its size, with its halves folded
    size = np.array([len(sketches[i]) for i in order])
    starts = np.flatnonzero(np.r_[True, size[1:] != size[:-1]])
    block = [np.frombuffer(b"".join(sketches[i] for i in order[a:b]), np.uint64).reshape(b - a, -1) for a, b in zip(starts, [*starts[1:], len(n)], strict=True)]
    own = np.searchsorted(starts, np.arange(len(n)), side="right") - 1
    every, best, many = [], [], 0
    for i in range(1, len(n)):
        if lo[i] >= i:
            continue
        at = own[i]
        mine, a = block[at][i - starts[at]], max(lo[i], starts[at])
        differ = np.bitwise_count(block[at][a - starts[at] : i - starts[at]] ^ mine).sum(1, dtype=np.int64)
        while a > lo[i]:
            # below: half the size, or a smaller one, for which no bound is known
            at, b = at - 1, a
            a = max(lo[i], starts[at])
            half = mine[: len(mine) // 2] ^ mine[len(mine) // 2 :]
            low = block[at][a - starts[at] : b - starts[at]]
            less = np.bitwise_count(low ^ half).sum(1, dtype=np.int64) if low.shape[1] == len(half) else np.zeros(b - a, np.int64)
            differ, mine = np.concatenate([less, differ]), half
        js = np.arange(lo[i], i)
        fine = ((den + num) * differ <= (den - num) * (n[js] + n[i])) & (part[js] != part[i]) & ((side[js] | side[i]) == 3)
        js, share = js[fine], differ[fine] / (n[js[fine]] + n[i])
        if len(js):
            nearest = int(np.argmin(share))
            best.append((cls[i : i + 1], cls[js[nearest : nearest + 1]], share[nearest : nearest + 1]))
            many += len(js)
            if not closest or many <= 4 * len(n) + 16:
                every.append((np.full(len(js), cls[i]), cls[js], share))
    cut = closest and many > 4 * len(n) + 16
    found = best if cut else every
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), cut
    return *(np.concatenate(x) for x in zip(*found, strict=True)), cut


CANDIDATE_SCHEMA = "later long, earlier long, share double, key long"


def candidates(tiles: DataFrame, sketches: DataFrame, num: int, den: int, closest: bool) -> DataFrame:
    """Candidate pairs of classes of different parts, and a row with a key alone for each tile cut to the closest pairs."""
    rows = tiles if "part" in tiles.columns else tiles.withColumn("part", F.col("cls"))
    # sketches come last, as they are the wide part
    rows = rows.select("key", "ti", "tj", "cls", "n", "side", "part").join(sketches, "cls").select("key", "ti", "tj", "cls", "n", "side", "sketch", "part")
    dealt = rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj")

    def run(batches):
        import pyarrow as pa

        def pairs(held):
            t = pa.Table.from_batches(held)
            get = lambda c: t.column(c).to_numpy().astype(np.int64)
            return tile_pairs(get("cls"), get("n"), get("side"), t.column("sketch").to_pylist(), get("part"), num, den, closest)

        def pack(found):
            later, earlier, share = (np.concatenate([f[i] for f in found]) for i in (0, 1, 2))
            first = np.unique(np.stack([later, earlier], 1), axis=0, return_index=True)[1]
            marks = [f[4] for f in found if f[3]]
            n, m = len(first), len(marks)
            full = lambda x, t: pa.concat_arrays([pa.array(x[first], t), pa.nulls(m, t)])
            cols = [full(later, pa.int64()), full(earlier, pa.int64()), full(share, pa.float64()), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(marks, pa.int64())])]
            return pa.RecordBatch.from_arrays(cols, names=["later", "earlier", "share", "key"])

        now, held, found, size = None, [], [], 0
        for batch in batches:
            k, i, j = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
                if a == b:
                    continue
                mark = (int(k[a]), int(i[a]), int(j[a]))
                if held and mark != now:
                    found.append((*pairs(held), now[0]))
                    size += len(found[-1][0])
                    held = []
                    if size > 100_000:
                        yield pack(found)
                        found, size = [], 0
                now = mark
                held.append(batch.slice(a, b - a))
        if held:
            found.append((*pairs(held), now[0]))
        if found:
            yield pack(found)

    return dealt.mapInArrow(run, CANDIDATE_SCHEMA)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """a, b, shared, united of the pairs (a, b) of classes whose whole texts are similar enough. reps: cls, id of a document of each class."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls"), "needed")
    keep = _maybe(needed)
    source = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    texts = materialize(source.where(keep(F.col("id"))).join(needed, "id").select("cls", "text"), "texts")
    left, right = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        words = word_hashes()
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            kept = []
            for a, b, ta, tb in zip(*batch.columns, strict=True):
                x, y = (sets[c] if c in sets else sets.setdefault(c, shingles(t.as_py(), width, words)) for c, t in ((a.as_py(), ta), (b.as_py(), tb)))
                if class_of(x) != a.as_py() or class_of(y) != b.as_py():  # another text under a repeated id
                    sets.pop(a.as_py(), None), sets.pop(b.as_py(), None)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if den * shared >= num * (len(x) + len(y) - shared):
                    kept.append((a.as_py(), b.as_py(), shared, len(x) + len(y) - shared))
                if len(sets) > 500:
                    sets.clear()
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*kept, strict=True)], names=["a", "b", "shared", "united"])

    links = materialize(both.mapInArrow(run, "a long, b long, shared long, united long").distinct(), "links")
    release(needed, texts)
    return links


def _maybe(needed: DataFrame, bits: int = 23):
    """A test on ids by a bit table of fixed size, made from all needed ids; it may let others pass, never stops one."""
    spark = needed.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits)).cast("int")
    words = needed.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, p & 31))").alias("v"))
    table = np.zeros(1 << (bits - 5), np.uint32)
    rows = words.toLocalIterator()  # at most 2 ** (bits - 5) rows
    for r in rows:
        table[r["w"]] = r["v"]
    sent = spark.sparkContext.broadcast(table.tobytes())

    def test(places):
        import pyarrow as pa

        table = np.frombuffer(sent.value, np.uint32)
        p = places.to_numpy(zero_copy_only=False)
        return pa.array((table[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1)

    test.__annotations__ = {}
    udf = F.arrow_udf(test, "boolean", F.ArrowUDFType.SCALAR)
    return lambda i: udf(F.pmod(F.xxhash64(i), F.lit(1 << bits)).cast("int")) & i.isNotNull()


def contract(batches):
    """Stars (u, v) in place of the edges (u, v) that a task sees, up to half a million nodes at a time: v is the least node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def stars():
        found = [(x, r) for x in list(parent) if (r := root(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 500_000:
            yield stars()
    yield stars()


def connected(edges: DataFrame) -> DataFrame:
    """cls, part of every node of edges (a, b): the least node connected to it.

    Large-star and small-star steps in turn; before each, tasks contract the edges that they hold, which saves rounds.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(contract, "u long, v long")
    before, written = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small.mapInArrow(contract, "u long, v long"), "stars")
        if written is not None:
            release(written)
        written = edges
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("part"))
        before = state


@dataclass
class Indexed:
    """What both joins start from: rows by document, representatives and sketches by class, and the keys' members."""

    documents: DataFrame  # id, n, cls
    classes: DataFrame  # cls, id, sketch
    members: DataFrame
    twice: DataFrame  # a, b: classes of rows that repeat an id with another text, which are one document


def indexed(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> Indexed:
    bound_batches(docs.sparkSession)
    clean_driver(docs.sparkSession)
    profiled = profile(docs, width, id_col, text_col)
    rows = profiled.where("block is null").select("id", "n", "cls", "sketch")
    some = rows.where("cls is not null and id is not null")
    classes = materialize(some.groupBy("cls").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    prefixes = materialize(index_rows(docs.where(docs[id_col].isNotNull()), frequent_table(profiled), width, num, den, text_col), "prefixes")
    members = key_members(prefixes)
    release(prefixes)
    documents = materialize(rows.select("id", "n", "cls"), "documents")
    release(profiled)
    clean_driver(docs.sparkSession)
    some = documents.where("cls is not null and id is not null")
    same_id = some.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b")
    twice = some.join(same_id.select("id", "a"), "id").select("a", F.col("cls").alias("b")).where("a <> b")
    return Indexed(documents, classes, members, twice)


def _named(x: Indexed, parts: DataFrame, id_col: str, more: DataFrame | None = None) -> DataFrame:
    """The rows of all documents with class_id and component_id, and columns of more (by cls), as a written table."""
    by_class = x.classes.select("cls", F.col("id").alias("class_id")).join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    least = by_class.groupBy("part").agg(F.min("class_id").alias("component_id"))
    named = by_class.join(least, "part").drop("part")
    if more is not None:
        named = named.join(more, "cls", "left")
    own = x.documents.join(named, "cls", "left")
    some = F.col("id").isNotNull()
    extra = [F.col(c) for c in named.columns if c not in ("cls", "class_id", "component_id")]
    return materialize(own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(some, F.coalesce("class_id", "id")).alias("class_id"), F.when(some, F.coalesce("component_id", "id")).alias("component_id"), *extra), "components")


def _pairs_of(found: DataFrame) -> DataFrame:
    return found.where("later is not null").select(F.col("later").alias("a"), F.col("earlier").alias("b")).distinct()


def join_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every row of docs.

    Two documents link when den * (size of the intersection) >= num * (size of the union) of their shingle sets. class_id is the
    least id with the same set, component_id the least id reachable by links; a document without shingles has its own id.
    """
    x = indexed(docs, width, num, den, id_col, text_col)
    reps, sketches = x.classes.select("cls", "id"), x.classes.select("cls", "sketch")
    check = lambda pairs: verified(pairs, docs, reps, width, num, den, id_col, text_col)
    first = materialize(candidates(first_tiles(x.members, num, den), sketches, num, den, closest=True), "pairs")
    seen = [first]
    links = check(_pairs_of(first))
    parts = connected(links.select("a", "b").unionByName(x.twice))
    # members of large or cut keys that haven't met, of different parts: the closest ones again, then all that are still apart
    keys = first.where("key is not null").select("key").unionByName(x.members.where("g > 1").select("key")).distinct()
    for closest in (True, False):
        tiles = cross_tiles(x.members.join(keys, "key", "left_semi"), parts)
        found = materialize(candidates(tiles, sketches, num, den, closest), "pairs")
        seen.append(found)
        new = _pairs_of(found)
        for known in seen[:-1]:
            new = new.join(_pairs_of(known), ["a", "b"], "left_anti")
        keys = found.where("key is not null").select("key").distinct()
        if not new.isEmpty():
            again, before = check(new), parts
            parts = connected(before.select(F.col("cls").alias("a"), F.col("part").alias("b")).unionByName(again.select("a", "b")))
            release(again, before)
        if keys.isEmpty():
            break
    out = _named(x, parts, id_col)
    release(*seen, links, parts, x.documents, x.classes, x.members)
    return out


def join_links(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and the membership of the documents.

    The links: class_a < class_b (least ids with each set), shared, united (sizes). The membership: doc_id, n_shingles, class_id,
    component_id, and n_links, the number of other documents that a document links with, copies included. Every candidate pair
    is verified, so the work grows with the number of links between different sets.
    """
    x = indexed(docs, width, num, den, id_col, text_col)
    reps, sketches = x.classes.select("cls", "id"), x.classes.select("cls", "sketch")
    pairs = materialize(candidates(cross_tiles(x.members), sketches, num, den, closest=False).select(F.col("later").alias("a"), F.col("earlier").alias("b")).distinct(), "pairs")
    links = verified(pairs, docs, reps, width, num, den, id_col, text_col)
    size = x.documents.where("cls is not null and id is not null").groupBy("cls").agg(F.count_distinct("id").alias("size"))
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    met = ends.join(size.select(F.col("cls").alias("other"), "size"), "other").groupBy("cls").agg(F.sum("size").alias("to_others"))
    n_links = size.join(met, "cls", "left").select("cls", (F.coalesce("to_others", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    named = reps.select("cls", "id")
    out = links.join(named.select(F.col("cls").alias("a"), F.col("id").alias("ia")), "a").join(named.select(F.col("cls").alias("b"), F.col("id").alias("ib")), "b")
    out = materialize(out.select(F.least("ia", "ib").alias("class_a"), F.greatest("ia", "ib").alias("class_b"), "shared", "united"), "class-links")
    rows = _named(x, connected(links.select("a", "b").unionByName(x.twice)), id_col, n_links)
    rows = rows.withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    release(pairs, links, x.documents, x.classes, x.members)
    return out, rows


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the least id (of rows that repeat it, one). Null ids all stay."""
    found = join_components(docs, width, num, den, id_col, text_col)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__tl_keep")).distinct()
    flagged = docs.join(kept, docs[id_col].cast("bigint") == F.col("__tl_keep"), "left_semi")
    nth = Window.partitionBy(flagged[id_col]).orderBy(F.xxhash64(flagged[text_col]))
    first = flagged.withColumn("__tl_no", F.row_number().over(nth)).where("__tl_no = 1").drop("__tl_no")
    return first.unionByName(docs.where(docs[id_col].isNull()))
