"""Which network an address belongs to: ranges as CIDR blocks, and the longest prefix around each address.

An address is a struct (bits, hi, lo): 32 or 128 bits, and the two halves of a 128-bit number (an IPv4
address stands in the lower one). A range falls apart into aligned blocks, two at most of each length;
a block's key is its family, its length and the address with the other bits cleared. Of the blocks
around an address the longest decides. Nested ranges answer with the innermost: within an outer range,
the block around an address is never smaller than within an inner one.

Lookups cut the numbers into stretches of about as many addresses and ranges each. Addresses and the
ranges within a stretch meet there; a range over several stretches goes to them as blocks, of which no
more lie over an edge than an address has bits.
"""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from perispark.sources.scratch import written

#: Addresses and ranges of a stretch, about; and how many of them are looked at to find its edges.
STRETCH, LOOKED_AT = 250_000, 50
#: A prefix length on which lookups depended once; they no longer do, tests still set it.
SHORT = 12
ADDRESS = StructType([StructField(x, LongType()) for x in ("bits", "hi", "lo")])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ip_number(c: Column) -> Column:
    """The 32-bit number of a dotted IPv4 address, null for anything else."""
    number = lambda p: p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3]
    parts = F.transform(F.split(c, r"\."), lambda x: x.try_cast("bigint"))
    whole = lambda p: F.when((F.size(p) == 4) & F.forall(p, lambda x: x <= 255), number(p))
    return F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _let(parts, whole))


def _struct(bits: int, hi: Column, lo: Column) -> Column:
    return F.struct(F.lit(bits).alias("bits"), hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def _groups(c: Column) -> Column:
    """The eight groups of an IPv6 text whose double colon, if any, stands for as many zeros as lack."""
    side = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    zeros = lambda left, right: F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    filled = lambda left, right: F.when(F.size(left) + F.size(right) < 8, F.concat(left, zeros(left, right), right))
    short = _let(side(F.substring_index(c, "::", 1)), lambda left: _let(side(F.substring_index(c, "::", -1)), lambda right: filled(left, right)))
    return F.when(F.contains(c, F.lit("::")), short).otherwise(F.split(c, ":"))


def address(c: Column) -> Column:
    """struct(bits, hi, lo) of an IPv4 or IPv6 text, null for anything else.

    IPv6 texts may be shortened, in either case, and end in a dotted IPv4 part; an IPv4 address written
    as ::ffff:a.b.c.d is that IPv4 address. Zones (%eth0) and ports aren't addresses.
    """
    return _let(F.lower(F.trim(c)), lambda text: _let(ip_number(text), lambda four: F.when(four.isNotNull(), _struct(32, F.lit(0), four)).otherwise(_six(text))))


def _six(text: Column) -> Column:
    def with_tail(tail: Column) -> Column:
        """The text with a dotted end as two groups of hexadecimal digits."""
        groups = F.concat(F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(65535))))
        return F.when(tail.isNotNull(), F.concat(F.regexp_extract(text, r"^([0-9a-f:]*:)[0-9.]+$", 1), F.lower(groups))).otherwise(text)

    def of_digits(digits: Column) -> Column:
        half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
        mapped = F.startswith(digits, F.lit("0" * 20 + "ffff"))
        return F.when(mapped, _struct(32, F.lit(0), half(17).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(_struct(128, half(1), half(17)))

    def of_groups(groups: Column) -> Column:
        fine = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, _let(F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""), of_digits))

    doubles = lambda six: F.size(F.split(six, "::")) - 1
    usual = lambda six: six.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~six.rlike("^:[^:]|:::|[^:]:$") & (doubles(six) <= 1)
    tail = ip_number(F.regexp_extract(text, r"^[0-9a-f:]*:([0-9.]+)$", 1))
    return _let(_let(tail, with_tail), lambda six: F.when(usual(six), _let(_groups(six), of_groups)))


def _packed(text: str | None) -> bytes | None:
    """16 bytes of an address text in its usual form; IPv4 addresses are mapped ones."""
    try:
        text = text.strip(" ")
        return socket.inet_pton(socket.AF_INET6, text) if ":" in text else b"\0" * 10 + b"\xff\xff" + socket.inet_pton(socket.AF_INET, text)
    except (AttributeError, OSError, ValueError):
        return None


def _parsed(batches: Iterator[pa.RecordBatch], texts: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, names = list(batch.columns), list(batch.schema.names)
        for c in texts:
            packed = [_packed(t) for t in batch.column(c).to_pylist()]
            halves = np.frombuffer(b"".join(x or b"\0" * 16 for x in packed), ">u8").astype(np.uint64).reshape(-1, 2)
            four = (halves[:, 0] == 0) & (halves[:, 1] >> np.uint64(32) == 0xFFFF)
            lo = np.where(four, halves[:, 1] & np.uint64(0xFFFFFFFF), halves[:, 1])
            parts = [pa.array(x) for x in (np.where(four, 32, 128), halves[:, 0].view(np.int64), lo.view(np.int64))]
            columns.append(pa.StructArray.from_arrays(parts, ["bits", "hi", "lo"], mask=pa.array([x is None for x in packed], pa.bool_())))
            names.append(f"{c}_number")
        yield pa.RecordBatch.from_arrays(columns, names)


def with_addresses(df: DataFrame, texts: Sequence[str]) -> DataFrame:
    """df with address() in place of each text. Usual forms are read by the C library; what it
    refuses, by address() itself."""
    if not texts:
        return df
    schema = StructType([*df.schema.fields, *[StructField(f"{c}_number", ADDRESS) for c in texts]])
    read = df.mapInArrow(lambda it: _parsed(it, texts), schema)
    number = lambda c: F.coalesce(f"{c}_number", address(F.col(c)).cast(ADDRESS)).alias(c)
    return read.select(*[number(c) if c in texts else c for c in df.columns])


def _cleared(hi: Column, lo: Column, n: Column) -> tuple[Column, Column]:
    """Both halves with the lowest n bits as 0; n is 0 to 129."""
    cut = lambda x, by: x.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), by))
    low = F.when(n >= 64, F.lit(0).cast("long")).otherwise(cut(lo, F.least(n, F.lit(63))))
    high = F.when(n >= 128, F.lit(0).cast("long")).when(n >= 64, cut(hi, F.greatest(F.least(n - 64, F.lit(63)), F.lit(0)))).otherwise(hi)
    return high, low


def _bit(ext: Column, hi: Column, lo: Column, k: Column) -> Column:
    at = lambda x, by: F.call_function("shiftright", x, by).bitwiseAND(F.lit(1))
    upper = at(hi, F.greatest(F.least(k - 64, F.lit(63)), F.lit(0)))
    return F.when(k >= 128, ext.bitwiseAND(F.lit(1))).when(k >= 64, upper).otherwise(at(lo, F.least(k, F.lit(63))))


_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


def _before(x: Column) -> Column:
    return F.when(x == _LOWEST, _HIGHEST).otherwise(x - 1)


def _after(x: Column) -> Column:
    return F.when(x == _HIGHEST, _LOWEST).otherwise(x + 1)


def _unsigned(c: Column) -> list[Column]:
    """What orders addresses as unsigned numbers."""
    return [c[x].bitwiseXOR(F.lit(_LOWEST)) for x in ("hi", "lo")]


def cidr_blocks(ranges: DataFrame, cols: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(bits, length, hi, lo, *cols), one row for each aligned block of the ranges, ends inclusive.

    start and end are address texts or IPv4 numbers; ranges whose ends aren't addresses of one family in
    order are left out. Of ranges that share a block the one that starts last has it, then the one that ends
    first (so the innermost), then the least of cols.

    At the level of 2**k addresses the range's first block is one of the answer if its number is odd, and
    the block before its end if the end's number is; both only while anything lies between. No level depends
    on another, so a range is one row exploded into its levels, about as many as its size has bits.
    """
    each = _blocks(_ranges(ranges, cols, start, end), cols)
    return each.groupBy("bits", "length", "hi", "lo").agg(F.min_by("_cols", "_inner").alias("_cols")).select("bits", "length", "hi", "lo", "_cols.*")


def _ranges(ranges: DataFrame, cols: Sequence[str], start: str, end: str) -> DataFrame:
    """(*cols, s, e): the ends as addresses, null where they aren't of one family in order."""
    kinds = dict(ranges.dtypes)
    r = ranges.select(*cols, *[(F.col(c) if kinds[c] == "string" else _struct(32, F.lit(0), F.col(c)).cast(ADDRESS)).alias(n) for c, n in ((start, "_s"), (end, "_e"))])
    r = with_addresses(r, [c for c in ("_s", "_e") if dict(r.dtypes)[c] == "string"])
    fits = lambda p: (p["s"]["bits"] == p["e"]["bits"]) & (F.struct(*_unsigned(p["s"])) <= F.struct(*_unsigned(p["e"])))
    both = F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))
    return r.select(*cols, F.when(fits(both), both).alias("_r")).select(*cols, "_r.*")


def _blocks(r: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(bits, length, hi, lo, _cols, _inner) of ranges (*cols, s, e), blocks of several ranges for each; of those the least _inner counts."""
    s_hi, s_lo, e_hi, e_lo = (F.col(x) for x in ("s.hi", "s.lo", "e.hi", "e.lo"))
    inner = F.struct(*[F.bitwise_not(x) for x in _unsigned(F.col("s"))], *_unsigned(F.col("e")), *cols)
    # the numbers just outside; a third part takes what runs over 128 bits
    r = r.select(
        F.struct(*cols).alias("_cols"), inner.alias("_inner"), F.col("s.bits").alias("bits"),
        F.when((s_hi == 0) & (s_lo == 0), -1).otherwise(0).alias("ax"), F.when(s_lo == 0, _before(s_hi)).otherwise(s_hi).alias("ah"),
        _before(s_lo).alias("al"), F.when((e_hi == -1) & (e_lo == -1), 1).otherwise(0).alias("bx"),
        F.when(e_lo == -1, _after(e_hi)).otherwise(e_hi).alias("bh"), _after(e_lo).alias("bl"),
    )
    # from the highest bit in which they differ on, nothing lies between
    differ = lambda x, y: F.length(F.bin(F.col(x).bitwiseXOR(F.col(y))))
    top = F.when(F.col("ax") != F.col("bx"), F.col("bits") + 2).when(F.col("ah") != F.col("bh"), differ("ah", "bh") + 64).otherwise(differ("al", "bl"))
    r = r.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(top - 2, F.col("bits")))))
    a, b, k = [F.col(x) for x in ("ax", "ah", "al")], [F.col(x) for x in ("bx", "bh", "bl")], F.col("k")
    up = lambda x: F.when(k >= 128, F.shiftright(x, 1)).otherwise(x)
    above = lambda x: F.struct(up(x[0]), *_cleared(x[1], x[2], k + 1))
    between = above(a) != above(b)
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), by)
    hi, lo = _cleared(a[1], a[2], k)
    set_hi = F.when(k >= 64, hi.bitwiseOR(one(F.greatest(F.least(k - 64, F.lit(63)), F.lit(0))))).otherwise(hi)
    set_lo = F.when(k < 64, lo.bitwiseOR(one(F.least(k, F.lit(63))))).otherwise(lo)
    block = lambda h, low: F.struct(h.alias("hi"), low.alias("lo"))
    first = F.when(between & (_bit(*a, k) == 0), block(set_hi, set_lo))
    last = F.when(between & (_bit(*b, k) == 1), block(*_cleared(b[1], b[2], k + 1)))
    length = (F.col("bits") - k).alias("length")
    return r.select("bits", length, F.inline(F.array_compact(F.array(first, last))), "_cols", "_inner")


def _keys(bits: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """What numpy sorts as families and unsigned numbers: 17 bytes each."""
    out = np.zeros(len(hi), [("b", "u1"), ("h", ">u8"), ("l", ">u8")])
    out["b"], out["h"], out["l"] = bits, hi, lo
    return out.view("S17")


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def _placed(batches: Iterator[pa.RecordBatch], edges: np.ndarray, ends: Sequence[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """The stretch of each end, after the other columns."""
    for batch in batches:
        at = [np.searchsorted(edges, _keys(_column(batch, "bits"), _column(batch, hi), _column(batch, lo)), "right") for _, hi, lo in ends]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, at)], [*batch.schema.names, *(n for n, *_ in ends)])


def _levels(bits: int, s_hi: np.ndarray, s: np.ndarray, e_hi: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The ranges' aligned blocks, small ones first: for each size the ranges, and both halves of the blocks' first and last numbers.

    What is left of a range starts at a multiple of the size and ends before one."""
    who = np.arange(len(s))
    for k in range(bits + 1):
        if not len(who):
            return
        if k == bits:
            yield who, s_hi, s, e_hi, e
            return
        size = np.uint64(1 << k % 64)
        low = size - np.uint64(1)
        # a half below the one that the size is in is all zeros at a start, all ones at an end
        half, other = (s, s_hi) if k < 64 else (s_hi, s)
        odd = (half & size) != 0
        firsts = (who[odd], s_hi[odd], s[odd], *((s_hi[odd], s[odd] | low) if k < 64 else (s_hi[odd] | low, ~s[odd])))
        moved = np.where(odd, half + size, half)
        carry = moved < half
        s_hi, s = (other + carry, moved) if k < 64 else (moved, other)
        go = ~(carry & (s_hi == 0) if k < 64 else carry) & ((s_hi < e_hi) | ((s_hi == e_hi) & (s <= e)))
        who, s_hi, s, e_hi, e = who[go], s_hi[go], s[go], e_hi[go], e[go]
        half, other = (e, e_hi) if k < 64 else (e_hi, e)
        even = (half & size) == 0
        lasts = (who[even], *((e_hi[even], e[even] & ~low) if k < 64 else (e_hi[even] & ~low, ~e[even])), e_hi[even], e[even])
        moved = np.where(even, half - size, half)
        borrow = moved > half
        before = e_hi
        e_hi, e = (other - borrow, moved) if k < 64 else (moved, other)
        go = ~(borrow & (before == 0) if k < 64 else borrow) & ((s_hi < e_hi) | ((s_hi == e_hi) & (s <= e)))
        who, s_hi, s, e_hi, e = who[go], s_hi[go], s[go], e_hi[go], e[go]
        if len(firsts[0]) + len(lasts[0]):
            yield tuple(np.concatenate(x) for x in zip(firsts, lasts, strict=True))


def _around(addresses: pa.Table, pieces: pa.Table, cols: Sequence[str]) -> pa.Table:
    """Of a stretch, each address that lies in a range, with cols of its longest block."""
    by = [(x, way) for x, way in zip(("s_hi", "s_lo", "e_hi", "e_lo"), ("descending",) * 2 + ("ascending",) * 2, strict=True)]
    # ordered as unsigned numbers: the innermost first, then the least cols
    flipped = {x: pa.array((_column(pieces, x) ^ np.uint64(1 << 63)).view(np.int64)) for x, _ in by}
    order = pc.sort_indices(pa.table(flipped | {c: pieces.column(c) for c in cols}), [*by, *((c, "ascending") for c in cols)], null_placement="at_start")
    pieces = pieces.take(order)
    family, of = _column(addresses, "bits"), _column(pieces, "bits")
    keys = _keys(family, _column(addresses, "hi"), _column(addresses, "lo"))
    rank = np.argsort(keys)
    keys, found = keys[rank], np.full(len(keys), -1)
    for bits in np.unique(of).tolist():
        own = np.flatnonzero(of == bits)
        ends = [_column(pieces, x)[own] for x in ("hi", "lo", "to_hi", "to_lo")]
        within = lambda hi, lo, side: np.searchsorted(keys, _keys(np.uint64(bits), hi, lo), side)  # noqa: E731, B023
        some = within(*ends[:2], "left") < within(*ends[2:], "right")
        own, ends = own[some], [x[some] for x in ends]
        for who, *numbers in _levels(bits, *ends):
            lo, hi = within(*numbers[:2], "left"), within(*numbers[2:], "right")
            order = np.flatnonzero(lo < hi)
            order = order[np.argsort(who[order], kind="stable")]
            lo, at = np.unique(lo[order], return_index=True)  # blocks of a size are the same, of which the first counts, or apart
            n, who = hi[order][at] - lo, who[order][at]
            places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            new = found[places] < 0
            found[places[new]] = own[np.repeat(who, n)][new]
    hit = np.flatnonzero(found >= 0)
    return pa.table([addresses.column("_ip").take(pa.array(rank[hit])), *(pieces.column(c).take(pa.array(found[hit])) for c in cols)], ["_ip", *cols])


def _edges(numbers: DataFrame) -> np.ndarray:
    """Where the stretches of (bits, hi, lo) begin, but the first, from a few of them for each stretch."""
    n = numbers.count()
    parts = -(-n // STRETCH)
    if parts < 2:
        return np.zeros(0, "S17")
    seen = numbers.sample(min(1.0, LOOKED_AT * parts / n), seed=1).toArrow()
    keys = np.sort(_keys(*(_column(seen, c) for c in ("bits", "hi", "lo"))))
    return np.unique(keys[np.arange(1, parts) * len(keys) // parts]) if len(keys) else keys


def network_lookup(df: DataFrame, ranges: DataFrame, ip_col: str, cols: dict[str, str], start: str = "start", end: str = "end") -> DataFrame:
    """df with cols (new name: name in ranges) of the innermost range around the address, null where none is;
    existing columns of the new names are replaced. start and end as in cidr_blocks(), which also says what
    counts where ranges cross.

    Each distinct address and range is sent once to its stretch; a range over an edge is sent as blocks to all
    that they touch. Edges come from a sample of both, so stretches grow in number, not in size.
    """
    names = [f"_c{i}" for i in range(len(cols))]
    seen = df.select(F.col(ip_col).alias("_ip")).filter("_ip IS NOT NULL").distinct()
    seen = with_addresses(seen.withColumn("_a", F.col("_ip")), ["_a"]).filter("_a IS NOT NULL").select("_ip", "_a.*")
    seen = written(seen, "addresses")
    r = _ranges(ranges.select(*[F.col(c).alias(n) for n, c in zip(names, cols.values(), strict=True)], start, end), names, start, end)
    r = r.filter("s IS NOT NULL").select(F.col("s.bits").alias("bits"), *[F.col(f"{x}.{y}").alias(f"{x}_{y}") for x in "se" for y in ("hi", "lo")], *names)
    r = written(r.distinct(), "ranges")
    edges = df.sparkSession.sparkContext.broadcast(_edges(seen.select("bits", "hi", "lo").union(r.select("bits", "s_hi", "s_lo"))))

    def placed(x: DataFrame, *ends: tuple[str, str, str]) -> DataFrame:
        schema = StructType([*x.schema.fields, *[StructField(n, LongType()) for n, *_ in ends]])
        return x.mapInArrow(lambda it: _placed(it, edges.value, ends), schema)

    of = placed(r, ("part", "s_hi", "s_lo"), ("to", "e_hi", "e_lo"))
    same = ["s_hi", "s_lo", "e_hi", "e_lo", *names]
    pieces = of.filter("part = to").select("part", "bits", *[F.col(x).alias(y) for x, y in zip(same[:4], ("hi", "lo", "to_hi", "to_lo"), strict=True)], *same)
    if len(edges.value):
        number = lambda x: F.struct("bits", *[F.col(f"{x}_{y}").alias(y) for y in ("hi", "lo")]).alias(x)
        wide = _blocks(of.filter("part < to").select(*names, *same[:4], number("s"), number("e")), [*names, *same[:4]])
        wide = wide.groupBy("bits", "length", "hi", "lo").agg(F.min_by("_cols", "_inner").alias("_cols"))
        size = F.col("bits") - F.col("length")
        upto = lambda n: F.when(n >= 64, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(n, F.lit(0)))))
        wide = wide.select("bits", "hi", "lo", F.col("hi").bitwiseOR(upto(size - 64)).alias("to_hi"), F.col("lo").bitwiseOR(upto(size)).alias("to_lo"), "_cols.*")
        wide = placed(wide, ("part", "hi", "lo"), ("to", "to_hi", "to_lo"))
        pieces = pieces.unionByName(wide.withColumn("part", F.explode(F.sequence("part", "to"))).drop("to"))
    kinds = {f.name: f.dataType for f in r.schema.fields}
    schema = StructType([StructField("_ip", StringType()), *[StructField(n, kinds[n]) for n in names]])
    best = (placed(seen, ("part", "hi", "lo")).groupBy("part").cogroup(pieces.groupBy("part"))
        .applyInArrow(lambda a, p: _around(a, p, names), schema).withColumnRenamed("_ip", "_at"))
    rest = [c for c in df.columns if c not in cols]
    joined = df.select(*rest).join(best, F.col(ip_col) == F.col("_at"), "left")
    return joined.select(*rest, *[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)])
