"""Addresses, CIDR blocks and the longest prefix, against Python's ipaddress."""

import ipaddress
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perispark.operators import addresses, matching

TEXTS = (
    "1.2.3.4", " 255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "::", "::1", "2001:DB8::ff", "2001:db8:0:0:0:0:0:1", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1", "1:", "1::2:", ":1::2", "::1.2.3.4", "64:ff9b::1.2.3.4", "::ffff:10.0.0.1", "::ffff:0a00:1",
    "12345::", "g::", "fe80::1%eth0", "", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", None,
)


def parsed(text):
    try:
        ip = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    if getattr(ip, "scope_id", None):
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.max_prefixlen, int(ip)


def number(hi, lo):
    return (hi % 2**64) << 64 | lo % 2**64


def test_address(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("a", addresses.address(F.col("t")))
    for r in df.collect():
        assert (r.a and (r.a.bits, number(r.a.hi, r.a.lo))) == parsed(r.t), r.t


def test_blocks_are_the_least_that_cover_a_range(spark):
    rng = random.Random(1)
    ranges = [("0.0.0.0", "255.255.255.255"), ("0.0.0.0", "0.0.0.0"), ("255.255.255.255", "255.255.255.255"), ("10.0.0.1", "10.0.1.254"), ("::", "ffff" + ":ffff" * 7),
        ("::", "::5"), ("ffff::", "ffff" + ":ffff" * 7), ("2001:db8::1", "2001:db8:0:1::7"), ("7fff::1", "8000::"), ("::1:ffff:ffff:ffff", "1:0:0:1::")]
    for size in (32, 128):
        for _ in range(60):
            x, y = sorted((rng.getrandbits(rng.randint(1, size)), rng.getrandbits(size)))
            kind = ipaddress.IPv4Address if size == 32 else ipaddress.IPv6Address
            ranges.append((str(kind(x)), str(kind(y))))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)] + [(900, "1.1.1.2", "1.1.1.1"), (901, "::1", "1.1.1.1"), (902, None, "::1")], "id int, start string, end string")
    # one range at a time, as blocks of several are shared
    got = {}
    for i, r in enumerate(ranges):
        got.setdefault(i, set())
    every = df.groupBy("id").agg(F.first("start").alias("start"), F.first("end").alias("end"))
    for r in addresses.cidr_blocks(every, ["id", "start", "end"]).collect():
        got.setdefault(r.id, set()).add((r.bits, r.length, number(r.hi, r.lo)))
    assert not {900, 901, 902} & set(got)
    owned = {}
    want = {}
    for i, (s, e) in enumerate(ranges):
        s, e = ipaddress.ip_address(s), ipaddress.ip_address(e)
        for n in ipaddress.summarize_address_range(s, e):
            key = (n.max_prefixlen, n.prefixlen, int(n.network_address))
            order = (-int(s), int(e), i)
            if key not in owned or order < owned[key]:
                owned[key] = order
                want[key] = i
    flat = {key: i for i, keys in got.items() for key in keys}
    assert flat == want and sum(map(len, got.values())) == len(flat)


def nested(rng, kind, low, high, depth, out):
    if depth == 0 or high - low < 4:
        return
    at = low
    for _ in range(3):
        s = rng.randint(at, high)
        e = rng.randint(s, min(high, s + (high - low) // 2))
        if (s, e) == (low, high):
            continue
        out.append((str(kind(s)), str(kind(e))))
        nested(rng, kind, s, e, depth - 1, out)
        at = e + 1
        if at > high:
            break


@pytest.mark.parametrize("short", [0, 12, 200])
def test_innermost_range(spark, monkeypatch, short):
    monkeypatch.setattr(addresses, "SHORT", short)
    rng, ranges = random.Random(4), []
    nested(rng, ipaddress.IPv4Address, 0, 2**32 - 1, 5, ranges)
    nested(rng, ipaddress.IPv6Address, 2**125, 2**126, 5, ranges)
    ends = [parsed(x) for r in ranges for x in r]
    ips = [str((ipaddress.IPv4Address if b == 32 else ipaddress.IPv6Address)(max(0, min(2**b - 1, n + d)))) for b, n in ends for d in (-1, 0, 1)]
    rows = [(i, ip, "old") for i, ip in enumerate([*ips, *ips[:50], None, "", "no address"])]
    df = spark.createDataFrame(rows, "id int, ip string, country_code string")
    table = spark.createDataFrame([(s, e, f"c{i}") for i, (s, e) in enumerate(ranges)], "start string, end string, country_code string")
    got = {r.id: r.country_code for r in matching.geocode(df, table).collect()}

    numbers = [(*parsed(s), parsed(e)[1]) for s, e in ranges]

    def innermost(ip):
        at = parsed(ip)
        inside = [(e - s, f"c{i}") for i, (bits, s, e) in enumerate(numbers) if at and at[0] == bits and s <= at[1] <= e]
        return min(inside)[1] if inside else None

    assert got == {i: innermost(ip) for i, ip, _ in rows}
    assert matching.geocode(df.limit(0), table).collect() == []
    assert {r.country_code for r in matching.geocode(df, table.limit(0)).collect()} == {None}


def test_usual_texts_are_read_without_expressions():
    for t in (*TEXTS, "0000001::", "1::2:3:4:5:6:7:8", "01.2.3.4", "1.2.3.4\n", "::1\0", "é::", "1:2:3:4:5:6:7::"):
        packed = addresses._packed(t)
        if packed is not None:
            ip = ipaddress.ip_address(packed)
            assert parsed(t) == (32, int(ip.ipv4_mapped)) if ip.ipv4_mapped else (128, int(ip)), t
    usual = ("1.2.3.4", " 255.255.255.255", "2001:DB8::ff", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "2001:0db8:0:0001:0:0:0:a")
    assert all(addresses._packed(t) for t in usual)


def test_levels_are_the_blocks_of_ranges():
    rng = random.Random(2)
    for bits, kind in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        top = 2**bits - 1
        ranges = [(0, top), (0, 0), (top, top), (1, top), (0, top - 1), (1, 2), (2**(bits - 1) - 1, 2**(bits - 1))]
        ranges += [tuple(sorted((rng.getrandbits(rng.randint(1, bits)), rng.getrandbits(bits)))) for _ in range(200)]
        halves = [np.array([x >> by & 2**64 - 1 for x in xs], np.uint64) for xs in zip(*ranges, strict=True) for by in (64, 0)]
        got = {}
        for who, *numbers in addresses._levels(bits, *halves):
            for i, a, b, c, d in zip(who.tolist(), *(x.tolist() for x in numbers), strict=True):
                got.setdefault(i, set()).add((a << 64 | b, c << 64 | d))
        for i, (s, e) in enumerate(ranges):
            assert got[i] == {(int(n[0]), int(n[-1])) for n in ipaddress.summarize_address_range(kind(s), kind(e))}, (s, e)


@pytest.mark.parametrize("stretch", [7, 40, 10**6])
def test_lookup_in_stretches(spark, monkeypatch, stretch):
    """Ranges that nest, cross, repeat and lie over edges, against the longest block of all ranges."""
    monkeypatch.setattr(addresses, "STRETCH", stretch)
    rng, ranges = random.Random(9), []
    for kind, bits in ((ipaddress.IPv4Address, 32), (ipaddress.IPv6Address, 128)):
        for _ in range(60):
            s = rng.getrandbits(bits) >> rng.choice((0, 0, 4, bits // 2))
            ranges.append((str(kind(s)), str(kind(min(2**bits - 1, s + rng.getrandbits(rng.randint(1, bits)))))))
        ranges += [(str(kind(0)), str(kind(2**bits - 1)))] + ranges[-3:]
    cols = [f"c{i:03}" for i in range(len(ranges))]
    rng.shuffle(cols)
    blocks = {}
    for (s, e), c in zip(ranges, cols, strict=True):
        s, e = ipaddress.ip_address(s), ipaddress.ip_address(e)
        for n in ipaddress.summarize_address_range(s, e):
            order = (-int(s), int(e), c)
            blocks[n] = min(blocks.get(n, order), order)
    ips = [str(ipaddress.ip_address(x)) for r in ranges for x in r] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)]

    def longest(ip):
        ip = ipaddress.ip_address(ip)
        if getattr(ip, "ipv4_mapped", None):
            ip = ip.ipv4_mapped
        around = [ipaddress.ip_network((ip, n), strict=False) for n in range(ip.max_prefixlen, -1, -1)]
        return next(blocks[n][2] for n in around if n in blocks)

    df = spark.createDataFrame(list(enumerate(ips)), "id int, ip string")
    table = spark.createDataFrame([(*r, c) for r, c in zip(ranges, cols, strict=True)], "start string, end string, country_code string")
    assert {r.id: r.country_code for r in matching.geocode(df, table).collect()} == {i: longest(ip) for i, ip in enumerate(ips)}


def test_ranges_as_numbers(spark, monkeypatch):
    monkeypatch.setattr(addresses, "STRETCH", 2)
    table = spark.createDataFrame([(16777216, 33554431, "a"), (16777220, 16777221, "b")], "start long, end long, country_code string")
    for kind in ("long", "int"):
        ranges = table.withColumns({c: F.col(c).cast(kind) for c in ("start", "end")})
        df = spark.createDataFrame([("1.0.0.3",), ("1.0.0.4",), ("1.0.0.5",), ("1.0.0.6",), ("2.0.0.0",)], "ip string")
        assert {r.ip[-1]: r.country_code for r in matching.geocode(df, ranges).collect() if r.ip[0] == "1"} == {"3": "a", "4": "b", "5": "b", "6": "a"}
