"""Scalar functions on boundary fixtures (FIXTURES §2: names, addresses, ages)."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from model import colour
from territory_engine.functions import addresses as A
from territory_engine.functions import clock as K
from territory_engine.functions import names as N
from territory_engine.functions.labels import territory_type_of_id


def one_col(spark, values, typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


NAMES = {
    None: False, "": False, "a": True, "a" * 40: True, "a" * 41: False, "a b": False, "a?": False,
    "é": False, "name\n": False, "Ab-9_x": True,
}
for ch in "@:.^+!/-_*":
    NAMES["x" + ch] = True


def test_valid_name(spark):
    df = one_col(spark, list(NAMES))
    got = {r["v"]: r["ok"] for r in df.select("v", N.valid_name("v").alias("ok")).collect()}
    assert got == NAMES


def test_colour_matches_js_semantics(spark):
    names = ["a", "Alice", "zz-top", "x" * 40, "ABC@:.^+!/-_*", "0"]
    df = one_col(spark, names).select("v", N.name_colour("v", 5).alias("f"), N.name_colour("v", 8).alias("s"))
    for r in df.collect():
        assert r["f"] == colour(r["v"], 5)
        assert r["s"] == colour(r["v"], 8)


ADDRESSES = [
    ("1.2.3.4", "1.2.3.4"),
    ("255.255.255.255", "255.255.255.255"),
    ("256.1.1.1", None),
    ("1.2.3", None),
    ("", None),
    ("junk", None),
    ("2001:db8:1:2:3:4:5:6", "2001:db8:1::"),
    ("2001:0DB8:0001::1", "2001:db8:1::"),
    ("::", "::"),
    ("::1", "::"),
    ("2001::", "2001::"),
    ("2001:0:0:1::", "2001::"),
    ("0:0:5::", "0:0:5::"),
    ("0:5:0::1", "0:5::"),
    ("1:2:3:4:5:6:7:8:9", None),
    ("1::2::3", None),
    ("12345::", None),
]


def test_recorded_ip(spark):
    from territory_engine.operators.admission import recorded_ip
    df = one_col(spark, [a for a, _ in ADDRESSES]).select("v", recorded_ip("v").alias("r"))
    got = {r["v"]: r["r"] for r in df.collect()}
    assert got == dict(ADDRESSES)


def test_prefix48_matches_ipaddress(spark):
    samples = ["2001:db8:abcd:12::1", "fe80::1", "::ffff:0:1", "2001:DB8:0:0:8:800:200c:417a", "0:0:0:1::"]
    df = one_col(spark, samples).select("v", A.ipv6_prefix48("v").alias("p"))
    for r in df.collect():
        net = ipaddress.IPv6Network(r["v"] + "/48", strict=False)
        assert r["p"] == net.network_address.compressed, r["v"]


def test_mask_ip(spark):
    vals = {"10.1.2.3": "10.x.x.x", "999.1.1.1": "999.x.x.x", "2001:db8::": "2001:db8::", "1.2.3": "1.2.3"}
    df = one_col(spark, list(vals)).select("v", A.mask_ip("v").alias("m"))
    assert {r["v"]: r["m"] for r in df.collect()} == vals


NOW = 10_000_000_000_000


@pytest.mark.parametrize("age,unit,value", [
    (0, "second", 0),
    (119_999, "second", -120),
    (120_000, "minute", -2),
    (3_599_999, "minute", -60),
    (3_600_000, "hour", -1),
    (86_399_999, "hour", -24),
    (86_400_000, "day", -1),
    (7 * 86_400_000, "week", -1),
    (60 * 86_400_000 - 1, "week", -9),
    (60 * 86_400_000, "month", -2),
    (90_000, "second", -90),
    (1500, "second", -1),     # -1.5 rounds toward +infinity
    (2500, "second", -2),     # -2.5 -> -2
])
def test_relative_age(spark, age, unit, value):
    df = spark.createDataFrame([(NOW - age,)], "t bigint")
    u, v = K.relative_age("t", NOW)
    r = df.select(u.alias("u"), v.alias("v")).first()
    assert (r["u"], r["v"]) == (unit, value)


def test_recent_age(spark):
    df = spark.createDataFrame([(NOW - 119_999,), (NOW - 120_000,), (NOW - 5_400_000,), (NOW - 30 * 86_400_000,)], "t bigint")
    u, v = K.recent_age("t", NOW)
    got = [(r["u"], r["v"]) for r in df.select(u.alias("u"), v.alias("v")).collect()]
    assert got == [("second", -120), ("minute", -2), ("hour", -2), ("hour", -720)]  # 1.5 h rounds up to 2


@pytest.mark.parametrize("label,inclusive,expected", [
    ("hourly", False, [False, False, True]),
    ("hourly", True, [False, True, True]),
    ("all-time", False, [True, True, True]),
])
def test_window_cut(spark, label, inclusive, expected):
    cut = NOW - 3_600_000
    df = spark.createDataFrame([(cut - 1,), (cut,), (cut + 1,)], "t bigint")
    got = [r["w"] for r in df.select(K.in_window("t", NOW, label, inclusive).alias("w")).collect()]
    assert got == expected


def test_territory_type_of_id(spark):
    df = one_col(spark, ["US", "LAX", "US-CA", "X"]).select("v", territory_type_of_id("v").alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == {"US": "country", "LAX": "colo", "US-CA": "region", "X": "region"}


def test_prefix48_property(spark):
    """Random IPv6 addresses in several spellings: /48 network equals ``ipaddress``'s."""
    import random
    rng = random.Random(11)
    texts = []
    for _ in range(300):
        groups = [rng.choice([0, 0, rng.randrange(1 << 16)]) for _ in range(8)]
        addr = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups))
        style = rng.randrange(3)
        text = addr.exploded if style == 0 else addr.compressed if style == 1 else addr.compressed.upper()
        texts.append(text)
    df = one_col(spark, texts).select("v", A.is_ipv6("v").alias("ok"), A.ipv6_prefix48("v").alias("p"))
    for r in df.collect():
        assert r["ok"], r["v"]
        assert r["p"] == ipaddress.IPv6Network(r["v"] + "/48", strict=False).network_address.compressed, r["v"]


def test_mixed_notation_matches_ipaddress(spark):
    """Texts with an embedded dotted quad, right and wrong ones: validity and /48 network as ``ipaddress`` has them."""
    rng = random.Random(48)
    texts = ["::1.2.3.4", "::ffff:255.255.255.255", "1:2:3:4:5:6:7.8.9.10", "1:2:3:4:5:6:7:8.9.10.11", "1::6:1.2.3.4", "1.2.3.4", "::1.2.3", "::1.2.3.4.5",
             "::1.2.3.256", "::01.2.3.4", ":1.2.3.4", "1:2:3:4:5::7.8.9.10", "1:2:3:4:5:6::7.8.9.10", "::1.2.3.4:5", "::g:1.2.3.4", "1.2.3.4::", "", "::0.0.0.0",
             "2001:DB8:1:2:3:4:0.0.0.1", "::1.2.3.4 ", "::1.2.3.4\n", "64:ff9b::192.0.2.33"]
    for _ in range(300):
        n = rng.randrange(0, 8)
        head = ":".join(rng.choice(["0", "1", "ab", "FFFF", "12345"][: rng.choice([4, 4, 5])]) for _ in range(n))
        head = rng.choice([head, head.replace("0:", ":", 1), "::" + head, head + ":"])
        texts.append(head + ":" + ".".join(str(rng.choice([0, 1, 9, 10, 99, 255, rng.choice([256, 7])])) for _ in range(4)))
    df = one_col(spark, texts).select("v", A.is_ipv6("v").alias("ok"), A.ipv6_prefix48("v").alias("p"))
    valid = 0
    for r in df.collect():
        try:
            want = ipaddress.IPv6Network(r["v"] + "/48", strict=False).network_address.compressed
        except ValueError:
            assert not r["ok"], r["v"]
            continue
        assert r["ok"] and r["p"] == want, r
        valid += 1
    assert valid > 50
