"""Admission: check order and both rate limiters (10/11 per name+address, 20/21 per address)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from territory_engine.operators import admission as A
from territory_engine.schema import RAW_CLAIM

T0 = 1_700_000_000_000


def raw(spark, rows):
    full = []
    for i, (name, ip, t) in enumerate(rows):
        d = {f.name: None for f in RAW_CLAIM.fields}
        d.update(name=name, original_ip=ip, time_ms=t, asn=13335, colo="LAX", country="US", region_code="CA",
                 city="", metro="")
        full.append(tuple(d[f.name] for f in RAW_CLAIM.fields) + (i,))
    schema = T.StructType(list(RAW_CLAIM.fields) + [T.StructField("seq", T.LongType())])
    return spark.createDataFrame(full, schema)


def verdicts(df):
    return [r["verdict"] for r in df.orderBy("seq").collect()]


def test_check_order(spark):
    rows = [("bad name", "", T0), (None, "1.2.3.4", T0), ("ok", "", T0), ("ok", "junk", T0), ("ok", "1.2.3.4", T0)]
    out = A.admit(raw(spark, rows))
    assert verdicts(out) == ["invalid_name", "invalid_name", "missing_address", "bad_address", "accepted"]
    r = out.where(F.col("verdict") == "accepted").first()
    assert (r["status"], r["region"], r["city_norm"], r["ip"]) == (200, "US-CA", None, "1.2.3.4")


def test_name_limit_10_of_11(spark):
    rows = [("n", "1.1.1.1", T0 + i) for i in range(11)]
    v = verdicts(A.admit(raw(spark, rows)))
    assert v == ["accepted"] * 10 + ["name_rate_limited"]


def test_ip_limit_20_of_21(spark):
    rows = [(f"n{i % 3}", "2.2.2.2", T0 + i) for i in range(21)]
    v = verdicts(A.admit(raw(spark, rows)))
    assert v == ["accepted"] * 20 + ["ip_rate_limited"]


def test_window_edge_resets(spark):
    base = (T0 // 10_000) * 10_000
    rows = [("n", "3.3.3.3", base + 9_000 + i) for i in range(10)] + [("n", "3.3.3.3", base + 10_000)]
    v = verdicts(A.admit(raw(spark, rows)))
    assert v == ["accepted"] * 11  # the 11th falls in the next period


def test_ipv6_share_one_limiter_key(spark):
    rows = [("n", f"2001:db8:1::{i:x}", T0 + i) for i in range(11)]
    out = A.admit(raw(spark, rows))
    assert verdicts(out)[-1] == "name_rate_limited"
    assert {r["ip"] for r in out.collect()} == {"2001:db8:1::"}


def test_to_claims_projection(spark):
    out = A.to_claims(A.admit(raw(spark, [("n", "1.2.3.4", T0)])))
    assert out.columns == ["ip", "name", "asn", "colo", "country", "region", "metro", "city", "time_ms"]
    assert out.count() == 1
