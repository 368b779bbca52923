"""Column expressions against plain arithmetic."""

import random
import struct
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from pulsegrid.functions import exprs as X


def exact(x, digits):
    """A double with so many decimals, from its whole binary expansion; ties go away from zero."""
    text = str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return ("-" if x < 0 else "") + text


def test_fixed_is_exact(spark):
    rng = random.Random(4)
    numbers = [1.005, 0.25, 1.45, 2.675, -0.04, 0.0, 0.125, 8.345, 1e13 + 0.3, 123456.785, 0.5, 1.5, 2.5, -2.5, 0.049999999999999996, 9.995, 99.95, 5e-324, 1e-9]
    numbers += [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randint(-9999, 9999) / 1000 for _ in range(500)] + [rng.randint(-4000, 4000) / 16 for _ in range(200)]
    numbers += [x for x in (struct.unpack("d", struct.pack("Q", rng.getrandbits(62)))[0] for _ in range(300)) if abs(x) < 1e11]
    df = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double").select("x", *[X.fixed(F.col("x"), d).alias(f"d{d}") for d in range(5)], X.fixed_number(F.col("x"), 2).alias("n"))
    for r in df.collect():
        if r.x is None:
            assert r.d1 is None and r.n is None
            continue
        assert [r[f"d{d}"] for d in range(5)] == [exact(r.x, d) for d in range(5)], r.x
        assert r.n == float(exact(r.x, 2))
    shown = spark.sql("select double('NaN') as a, double('Infinity') as b, 1e20 as c").select(*[X.fixed(F.col(c).cast("double"), 1).alias(c) for c in "abc"]).first()
    assert (shown.a, shown.b, shown.c) == ("NaN", "Infinity", "100000000000000000000.0")


def test_fixed_known_values(spark):
    got = spark.range(1).select(X.fixed(F.lit(1.005), 2), X.fixed(F.lit(0.25), 1), X.signed(F.lit(0.25), 1, " ms"), X.signed(F.lit(-1.005), 2)).first()
    assert list(got) == ["1.00", "0.3", "+0.3 ms", "-1.00"]


def test_pace_text(spark):
    got = spark.createDataFrame([(300.0,), (359.6,), (61.5,), (None,)], "x double").select(X.pace_text(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == ["5:00/km", "5:60/km", "1:02/km", "unknown"]
