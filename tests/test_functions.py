import math

import pytest
from pyspark.sql import functions as F

from meristem.functions import special, vectors


def test_known_values():
    assert special.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    assert special.t_cdf(2.228139, 10) == pytest.approx(0.975, abs=1e-6)
    assert special.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-6)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.poisson_ppf(0.5, 3.0) == 3
    assert special.poisson_cdf(special.poisson_ppf(0.995, 700.0), 700.0) >= 0 and abs(special.poisson_ppf(0.5, 700.0) - 700) <= 1
    assert special.negative_binomial_ppf(0.5, 5, 4) is None
    assert special.hypergeometric_tail(0, 50, 10, 12) == pytest.approx(1.0)


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 1.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vectors.norm(F.col("a")).alias("n"), vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unit(F.col("a")).alias("u"), vectors.zscore(F.col("b")).alias("z")).collect()
    assert got[0]["n"] == 3.0 and got[0]["d"] == 4.0 and got[0]["c"] == pytest.approx(4 / (3 * math.sqrt(5)))
    assert got[1]["c"] is None and got[1]["u"] == [0.0, 0.0, 0.0] and got[1]["z"] == [0.0, 0.0, 0.0]


def test_js_is_symmetric(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])], "a array<double>, b array<double>")
    x, y = df.select(vectors.js(F.col("a"), F.col("b")), vectors.js(F.col("b"), F.col("a"))).first()
    assert x == pytest.approx(y) and 0 < x < math.log(2)
