import enum
import hashlib
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from meshweave.functions import hashing, names
from meshweave.functions.dtypes import NUMERIC, promote, promoted, spark_type


def test_cache_name_limit():
    path = "https://example.org/" + "a" * 256 + ".nc"
    name = names.cache_name(path)
    assert len(name) == 255 and name.endswith(".nc") and name.startswith(hashlib.md5(path.encode()).hexdigest())
    assert len(names.cache_name(path, None)) > 255


def test_cache_name_column(spark):
    paths = ["https://é.example/Ä b--c.nc?x=1&y", "a" * 400 + ".nc", "-_x_-", ""]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", names.cache_name_of(F.col("p")).alias("n")).collect()
    assert [r.n for r in rows] == [names.cache_name(r.p) for r in rows]


def test_secrets():
    assert names.with_secrets("http://a/b?x=1", {"token": "s e"}) == "http://a/b?x=1&token=s+e"
    assert names.with_secrets("http://a/b?token=1", {"token": "2"}) == "http://a/b?token=2"
    assert names.with_secrets("http://a/b", None) == "http://a/b"


class Kind(enum.Enum):
    A = "a"


class Hashed:
    def sha256(self):
        return b"\x01\x02"


@dataclass
class Inner:
    note: str = ""
    n: int | None = None


@dataclass
class Outer:
    size: int
    inner: Inner
    tags: tuple = ()
    off: bool = False


@pytest.mark.parametrize("settings,text", [
    ({"b": Kind.A, "a": Hashed()}, '{"a":"0102","b":"a"}'), ({"k": "é", "n": None, "l": [], "z": 0, "f": False}, '{"f":false,"k":"é","z":0}'), ({"k": {"n": None, "m": {}}}, '{"k":{"m":{},"n":null}}'),
    (Outer(3, Inner("x")), '{"inner":{"note":"x"},"off":false,"size":3}'), (Outer(0, Inner(), ("t", Kind.A)), '{"off":false,"size":0,"tags":["t","a"]}'), ({}, "{}"),
])
def test_fingerprints(settings, text):
    assert hashing.fingerprint(settings) == hashlib.sha256(text.encode()).digest()


def test_fingerprints_refuse_and_ignore():
    assert hashing.fingerprint(Outer(1, Inner(n=5)), ignore=["inner"]) == hashing.fingerprint({"size": 1, "off": False})
    for bad in (5, "text", Outer, [1]):
        with pytest.raises(ValueError):
            hashing.fingerprint(bad)
    with pytest.raises(TypeError):
        hashing.fingerprint({"a": object()})


def test_promotion(spark):
    import numpy as np

    pairs = [(a, b) for a in NUMERIC for b in NUMERIC]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", promote(F.array("a", "b")).alias("t")).collect()
    assert all(r.t == np.promote_types(r.a, r.b).name == promoted([r.a, r.b]) for r in rows)
    assert spark_type("uint32") == "bigint" and spark_type("uint64") == "decimal(20,0)" and spark_type("datetime64[ns]") == "bigint"
