import math

import pytest
from pyspark.sql import functions as F

from mnemora.functions import activation as act
from mnemora.functions import location as loc
from mnemora.functions import visual as vis
from mnemora.functions.text import gist, gist_of, media_path
from mnemora.functions.vector import cosine, unit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_familiarity(spark):
    f = lambda n: value(spark, loc.familiarity(F.lit(n)))
    assert f(1) == pytest.approx(0.0909, abs=1e-3) and f(10) == pytest.approx(0.5) and f(24) >= 0.7
    assert value(spark, loc.floor_of(F.lit(0.9))) == pytest.approx(0.26)
    assert not value(spark, loc.well_known(F.lit(0.69))) and value(spark, loc.well_known(F.lit(0.7)))
    assert value(spark, loc.decayed(F.lit(0.9), F.lit(100.0), F.lit(True))) == 0.9
    assert math.isnan(value(spark, loc.decayed(F.lit(float("nan")), F.lit(100.0), F.lit(False))))
    assert value(spark, loc.association_strength(F.lit(2), 5.0)) == pytest.approx(0.5)


def test_working_memory(spark):
    b = lambda ms: value(spark, act.working_memory_boost(F.lit(float(ms))))
    assert b(0) == 2.0 and b(4000) == pytest.approx(1.37, abs=0.01) and b(8000) == pytest.approx(1.14, abs=0.01) and b(20000) < 1.01 and b(-5) == 1.0


def test_surprise_and_zones(spark):
    assert value(spark, act.surprise(F.lit(1.0), F.lit(0.0), F.lit(0.5))) < 0.1
    assert value(spark, act.surprise(F.lit(0.0), F.lit(0.0), F.lit(0.5))) > 0.5
    low, high = act.thresholds(F.lit(100), F.lit(50.0))
    assert value(spark, low) == pytest.approx(0.35) and value(spark, high) == pytest.approx(0.4)


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(x) for x in v]) for v in ((1.0, 0.0), (0.0, 2.0), (0.0, 0.0)))
    assert value(spark, cosine(a, b)) == 0 and value(spark, cosine(a, a)) == 1 and value(spark, cosine(a, z)) == 0
    assert value(spark, cosine(a, F.array(F.lit(1.0)))) == 0 and value(spark, unit(z)) == [0.0, 0.0] and value(spark, unit(b)) == [0.0, 1.0]


def test_hashes(spark):
    h = lambda x, y: value(spark, vis.hamming(F.lit(x), F.lit(y)))
    assert h("ff" * 8, "f0" * 8) == 32 and h("ff00" * 4, "f00f" * 4) == 32 and h("0" * 16, "0" * 16) == 0


def test_activity(spark):
    a = lambda text, tool=None: value(spark, loc.activity(F.lit(text), F.lit(tool)))["activity"]
    assert a("Fix the login bug") == "debugging" and a("tidy", "Read") == "reading" and a("hum") == "unknown" and a(None, "Edit") == "writing"
    assert a("refactor and review") == "refactoring"


def test_gist(spark):
    assert gist_of("") == "" and gist_of("  a  b ") == "a b" and gist_of(None) is None
    text = "This is the opening sentence of it. " + "Then parsers met parsers and lexers met lexers. " * 4
    assert gist_of(text) == "This is the opening sentence of it. [parsers, lexers]"
    assert gist_of("word " * 100) == ("word " * 29).strip() + "..."
    assert [r[0] for r in spark.createDataFrame([("x",), (None,)], "t string").select(gist(F.col("t"))).collect()] == ["x", None]


def test_media(spark):
    m = lambda t: value(spark, media_path(F.lit(t)))
    assert m('see "/a b/c.png" or d.jpg') == "/a b/c.png" and m("https://x.example/y.gif now") == "https://x.example/y.gif" and m("at img.webp") == "img.webp" and m("none") is None
