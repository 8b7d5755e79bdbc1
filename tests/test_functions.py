"""Column functions on small hand-made inputs."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crivo.functions import stats, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


TEXTS = ["Não declarada", "Cor / Raça", "1º", "3ª", "½ ﬁ…™", "한글 é", "𝐀x", "á", " x", "字豈", "plain", "", None]


def test_strip_accents_is_exact(spark):
    got = values(spark, [(t,) for t in TEXTS], "t string", text.strip_accents(F.col("t")))
    assert [g[0] for g in got] == [None if t is None else text.strip_accents_text(t) for t in TEXTS]


def test_strip_accents_on_every_character(spark):
    chars = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i <= 0xDFFF]
    chunks = ["".join(chars[i:i + 200]) for i in range(0, len(chars), 200)]
    got = values(spark, [(c,) for c in chunks], "t string", text.strip_accents(F.col("t")))
    assert [g[0] for g in got] == [text.strip_accents_text(c) for c in chunks]


def test_latin_accents_are_exact_unless_beyond_latin(spark):
    chars = [chr(i) for i in range(0x20, 0x600)]
    got = values(spark, [(c,) for c in chars], "t string", text.strip_latin_accents(F.col("t")), text.beyond_latin(F.col("t")))
    for c, (plain, beyond) in zip(chars, got):
        assert beyond or plain == text.strip_accents_text(c)
    assert not any(beyond for c, (_, beyond) in zip(chars, got) if c in "ãáàâçéêíóôõúüªº")


def test_trim_all(spark):
    got = values(spark, [("\t a b \n ",), (None,)], "t string", text.trim_all(F.col("t")))
    assert got == [("a b",), (None,)]


def test_base_name(spark):
    rows = [("/x/y/m_2023.csv",), ("a.b.c",), ("plain",), (".hidden",)]
    got = values(spark, rows, "t string", text.base_name(F.col("t")))
    assert got == [("m_2023",), ("a.b",), ("plain",), (".hidden",)]


def test_day_first_epoch_ignores_the_zone(spark):
    rows = [("31/12/2020",), ("1/2/2020 03:04",), ("32/1/2020",), (None,), ("2020-05-06",)]
    want = [(1609372800,), (1580526240,), (0,), (0,), (1588723200,)]
    assert values(spark, rows, "t string", text.day_first_epoch(F.col("t"))) == want
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert values(spark, rows, "t string", text.day_first_epoch(F.col("t"))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_na_tokens(spark):
    got = values(spark, [("NA",), ("",), ("x",), (None,)], "t string", text.na_to_null(F.col("t")))
    assert got == [(None,), (None,), ("x",), (None,)]


def tail(x, dof):
    """Closed form by recurrence over the degrees of freedom."""
    if dof % 2 == 0:
        return math.fsum(math.exp(-x / 2 + j * math.log(x / 2) - math.lgamma(j + 1)) for j in range(dof // 2))
    terms = (math.exp(-x / 2 + (j + 0.5) * math.log(x / 2) - math.lgamma(j + 1.5)) for j in range((dof - 1) // 2))
    return math.erfc(math.sqrt(x / 2)) + math.fsum(terms)


def test_chi2_sf(spark):
    rows = [(float(d * m), d) for d in (1, 2, 3, 7, 10, 25, 100, 999, 5000) for m in (0.1, 0.7, 1.0, 1.01, 1.4, 3.0)]
    got = values(spark, rows, "x double, d int", "x", "d", stats.chi2_sf("x", "d"))
    for x, d, p in got:
        assert p == pytest.approx(tail(x, d), rel=1e-9, abs=1e-290)


def test_chi2_sf_at_the_edges(spark):
    rows = [(0.0, 1), (-3.0, 2), (None, 1), (float("nan"), 1), (5.0, 0), (1e7, 3)]
    got = values(spark, rows, "x double, d int", stats.chi2_sf("x", "d"))
    assert got == [(1.0,), (1.0,), (None,), (None,), (1.0,), (0.0,)]


def test_sigmoid_and_loss_do_not_overflow(spark):
    got = values(spark, [(-900.0, 1), (0.0, 0), (900.0, 0)], "z double, y int",
                 stats.sigmoid(F.col("z")), stats.log_loss(F.col("z"), F.col("y")))
    assert got[0] == (0.0, 900.0)
    assert got[1] == (0.5, pytest.approx(math.log(2)))
    assert got[2] == (1.0, 900.0)


def test_is_close(spark):
    rows = [(1.0, 1.0 + 1e-6), (1.0, 1.1), (None, None), (1e6, 1e6 + 5.0)]
    got = values(spark, rows, "a double, b double", stats.is_close(F.col("a"), F.col("b")))
    assert got == [(True,), (False,), (False,), (True,)]


def test_corrected_v_with_one_category_is_missing(spark):
    v = stats.corrected_v(F.col("c"), F.col("n"), F.col("r"), F.col("k"))
    got = values(spark, [(0.0, 10, 1, 2), (10.0, 10, 2, 2)], "c double, n long, r long, k long", v)
    assert got[0] == (None,)
    assert got[1][0] == pytest.approx(1.0)


def test_formats(spark):
    got = values(spark, [(1234.56789,)], "x double", stats.number_text(F.col("x")), stats.scientific_text(F.col("x")))
    assert got == [("1234.5679", "1.23e+03")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_strip_accents_on_any_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) <= 0xDFFF for c in t)] or ["é"]
    got = values(spark, [(t,) for t in texts], "t string", text.strip_accents(F.col("t")))
    assert [g[0] for g in got] == [text.strip_accents_text(t) for t in texts]
