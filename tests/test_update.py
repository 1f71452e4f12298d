"""Codes of a hierarchy carried over to its next version, on a small hierarchy."""

import pytest
from pyspark.sql import functions as F

from cadastra.operators import update
from cadastra.operators.codes import CodeFormat

FIELDS = "fid long, adm1_code string, adm1_name string, adm2_code string, adm2_name string, xmin double, ymin double, xmax double, ymax double"


def unit(fid, a, b, x, y, w=10.0, h=10.0, name=None):
    return fid, a, f"region {a}", b, name or f"place {b}", float(x), float(y), x + w, y + h


@pytest.fixture(scope="module")
def sides(spark):
    old = [unit(1, "K-01", "K-01-01", 0, 0), unit(2, "K-01", "K-01-02", 10, 0), unit(3, "K-01", "K-01-03", 20, 0), unit(4, "K-02", "K-02-01", 0, 50), unit(5, "K-02", "K-02-02", 10, 50)]
    new = [unit(1, "n1", "p", 0, 0), unit(2, "n1", "q", 10, 0, w=5.0), unit(3, "n1", "r", 15, 0, w=5.0), unit(4, "n1", "s", 20, 0), unit(5, "n2", "t", 0, 50, w=20.0), unit(6, "n2", "u", 40, 50)]
    return spark.createDataFrame(old, FIELDS), spark.createDataFrame(new, FIELDS)


def test_all_levels(sides):
    out, log = update.update_hierarchy(*sides, [1, 2], CodeFormat("K", "-", 2))
    got = {r.fid: (r.adm1_code, r.adm2_code, r.predecessor_adm2_code) for r in out.collect()}
    assert got == {
        1: ("K-01", "K-01-01", "K-01-01"), 4: ("K-01", "K-01-03", "K-01-03"),  # unchanged
        2: ("K-01", "K-01-04", "K-01-02"), 3: ("K-01", "K-01-05", "K-01-02"),  # a split keeps its predecessor
        5: ("K-03", "K-03-01", None), 6: ("K-03", "K-03-02", None),  # a merge and a new unit, below a region that is modified
    }
    rows = {(r.level, r.outcome, r.old_code) for r in log.collect()}
    assert {(2, "retired", "K-02-01"), (2, "retired", "K-02-02"), (2, "retained", "K-01-01")} <= rows
    codes = [r.new_code for r in log.collect() if r.new_code]
    assert len(codes) == len(set(codes))


def test_sides_are_checked(sides, spark):
    old, new = sides
    seeded = update.checked_side(new.drop("adm2_code"), [1, 2], "adm{n}_code", "adm{n}_name", seed=True)
    assert {r.adm2_code for r in seeded.collect()} >= {"n1 > place p", "n2 > place t"}
    for bad, match in ((old.withColumn("adm1_code", F.when(F.col("fid") > 1, F.col("adm1_code"))), "1 rows"), (old.withColumn("adm2_code", F.lit("x")), "several names"), (old.drop("adm2_code"), "no column")):
        with pytest.raises(ValueError, match=match):
            update.checked_side(bad, [1, 2], "adm{n}_code", "adm{n}_name")


def test_overflow(spark):
    log = spark.createDataFrame([(2, f"K-01-{i:02d}") for i in range(1, 12)] + [(2, "K-02-1"), (1, "K-01"), (1, None)], "level int, new_code string")
    assert [tuple(r) for r in update.overflowing(log, CodeFormat("K", "-", [2, 1]), [1, 2]).collect()] == [(2, "K-01", 11, 1)]
