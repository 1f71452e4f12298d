"""Levels by template and by values, and the shared table operators, on small tables."""

import pytest
from pyspark.sql import functions as F

from cadastra.operators import codes, hierarchy, levels, names, tables


def test_template_levels():
    assert levels.template_levels(["adm0_code", "adm1_code", "adm2_code", "adm1_name"]) == [0, 1, 2]
    assert levels.template_levels(["adm1_name", "adm2_code"], require_codes=False) == [1, 2]
    with pytest.raises(ValueError, match="adm1_code"):
        levels.template_levels(["adm2_code", "adm1_name"])
    with pytest.raises(ValueError, match="no column"):
        levels.template_levels(["name", "adm0_code"])


def test_siblings_families_and_order():
    assert (levels.sibling("adm2_name", 1), levels.sibling("GID_2", 1)) == ("adm2_name1", "GID_2_1")
    assert levels.free_sibling("adm2_name", ["adm2_name", "adm2_name1", "adm2_name3"]) == "adm2_name2"
    assert levels.misordered(["n", "n1", "n2", "n_2", "GID_2_1", "GID_2"]) == ["GID_2"]
    assert levels.misordered(["name2", "name", "name1"]) == ["name"]
    assert levels.families(["adm1_code", "adm1_type", "adm2_type", "adm22_type", "x"], [1, 2], "adm{n}_code", "adm{n}_name") == {"adm{n}_code": {1: "adm1_code"}, "adm{n}_type": {1: "adm1_type", 2: "adm2_type"}}
    columns = ["x", "adm1_code", "adm1_name", "adm2_type", "adm2_name1", "adm2_name", "adm2_code", "adm3_area"]
    assert levels.canonical_order(columns) == (["adm2_name", "adm2_name1", "adm2_type", "adm2_code", "adm1_name", "adm1_code", "x", "adm3_area"], "adm2_code")
    assert levels.finer_columns(columns[:-1], ["adm1_name"]) == ["adm2_type", "adm2_name1", "adm2_name", "adm2_code"]
    with pytest.raises(ValueError):
        levels.finer_columns(columns, ["x"])


def test_guess_and_noise():
    assert levels.guess_columns(["fid", "area", "ADM2_PCODE", "label", "Name"]) == ("ADM2_PCODE", "Name")
    assert levels.guess_columns(["a", "b"]) == (None, None)
    assert [hierarchy.is_noise(c) for c in ("OBJECTID_1", "shape_le_1", "shape_le_12", "globalid", "id", "shape__are")] == [True, True, False, True, False, False]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"A{i // 12}", f"East {i // 12}", f"A{i // 12}-{i // 3}", f"Town {i // 3}", f"V{i}", "Landia", f"zone {i // 24}", i * 1.5) for i in range(48)]
    return spark.createDataFrame(rows, "adm1_code string, adm1_name string, adm2_code string, adm2_name string, adm3_name string, adm0_name string, zone string, size double")


def test_detected_levels(table):
    found = levels.detect_levels(table.drop("zone"))
    assert sorted(found) == [0, 1, 2, 3]
    assert found[1].code == "adm1_code" and found[2].code == "adm2_code" and found[1].kinds == {"adm1_code": "code", "adm1_name": "name"}
    assert found[0].columns == ["adm0_name"] and found[0].group_by == []
    with pytest.raises(ValueError):
        levels.detect_levels(table.select("size"))
    assert list(levels.detect_or_single(table.select("size"))) == [0]


def test_structure_rows_follow_the_shared_template(table):
    rows = levels.level_rows(table.drop("zone")).collect()
    assert {(r.level, r.column_name) for r in rows if r.problem is None} >= {(1, "adm1_code"), (1, "adm1_name"), (2, "adm2_code"), (2, "adm2_name")}
    assert not [r for r in rows if r.problem == "levels-undetected"]
    assert [r.problem for r in levels.level_rows(table.select("size")).collect()] == ["levels-undetected"]


def test_schema_checks_of_all_kinds(spark):
    df = spark.createDataFrame([("a", "x", "a1", None, 1), ("a", "x", "a2", "t", 2), ("b", "y", "a2", "t", 3), (None, "y", "b3", "t", 4)], "adm1_code string, adm1_name string, adm3_code string, Adm3Name string, size int")
    got = {(r.kind, r.level, r.column_name, r.code) for r in levels.schema_checks(df, "adm{n}_code").collect()}
    assert got == {("level-skipped", 2, None, None), ("column-naming", 3, "Adm3Name", None), ("multiple-parents", 3, "adm3_code", "a2"), ("orphan-child", 3, "adm3_code", "b3")}
    assert [r.kind for r in levels.schema_checks(df, "gid_{n}").collect()] == ["levels-undetected"]
    more = df.withColumn("adm1_type", F.lit("z"))
    assert ("column-set-mismatch", 3) not in {(r.kind, r.level) for r in levels.schema_checks(more, "adm{n}_code").collect()}
    both = more.withColumn("adm2_code", F.col("adm3_code")).withColumn("adm2_type", F.lit("z"))
    assert {(r.kind, r.level) for r in levels.schema_checks(both, "adm{n}_code").collect()} >= {("column-set-mismatch", 3), ("column-set-mismatch", 2)}


def test_cluster_guard(spark):
    df = spark.createDataFrame([("p", f"c{i}", f"n{i}", f"g{i // 5}", f"v{i % 3}") for i in range(10)] + [("p", "c0", None, "g0", "other")], "p string, c string, n string, g string, v string")
    got = {r.member: r.problem for r in levels.cluster_guard(df, "c", ["n", "g", "v"], "p").collect()}
    assert got == {"n": None, "g": "coarser", "v": "fragments"}
    levels.verify_cluster(df, "c", ["c", "n"], "p")
    with pytest.raises(ValueError, match="coarser"):
        levels.verify_cluster(df, "c", ["n", "g"], "p")


def test_codes_from_names(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None), ("b", None)], "p string, n string")
    assert {r.c for r in tables.seeded_codes(df, "c", "n", "p").collect()} == {"x", "y", None}
    with pytest.raises(ValueError, match="x"):
        tables.seeded_codes(df, "c", "n")


def test_html_table(spark):
    html = "<table id=m><TR class='h'><th>Country or <b>Area</b></th><th>ISO-alpha3 Code</th></TR><tr><td>C&#244;te&nbsp;d'Ivoire &amp; x</td>\n<td> CIV </td></tr><tr></tr><tr><td>&#128512;&lt;a&gt;</td></tr></table>"
    rows = tables.html_rows(spark.createDataFrame([(1, html), (2, None), (3, "no table")], "k int, h string"), "k", "h").orderBy("row").collect()
    assert [(r.k, r.cells) for r in rows] == [(1, ["Country or Area", "ISO-alpha3 Code"]), (1, ["Côte d'Ivoire & x", "CIV"]), (1, ["😀<a>"])]
    assert [r.x for r in spark.createDataFrame([("ISO-alpha3 Code ",), ("_A b",)], "h string").select(tables.header_name(F.col("h")).alias("x")).collect()] == ["iso_alpha3_code", "a_b"]


def test_decisions_sheet(spark):
    rows = [(1, " ken ", "Kenya ", "null", "TRUE", ""), (2, "KEN", "Kenya", " src2 ", "false", "2024"), (3, "", "none", "x", "true", ""), (4, None, "none", "x", "true", "")]
    got = tables.decisions(spark.createDataFrame(rows, "_row int, ` ISO3` string, Country_Name string, SELECTED_SOURCE string, accepted string, last_updated string")).collect()
    assert [tuple(r) for r in got] == [("KEN", "Kenya", "src2", False, False, "", "2024")]


def test_decoded_rows_are_those_of_the_plain_loop(spark):
    import random

    rng = random.Random(2)
    rows, want = [], []
    for g in range(5):
        before = [None] * 4
        for k in range(20):
            repeat, empty = (rng.randrange(16) if k else 0), rng.randrange(16)
            fresh = [i for i in range(4) if not (repeat >> i & 1) and not (empty >> i & 1)]
            values = [rng.randrange(9) for _ in fresh][: rng.randint(0, 4)]
            now, at = [], 0
            for i in range(4):
                if repeat >> i & 1:
                    now.append(before[i])
                elif empty >> i & 1:
                    now.append(None)
                else:
                    now.append(values[at] if at < len(values) else None)
                    at += 1
            before = now
            rows.append((g, k, repeat, empty, values))
            want += [(g, k, i, None if v is None else str(v)) for i, v in enumerate(now)]
    df = spark.createDataFrame(rows, "g int, k int, repeat int, empty int, values array<long>")
    got = tables.decode_rows(df, "g", "k", 4).collect()
    assert sorted((r.g, r.k, r.position, None if r.value is None else str(r.value)) for r in got) == sorted(want, key=lambda r: r[:3])


UNITS = "level int, name_column string, name_index int, code_column string, code string, parent_code string, name string, row_count long"


def unit(code, name, *, column="n", index=0, parent="p", level=2, rows=1):
    return level, column, index, "c", code, parent, name, rows


def test_normalized_duplicates(spark):
    cases = [("Saint-Denis", "Saint Denis"), ("SAINT DENIS x", "saint-denis X"), ("Évora", "Evora"), ("Évora b", "Evóra b"), ("Пётр", "Петр"), ("A-1", "A 1"), ("A1", "A 1"), ("same", "same")]
    rows = [unit(f"{i}{k}", n, parent=f"p{i}") for i, pair in enumerate(cases) for k, n in enumerate(pair)]
    got = {r.code_a[:-1] for r in names.normalized_duplicate(spark.createDataFrame(rows, UNITS)).collect()}
    assert got == {"0", "1", "2", "5"}


def test_report_of_names(spark):
    rows = [unit(f"c{i}", None if i < 5 else f"Name {i}") for i in range(11)] + [unit(f"c{i}", "" if i == 10 else f"Nom {i}", column="m", index=1) for i in range(11)]
    rows += [unit("x1", "a​b", level=1), unit("x1", "Ã©t​", level=1), unit("x2", "", level=1), unit("x2", " y ", level=1)]
    df = spark.createDataFrame(rows, UNITS)
    got = names.report(names.run_checks(df), df).collect()
    assert sorted((r.kind, r.level, r.name_column, r.code_a) for r in got) == sorted([("blank-name", 2, "n", f"c{i}") for i in range(5)] + [("blank-name", 2, "m", "c10"), ("blank-name", 1, "n", "x2"), ("encoding-artifact", 1, "n", "x1")])
    rows[5] = unit("c5", None)
    df = spark.createDataFrame(rows, UNITS)
    got = [r for r in names.report(names.run_checks(df), df).collect() if r.level == 2 and r.name_column == "n"]
    assert [(r.kind, r.code_a, r.reason[:9]) for r in got] == [("blank-name", None, "6 of the ")]
    two = spark.createDataFrame([unit("c1", None), unit("c1", None, column="m", index=1)] + [unit(f"d{i}", f"Nom {i}", column="m", index=1) for i in range(9)], UNITS)
    assert [(r.name_column, r.code_a) for r in names.report(names.run_checks(two), two).collect()] == [("m, n", "c1")]


def test_a_failing_check_is_a_finding(spark, monkeypatch):
    bad = lambda: (F.raise_error(F.lit("broken rule")).cast("boolean"), F.lit("x"), None)
    monkeypatch.setitem(names.RULES, "whitespace", bad)
    got = names.run_checks(spark.createDataFrame([unit("c1", " a "), unit("c2", "N/A")], UNITS)).collect()
    assert sorted(r.kind for r in got) == ["check-failed", "placeholder-name"] and "broken rule" in next(r.reason for r in got if r.kind == "check-failed")


def test_blank_codes_go_by_parent(spark):
    rows = [unit(None, "a", parent="p"), unit(None, "b", parent="p"), unit(None, "c", parent="q"), unit(" ", "d", parent="q"), unit(None, "e", index=1, parent="q")]
    got = [r.reason for r in codes.check_codes(spark.createDataFrame(rows, UNITS)).where("kind = 'blank-code'").collect()]
    assert sorted(got) == ["1 without a code below q", "2 without a code below p"]
