"""Golden cells of the table engine, its contracts, lineage, round trips and post-processing."""

import math
import warnings
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as t
from tessera.functions.post import apply_conditional_format, apply_row_masks, as_display, collapse_row_labels, get_data_labels, replace_leading_whitespace, str_extract_num, wrap_text
from tessera.functions.stats import betainc, proportion_ci_values, qbeta, quantile


def table(result):
    return [tuple(r) for r in result.table.drop("ord_layer_index", "ord_layer_1", "ord_layer_2").collect()]


def cells(result, column="res1"):
    return {r["rowlabel1"]: r[column] for r in result.table.collect()}


def text(spark, fmt, *values, **keywords):
    row = spark.range(1).select(t.apply_formats(fmt, *[F.lit(v).cast("double") for v in values], **keywords).alias("x"))
    return row.first()[0]


@pytest.fixture(scope="module")
def missing(spark):
    return spark.createDataFrame([("A", "X"), ("A", "Y"), ("A", "UNK"), ("A", None), ("A", "X")], "TRT string, V string")


def count(**settings):
    return t.table_spec("TRT", layers=[t.group_count("V", settings=t.layer_settings(**settings))])


def test_formats(spark):
    two = ("n", "p")
    assert text(spark, t.f_str("xx (xx.x%)", *two), 5, 9.3) == " 5 ( 9.3%)"
    assert text(spark, t.f_str("xx (XX.X%)", *two), 5, 9.3) == " 5 (9.3% )"
    assert text(spark, t.f_str("xx (XX.X%)", *two), 99, 99.9) == "99 (99.9%)"
    assert text(spark, t.f_str("(XX)", "n"), 5) == "(5 )"
    assert text(spark, t.f_str("xx", "n"), 12345) == "12345"
    assert text(spark, t.f_str("xx.x", "n"), None) == "    "
    assert text(spark, t.f_str("xx.x", "n", empty="NE"), None) == "  NE"
    assert text(spark, t.f_str("xx (xx)", *two, empty={".overall": "-"}), None, None) == "-"
    assert text(spark, t.f_str("xx", "n"), 5, width=6, pad="left") == "     5"
    assert text(spark, t.f_str("xx.x", "n"), -0.01) == " 0.0"
    assert text(spark, t.f_str("xx%", "p"), 0.4, lt=1, threshold_group=0) == "<1%"
    assert text(spark, t.f_str("xx%", "p"), 0.6, lt=1, threshold_group=0) == " 1%"
    assert text(spark, t.f_str("xx%", "p"), 99.6, gt=99, threshold_group=0) == ">99%"
    with pytest.raises(ValueError, match="Expected 1"):
        text(spark, t.f_str("xx", "n"), 1, 2)
    with pytest.raises(ValueError, match="No format groups"):
        t.f_str("123")
    with pytest.warns(UserWarning, match="hug"):
        t.f_str("XX", "n")


@pytest.mark.parametrize(("value", "digits", "plain", "ibm"), [(2.5, 0, 2, 3), (3.5, 0, 4, 4), (-2.5, 0, -2, -3), (0.15, 1, 0.1, 0.2), (0.25, 1, 0.2, 0.3), (1.235, 2, 1.24, 1.24)])
def test_rounding(spark, value, digits, plain, ibm):
    from tessera.functions.fmt import round_column

    row = spark.range(1).select(round_column(F.lit(value), digits), round_column(F.lit(value), digits, t.Options(ibm_rounding=True))).first()
    assert row[1] == pytest.approx(ibm) and (value == 1.235 or row[0] == pytest.approx(plain))


def test_desc(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", 20.0), ("A", 30.0), ("B", 40.0), ("B", 50.0), ("B", 60.0)], "TRT string, VALUE double")
    formats = {"n": t.f_str("xxx", "n"), "Mean": t.f_str("xx.x", "mean"), "SD": t.f_str("xx.xx", "sd")}
    result = t.build(t.table_spec("TRT", layers=[t.group_desc("VALUE", settings=t.layer_settings(format_strings=formats))]), df)
    assert table(result) == [("n", "  3", "  3"), ("Mean", "20.0", "50.0"), ("SD", "10.00", "10.00")]
    assert result.labels == {"res1": "A (N=3)", "res2": "B (N=3)"} == {k: v for k, v in get_data_labels(result.table).items() if v}


def test_desc_special_values(spark):
    df = spark.createDataFrame([("A", v) for v in (1.0, None, math.nan, math.inf, 3.0)], "TRT string, X double")
    row = t.build(t.table_spec("TRT", layers=[t.group_desc("X")]), df).numeric[1].first()
    assert (row.n, row.n_records, row.missing, row.min, row.max) == (3, 5, 2, 1.0, 3.0) and math.isinf(row.mean)


def test_missing_rows(spark, missing):
    found = cells(t.build(count(missing_count={"label": "Missing", "missing_values": ["UNK"]}), missing))
    assert found == {"X": " 2 (40.0%)", "Y": " 1 (20.0%)", "Missing": " 2 (40.0%)"}
    found = cells(t.build(count(missing_count={"missing_values": ["UNK", "Y"]}), missing))
    assert found == {"X": " 2 (40.0%)", "Missing": " 3 (60.0%)"}
    found = cells(t.build(count(missing_count={}), missing))
    assert found["UNK"] == " 1 (20.0%)" == found["Missing"]
    found = cells(t.build(count(missing_count={"missing_values": ["UNK"]}, total_row=True, total_row_count_missings=False), missing))
    assert found["Total"] == " 3 (60.0%)"


def test_nested_distinct(spark):
    rows = [("A", "CARDIAC", "AFIB", "S1"), ("A", "CARDIAC", "AFIB", "S1"), ("A", "CARDIAC", "TACHY", "S2"), ("A", "GI", "NAUSEA", "S3"), ("B", "CARDIAC", "AFIB", "S4"), ("B", "GI", "NAUSEA", "S5")]
    df = spark.createDataFrame(rows, "TRT string, SOC string, PT string, SUBJ string")
    spec = t.table_spec("TRT", layers=[t.group_count(["SOC", "PT"], settings=t.layer_settings(distinct_by="SUBJ", format_strings={"n_counts": t.f_str("xx", "distinct_n")}))])
    result = t.build(spec, df, metadata=True)
    assert [r[:3] for r in table(result)] == [("CARDIAC", "", " 2"), ("CARDIAC", "AFIB", " 1"), ("CARDIAC", "TACHY", " 1"), ("GI", "", " 1"), ("GI", "NAUSEA", " 1")]
    assert t.meta_subset(result, "1_CARDIAC_AFIB", "res1").select("SUBJ").distinct().count() == 1
    assert t.meta_result(result, "1_nothing_", "res1") is None


def test_shift_column_denominator(spark):
    df = spark.createDataFrame([("A", b, p) for b, p in zip("NNNNNNNNHH", "NNNNNNNHHH", strict=True)], "TRT string, BASE string, POST string")
    layer = t.group_shift({"row": "POST", "column": "BASE"}, settings=t.layer_settings(shift_denom="column", format_strings=[t.f_str("xx (xxx%)", "n", "pct")]))
    result = t.build(t.table_spec("TRT", layers=[layer]), df)
    assert table(result) == [("H", " 2 (100%)", " 1 ( 12%)"), ("N", " 0 (  0%)", " 7 ( 88%)")]
    assert result.labels == {"res1": "A | H (N=2)", "res2": "A | N (N=8)"}


def test_risk_difference_and_tests(spark):
    df = spark.createDataFrame([("Trt", "Yes")] * 60 + [("Trt", "No")] * 40 + [("Ctrl", "Yes")] * 40 + [("Ctrl", "No")] * 60, "TRT string, V string")
    result = t.build(count(risk_diff={"comparisons": [("Trt", "Ctrl")]}, assoc_test=t.assoc_test(t.fisher_exact_2x2, reference="Ctrl")), df)
    assert cells(result, "rdiff1")["Yes"] == "20.0 ( 6.4, 33.6)"
    assert cells(result, "pval1")["Yes"] == "0.007" and result.labels["pval1"] == "Ctrl vs Trt"
    assert t.fisher_exact_2x2([[4, 0], [2, 3]]) == pytest.approx(0.1667, abs=1e-4)


def test_population(spark):
    df = spark.createDataFrame([("A", "X", "S1"), ("A", "Y", "S2"), ("B", "X", "S3")], "TRT string, V string, ID string")
    pop = spark.createDataFrame([("A", "S1"), ("A", "S2"), ("A", "S4"), ("A", "S6"), ("B", "S3"), ("B", "S5"), ("B", "S7")], "ARM string, ID string")
    spec = t.table_spec("TRT", pop_data=t.pop_data({"TRT": "ARM"}), layers=[t.group_count("V", settings=t.layer_settings(distinct_by="ID", missing_subjects=True))])
    result = t.build(spec, df, pop, metadata=True)
    assert cells(result) == {"X": " 1 (25.0%)", "Y": " 1 (25.0%)", "Missing": " 2 (50.0%)"}
    assert t.header_n(result) == [(("A",), 4), (("B",), 3)]
    assert sorted(r.ID for r in t.meta_subset(result, "1_Missing", "res1").collect()) == ["S4", "S6"]
    plain = t.table_spec("TRT", pop_data=t.pop_data({"TRT": "ARM"}), layers=[t.group_count("V", settings=t.layer_settings(missing_subjects=True))])
    assert cells(t.build(plain, df, pop))["Missing"] == " 2 (50.0%)"
    with pytest.warns(UserWarning, match="no rows for level"):
        gap = t.build(spec, df, pop.where("ARM = 'A'"))
    assert cells(gap, "res2")["X"] == " 1 (    %)"


def test_groups(spark):
    df = spark.createDataFrame([("A", "X"), ("A", "Y"), ("B", "X"), ("C", "Y")], "TRT string, V string")
    spec = t.table_spec("TRT", total_groups=[t.total_group("TRT")], custom_groups=[t.custom_group("TRT", AB=["A", "B"])], layers=[t.group_count("V")])
    result = t.build(spec, df, metadata=True)
    assert result.labels == {"res1": "A (N=2)", "res2": "AB (N=3)", "res3": "B (N=1)", "res4": "C (N=1)", "res5": "Total (N=4)"}
    for r in result.table.collect():
        for k in range(1, 6):
            assert t.meta_subset(result, r.row_id, f"res{k}").count() == int(r[f"res{k}"].split("(")[0])


def test_levels_complete(spark):
    df = spark.createDataFrame([("A", "X")], "TRT string, V string")
    result = t.build(t.table_spec("TRT", levels={"V": ["Z", "X"], "TRT": ["B", "A"]}, layers=[t.group_count("V")]), df)
    assert [r[0] for r in table(result)] == ["Z", "X"] and list(result.labels.values()) == ["B (N=0)", "A (N=1)"]


def test_ordering_by_count(spark):
    rows = [("A", v) for v, n in (("Zebra", 20), ("Apple", 6), ("Mango", 4)) for _ in range(n)] + [("B", v) for v, n in (("Apple", 18), ("Mango", 9), ("Zebra", 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "TRT string, V string")
    assert [r[0] for r in table(t.build(count(order_count_method="bycount"), df))] == ["Apple", "Zebra", "Mango"]
    assert [r[0] for r in table(t.build(count(order_count_method="bycount", ordering_cols=["A"]), df))] == ["Zebra", "Apple", "Mango"]
    assert [r[0] for r in table(t.build(count(outer_sort_position="desc"), df))] == ["Zebra", "Mango", "Apple"]
    with pytest.raises(ValueError, match="no level"):
        t.build(count(order_count_method="bycount", ordering_cols=["Q"]), df)


def test_precision(spark):
    rows = [("A", "Na", 140.0), ("A", "Na", 141.0), ("A", "ALT", 28.4), ("A", "ALT", 30.1), ("A", "Cr", 0.88), ("A", "Cr", 0.91)]
    df = spark.createDataFrame(rows, "TRT string, PARAM string, AVAL double")
    settings = t.layer_settings(precision_by=["PARAM"], format_strings={"Mean": t.f_str("a.a+1", "mean")})
    result = t.build(t.table_spec("TRT", layers=[t.group_desc("AVAL", by="PARAM", settings=settings)]), df)
    assert table(result) == [("ALT", "Mean", "29.25"), ("Cr", "Mean", "0.895"), ("Na", "Mean", "140.5")]
    capped = t.layer_settings(precision_by=["PARAM"], precision_cap={"dec": 1}, format_strings={"Mean": t.f_str("a.a+1", "mean")})
    assert ("Cr", "Mean", "0.90") in table(t.build(t.table_spec("TRT", layers=[t.group_desc("AVAL", by="PARAM", settings=capped)]), df))


def test_proportion_intervals(spark):
    low, high = proportion_ci_values(np.array([12, 0, 40]), np.array([40, 40, 40]))
    # The exact interval by its definition: binomial tails of half the error each.
    assert low == pytest.approx([0.16562720, 0.0, 0.9119027], abs=1e-7) and high == pytest.approx([0.46531629, 0.0880973, 1.0], abs=1e-7)
    for p, (a, b) in product((0.025, 0.5, 0.975), ((12, 29), (0.5, 40.5), (3, 15))):
        assert betainc(a, b, qbeta(p, np.array(a), np.array(b))) == pytest.approx(p, abs=1e-10)
    for method in ("wilson", "wald", "agresti_coull", "clopper_pearson", "jeffreys"):
        a, b = t.proportion_ci(F.lit(7), F.lit(23), method)
        want = proportion_ci_values(np.array([7]), np.array([23]), method)
        assert list(spark.range(1).select(a, b).first()) == pytest.approx([want[0][0], want[1][0]], abs=1e-9)


@pytest.mark.parametrize(("kind", "want"), [(1, 1.0), (2, 1.5), (3, 1.0), (4, 1.0), (5, 1.5), (6, 1.25), (7, 1.75), (8, 1.4166667), (9, 1.4375)])
def test_quantile_types(spark, kind, want):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    assert df.agg(quantile(F.col("x"), 0.25, kind)).first()[0] == pytest.approx(want)


def test_analyze_and_ard(spark):
    df = spark.createDataFrame([(a, s, float(v)) for a in "AB" for s, v in zip("MFMFMFMFMF", range(25, 35), strict=True)], "TRT string, SEX string, AGE double")
    layer = t.group_analyze("AGE", analyze_fn=lambda d, v: {"m": d[v].mean(), "k": len(d)}, settings=t.layer_settings(format_strings={"Mean": t.f_str("xx.x", "m"), "N": t.f_str("xx", "k")}))
    assert table(t.build(t.table_spec("TRT", layers=[layer]), df)) == [("Mean", "29.5", "29.5"), ("N", "10", "10")]
    spec = t.table_spec("TRT", layers=[t.group_count("SEX"), t.group_desc("AGE")])
    result = t.build(spec, df)
    long = t.to_ard(result)
    assert long.columns[0] == "analysis_id" and long.columns[-2:] == ["stat_name", "stat_value"]
    again = t.from_ard(long, spec).select("rowlabel1", "res1", "res2").collect()
    assert [tuple(r) for r in again] == table(result)
    assert t.stats_data(result, 1, "n").columns == ["TRT", "SEX", "n"] and t.stats_data(result, 1, "mean") is None
    assert as_display(result.table, labels=True).columns == ["rowlabel1", "A (N=10)", "B (N=10)"]


def mean_of(values):
    return float(values.mean())


def test_serialization(tmp_path):
    spec = t.table_spec(
        "TRT",
        where="AGE > 1",
        pop_data=t.pop_data({"TRT": "ARM"}, "SAFE = 'Y'"),
        total_groups=[t.total_group("TRT")],
        custom_groups=[t.custom_group("TRT", AB=["A", "B"])],
        layers=[
            t.group_count(["SOC", "PT"], by=t.label("SOC"), settings=t.layer_settings(distinct_by="ID", missing_count={"label": "M"}, format_strings={"n_counts": t.f_str("xx", "n", empty="-")})),
            t.group_desc("AGE", settings=t.layer_settings(custom_summaries={"own": mean_of}, precision_cap={"int": 2})),
        ],
    )
    for name in ("spec.json", "spec.yaml"):
        path = str(tmp_path / name)
        try:
            t.write_spec(spec, path)
        except ImportError:
            continue
        again = t.read_spec(path)
        assert again.cols == spec.cols and again.where == spec.where and again.pop_data == spec.pop_data
        assert again.layers[0].settings == spec.layers[0].settings and t.is_label(again.layers[0].by[0])
        assert again.layers[1].settings.custom_summaries["own"].__name__ == "mean_of"
    with pytest.raises(ValueError, match="Unsupported"):
        t.write_spec(spec, str(tmp_path / "spec.txt"))


def test_contracts(spark, missing):
    with pytest.raises(ValueError, match="target must have"):
        t.group_shift({"row": "a"})
    with pytest.raises(ValueError, match="zero_count_display"):
        t.layer_settings(zero_count_display="none")
    with pytest.raises(ValueError, match="not found"):
        t.build(t.table_spec("NO", layers=[t.group_count("V")]), missing)
    with pytest.raises(ValueError, match="denoms_by"):
        t.build(count(denoms_by=["Q"]), missing)
    with pytest.raises(ValueError, match="identical stat_columns"):
        t.build(t.table_spec("TRT", layers=[t.group_count("V", settings=t.layer_settings(stat_columns={"n": t.f_str("x", "n")})), t.group_count("V")]), missing)
    with pytest.raises(ValueError, match="nested"):
        t.build(t.table_spec("TRT", layers=[t.group_count(["V", "TRT"], settings=t.layer_settings(risk_diff={"comparisons": [("A", "B")]}))]), missing)
    with pytest.raises(TypeError, match="Unknown build override"):
        t.build(count(), missing, colour="red")
    with pytest.raises(ValueError, match="Unknown option"):
        t.set_options(colour="red")
    with pytest.warns(UserWarning, match="unknown statistic"):
        t.build(count(format_strings=[t.f_str("xx", "nn")]), missing)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        old = t.set_options(ibm_rounding=True)
    assert t.set_options(ibm_rounding=old.ibm_rounding).ibm_rounding


def test_overrides(spark, missing):
    assert cells(t.build(count(), missing, where="V = 'X'")) == {"X": " 2 (100.0%)"}


def test_post_processing(spark):
    df = spark.createDataFrame([("A", "C", 1, 1), ("A", "D", 1, 2), ("B", "E", 1, 3), ("B", "F", 1, 4)], "rowlabel1 string, rowlabel2 string, ord_layer_index int, ord_layer_1 int")
    assert [r.rowlabel1 for r in apply_row_masks(df).collect()] == ["A", "", "B", ""]
    assert [r.row_label for r in collapse_row_labels(df).collect()] == ["A", "  C", "  D", "B", "  E", "  F"]
    assert len(apply_row_masks(df.union(df.withColumn("ord_layer_index", F.lit(2))), row_breaks=True).collect()) == 9
    one = spark.range(1)
    assert one.select(str_extract_num(F.lit(" 5 (-9.3%)"), 2)).first()[0] == -9.3
    assert one.select(str_extract_num(F.lit("x"))).first()[0] is None
    assert one.select(replace_leading_whitespace(F.lit("  a b"), "_")).first()[0] == "__a b"
    assert one.select(apply_conditional_format(F.lit(" 0  (0.0%)"), 2, "x == 0", "")).first()[0] == " 0        "
    assert one.select(apply_conditional_format(F.lit(" 5 (12.1%)"), 2, "x > 20", "(>20%)")).first()[0] == " 5 (12.1%)"
    assert wrap_text("RENAL AND URINARY DISORDERS", 8) == "RENAL\nAND\nURINARY\nDISORDE-\nRS"


def test_stream_table(spark, tmp_path):
    from tessera.streaming.tables import stream_table

    source = str(tmp_path / "in")
    spark.createDataFrame([("A", "X")] * 3 + [("B", "Y")], "TRT string, V string").write.parquet(source)
    stream = spark.readStream.schema("TRT string, V string").parquet(source)
    found = []
    query = stream_table(stream, t.table_spec("TRT", layers=[t.group_count("V")]), ["TRT", "V"], lambda r, _: found.append(table(r)), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert found[-1] == [("X", " 3 (100.0%)", " 0 ( 0.0%)"), ("Y", " 0 ( 0.0%)", " 1 (100.0%)")]
