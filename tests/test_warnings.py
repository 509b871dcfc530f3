"""Failures of the caller's functions and odd denominators: one warning each, and blank cells."""

import math
import warnings

import pytest
from pyspark.sql import functions as F

import tessera as t
from tessera.plans import context


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, "AB"[i % 2], "xyz"[i % 3], float(i % 7), "mf"[i % 5 == 0]) for i in range(60)]
    return spark.createDataFrame(data, "id int, arm string, term string, value double, sex string").cache()


def warned(make):
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        table = make().table.collect()
    return [str(w.message) for w in found if issubclass(w.category, UserWarning)], table


def failing():
    def boom(*_):  # local, so that workers get it by value
        raise RuntimeError("no")

    return boom


boom = failing()


def test_failing_summary_and_analysis(rows):
    settings = t.layer_settings(custom_summaries={"own": boom}, format_strings={"Own": t.f_str("xx", "own"), "n": t.f_str("xx", "n")})
    found, table = warned(lambda: t.build(t.table_spec("arm", layers=[t.group_desc("value", settings=settings)]), rows))
    assert len(found) == 1 and "own: RuntimeError: no (2 groups)" in found[0]
    assert [r.res1.strip() for r in table] == ["", "30"]
    for formats in ({"Own": t.f_str("xx.x", "m")}, None):
        layer = t.group_analyze("value", analyze_fn=boom, settings=t.layer_settings(format_strings=formats))
        found, table = warned(lambda layer=layer: t.build(t.table_spec("arm", layers=[layer]), rows))
        assert len(found) == 1 and "RuntimeError: no" in found[0] and "value" in found[0]
        assert all(not r.res1.strip() for r in table)


@pytest.mark.parametrize("fn", [boom, lambda *_: [0.1, 0.2]])
@pytest.mark.parametrize("pairwise", [False, True])
def test_failing_tests_of_association(rows, fn, pairwise):
    test = t.assoc_test(fn, reference="A" if pairwise else None, columns=["arm", "term"])
    spec = t.table_spec("arm", layers=[t.group_count("term", settings=t.layer_settings(assoc_test=test))])
    found, table = warned(lambda: t.build(spec, rows))
    assert len(found) == 1 and ("RuntimeError: no" in found[0] or "2 value(s) returned for a format of 1" in found[0])
    assert all(r.pval1 == "" for r in table)


def test_tests_get_the_columns_they_name(rows):
    seen = t.assoc_test(lambda d: ",".join(d.columns), columns=["term", "arm"])
    spec = t.table_spec("arm", layers=[t.group_count("term", settings=t.layer_settings(assoc_test=seen))])
    assert warned(lambda: t.build(spec, rows))[1][0].pval1 == "term,arm"


def test_denominators_without_rows(spark, rows):
    pop = spark.createDataFrame([(1, "A")], "id int, arm string")
    spec = t.table_spec("arm", layers=[t.group_count("term")])
    found, _ = warned(lambda: t.build(spec, rows, pop))
    assert any("denominator is zero or missing" in x and "B/x" in x for x in found)
    compared = t.table_spec("arm", layers=[t.group_count("term", settings=t.layer_settings(risk_diff={"comparisons": [("A", "B")]}))])
    found, _ = warned(lambda: t.build(compared, rows, pop.union(spark.createDataFrame([(2, "B")], pop.schema))))
    assert any("exceed their denominators" in x for x in found)
    excluded = t.table_spec("arm", layers=[t.group_count("term", settings=t.layer_settings(missing_count={"denom_exclude": True}))])
    found, _ = warned(lambda: t.build(excluded, rows, rows.select("id", "arm")))
    assert sum("denom_exclude has no effect" in x for x in found) == 1
    assert warned(lambda: t.build(spec, rows, rows.select("id", "arm")))[0] == []


def test_precision_of_some_groups_only(rows):
    given = [{"term": "x", "max_int": 2, "max_dec": 1}]
    settings = t.layer_settings(format_strings={"Mean": t.f_str("a.a", "mean")}, precision_by="term", precision_data=given)
    spec = t.table_spec("arm", layers=[t.group_desc("value", by="term", settings=settings)])
    found, _ = warned(lambda: t.build(spec, rows))
    assert len(found) == 1 and "no widths for some groups" in found[0] and "y" in found[0]


def test_too_many_columns_are_refused(rows, monkeypatch):
    monkeypatch.setattr(context, "MOST_COLUMNS", 5)
    with pytest.raises(ValueError, match="too many for columns"):
        t.build(t.table_spec("id", layers=[t.group_count("term")]), rows)


def test_weights_count_as_rows(rows):
    weighted = rows.groupBy("arm", "term", "sex").agg(F.count(F.lit(1)).alias("times"))
    settings = t.layer_settings(total_row=True, missing_count={"label": "M", "missing_values": ["z"]})
    for layers in ([t.group_count("term", settings=settings), t.group_count(["sex", "term"])], [t.group_shift({"row": "term", "column": "sex"})]):
        spec = t.table_spec("arm", total_groups=[t.total_group("arm")], layers=layers)
        plain, short = t.build(spec, rows), t.build(spec, weighted, weight="times")
        assert plain.table.collect() == short.table.collect() and plain.labels == short.labels
    with pytest.raises(ValueError, match="count and shift"):
        t.build(t.table_spec("arm", layers=[t.group_desc("value")]), rows, weight="id")


@pytest.mark.parametrize("kind", range(1, 10))
def test_quartiles_of_all_types(spark, kind):
    def r_quantile(v, p):
        v, n = sorted(v), len(v)
        if kind <= 3:
            x = n * p - (0.5 if kind == 3 else 0)
            j = math.floor(x + 4e-15)
            g = x - j
            step = 1.0 if g > 1e-14 else {1: 0.0, 2: 0.5, 3: 0.0 if j % 2 == 0 else 1.0}[kind]
        else:
            a, b = {4: (0, 1), 5: (0.5, 0.5), 6: (0, 0), 7: (1, 1), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
            x = a + p * (n + 1 - a - b)
            j = math.floor(x + 4e-15)
            step = x - j if abs(x - j) >= 4e-15 else 0.0
        at = lambda k: v[min(max(k, 1), n) - 1]
        return at(j) * (1 - step) + at(j + 1) * step

    groups = {"a": [1.0, 2.0, 2.0, 5.0, 9.0, 9.0, 9.0, 11.5], "b": [4.0], "c": [3.0, 1.0, 2.0, 8.0, 8.0], "d": []}
    data = spark.createDataFrame([(g, v) for g, x in groups.items() for v in [*x, None]], "g string, v double")
    spec = t.table_spec("g", layers=[t.group_desc("v", settings=t.layer_settings(format_strings={"Q": t.f_str("xx.xx, xx.xx", "q1", "q3")}))])
    result = t.build(spec, data, options=t.Options(quantile_type=kind))
    for r in t.numeric_data(result, 1).collect():
        values = groups[r.g]
        want = (r_quantile(values, 0.25), r_quantile(values, 0.75)) if values else (None, None)
        assert (r.q1, r.q3) == (pytest.approx(want) if values else want)


def test_specs_keep_empty_settings(tmp_path):
    layers = [t.group_count("a", settings=t.layer_settings(missing_count={}, denoms_by=[], total_row=True)), t.group_desc("v", settings=t.layer_settings(format_strings={}))]
    spec = t.table_spec("arm", layers=layers)
    t.write_spec(spec, str(tmp_path / "s.json"))
    again = t.read_spec(str(tmp_path / "s.json"))
    assert again.layers[0].settings.missing_count == {} and list(again.layers[0].settings.denoms_by) == []
    assert again.layers[1].settings.format_strings == {}


def test_specs_name_trusted_functions_only(tmp_path):
    path = tmp_path / "s.json"
    settings = '{"_type": "LayerSettings", "custom_summaries": {"x": {"_fn": "%s"}}}'
    text = '{"_type": "TableSpec", "cols": ["a"], "layers": [{"_type": "Layer", "kind": "desc", "target": ["v"], "settings": ' + settings + "}]}"
    path.write_text(text % "os:system")
    with pytest.raises(ValueError, match="neither registered nor"):
        t.read_spec(str(path))
    path.write_text(text % "statistics:fmean")
    assert t.read_spec(str(path), modules=["statistics"]).layers[0].settings.custom_summaries["x"]([1, 3]) == 2


def test_a_nested_layer_reads_its_source_a_few_times(spark, tmp_path):
    data = spark.createDataFrame([(i, "AB"[i % 2], "xyz"[i % 3], "pqrs"[i % 4]) for i in range(50)], "id int, arm string, soc string, term string")
    data.write.parquet(str(tmp_path / "d"))
    source = spark.read.parquet(str(tmp_path / "d"))
    spec = t.table_spec("arm", layers=[t.group_count(["soc", "term"], settings=t.layer_settings(order_count_method="bycount", total_row=True))])
    plan = t.build(spec, source).table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2
