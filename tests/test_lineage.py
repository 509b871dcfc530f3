"""Metadata of all cells: filters give the rows that a cell counts; variables, missing subjects, transposed layers."""

import warnings

import pytest

import tessera as t


@pytest.fixture(scope="module")
def df(spark):
    rows = [("A", "X", 1.0, 5.0, "S1"), ("A", "Y", 2.0, None, "S2"), ("B", "X", 3.0, 6.0, "S3"), ("B", "X", None, 7.0, "S4")]
    return spark.createDataFrame(rows, "TRT string, V string, AGE double, BMI double, ID string")


def test_every_cell(df):
    spec = t.table_spec("TRT", total_groups=[t.total_group("TRT")], layers=[t.group_count("V", settings=t.layer_settings(total_row=True)), t.group_desc(["AGE", "BMI"])])
    result = t.build(spec, df, metadata=True)
    found = t.cell_metadata(result)
    table = result.table.collect()
    assert set(found) == {(r.row_id, f"res{k}") for r in table for k in (1, 2, 3)}
    for r in table:
        for k in (1, 2, 3):
            meta = found[r.row_id, f"res{k}"]
            rows = df
            for f in meta.filters:
                rows = rows.where(f)
            if meta.layer_index == 1:
                assert rows.count() == int(r[f"res{k}"].split("(")[0])
            else:
                assert [x for x in ("AGE", "BMI") if x in meta.names] == [r.rowlabel1]


    last = table[-1].row_id
    assert t.meta_result(result, last, "res2") == found[last, "res2"]


def test_missing_subjects_need_a_subject(spark, df):
    pop = spark.createDataFrame([("A", "S1"), ("A", "S2"), ("A", "S9"), ("B", "S3"), ("B", "S4")], "TRT string, ID string")
    for subject in (None, "ID"):
        settings = t.layer_settings(missing_subjects=True, distinct_by=subject)
        spec = t.table_spec("TRT", pop_data=t.pop_data({"TRT": "TRT"}), layers=[t.group_count("V", settings=settings)])
        result = t.build(spec, df, pop, metadata=True)
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            found = t.cell_metadata(result)
        missing = [m for m in found.values() if m.anti_join is not None]
        assert (len(missing), len([w for w in seen if "missing subjects" in str(w.message)])) == ((2, 0) if subject else (0, 1))
    assert [r.ID for r in t.meta_subset(result, "1_Missing", "res1").collect()] == ["S9"]


def test_transposed_layers_have_none(df):
    layer = t.group_desc("AGE", settings=t.layer_settings(stats_as_columns=True))
    with pytest.warns(UserWarning, match="have no metadata"):
        result = t.build(t.table_spec("TRT", layers=[layer]), df, metadata=True)
    assert t.cell_metadata(result) == {}
