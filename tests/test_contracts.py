import pytest

from rowferry.contracts import ColumnContract, ContractError, FieldMapping, ForeignKey, TableContract, TargetContract
from rowferry.operators import projection, validation
from rowferry.sources import targets

SITES = TargetContract((
    TableContract("site", (ColumnContract("id", "int", False, True), ColumnContract("place", "varchar(10)")),
                  (ForeignKey("type_id", "site_kind"), ForeignKey("parent_id", "site"))),
    TableContract("site_kind", (ColumnContract("id", "int", False, True, True), ColumnContract("name", "text", False))),
    TableContract("detail", (
        ColumnContract("id", "int", False, True, True), ColumnContract("site_id", "int", False),
        ColumnContract("code", "varchar(4)", False), ColumnContract("state", "text", enum_values=("active", "closed")),
        ColumnContract("event_id", "text", False)), (ForeignKey("site_id", "site"),)),
))


def test_order_and_lookups():
    assert SITES.parents_first(["detail", "site", "site_kind"]) == ["site_kind", "site", "detail"]
    assert targets.waves(SITES) == [["site_kind"], ["site"], ["detail"]]
    assert SITES.table("site").lookup_only and not SITES.table("detail").lookup_only


def test_cycle_is_refused():
    loop = TargetContract((TableContract("a", (), (ForeignKey("b_id", "b"),)),
                           TableContract("b", (), (ForeignKey("a_id", "a"),))))
    with pytest.raises(ContractError, match="cycle"):
        loop.parents_first(["a", "b"])
    with pytest.raises(ContractError, match="cycle"):
        targets.waves(loop)
    with pytest.raises(ContractError, match="not part"):
        SITES.parents_first(["unknown"])


def test_managed_columns_and_widths(spark):
    mappings = [FieldMapping("k", "detail", "id"), FieldMapping("k", "detail", "site_id"),
                FieldMapping("v", "detail", "code"), FieldMapping("v", "site", "place")]
    df = spark.createDataFrame([(1, "0123456789ABC")], "k int, v string")
    staged = projection.stage(df, mappings, SITES, ["k"])
    assert projection.fan_out(staged, "detail").columns == ["code"]
    assert projection.fan_out(staged, "detail").first().code == "0123"
    assert projection.fan_out(staged, "site").first().place == "0123456789"
    with pytest.raises(ContractError, match="no target values"):
        projection.stage(df, mappings[:2], SITES)


def test_checks_and_split(spark):
    mappings = [FieldMapping("v", "detail", "code"), FieldMapping("s", "detail", "state"),
                FieldMapping("n", "detail", "number", "cast:str->int")]
    df = spark.createDataFrame([("ok", "active", "1"), ("", "gone", "x"), (None, None, None)], "v string, s string, n string")
    rows = validation.transform_rows(df, mappings, SITES)
    good, failed = validation.split(rows)
    assert good.count() + failed.count() == 3
    errors = {tuple(r.errors) for r in failed.collect()}
    missing = ("required target field 'id' is missing or null", "required target field 'site_id' is missing or null")
    assert (*missing, "required target field 'code' is missing or null") in errors
    assert any(e[0].startswith("transform failed for n -> number: invalid literal") and
               "'gone' is not a valid value for enum 'state'" in e for e in errors)
    assert not any("event_id" in text for e in errors for text in e)


def test_unknown_table_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "v string")
    rows = validation.transform_rows(df, [FieldMapping("v", "nowhere", "c")], SITES)
    assert rows.first().errors == ["target table 'nowhere' not found in target schema"]


def test_empty_target_types(spark):
    empty = projection.empty_target(spark, SITES.table("detail"))
    assert dict(empty.dtypes)["id"] == "bigint" and empty.schema["code"].metadata["native_type"] == "varchar(4)"
