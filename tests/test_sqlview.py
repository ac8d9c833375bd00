"""Read-only SQL: what is refused, and what QUALIFY becomes."""

import pytest

from tidemark.operators.checks import ValidationError
from tidemark.sources.sqlview import SqlView, with_qualify

JAVA = "java_method('java.lang.System', 'getProperty', 'user.dir')"


@pytest.fixture(scope="module")
def view(spark):
    t = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0), (3, "b", None)], "id int, k string, v double")
    return SqlView({"t": t, "u": t})


@pytest.mark.parametrize(
    "sql",
    [
        f"select {JAVA}", "select reflect('a', 'b') from t", "select try_reflect('a', 'b')", "select input_file_name() from t", "select current_user()",
        f"select (select {JAVA})", f"select * from t where id in (select length({JAVA}))", f"with x as (select {JAVA}) select 1", f"values ({JAVA})", f"select * from t order by {JAVA}",
        f"select * from t join u on t.k = {JAVA}", f"select transform(array(1), x -> {JAVA})", f"select k from t qualify {JAVA} = ''", "select identifier('reflect')('a', 'b')",
        "select transform(id) using 'cat' as (x) from t", "select * from parquet.`/tmp`", "select * from read_files('/tmp')", "select * from other", "select spark_catalog.default.f(1)",
        "create table x as select 1", "insert into t values (1)", "show tables", "describe t", "set a=b", "cache table t", "explain select 1",
    ],
)
def test_refused(view, sql):
    with pytest.raises(ValidationError):
        view.query(sql)


def test_functions_that_the_session_registered_are_refused(spark, view):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(ValidationError):
        view.query("select own_function(id) from t")


def test_the_session_is_left_as_it_was(spark, view):
    before = spark.catalog.listTables()  # of other tests
    assert view.query("select count(*) as n from t cross join u").first().n == 9
    assert spark.catalog.listTables() == before
    assert view.query("select id from t where id = :n", {"n": 2}).collect()[0].id == 2


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select k, id from t qualify row_number() over (partition by k order by id desc) = 1 order by k", [("a", 2), ("b", 3)]),
        ("select id from (select id, k from t qualify count(*) over (partition by k) > 1) x where id > 1 -- qualify", [(2,)]),
        ("select id from t where k <> 'qualify' qualify max(id) over () = id union all select id from u qualify min(id) over () = id", [(3,), (1,)]),
        ("select id, max(id) over (partition by k) as m from t qualify m = id limit 5", [(2, 2), (3, 3)]),
    ],
)
def test_qualify(view, sql, want):
    assert sorted(map(tuple, view.query(sql).collect())) == sorted(want)


def test_qualify_where_it_cannot_be_told(view):
    assert with_qualify("select 'qualify' from t") == "select 'qualify' from t"
    for sql in ("select distinct id from t qualify id = 1", "select 1 qualify true"):
        with pytest.raises(ValidationError):
            view.query(sql)
