"""Every query over the smallest tables against its DuckDB SQL; those without SQL have their rows looked at elsewhere."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from geoloom.plans import registry  # noqa: E402
from tools.compare import differs, duck_over  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_over(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    assert differs(spark, duck, QUERIES[name], SQL[name], SF) == ""


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["f01_cloud_range", "f04_intersects_box", "f09_date_window", "r05_indices", "a03_consolidate", "j02_candidate_match"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_without_a_session():
    """The driver lists the queries before there is a session."""
    import subprocess

    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[0]) > 100


def test_grep_gives_every_line(spark, duck):
    """Not the first 200 of them."""
    n = duck.execute("SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'the')").fetchone()[0]
    assert QUERIES["t04_grep_first"](spark, SF).count() == n > 200
