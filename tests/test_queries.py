"""Every query of the catalogue against its SQL, and the driver contract without the training-data part."""

from __future__ import annotations

import subprocess
import sys

import duckdb
import pytest

from lexiquarry.plans import catalogue
from tests.conftest import ROOT, SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return made


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        rows = [tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, rows))


def test_books_of_orders_have_the_kinds_of_their_sql(spark, duck):
    """The array that ``_book`` reads when it runs is the one that its SQL was made of."""
    from lexiquarry.plans import layouts

    got = {(r.seq, r.kind) for r in layouts._book(spark, SF).select("seq", "boundary.kind").collect()}
    assert {kind for _, kind in got} == {None, "part", "chapter", "section", "rule", "form", "background", "clause"}
    assert got == set(duck.sql(f"WITH {layouts._BOOK} SELECT seq, kind FROM b").fetchall())


def test_constants_of_plans_are_bound_once():
    """SQL takes a constant when its module is read, a query when it runs: a second value would part them."""
    import ast
    from collections import Counter
    from pathlib import Path

    for path in Path(ROOT, "lexiquarry", "plans").glob("*.py"):
        bound = Counter(t.id for n in ast.parse(path.read_text()).body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name))
        assert not [name for name, times in bound.items() if times > 1], path


def test_entry_without_the_training_data_part():
    """The other queries are there when that subpackage and the pipeline are not."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('lexiquarry.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = set(e.queries())\n"
        "assert 'word_profile_by_source' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)\n"
        "assert set(e.oracle_sql()) <= names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_training_data_part():
    from pathlib import Path

    for path in Path(ROOT, "lexiquarry").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lexiquarry.llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
