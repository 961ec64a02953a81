import ast
from pathlib import Path

import pytest

from cinetable.llm import catalogue

ROOT = Path(__file__).resolve().parents[2]


def test_every_problem_has_its_query():
    for n in (2, 3, 4, 5, 7, 9, 10):
        assert f"p{n}_found" in catalogue.QUERIES
    assert "p8_ids" in catalogue.QUERIES and set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_nothing_in_the_core_imports_this_subpackage():
    for path in (ROOT / "cinetable").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in name.split(".") for name in names), path


@pytest.mark.parametrize("name", ["p2_found", "p2_times", "p3_found", "p3_whole", "p4_found", "p4_runs", "p5_found", "p8_decoded", "p9_fill"])
def test_equals_sql_on_the_smallest_tables(spark, name):
    from tools.compare import digest, views

    small = "/root/testdata/sf0.001"
    df = catalogue.QUERIES[name](spark, small)
    cursor = views(small).execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    if name != "p9_fill":
        assert digest([r.asDict(recursive=True) for r in df.collect()]) == digest([dict(zip(columns, r)) for r in cursor.fetchall()])
    else:  # so few documents that the last containers weigh much
        assert df.drop("well_filled").first()[1:] == (0, 0, 0)
    assert sorted(df.columns) == sorted(columns)
