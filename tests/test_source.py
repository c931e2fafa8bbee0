"""The source itself: no name is defined twice in a module, so that nothing overrides what stands above it."""

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
MODULES = sorted(p.relative_to(ROOT).as_posix() for p in [*ROOT.glob("*.py"), *ROOT.glob("tidebook/**/*.py"), *ROOT.glob("tests/**/*.py")])


@pytest.mark.parametrize("module", MODULES)
def test_names_are_defined_once(module):
    tree = ast.parse((ROOT / module).read_text())
    for scope in [tree, *(n for n in tree.body if isinstance(n, ast.ClassDef))]:
        names = Counter(n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
        assert [n for n, k in names.items() if k > 1] == []


def test_bench_finds_its_queries():
    import __spark_entry__
    import bench

    assert {n for n in bench.HEADLINE if n not in __spark_entry__.queries()} == set()
