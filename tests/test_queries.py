"""Every registered query against its SQL; those without SQL must run and be the same when run again."""

import pytest

from lexquarry.plans.all import REGISTRY

from .conftest import SMALL
from .oracle import same_rows


@pytest.mark.parametrize("name", sorted(k for k, e in REGISTRY.items() if e.sql))
def test_matches_sql(spark, name):
    same_rows(spark, SMALL, REGISTRY[name].run, REGISTRY[name].sql)


@pytest.mark.parametrize("name", sorted(k for k, e in REGISTRY.items() if not e.sql))
def test_repeats(spark, name):
    runs = [sorted(map(str, REGISTRY[name].run(spark, SMALL).collect())) for _ in range(2)]
    assert runs[0] and runs[0] == runs[1]


def test_imports_without_training_data_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['lexquarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    from .conftest import ROOT

    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
