import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(queries)


@pytest.mark.parametrize("absent", ["tarnflow.llm", "tiktoken"])
def test_core_queries_are_there_without_the_text_package(absent):
    code = f"import sys; sys.modules['{absent}'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and set(e.oracle_sql()) <= set(q) and not any(k.startswith(('p6', 'p7', 'p8')) for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=60)


def test_core_does_not_import_the_text_package():
    for p in (ROOT / "tarnflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) tarnflow\.llm", p.read_text(), re.M)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_flagship_and_found_queries_run(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    want = {"p1_found": ["obs_id"], "p2_found": ["net", "node_id", "root_id", "depth"], "p3_found": ["obs_id", "result_id"], "p4_found": ["wqms_id", "var", "week_end"], "p5_found": ["rel", "id_a", "id_b"]}
    for name, columns in want.items():
        df = e.queries()[name](spark, DATA)
        rows = df.collect()
        assert df.columns == columns and rows and len(rows) == len(set(rows))
