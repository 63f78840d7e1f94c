import subprocess
import sys
from pathlib import Path


def test_other_queries_stay_where_a_library_is_missing():
    """With ``xxhash`` hidden the corpus queries can't be imported; all others are registered."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120)
    number, some, inside = out.stdout.split()
    assert int(number) > 90 and (some, inside) == ("False", "True")
