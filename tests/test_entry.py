import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert callable(e.entry)


def test_core_does_not_need_the_subpackage():
    """The rest imports, and registers its queries, when viewlake.llm can't be imported."""
    code = "import sys; sys.modules['viewlake.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert 'p2_found' in n and 'p3_found' not in n"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, files in os.walk(os.path.join(ROOT, "viewlake")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "viewlake.llm" not in open(os.path.join(folder, f)).read(), f


DATA = "/root/testdata/sf0.001"
CHECKED = ["p2_found", "p6_found", "p2_footprints", "unique_resolutions", "resolution_variation", "exif_counts", "camera_left_join", "tile_sky", "tile_noise", "cluster_stats", "findings"]


@pytest.mark.skipif(not os.path.isdir(DATA) or importlib.util.find_spec("duckdb") is None, reason="needs the generated tables and duckdb")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = e.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    got = tidy(tuple(r) for r in df.select(*cols).collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert got == tidy(want)
