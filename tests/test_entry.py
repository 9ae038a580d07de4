"""The driver's contract, with and without the optional parts."""

import collections
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb

import __spark_entry__ as entry
from veilframe import box_queries, more_queries, rule_samples
from veilframe.plans.config import PACKS

ROOT = pathlib.Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "veilframe", tmp_path / "veilframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "veilframe" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(tmp_path, tmp_path / "left")
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path / "left")  # folders gone, pipeline left behind
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scrub_documents' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    # the path holds this copy and the interpreter's own packages alone
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p and pathlib.Path(p).resolve() != ROOT and ROOT not in pathlib.Path(p).resolve().parents)}
    for place in (tmp_path, tmp_path / "left"):
        subprocess.run([sys.executable, "-c", code], cwd=place, env=env, check=True, timeout=120)


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "veilframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path


def test_every_live_rule_has_a_line():
    for lang, pack in PACKS.items():
        live = {key for key, *_ in pack.RULES} & set(pack.PRIORITY)
        assert {key for key, _, value, _ in rule_samples.SAMPLES[lang] if value} == live


def test_queries_equal_their_sql(spark):
    """Queries of hits, risk, pages and boxes on the smallest tables, row by row against the SQL that the driver runs."""
    tables = pathlib.Path("/root/testdata/sf0.001")
    base = duckdb.connect()
    for path in tables.glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name, query in (more_queries.QUERIES | rule_samples.QUERIES | box_queries.QUERIES).items():
        got = query(spark, str(tables))
        names = sorted(got.columns)
        told = base.execute((more_queries.ORACLES | rule_samples.ORACLES | box_queries.ORACLES)[name])
        at = [[d[0] for d in told.description].index(c) for c in names]
        want = collections.Counter(tuple(row[k] for k in at) for row in told.fetchall())
        assert collections.Counter(tuple(row[c] for c in names) for row in got.collect()) == want, name
