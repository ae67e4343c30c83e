from __future__ import annotations

import os
import subprocess
import sys

import corpus_pipeline
from sylva.llm import common


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = common.table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(spark, stage(spark, docs, sf), name)
        assert docs.columns == common.table(spark, sf, "documents").columns, name
        if name in ("drop_near_copies", "decontaminate"):
            assert docs.count() < before, name
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()


def test_the_rest_works_without_the_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("sylva", "__spark_entry__.py"):
        os.symlink(f"{root}/{name}", f"{tmp_path}/{name}")
    code = "import sys; sys.modules['sylva.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') for k in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
