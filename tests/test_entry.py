"""The entry points, with and without the corpus operators."""

import subprocess
import sys

import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['gaugemill.llm'] = None; import __spark_entry__ as e; assert e.corpus is None and len(e.queries()) >= 40 and not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()]"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rsplit("/", 1)[0])
