"""The driver contract: names, schemas, and an engine that stands without its optional part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).resolve().parent


def test_registry(spark):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "pair_wer" in names
    flagship = __spark_entry__.entry(spark)
    assert flagship.count() > 0 and "wer" in flagship.columns


def test_imports_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tapeline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pair_wer' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
