"""The engine works without its corpus part."""

import subprocess
import sys


def test_nothing_else_imports_the_corpus_part():
    code = "import sys; sys.modules['cellgrove.llm'] = None\nimport __spark_entry__ as e\nassert not e.HAS_LLM and len(e.queries()) > 30 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
