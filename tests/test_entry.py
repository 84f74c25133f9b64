import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_and_names(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["group_id", "image_id", "is_canonical"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 79


def test_the_rest_stands_without_the_training_data_operators():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('framewell.llm') or name == 'corpus_pipeline':\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e, pkgutil, importlib, framewell\n"
        "for m in pkgutil.walk_packages(framewell.__path__, 'framewell.', onerror=lambda n: None):\n"
        "    if not m.name.startswith('framewell.llm'):\n"
        "        importlib.import_module(m.name)\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
