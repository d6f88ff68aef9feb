import importlib
import sys

import __spark_entry__


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_imports_without_the_training_data_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("quirelake.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("quirelake.llm", "corpus_pipeline"):
        monkeypatch.setattr(sys, "meta_path", [_Gone(name), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    names = set(entry.queries())
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


class _Gone:
    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name or name.startswith(f"{self.name}."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None
