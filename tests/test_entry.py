import builtins
import sys

import __spark_entry__


def test_engine_stays_without_the_libraries_of_the_corpus_package(monkeypatch):
    """A library that only the corpus package needs is missing: its queries go, all others stay."""
    for name in [x for x in sys.modules if x.startswith("lumetext.llm") or x in ("corpus_pipeline", "public_tokenizers")]:
        monkeypatch.delitem(sys.modules, name)
    found = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "public_tokenizers":
            raise ImportError(name)
        return found(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    names = __spark_entry__.queries()
    assert "bm25_multi" in names and "pipeline" not in names and not [x for x in names if x.startswith("op")]
    assert set(__spark_entry__.oracle_sql()) <= set(names)
