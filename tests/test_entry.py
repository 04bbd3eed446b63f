import importlib.util
import os

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(REPO, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_contract(spark):
    mod = _entry_module()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["n", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]
    r = rows[0]
    assert r["n"] == r["tp"] + r["fp"] + r["fn"] + r["tn"] > 0
    q, o = mod.queries(), mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 78
    assert all(callable(f) for f in q.values()) and all(isinstance(s, str) and s.strip() for s in o.values())
