"""Records: header and children come from one evaluation of each child table."""
from conftest import SF
from parleo.catalog import records as catalog
from parleo.operators import entities as ent
from parleo.operators import records


def test_entities_are_searched_once_and_counts_agree(spark, monkeypatch):
    calls, real = [], ent.entity_arrays
    monkeypatch.setattr(ent, "entity_arrays", lambda *a, **k: calls.append(1) or real(*a, **k))
    rec = catalog.call_records(spark, SF)
    assert len(calls) == 1
    numbers = ["call_id", "num_segments", "num_entities", "num_intents", "num_obligations", "num_promises", "compliance_score"]
    built = {tuple(r) for r in records.flatten(rec).select(*numbers).collect()}
    assert built == {tuple(r) for r in catalog.flat_calls(spark, SF).select(*numbers).collect()} and built
