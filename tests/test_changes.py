from conceptmill.operators.diff import concept_diff
from conceptmill.operators.store import Store
from conceptmill.streaming.drops import watch
from tests.test_store import G, graph, types


def test_diff(spark):
    before = graph(spark, *types("a", "b", "c", "d"), ("b", "skos:broader", "a"), ("b", "skos:prefLabel", "B", "en"), ("d", "owl:deprecated", "true", None, "xsd:boolean"))
    after = graph(spark, *types("a", "b", "d", "e"), ("b", "skos:broader", "d"), ("b", "skos:prefLabel", "B2", "en"), ("a", "owl:deprecated", "true", None, "xsd:boolean"))
    got = {(r["node"], r["change"], r["was"], r["now"]) for r in concept_diff(before, after).collect()}
    assert got == {("c", "removed", None, None), ("e", "added", None, None), ("b", "relabelled", "B", "B2"), ("b", "moved", "a", "d"), ("d", "reinstated", None, None), ("a", "deprecated", None, None)}


def test_dropped_files_become_candidates(spark, tmp_path):
    drops = tmp_path / "drops"
    drops.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    store.create_graph(G)
    for i in (1, 2):
        (drops / f"{i}.nt").write_text(f'<urn:a{i}> <urn:p> "x" .\n')
        watch(store, str(drops), G, str(tmp_path / "checkpoint")).awaitTermination(60)
    assert [(c["id"], c["additions"], c["state"]) for c in store.catalog["candidates"]] == [(1, 1, "proposed"), (2, 1, "proposed")]
    assert store.scan(G).count() == 0
