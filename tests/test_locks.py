import json

import pytest

from conceptmill.operators.store import Store, StoreRefused

G = "urn:g"


def test_a_store_in_use_is_refused(spark, tmp_path):
    at = str(tmp_path / "store")
    one = Store(spark, at, exclusive=True)
    one.create_graph(G)
    with pytest.raises(StoreRefused, match="AlreadyInUse.*process"):
        Store(spark, at, exclusive=True)
    reader = Store(spark, at)
    assert reader.exists(G)
    with pytest.raises(StoreRefused, match="AlreadyInUse"):
        reader.create_graph("urn:h")
    one.close()
    with pytest.raises(StoreRefused, match="NestedTransaction"), reader.transaction():
        reader.create_graph("urn:h")
    reader.create_graph("urn:h")
    assert not (tmp_path / "store" / "lock").exists()


def test_a_change_by_another_driver_is_not_lost(spark, tmp_path):
    at = str(tmp_path / "store")
    a, b = Store(spark, at), Store(spark, at)
    a.create_graph("urn:a")
    with pytest.raises(StoreRefused, match="ChangedElsewhere"):
        b.create_graph("urn:b")
    b.refresh().create_graph("urn:b")
    assert Store(spark, at).exists("urn:a") and Store(spark, at).exists("urn:b")


def test_a_lock_left_behind(spark, tmp_path):
    at = str(tmp_path / "store")
    Store(spark, at, exclusive=True)
    with pytest.raises(StoreRefused, match="AlreadyInUse"):
        Store(spark, at, exclusive=True)
    Store.unlock(spark, at)
    Store(spark, at, exclusive=True).close()


@pytest.mark.parametrize("change, code", [({"graphs": {G: {"kind": "strange", "path": None}}}, "Corrupt"), ({"graphs": {G: {"kind": "vocabulary", "path": "/none/such"}}}, "Corrupt"), (None, "Open"), ({"format": 99}, "FormatTooNew")])
def test_what_cannot_be_opened(spark, tmp_path, change, code):
    at = tmp_path / "store"
    Store(spark, str(at)).create_graph(G)
    file = at / "catalog.json"
    (at / ".catalog.json.crc").unlink(missing_ok=True)
    file.write_text("{" if change is None else json.dumps(json.loads(file.read_text()) | change))
    with pytest.raises(StoreRefused, match=code):
        Store(spark, str(at), exclusive=True)
    assert not (at / "lock").exists()
