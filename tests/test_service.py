import pytest
from inkspan.plans import model as m
from inkspan.plans import service

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ix(spark):
    s = m.sentences(spark, SF).cache()
    rel = spark.createDataFrame([("p01", "p02", "x"), ("p02", "p03", "y"), ("p03", "p05", "x")], "a string, b string, rel string")
    trj = spark.createDataFrame([("p01", "l01", 5, 1), ("p01", "l01", 7, 2), ("p01", "l02", None, 3)], "person string, place string, year int, ord int")
    return service.Index(s, m.find_mentions(s, m.surfaces(m.PERSONS)), m.find_mentions(s, m.surfaces(m.PLACES)), m.persons(spark), m.places(spark), m.book_eras(spark), rel, trj, tuple(f"src{k}" for k in range(20)))


def test_payloads(ix):
    assert ix.health()["ok"] and ix.stats()["persons"].first()["n"] == len(m.PERSONS)
    assert set(ix.index("src0")) == {"persons", "places", "chapters", "quick"}
    p = ix.person("p01", limit=5)
    assert p["mentions"].count() == 5 and p["by_book"].count() == 20
    assert ix.search("TH")["persons"].count() == 3
    uid = p["mentions"].first()["uid"]
    assert ix.sentence(uid)["sentence"].count() == 1 and ix.chapter(0).count() > 0
    assert [(r["a"], r["b"], r["degree"]) for r in ix.relations_of("p01", 2).collect()] == [("p01", "p02", 1), ("p02", "p03", 2)]
    assert [(r["place"], r["time_order"]) for r in ix.trajectory("p01").collect()] == [("l01", 1), ("l02", 0)]


def test_validation(ix):
    for bad in ("", " " * 3, "x" * 65):
        with pytest.raises(ValueError):
            ix.search(bad)
    with pytest.raises(ValueError):
        ix.index("nowhere")
    with pytest.raises(ValueError):
        ix.sentence("1")
    assert service.clamped(9999) == 500 and service.clamped(0) == 1


def test_sheets(spark):
    s = spark.createDataFrame([("u", "drop", "active"), ("v", "drop", "active")], "uid string, action string, status string")
    got = service.with_row(s, {"uid": "u", "action": "keep"}, ["uid"])
    assert sorted(tuple(r) for r in got.collect()) == [("u", "drop", "revoked"), ("u", "keep", "active"), ("v", "drop", "active")]
    assert {r["uid"]: r["status"] for r in service.revoked(s, {"uid": "v"}).collect()} == {"u": "active", "v": "revoked"}
