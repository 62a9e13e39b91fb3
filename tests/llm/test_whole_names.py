
from discloom.llm import variants as V

SCHEMA = "key string, brand string, legal string, site string"


def grouped(spark, rows):
    got = V.systems(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.key for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.system, set()).add(r.key)
    return sorted(map(sorted, by.values()))


def test_a_frequent_variant_goes_to_its_system_too(spark):
    legal = "Zubramilo Ventures LLC"
    rows = [(f"a{i}", "Vaskalund Ushigimbran Pizza", legal, None) for i in range(6)]
    rows += [(f"b{i}", "Vasky Ushigimbran Pizza", legal, None) for i in range(4)]  # pet form
    rows += [(f"c{i}", "Ushigimbran Pizza", None, "www.vaskalund.example") for i in range(3)]  # a word left out
    rows += [("a6", "Vaskalund Ushigimbran Pizza", None, "https://vaskalund.example/")]
    rows += [(f"d{i}", "Skatroclo Dornojov Yoga", legal, None) for i in range(3)]  # another brand
    want = [[f"a{i}" for i in range(7)] + [f"b{i}" for i in range(4)] + [f"c{i}" for i in range(3)], [f"d{i}" for i in range(3)]]
    assert grouped(spark, rows) == want
