from siltstone.operators.text import near_clones, winnowed


def test_near_clones_of_a_large_group(spark):
    """More edited copies than any fingerprint bound, held against sets compared pair by pair."""
    base = [f"w{n}" for n in range(40)]
    rows = [(k, " ".join([*base[: 20 + k % 15], f"own{k}", *base[20 + k % 15 :]])) for k in range(210)]
    rows += [(300, " ".join(base)), (301, " ".join(base)), (302, " ".join(base) + " "), (303, "few words"), (304, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    sets = {}
    for r in winnowed(docs.where("id <> 301"), "id", "text").collect():
        sets.setdefault(r.id, set()).add(r.print)
    want = {}
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and round(100.0 * shared / min(len(sets[a]), len(sets[b])), 1) >= 60:
                want[a, b] = shared
    got = near_clones(docs, "id", "text").collect()
    assert len(got) == len(want) > 5000 and {(r.a, r.b): r.shared for r in got} == want
