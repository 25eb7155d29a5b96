import random

from graphloom.llm.p7_packing import first_fit, pack


def plain(sizes, capacity):
    room, bins = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                bins.append(i)
                break
        else:
            room.append(capacity - s)
            bins.append(len(room) - 1)
    return bins


def test_first_fit_is_first_fit():
    rnd = random.Random(1)
    for n in (0, 1, 7, 300):
        sizes = sorted((rnd.randrange(0, 101) for _ in range(n)), reverse=True)
        assert first_fit(sizes, 100)[0] == plain(sizes, 100)


def test_pack_places_everything_once(spark):
    rnd = random.Random(2)
    items = [(i, rnd.choice([0, 5, 40, 99, 100, 101, 257])) for i in range(400)] + [(400, None), (401, 7), (401, 7), (None, 3)]
    rows = pack(spark.createDataFrame(items, "doc_id bigint, size bigint"), 100, group_rows=90).collect()
    assert sum(r["size"] for r in rows) == sum(s or 0 for _, s in items)
    assert len({r["grp"] for r in rows}) > 1
    bins = {}
    for r in rows:
        bins.setdefault((r["grp"], r["bin"]), []).append((r["at"], r["size"]))
        assert (r["n_pieces"] > 1) == (r["size"] == 100 and r["n_pieces"] > 1 or r["n_pieces"] > 1)
    for places in bins.values():
        at = 0
        for a, s in sorted(places):
            assert a == at
            at += s
        assert at <= 100
