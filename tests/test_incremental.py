import numpy as np

from framewell.operators import dedup, incremental


def groups(df, group, member):
    out = {}
    for r in df.collect():
        out.setdefault(r[group], set()).add(r[member])
    return sorted(map(sorted, out.values()))


def test_edits_give_what_grouping_anew_gives(spark):
    rng = np.random.default_rng(4)

    def hash_near(v):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            v ^= 1 << int(b)
        return v - (1 << 64) if v >> 63 else v

    centres = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fresh = lambda: hash_near(centres[int(rng.integers(0, 6))]) if rng.random() < 0.7 else int(rng.integers(-(1 << 63), 1 << 63))
    now = {i: fresh() for i in range(80)}
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, phash long")
    state = incremental.begin(frame([*now.items()]))
    for turn in range(3):
        gone = [int(i) for i in rng.choice([*now], (12, 0, 30)[turn], replace=False)]
        changed = [i for i in gone[::3]]
        come = {1000 * (turn + 1) + k: fresh() for k in range((10, 15, 0)[turn])} | {i: fresh() for i in changed}
        state = incremental.update(state, frame([*come.items()]), spark.createDataFrame([(i,) for i in gone], "image_id long"))
        for i in gone:
            del now[i]
        now |= come
        want = groups(dedup.components(frame([*now.items()])), "component", "image_id")
        assert groups(state.members, "rep", "image_id") == want
        assert groups(incremental.members_of_groups(state), "group_id", "image_id") == [g for g in want if len(g) > 1]
        assert state.keys.select("phash").distinct().count() == len(set(now.values()))
    same = incremental.update(state, frame([]), spark.createDataFrame([], "image_id long"))
    assert same is state
    none = incremental.update(state, frame([]), state.members.select("image_id"))
    assert none.members.count() == 0 and none.keys.count() == 0
    assert incremental.begin(frame([])).members.count() == 0
