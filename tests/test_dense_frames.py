"""RANGE frames of many rows: each row is looked at a fixed number of times."""

import random
import re

from millrace.operators.windows import range_frame


def test_frames_are_running_sums(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["x", "y", None]), rng.choice([None, *[rng.randint(-40, 40) for _ in range(20)]]), rng.choice([None, 1, 3, 10**15])) for k in range(1200)]
    df = spark.createDataFrame(rows, "id long, g string, o long, v long")
    for below, above in ((6, 1), (0, 0), (3, 0)):
        framed = range_frame(df, ["g"], "o", below, above, {"v": "s"}, "n")
        frames = re.findall(r"specifiedwindowframe\(([^)]*\)[^)]*)\)", framed._jdf.queryExecution().optimizedPlan().toString())
        assert frames and all(f == "RangeFrame, unboundedpreceding$(), currentrow$(" for f in frames)
        got = {r.id: (r.n, r.s) for r in framed.collect()}
        for i, g, o, _ in rows:
            near = [v for _, g2, o2, v in rows if g2 == g and (o2 is None if o is None else o2 is not None and o - below <= o2 <= o + above)]
            known = [v for v in near if v is not None]
            assert got[i] == (len(near), sum(known) if known else None)
