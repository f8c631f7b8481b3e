"""Numbers traced to values, against plain Python."""

import random
import re

from meshwork.operators import trace


def test_against_plain_python(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-20, 20), rng.randint(0, 4)) for _ in range(40)] + [0.125, None]
    texts = [(i, " ".join(rng.choice([f"{rng.choice(values[:40]):.{rng.randint(0, 4)}f}", f"{rng.uniform(-20, 20):.1f}", "x"]) for _ in range(12))) for i in range(30)]
    texts += [(100, None), (101, ""), (102, "no number"), (103, "0.12 0.13 0.14 -0.13"), (104, "12345678901234567890 1.12345678")]
    got = {r.id: (r.n_numbers, r.n_traced) for r in trace.traced(spark.createDataFrame(texts, "k long, s string"), "k", "s", spark.createDataFrame([(v,) for v in values], "w double"), "w").collect()}
    known = [v for v in values if v is not None]

    def hit(t):
        d = len(t.split(".")[1]) if "." in t else 0
        return d <= 4 and any(abs(v * 10.0**d - int(t.replace(".", ""))) <= 0.5 + 1e-6 for v in known)

    want = {}
    for i, s in texts:
        found = re.findall(trace.NUMBER, s or "")
        if found:
            want[i] = (len(found), sum(map(hit, found)))
    assert got == want and got[103][1] >= 2 and got[104] == (2, 0)
