"""How many of all name pairs of one client the amount join (D9) scores: ``python tools/employee_share.py [employees a side ...]``.

Made-up names (first and last names by a skewed draw) and log-normal amounts; 60 in 100 payroll employees are a ledger employee with
a changed letter, a middle name or swapped words, and an amount that is equal or off by up to a tenth."""

from __future__ import annotations

import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tieout.operators import amount_join as aj  # noqa: E402
from tieout.operators.employees import CONTEXT_THRESHOLD  # noqa: E402
from tieout.session import build_session, cut_lineage  # noqa: E402

SYLLABLES = [a + b for a in "bcdfghjklmnprstvwz" for b in ("a", "e", "i", "o", "u", "an", "el", "in", "or", "us")]


def employees(n: int, rng: random.Random) -> tuple[list[tuple], list[tuple]]:
    word = lambda k: "".join(rng.choices(SYLLABLES, k=k)).title()
    first, last = [word(rng.randint(2, 3)) for _ in range(400)], [word(rng.randint(2, 4)) for _ in range(int(40 * n ** 0.5))]
    pick = lambda x: x[int(len(x) * rng.random() ** 2)]
    fresh = lambda: (f"{pick(first)} {pick(last)}", round(rng.lognormvariate(7, 1), 2))
    left = [fresh() for _ in range(n)]
    right = []
    for s, a in left:
        if rng.random() > 0.6:
            right.append(fresh())
            continue
        i, w = rng.randrange(len(s)), s.split()
        s = rng.choice([s, s[:i] + rng.choice("aeinorst") + s[i + 1:], f"{w[0]} {pick(first)} {w[1]}", f"{w[1]} {w[0]}"])
        right.append((s, a if rng.random() < 0.5 else round(a * rng.uniform(0.9, 1.1), 2)))
    return left, right


def main() -> None:
    spark = build_session(app="employee-share")
    for n in map(int, sys.argv[1:] or (2000, 10000, 50000)):
        left, right = employees(n, random.Random(n))
        le = spark.createDataFrame([("c", f"{s}|{i}", s, a) for i, (s, a) in enumerate(left)], "unified_name string, l_item string, l_norm string, qa double")
        pe = spark.createDataFrame([("c", f"{s}|{i}", s, a) for i, (s, a) in enumerate(right)], "unified_name string, p_name string, p_norm string, pa double")
        lp, pp = cut_lineage(aj.profile(le, "l_norm", "qa", "l")), cut_lineage(aj.profile(pe, "p_norm", "pa", "p"))
        began = time.time()
        near = aj.meet(lp, pp).filter(aj.amounts_near_or_zero()).count()
        band = time.time() - began
        began = time.time()
        pairs = cut_lineage(aj.that_may_reach(aj.meet(lp, pp), CONTEXT_THRESHOLD))
        kept = pairs.count()
        joined = time.time() - began
        began = time.time()
        names = cut_lineage(aj.distinct_names(pairs, CONTEXT_THRESHOLD).withColumn("windows", aj.windows_matter()))
        distinct, windows = names.agg(F.count(F.lit(1)), F.sum(F.col("windows").cast("int"))).first()
        aj.with_bounded_scores(pairs, CONTEXT_THRESHOLD).write.format("noop").mode("overwrite").save()
        print(f"{n} x {n}: of all {n * n} pairs {near / n / n:.4f} within the amount band ({band:.0f} s to count), {kept / n / n:.6f} pass the bounds ({joined:.0f} s), "
              f"{distinct / n / n:.6f} distinct names scored, {(windows or 0) / n / n:.6f} by windows ({time.time() - began:.0f} s)", flush=True)


if __name__ == "__main__":
    main()
