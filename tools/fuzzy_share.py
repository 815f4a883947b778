"""How many of all name pairs the staged similarity join scores: ``python tools/fuzzy_share.py [size ...]``.

Made-up company names of two or three words; of the right side's names 70 in 100 are variants of left ones (a letter changed, a word added
or dropped, words swapped), the rest are new."""

from __future__ import annotations

import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tieout.operators.blocking import best_similar  # noqa: E402
from tieout.session import build_session  # noqa: E402

SYLLABLES = [a + b + c for a in "bcdfghklmnprstvw" for b in "aeiou" for c in ("", "", "l", "n", "r", "s", "t", "x")]


def names(n: int, rng: random.Random) -> tuple[list[str], list[str]]:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))).title() for _ in range(int(12 * n ** 0.5))]  # a vocabulary grows slower than its names
    fresh = lambda: " ".join(rng.choices(words, k=rng.randint(2, 3)))
    left = list({fresh() for _ in range(n)})

    def variant(s: str) -> str:
        w, kind = s.split(), rng.randrange(4)
        if kind == 0:
            i = rng.randrange(len(s))
            return s[:i] + rng.choice("aeinorst") + s[i + 1:]
        return " ".join(w + [rng.choice(words)] if kind == 1 else w[:-1] + [rng.choice(words)] if kind == 2 else w[::-1])

    right = list({variant(rng.choice(left)) if rng.random() < 0.7 else fresh() for _ in range(n)})
    return left, right


def main() -> None:
    spark = build_session(app="fuzzy-share")
    spark.sparkContext.setLogLevel("OFF")
    for n in map(int, sys.argv[1:] or (500, 2000, 8000)):
        left, right = names(n, random.Random(n))
        frame = lambda x: spark.createDataFrame([(s, s) for s in x], "id string, s string")
        began, report = time.time(), []
        best_similar(frame(left), frame(right), 0.5, report)
        pairs = len(left) * len(right)
        scored = sum(r["scored"] for r in report)
        print(f"{n}: {len(left)} x {len(right)} names, {time.time() - began:.0f} s; scored {scored / pairs:.6f} of all pairs; by stage "
              + ", ".join(f"{r['threshold']}: asked {r['asked']}, scored {r['scored']}, found {r['found']}" for r in report), flush=True)


if __name__ == "__main__":
    main()
