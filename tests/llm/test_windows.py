"""Windows of a long text are searched together and found as each is alone."""

import random

import numpy as np

from quillfin.llm import decontam


def test_windows_are_searched_together():
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice((8, 20, 60))))) for k in range(40)]
    bags = [set(t.split()) for _, t in items]
    index = decontam.Index(items, (40, 30.0, {w: sum(w in b for b in bags) for b in bags for w in b}))
    text = " ".join(items[r.randrange(40)][1] if r.random() < 0.02 else f"w{r.randrange(400)}" for _ in range(12000))
    numbers = np.array(index.numbers(text.split()), dtype=np.int32)
    hits = np.flatnonzero(numbers >= 0)
    (c,) = index.classes
    together: dict[int, dict[int, float]] = {}
    for begin, found in c.windows(numbers, hits):
        together.setdefault(begin, {}).update(found)
    alone = {}
    for begin in range(0, len(numbers) - c.span, c.span):
        own = np.unique(w[w >= 0]) if len(w := numbers[begin : begin + 2 * c.span]) else w
        alone[begin] = dict(index.search(own))
    assert len(alone) > 2 * decontam.WINDOWS and any(alone.values())
    assert {b: f for b, f in together.items() if f} == {b: f for b, f in alone.items() if f}
