
import random

from discloom.llm import leaks as L


def test_alterations_that_stand_together_are_found():
    words = [f"w{i}" for i in range(40)]
    items = L.Items([(1, " ".join(words[:32])), (2, " ".join(f"v{i}" for i in range(34)))])
    v = [f"v{i}" for i in range(34)]
    texts = [
        words[:14] + ["a", "b", "c", "d"] + words[18:32],
        words[:14] + words[18:32],
        v[:17] + ["a", "b", "c", "d"] + v[17:],
        words[:13] + ["a", "b"] + words[15:17] + ["c", "d"] + words[19:32],
        words[:14] + ["a", "b", "c", "d", "e"] + words[19:32],
        words[:13] + ["a", "b", "c", "d"] + words[18:31],
    ]
    got = L.search(items, [(i, "before it " + " ".join(t) + " after it") for i, t in enumerate(texts)])
    assert sorted(got) == [(1, 0), (1, 1), (1, 3), (2, 2)]


def test_clumps_of_alterations_by_the_definition():
    rng = random.Random(11)
    for _ in range(3000):
        e = rng.randint(4, 8)
        n = 8 * e + rng.randint(0, 2)
        item = [f"w{i}" for i in range(n)]
        doc = list(item)
        left = e
        while left:
            size = min(left, rng.choice((1, 2, 3, 4, 8)))
            at = rng.randint(1, n - 1 - size)
            for i in range(at, at + size):
                doc[i] = "x"
            left -= size
        if doc[0] == "x" or doc[-1] == "x":
            continue
        assert L.search(L.Items([(1, " ".join(item))]), [(1, " ".join(doc))]) == [(1, 1)], doc
