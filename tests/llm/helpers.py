"""Brute-force models for the operators of the llm subpackage."""

import numpy as np


def components(n: int, pairs) -> list[int]:
    """Smallest index reachable from each of n."""
    label = list(range(n))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(fps: list[int], limit: int):
    x = np.array(fps, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= limit):
            yield i, i + 1 + int(j)
