"""Brute-force versions shared by tests."""

import numpy as np
import pyarrow as pa

from quire.llm import parity
from quire.llm.shared import text_parts


def groups(rows, t):
    """Least ids of the groups of similar texts."""
    s = []
    for _, data, offs in text_parts(pa.array([x for _, x in rows])):
        g, n = parity.sets(data, offs)
        s += [set(x.tolist()) for x in np.split(g, np.cumsum(n)[:-1])]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k in range(len(rows)):
        for j in range(k):
            small, big = sorted((len(s[j]), len(s[k])))
            if small and small >= t * big and len(s[j] & s[k]) >= t * len(s[j] | s[k]):
                x, y = sorted((root(rows[j][0]), root(rows[k][0])))
                up[y] = x
    return sorted({root(i) for i in up})
