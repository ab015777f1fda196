"""Connected groups inside one block of rows, with numpy arrays."""

from __future__ import annotations

import numpy as np


class Groups:
    """Labels 0..n-1 that links merge; a label is the smallest index of its group once settle() has run."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the groups of a[i] and b[i] for all i: roots are hooked to smaller roots until none differ."""
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            self.settle()

    def settle(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return self.root
            self.root = up
