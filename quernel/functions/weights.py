"""How rare a byte is, and the weight of two neighbouring bytes."""

from __future__ import annotations

import numpy as np

# The rank of each byte 0..127 by frequency in text and source code, 0 being the most
# frequent; they decide where n-grams begin and end, so an index and its queries must share them.
# Bytes from 128 on all have 200.
_ASCII_RANKS = """
180 200 200 200 200 200 200 200 200  39  10 200 200  62 200 200
200 200 200 200 200 200 200 200 200 200 200 170 200 200 200 200
  0  57  32  58  90  60  55  33  25  25  54  53  29  52  30  34
 36  37  38  43  44  45  46  47  48  49  31  27  50  26  50  55
 59  67  80  65  74  68  76  79  78  66  86  84  72  75  70  71
 73  87  69  63  64  77  82  81  85  83  88  51  61  51  95  24
105   3  19  11  12   1  16  18  17   5  40  23   9  15   6   4
 14  41   8   7   2  13  21  22  35  20  42  28  56  28 100 190
"""
_OTHER_RANK = 200

RANKS = np.full(256, _OTHER_RANK, np.int32)
RANKS[:128] = [int(x) for x in _ASCII_RANKS.split()]


def pair_weight(first: int, second: int) -> int:
    """Weight of two neighbouring bytes, 0 to 65535; the rarer, the heavier."""
    return int(RANKS[first]) * 256 + int(RANKS[second])


def pair_weights(data: np.ndarray) -> np.ndarray:
    """Weights of all neighbouring bytes of an array."""
    r = RANKS[data]
    return r[:-1] * 256 + r[1:]
