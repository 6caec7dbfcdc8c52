"""Arrow batches in small pieces: Spark sends 10,000 rows at once, and what Python makes of them is many times their size.

A piece holds PIECE bytes at most, or one row; what is made of it leaves before the next is read. So a worker's memory
follows the longest row and not the number of rows that Spark sends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

PIECE = 1 << 18


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices of `size` bytes at most or of one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            one = todo.pop()
            if one.num_rows > 1 and one.nbytes > size:
                half = one.num_rows // 2
                todo += [one.slice(half), one.slice(0, half)]
            else:
                yield one
