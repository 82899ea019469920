"""Arrow list columns as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, lists: pa.Array):
    """Yield ``(rows, ids, matrix)`` for each vector length in a batch, leaving out nulls and non-finite vectors.

    ``rows`` are positions in the batch, ``matrix`` is float64 with one row per vector. Null ids are left out too.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists, ids = lists.combine_chunks(), ids.combine_chunks()
    if not len(lists):
        return
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()
    size = np.diff(starts)
    flat = lists.values
    holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(values)
    if holes is not None:
        bad |= holes
    names = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size[ok]):
        rows = np.flatnonzero(ok & (size == n))
        at = starts[rows][:, None] + np.arange(n)[None, :]
        keep = ~bad[at].any(axis=1)
        yield rows[keep], names[rows[keep]], values[at[keep]]
