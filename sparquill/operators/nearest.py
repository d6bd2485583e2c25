"""Blocks of queries against batches of vectors, in arrays: what tasks of vector searches run."""

from __future__ import annotations

#: Vectors that are compared at a time with a block of queries, which bounds the matrix of their scores.
ROWS = 1024


def matrices(column):
    """Rows of a list column by length: (row numbers, unit vectors), without those that have no direction (null, zero, not finite)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.cumsum(size) - size
    for length in np.unique(size[size > 0]):
        all_rows = np.flatnonzero(size == length)
        for i in range(0, len(all_rows), ROWS):
            rows = all_rows[i : i + ROWS]
            v = flat[begin[rows, None] + np.arange(length)]
            with np.errstate(all="ignore"):
                norm = np.sqrt((v * v).sum(1))
                real = np.isfinite(norm) & (norm > 0)
            if real.any():
                yield rows[real], v[real] / norm[real, None]


def by_length(rows):
    """Rows (name, vector, ...) as {length: (their numbers, unit vectors)}."""
    import numpy as np

    out: dict = {}
    for i, row in enumerate(rows):
        v = np.asarray(row[1], float)
        n = np.sqrt((v * v).sum())
        if len(v) and np.isfinite(n) and n > 0:
            out.setdefault(len(v), []).append((i, v / n))
    return {k: (np.array([i for i, _ in v]), np.stack([x for _, x in v])) for k, v in out.items()}


class Best:
    """The ``limit`` best rows of each of ``n`` queries; equal scores go to the smaller key."""

    def __init__(self, n: int, limit: int):
        import numpy as np

        self.limit, self.bound = limit, np.full(n, -np.inf)
        self.query, self.score, self.key = np.zeros(0, int), np.zeros(0), None

    def add(self, queries, keys, score) -> None:
        """``score`` has a row for each of ``queries`` (numbers), a column for each of ``keys`` (an Arrow array)."""
        import numpy as np
        import pyarrow as pa

        if not score.size or not self.limit:
            return
        least = self.bound[queries]
        if score.shape[1] > self.limit:
            least = np.maximum(least, np.partition(score, -self.limit, axis=1)[:, -self.limit])
        q, v = np.nonzero(score >= least[:, None])
        own = keys.take(pa.array(v))
        query, value = np.append(self.query, queries[q]), np.append(self.score, score[q, v])
        key = own if self.key is None else pa.concat_arrays([self.key, own])
        # places of keys in their order, so that keys of any type sort with the scores
        _, place = np.unique(key.to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.lexsort((place, -value, query))
        query, value = query[order], value[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kept = nth < self.limit
        last = nth == self.limit - 1
        self.bound[query[last]] = value[last]
        self.query, self.score, self.key = query[kept], value[kept], key.take(pa.array(order[kept]))


def scores(vectors, queries):
    """Cosines of unit vectors, to twelve places: the order of sums makes no ties."""
    import numpy as np

    return np.round(queries @ vectors.T, 12)


def answers(best: Best, names, schema):
    """Rows (query_id, key, score) of what was found."""
    import pyarrow as pa

    if best.key is not None and len(best.query):
        named = pa.array(names, schema.field(0).type).take(pa.array(best.query))
        yield pa.RecordBatch.from_arrays([named, best.key.cast(schema.field(1).type), pa.array(best.score)], schema=schema)
