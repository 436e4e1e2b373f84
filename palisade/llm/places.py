"""Places in documents, packed: (id, mark, position) dealt by document and gathered per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetools as bt
from . import packed

KINDS = {"bucket": pa.int32(), "ids": pa.binary(), "mark": pa.binary(), "at": pa.binary(), "flag": pa.binary()}
SCHEMA = "bucket int, ids binary, mark binary, at binary, flag binary"


def emitted(ids: np.ndarray, mark: np.ndarray, at: np.ndarray, flag: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Places of any documents, split by the documents' buckets."""
    out: dict[str, list] = {k: [] for k in KINDS}
    bucket = packed.bucket_of(bt.mix(ids.astype(np.int64).view(np.uint64).copy()), buckets)
    order, starts = packed.parts(bucket, buckets)
    for k in np.flatnonzero(np.diff(starts)):
        own = order[starts[k] : starts[k + 1]]
        out["bucket"].append(int(k))
        out["ids"].append(packed.planes(ids[own].astype(np.int64)))
        out["mark"].append(packed.marks_cell(mark[own]))
        out["at"].append(packed.planes(at[own].astype(np.int32)))
        out["flag"].append(packed.planes(flag[own].astype(np.int32)))
    return packed.batch(out, KINDS)


def by_document(places: DataFrame, buckets: int) -> DataFrame:
    """One row per document: doc_id, mark, at, flag (binary int32, in the order of the places)."""

    def each(cells: dict[str, list]) -> Iterator[pa.RecordBatch]:
        ids = [packed.from_planes(c, np.int64) for c in cells["ids"]]
        mark = np.concatenate([packed.from_marks_cell(c, len(i)) for c, i in zip(cells["mark"], ids, strict=True)])
        ids = np.concatenate(ids)
        at = np.concatenate([packed.from_planes(c, np.int32) for c in cells["at"]])
        flag = np.concatenate([packed.from_planes(c, np.int32) for c in cells["flag"]])
        order = np.lexsort((at, mark, ids))
        ids, mark, at, flag = ids[order], mark[order], at[order], flag[order]
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])))
        ends = np.append(first[1:], len(ids))
        for s in range(0, len(first), 2000):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first[s : s + 2000]]),
                    pa.array(mark[first[s : s + 2000]]),
                    pa.array([at[a:b].tobytes() for a, b in zip(first[s : s + 2000], ends[s : s + 2000], strict=True)], pa.binary()),
                    pa.array([flag[a:b].tobytes() for a, b in zip(first[s : s + 2000], ends[s : s + 2000], strict=True)], pa.binary()),
                ],
                ["doc_id", "mark", "at", "flag"],
            )

    gathered = packed.gathered(each, list(KINDS))
    return packed.dealt(places, buckets).mapInArrow(gathered, "doc_id long, mark long, at binary, flag binary")
