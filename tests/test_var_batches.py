"""Rows of a batch one at a time: no batch of blocks becomes Python numbers as a whole, and outputs travel many at once."""

import numpy as np
import pyarrow as pa

from lacuna.operators import varblocks as vb


def test_rows_are_views_and_outputs_are_gathered():
    v = pa.array([np.arange(700.0) + i for i in range(50)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.concat_arrays([v, v.slice(0, 10)])], ["gid", "v"]).slice(3, 40)
    rows = list(vb.each(iter([batch])))
    assert [r["gid"] for r in rows] == list(range(3, 43))
    assert all(isinstance(r["v"], np.ndarray) and r["v"][0] == i for i, r in enumerate(rows, 3))
    assert rows[0]["v"].base is not None  # a view
    parts = list(vb.gathered(({"gid": np.full(3, i), "i": np.arange(3), "m": np.full((3, 2), i + 0.5)} for i in range(100)), vb.FILLED, 120))
    assert len(parts) == 10
    got = pa.Table.from_batches(parts).to_pylist()
    assert len(got) == 300 and got[-1] == {"gid": 99, "i": 2, "m": [99.5, 99.5]}


def test_a_long_block_makes_no_matrix_of_all_its_cells():
    y = np.ones((400, 2))
    y[5:9, 0] = np.nan
    block = vb.Block(y, np.nan_to_num(y), 400, 0, 1, False, np.array([[0.1, 0.2], [0.5, 0.0], [0.0, 0.5]]), np.eye(2), 1)
    assert max(x.size for x in vars(block).values() if isinstance(x, np.ndarray)) <= y.size
