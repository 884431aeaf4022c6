"""Equal vectors: of many that score alike a task keeps no more than asked for."""

from types import SimpleNamespace

import numpy as np
import pandas as pd

from kindred.operators import ivf


def test_a_task_holds_k_rows_a_query(monkeypatch):
    held, first = [], ivf._first
    monkeypatch.setattr(ivf, "_first", lambda found, k: held.append(len(found)) or first(found, k))
    none = np.zeros((3, 0), np.int64)
    for beat in (None, np.full(3, -2.0)):
        block = ivf.Block(np.arange(3), np.eye(3), none, none, np.full(3, -2.0), 1.0)
        block.beat = beat if beat is not None else np.full(3, -2.0)
        shared = SimpleNamespace(value=(block, np.eye(3), np.zeros(3), np.full(3, 3.0)))
        batches = [pd.DataFrame({"cell": 0, "record_id": [f"R{i:04}" for i in range(a + 999, a - 1, -1)], "vector": [[1.0, 0.0, 0.0]] * 1000}) for a in (1000, 0)]
        out = pd.concat(ivf._scanner(shared, 2, SimpleNamespace(add=lambda n: None))(iter(batches)))
        assert held.pop() <= 2 * 3 * len(batches)
        assert out[out["query_id"] == 0]["record_id"].tolist() == ["R0000", "R0001"]
