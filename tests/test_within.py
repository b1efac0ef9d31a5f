import random

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.operators import catalog as C
from weftgraph.operators import within as W


def _texts(seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choices("aab é語𝒳", k=n))
    names = {word(n) for n in [1, 2, 3, 5, 8, 9, 12, 13, 17, 26] for _ in range(6)} - {"a", "b", " "}
    texts = ["", *(word(draw.randrange(60)) for _ in range(150)), *(word(3) + draw.choice(sorted(names)) + word(2) for _ in range(150)), *names]
    return texts, sorted(names)


@pytest.mark.parametrize("together", [W.TOGETHER, 64, 1])
def test_found_names_are_those_inside(monkeypatch, together):
    monkeypatch.setattr(W, "TOGETHER", together)
    texts, names = _texts(together)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 3)), pa.array(["x" * 9, *texts, "", "y"])], ["k", "t"]).slice(1, len(texts))
    marks = list(W._marks(16)(iter([pa.RecordBatch.from_arrays([pa.array(names)], ["n"])])))
    places = np.frombuffer(marks[0].column(0)[0].as_py(), np.uint32)
    bits = np.packbits(np.isin(np.arange(1 << 16), places), bitorder="little").tobytes()
    lengths = {}
    for n in np.frombuffer(marks[0].column(1)[0].as_py(), np.int64).tolist():
        lengths.setdefault(int(W._heads(np.array([n]))[0]), []).append(n)
    shared = type("Shared", (), {"value": bits})
    found = [(k, n) for b in W._search(shared, 16, lengths)(iter([batch])) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(found) == len(set(found))
    assert {(k, n) for k, n in found if n in names} == {(k, n) for k, t in enumerate(texts, 1) for n in names if n in t}
    assert all(n in texts[k - 1] for k, n in found)


@pytest.mark.parametrize("bound", [C.BROADCAST_ENTRIES, 0])
def test_names_in_texts_of_any_script(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(C, "BROADCAST_ENTRIES", bound)
    texts, names = _texts(7)
    known = spark.createDataFrame([("L", f"E{i}", n.upper()) for i, n in enumerate(names)] + [("L", "E", None), ("L", "F", "")], "label string, id string, name string")
    asked = spark.createDataFrame([*enumerate(texts), *enumerate(texts[:20]), (999, None)], "k int, t string")
    low = [n.upper().lower() for n in names]
    assert rows(C.link_names(asked, "k", "t", known)) == sorted(((k, "L", f"E{i}") for k, t in enumerate(texts) for i, n in enumerate(low) if n in t.lower()), key=str)
    some = C.link_names(asked, "k", "t", known, least=5, also=("name",))
    assert {(r.k, r.name) for r in some.collect()} == {(k, n.upper()) for k, t in enumerate(texts) for n in names if len(n) >= 5 and n in t}
    assert C.link_names(asked, "k", "t", known.filter("name is null")).count() == 0
