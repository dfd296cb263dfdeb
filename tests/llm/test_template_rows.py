"""What line dedup hands on of the lines whose rare tokens may be variable."""

import numpy as np
import pyarrow as pa

from trailforge.llm import templates


def test_a_line_is_one_row_however_often_it_comes():
    line = "one two three four five six seven"
    batch = pa.RecordBatch.from_pydict({"text": [line] * 50 + [f"{line} eight\n{line}", None]})
    made = [b for b in templates._tokens(None)([batch, batch])]
    assert sum(b.num_rows for b in made) == 2
    long, longer = (np.array(x) for b in made for x in b.column(2).to_pylist())
    # Tokens of one leaf are told apart by place; another number of tokens is another leaf.
    assert len(long) == 7 and len(longer) == 8 and len({*long, *longer}) == 15


def test_portions_and_forgetting_lose_no_line(monkeypatch):
    monkeypatch.setattr(templates, "_SEEN", 3)
    monkeypatch.setattr(templates, "_PORTION", 10)
    texts = [f"a b c d {x} f" for x in "pqrstuvw"]
    made = [b for b in templates._tokens(None)([pa.RecordBatch.from_pydict({"text": texts})])]
    assert sum(b.num_rows for b in made) == 8 and len({x for b in made for x in b.column(1).to_pylist()}) == 8
    counts = {}
    for b in templates._counted(pa.RecordBatch.from_arrays([x.column(2)], ["ks"]) for x in made if x.num_rows):
        for k, n in zip(*(c.to_pylist() for c in b.columns)):
            counts[k] = counts.get(k, 0) + n
    assert sorted(counts.values()) == [1] * 8 + [8] * 5
