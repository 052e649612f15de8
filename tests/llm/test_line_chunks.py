"""Line dedup goes by chunks first; line pairs only extend them."""
import numpy as np

from barloom.llm import lines
from barloom.llm.common import keyed_texts
from barloom.session import materialize


def test_repeats_are_found_by_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = lambda: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(6))
    block = [line() for _ in range(40)]
    rows = [(k, "\n".join([line(), *block, "", line()])) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    looked = []
    inner = lines._repeated
    monkeypatch.setattr(lines, "_repeated", lambda found, keyed: looked.append(found) or inner(found, keyed))
    left = {r.doc_id: r.text for r in lines.without_passages(frame).collect()}
    assert left[0] == rows[0][1] and all(not set(block) & set(left[k].split("\n")) for k in (1, 2))
    chunks, pairs = (f.count() for f in looked)
    every = materialize(lines.units(keyed_texts(frame)), "units").filter("within IS NOT NULL").count()
    assert chunks > 12 and pairs < every * 0.75  # most pairs of the copies lie in chunks that went
