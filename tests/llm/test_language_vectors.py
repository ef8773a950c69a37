"""What a task of the language model holds of the vectors of its texts."""

import tracemalloc

import numpy as np
import pandas as pd

from tallyhouse.llm import langid


def test_vectors_are_handed_over_a_few_at_a_time():
    settings = langid.Settings()
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9E00, 3000))) for _ in range(1000)]
    batch = pd.DataFrame({"text": texts, "lang": ["a", "b"] * 500, "shard": range(1000)})
    idf = np.ones(1 << settings.bits)
    tracemalloc.start()
    rows, size, shards = 0, 0, []
    for part in langid.examples_of([batch, batch[:0]], idf, ("a", "b"), settings):
        rows, shards = rows + len(part), shards + list(part["shard"])
        size += sum(p.nbytes + v.nbytes for p, v in zip(part["places"], part["values"]))
        assert list(part["label"]) == [x % 2 for x in part["shard"]]
        for i in (0, len(part) - 1):
            places, values = langid.vector(texts[part["shard"][i]], idf, settings)
            assert (part["places"][i] == places).all()
            assert (part["values"][i] == values.astype(np.float32)).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert shards == list(range(1000)) and rows == 1000
    # two parts at most, while the next is made
    assert most < 0.4 * size, (most, size)
