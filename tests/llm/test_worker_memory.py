"""What a Python worker of the pipeline holds at once, as tracemalloc counts it."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from turnstone.llm import common, jaccard_join, toxicity


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    return ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (60_000, 8))]


@pytest.fixture(scope="module")
def sample(words):
    clean = [" ".join(words[i : i + 100]).encode() + b"." for i in range(0, len(words), 100)]
    toxic = [f"you are a wobblegit {i} {words[i]}. zorkfish blatherskite {words[-i]}.".encode() for i in range(60)]
    return [*clean, *toxic], np.arange(len(clean) + len(toxic)) >= len(clean)


def test_training_holds_no_features_of_all_words(sample):
    # measured: 51 MB; 125 with the features of all words in one array
    assert peak_mb(lambda: toxicity.train(*sample)) < 80


def test_scoring_holds_no_dense_table(sample, words):
    model = pickle.dumps(toxicity.train(*sample))
    rng = np.random.default_rng(4)
    text = pa.array([" ".join(rng.choice(words, 3000)).encode() for _ in range(80)])

    def score():
        read, known = pickle.loads(model), toxicity.Known()
        for at, to in common.pieces(text, toxicity.PIECE):
            read.score(read.worst(toxicity.readings(*toxicity.scan.view(text, at, to)), to - at, known))

    # measured: 39 MB; 75 with a row of the table for each of all subsequences
    assert peak_mb(score) < 55


def test_keys_of_a_batch_are_held_once(words):
    rng = np.random.default_rng(5)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000)), "text": pa.array([" ".join(rng.choice(words, 300)) for _ in range(4000)])})
    keys = jaccard_join._keys(5, 80, 100, np.zeros(0, np.uint64), 96)
    # measured: 44 MB; 91 with what the sort leaves behind
    assert peak_mb(lambda: [None for _ in keys(iter([batch]))]) < 65


def test_released_passes_all_batches_on():
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(common.released(lambda some: (b for b in some))(iter(batches))) == batches
    assert list(common.released(lambda some: iter(()))(iter(batches))) == []
