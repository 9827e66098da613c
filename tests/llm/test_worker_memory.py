"""What a task holds beside its input is bounded: executors keep their Python workers beside the JVM's heap."""

import tracemalloc

import numpy as np
import pyarrow as pa

from evenhand.llm import langid, ngram_join, textarrays


def _peak(run, *batches: pa.RecordBatch) -> float:
    """Peak of a task's allocations, in MB, without what is kept for all tasks."""
    for _ in run(iter(batches)):
        pass
    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _texts(rows: int) -> pa.RecordBatch:
    texts = [" ".join(f"word{i % 7}x{(i * j) % 991}" for j in range(400)) for i in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts), pa.array(range(rows), pa.int64())], ["id", "text", "h"])


def test_language_task_holds_little():
    batch = _texts(900)  # some 4 MB of text
    assert _peak(langid._document_frequencies(1 << 12), batch.select(["text"])) < 25


def test_shingle_task_holds_little():
    assert _peak(ngram_join._profile(5), _texts(900)) < 25


def test_entry_task_holds_its_entries_about_twice():
    size, rng = 1 << 19, np.random.default_rng(0)
    tok, name = rng.integers(0, size, size).astype(np.uint64), np.arange(size, dtype=np.int64)
    blob = b"".join([np.int64(size).tobytes(), tok.tobytes(), name.tobytes(), np.full(size, 9, np.int32).tobytes(), np.zeros(size, bool).tobytes()])
    batch = pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])
    rows = [r for b in ngram_join._shared(iter([batch])) for r in b.column(1).to_pylist()]
    values, n = np.unique(tok, return_counts=True)
    assert sorted(rows) == name[np.isin(tok, values[n > 1])].tolist()
    assert _peak(ngram_join._shared, batch) / (21 * size / 1e6) < 3


def test_large_groups_hand_memory_back(monkeypatch):
    called = []
    monkeypatch.setattr(ngram_join, "release", lambda: called.append(1), raising=False)

    class levels:
        value = np.zeros(ngram_join.CELLS, np.uint8)

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    for pad, expected in ((0, []), (600_000, [1])):
        full = pa.array([t + " " * pad for t in texts])
        names = [ngram_join.set_name(u) for _, _, d, o in textarrays.slices(full) for u in textarrays.shingle_sets(d, o)]
        out = ngram_join._compare(levels, 5, 0.75)((pa.scalar(names[0]), pa.scalar(0)), pa.table({"hub": [names[0]] * 2, "s": names, "text": full}))
        assert out.to_pylist() == [{"a": names[0], "b": names[1]}] and called == expected


def test_powers_of_a_long_word_are_not_kept():
    word = np.full(4 << 20, ord("a"), np.uint8)
    one, _ = textarrays.word_hashes(word, np.array([0, len(word)]))
    assert len(one) == 1 and len(textarrays._POWERS["up"]) < len(word)
    again, _ = textarrays.word_hashes(np.concatenate([np.full(9, ord(" "), np.uint8), word]), np.array([0, len(word) + 9]))
    assert one[0] == again[0]
