import time

from gradeloom.llm import worker as W


def test_memory_is_bounded_by_bytes():
    m = W.Memory(100_000)
    for batch in range(50):
        words = [f"{batch}-{i}" + "x" * 100 for i in range(100)]
        todo = m.missing(words + ["kept"])
        m.add({w: b"v" for w in todo})
        assert all(w in m.new for w in words) and "kept" in m.new
        m.turn()
        assert len(m.new) + len(m.old) <= 100_000 // 2 // (W.Memory.EACH + 100) * 2 + 202
    assert m.missing(["kept"]) == [] and "kept" in m.new


def test_slices_take_whole_texts():
    texts = ["a" * 5, "b" * 5, "c" * 30, "", "d"]
    assert list(W.slices(texts, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(W.slices([], 10)) == [] and list(W.slices(["x" * 99], 10)) == [(0, 1)]


def test_idle_workers_hold_nothing(monkeypatch):
    monkeypatch.setattr(W, "IDLE", 0.2)
    made = []

    def make(x):
        made.append(x)
        return [x]

    with W.task():
        a = W.kept(make, 1)
        assert W.kept(make, 1) is a and made == [1]
        time.sleep(0.5)  # a running task keeps it
        assert W.kept(make, 1) is a
    with W.task():
        assert W.kept(make, 1) is a  # and so do tasks that follow each other
    time.sleep(0.8)
    assert not W._kept
    with W.task():
        W.kept(make, 1)
        W.kept(dict)
        assert [k[0] for k in W._kept] == [dict]  # another kind goes first
