"""A worker holds one operator's state at a time."""

from loomtext.llm import _held


def test_one_state_at_a_time():
    built = []

    def make(name):
        return lambda: built.append(name) or name

    assert _held.held("a", make("a")) == "a" and _held.held("a", make("again")) == "a"
    assert _held.held("b", make("b")) == "b" and list(_held._state) == ["b"]
    assert _held.held("a", make("a2")) == "a2"
    _held.release()
    assert not _held._state and built == ["a", "b", "a2"]
