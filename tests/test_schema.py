import json
import subprocess
import sys

import pytest

from tidemark import NoRollbackError, Repository
from tidemark.control import schema
from tidemark.control.records import CONTROL, Change, State, data_path
from tidemark.plans.faults import Stopped, stopping

ID = "0123456789abcdef" * 2
STATE = {"revision": 1, "operation": ID, "publication": ID, "metadata": {"a": [1]}, "undo": None}


def put(d, files, delete=(), **metadata):
    with d.write() as batch:
        for path, content in files.items():
            batch.stage(path).write_bytes(content)
        for path in delete:
            batch.delete(path)
        batch.commit(metadata=metadata, quiescent=True)


def acts(d):
    def prune():
        with d.prune(quiescent=True) as plan:
            plan.delete("a")
            plan.delete("none/x")
            plan.commit(metadata={"n": 4})

    yield lambda: put(d, {"a": b"1", "d/b": b"1"}, n=1)
    yield lambda: put(d, {"a": b"2", "行/c": b"2"}, delete=["d/b"], n=2)
    yield lambda: d.rollback(quiescent=True)
    yield lambda: put(d, {"a": b"3"}, n=3)
    yield prune


def test_records_fit_at_every_step(tmp_path):
    """Whatever stands on disk when an operation stops fits, intents of all kinds among it."""
    shapes = set()
    for case in range(5):
        repository = Repository(tmp_path / f"c{case}")
        repository.initialize()
        d = repository.create_dataset("a/b:行", tmp_path / f"d{case}")
        each = list(acts(d))
        for act in each[:case]:
            act()
        at = 0
        while True:
            try:
                with stopping(at, only="replace"):
                    each[case]()
                break
            except Stopped:
                shapes |= {s for _, s in schema.records(d.root)} | {s for _, s in schema.records(repository.root)}
                assert schema.check(d.root) + schema.check(repository.root) == []
                d.recover(quiescent=True)
                at += 1
            except NoRollbackError:  # recovery has completed it
                break
        assert schema.check(d.root) == []
    with pytest.raises(Stopped), stopping(0, only="discard_tree"):
        repository.drop_dataset("a/b:行", quiescent=True)
    assert json.loads((repository.control / "register.json").read_text())["dropping"] and schema.check(repository.root) == []
    assert shapes == {"register", "dataset", "state", "change", "publish", "rollback", "prune"}


@pytest.mark.parametrize(
    "change",
    [{"revision": -1}, {"revision": True}, {"revision": 1.0}, {"operation": "x"}, {"metadata": []}, {"undo": ID.upper()}, {"more": 1}],
)
def test_misfits_of_states(change):
    assert list(schema.misfits(STATE, "state")) == []
    assert list(schema.misfits({**STATE, **change}, "state"))
    with pytest.raises(Exception, match="invalid state"):
        State.read({**STATE, **change})


@pytest.mark.parametrize("path", [
    "a",
    "a/b",
    "a.b/..c",
    ".x/y",
    "行/情",
    "a b",
    "..",
    "a/..",
    "../a",
    "/a",
    "a//b",
    "a/",
    "",
    ".",
    "a/./b",
    f"{CONTROL}",
    f"a/{CONTROL}/b",
    "a\\b",
    "a\0b",
])
def test_paths_fit_as_they_are_accepted(path):
    try:
        data_path(path)
        good = True
    except ValueError:
        good = False
    assert (list(schema.misfits(path, "path")) == []) is good
    record = {"id": ID, "before": STATE, "entries": [{"path": path, "existed": True}]}
    assert (list(schema.misfits(record, "change")) == []) is good
    if good:
        assert Change.read(record)


def test_command(tmp_path):
    repository = Repository(tmp_path / "r")
    repository.initialize()
    run = lambda: subprocess.run([sys.executable, "-m", "tidemark.control.schema", str(repository.root)], capture_output=True, text=True, timeout=60)
    assert run().returncode == 0
    (repository.control / "register.json").write_text('{"format": 2}')
    assert run().returncode == 1 and "fields other than" in run().stdout
