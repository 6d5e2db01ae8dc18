"""State dicts in one file: written, listed, digested by ranges, compared."""

import hashlib
import json
import struct

import numpy as np
import pytest

from tallyspark.operators import controls
from tallyspark.sources import tensors


def save(path, named):
    head, place = {"__metadata__": {"format": "pt"}}, 0
    for key, a in named.items():
        n = a.nbytes
        head[key] = {"dtype": "F32", "shape": list(a.shape), "data_offsets": [place, place + n]}
        place += n
    text = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + b"".join(a.tobytes() for a in named.values()))


def two_files(folder, flip=False):
    r = np.random.default_rng(1)
    folder.mkdir()
    first = {"vision.block.0.weight": r.random((64, 33), np.float32), "vision.block.0.bias": np.empty(0, np.float32), "head": r.random(3, np.float32)}
    second = {"text.embed": r.random((5000, 16), np.float32), "text.out": r.random((1, 1), np.float32)}
    if flip:
        second["text.embed"].view(np.uint8).reshape(-1)[123_457] ^= 1
    save(folder / "a b.tensors", first)
    save(folder / "two.tensors", second)
    return first | second


def test_one_changed_byte_is_found(spark, tmp_path, monkeypatch):
    before, after = two_files(tmp_path / "before"), two_files(tmp_path / "after", flip=True)
    made = {phase: tensors.manifest(spark, f"file://{tmp_path}/{phase}", phase) for phase in ("before", "after")}
    got = {r["param_key"]: (r["module"], r["digest"]) for r in made["after"].collect()}
    assert {k: d for k, (_, d) in got.items()} == {k: hashlib.sha256(a.tobytes()).hexdigest() for k, a in after.items()}
    assert got["vision.block.0.weight"][0] == "vision.block.0" and got["head"][0] == ""
    changed = controls.weight_diff(made["before"].unionByName(made["after"])).where("NOT identical").collect()
    assert [r["param_key"] for r in changed] == ["text.embed"] and set(before) == set(after)


def test_a_row_per_tensor_and_no_content_in_the_listing(spark, tmp_path):
    named = two_files(tmp_path / "w")
    found = tensors.entries(spark, f"file://{tmp_path}/w")
    assert {(r["param_key"], r["size"], tuple(r["shape"])) for r in found.collect()} == {(k, a.nbytes, a.shape) for k, a in named.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    dealt = tensors.digests(found)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in dealt  # tensors of one file go to different tasks


def test_ranges_of_a_tensor(tmp_path, monkeypatch):
    named = two_files(tmp_path / "w")
    (entry,) = [e for e in tensors.header(f"{tmp_path}/w/two.tensors") if e["param_key"] == "text.embed"]
    with tensors._opened(entry["path"]) as f:
        assert f.read_at(entry["size"], entry["begin"]) == named["text.embed"].tobytes()


@pytest.mark.parametrize("data", [b"", b"\x01", struct.pack("<Q", 1 << 40) + b"{}", struct.pack("<Q", 61) + b'{"a": {"dtype": "U8", "shape": [9], "data_offsets": [0, 9]}}  '])
def test_broken_files_are_errors(tmp_path, data):
    (tmp_path / "x.tensors").write_bytes(data)
    with pytest.raises(ValueError):
        tensors.header(f"{tmp_path}/x.tensors")


def test_written_files_read_back(spark, tmp_path):
    rows = spark.range(50).selectExpr("id % 3 AS file", "concat('m.', id) AS param_key", "encode(concat('bytes ', id), 'UTF-8') AS data")
    assert tensors.write(rows, f"file://{tmp_path}/out").count() == 3
    got = {r["param_key"]: r["digest"] for r in tensors.manifest(spark, f"file://{tmp_path}/out", "before", 7).collect()}
    assert got == {f"m.{i}": hashlib.sha256(f"bytes {i}".encode()).hexdigest() for i in range(50)}
