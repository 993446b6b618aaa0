"""Changes by key: the rows as one change after the other makes them, and parts that no change touches stay as they are."""

import os
import random

import pytest

from sparkloom.sources import keyed

SCHEMA = "id long, name string, n long, __first string"
CHANGES = SCHEMA + ", op string, place long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) if "_staged" not in d and "_layout" not in d for f in names if f.endswith(".parquet")}


def by_hand(rows, changes):
    table = {r[0]: r[1:] for r in rows}
    for id_, *values, op, _ in sorted((c for c in changes if c[0] is not None), key=lambda c: c[-1]):
        if op == "upsert":
            table[id_] = tuple(values)
        elif op == "delete":
            table.pop(id_, None)
        elif id_ in table:
            table[id_] = tuple(old if new is None else new for old, new in zip(table[id_], values, strict=True))
    return sorted((k, *v) for k, v in table.items())


def content(spark, path):
    return sorted(tuple(r) for r in keyed.read(spark, str(path)).collect())


def test_changes_one_after_the_other(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"name {k}", k, None if k % 3 else "x") for k in range(60)]
    keyed.create(spark.createDataFrame(rows + [(None, "none", 0, "y")], SCHEMA), str(tmp_path / "t"), "id", 8)
    for batch in range(3):
        made = [(rng.choice([rng.randrange(80), rng.randrange(80), None]), rng.choice([None, f"new {p}"]), rng.choice([None, p]), None, rng.choice(["upsert", "delete", "patch", "patch"]), p) for p in range(120)]
        rows = by_hand(rows, made)
        keyed.apply(spark.createDataFrame(made, CHANGES), str(tmp_path / "t"), f"b{batch}")
        assert content(spark, tmp_path / "t") == rows


def test_other_parts_stay_untouched(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.range(200).selectExpr("id", "concat('n', id) name", "id n", "'x' __first"), path, "id", 10)
    before, part_of = files(path), {r["id"]: r[keyed.PART] for r in keyed.read(spark, path, with_part=True).collect()}
    keyed.apply(spark.createDataFrame([(7, "seven", None, None, "patch", 1), (8, None, None, None, "delete", 2)], CHANGES), path, "b")
    touched, now = {part_of[7], part_of[8]}, files(path)
    same = {f for f, t in before.items() if now.get(f) == t}
    assert {int(f.split(f"{keyed.PART}=")[1].split("/")[0]) for f in set(before) - same} == touched and len(same) == 10 - len(touched)
    got = {r["id"]: r["name"] for r in keyed.read(spark, path).collect()}
    assert got[7] == "seven" and 8 not in got and len(got) == 199
    # a part whose rows all go
    gone = [k for k, p in part_of.items() if p == part_of[7]]
    keyed.apply(spark.createDataFrame([(k, None, None, None, "delete", 1) for k in gone], CHANGES), path, "c")
    assert not set(gone) & {r["id"] for r in keyed.read(spark, path).collect()} and not os.path.exists(f"{path}/{keyed.PART}={part_of[7]}")
    keyed.apply(spark.createDataFrame([], CHANGES), path, "d")
    assert keyed.read(spark, path).count() == 200 - len({*gone, 8})


def test_a_failed_run_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    keyed.create(spark.range(40).selectExpr("id", "'old' name", "id n", "'x' __first"), path, "id", 4)
    changes = spark.createDataFrame([(k, "new", 0, "y", "upsert", k) for k in range(5)], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(keyed, "publish", lambda *a: (_ for _ in ()).throw(OSError("the driver is lost")))
        with pytest.raises(OSError):
            keyed.apply(changes, path, "b")
    assert {r["name"] for r in keyed.read(spark, path).collect()} == {"old"}
    folder = keyed.stage(changes, path, "b")
    with monkeypatch.context() as m:  # half published: rows are in their place, the stage is still there
        m.setattr(keyed, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost again")))
        with pytest.raises(OSError):
            keyed.publish(spark, path, folder)
    for _ in range(2):
        keyed.apply(changes, path, "b")
        assert sorted(r["id"] for r in keyed.read(spark, path).where("name = 'new'").collect()) == list(range(5)) and keyed.read(spark, path).count() == 40
    assert not os.path.exists(folder)


def test_cascade(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.range(30).selectExpr("id", "concat('p', id % 5) name", "id % 7 n", "'x' __first"), path, "id", 6)
    keyed.cascade(spark.createDataFrame([(3,), (3,), (99,), (None,)], "parent long"), path, "n", "b")
    assert sorted(r["id"] for r in keyed.read(spark, path).collect()) == [k for k in range(30) if k % 7 != 3]
