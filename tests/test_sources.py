"""Written tables, discovery, locks and text output."""

import pytest

from codegrain.sources import seeds


def test_readers_see_one_version_whole(spark, tmp_path):
    path = str(tmp_path / "nodes")
    assert seeds.current(spark, path) is None
    with pytest.raises(seeds.SeedError) as x:
        seeds.load(spark, path)
    assert x.value.code == "NO_SEEDS"
    seeds.write(spark.range(3), path, meta={"n": 3})
    old = seeds.load(spark, path)
    seeds.write(spark.range(5), path)
    assert (old.count(), seeds.load(spark, path).count()) == (3, 5)
    seeds.write(spark.range(7), path, meta={"n": 7})
    assert seeds.current(spark, path)["meta"] == {"n": 7}
    assert len([p for p in (tmp_path / "nodes").iterdir() if p.name.startswith("v-")]) == 2


def test_discovery_hash_and_lock(spark, tmp_path):
    root = str(tmp_path)
    for name in ("a", "b/c", "node_modules/x", ".git/y"):
        spark.range(2).write.parquet(f"{root}/{name}/nodes.parquet")
    found = seeds.discover(spark, root)
    assert list(found) == ["a", "b/c"] and seeds.is_ready(spark, root) and not seeds.is_ready(spark, f"{root}/none")
    before = seeds.tables_hash(spark, found)
    assert before == seeds.tables_hash(spark, found)
    spark.range(3).write.mode("overwrite").parquet(f"{root}/a/nodes.parquet")
    assert before != seeds.tables_hash(spark, found)
    with seeds.locked(spark, f"{root}/a"):
        with pytest.raises(seeds.SeedError), seeds.locked(spark, f"{root}/a"):
            pass
    with seeds.locked(spark, f"{root}/a"):
        pass
    with pytest.raises(seeds.SeedError):
        seeds.package_tables(spark, {})


def test_text_table_and_guard(spark):
    assert seeds.ascii_table(spark.createDataFrame([(1, "x"), (22, None)], "id int, name string")) == "id | name\n---+-----\n1  | x\n22 |"
    for bad in ("with a as (select 1) select * from a", "delete from nodes", " drop table x"):
        with pytest.raises(seeds.SeedError):
            seeds.select_only(bad)
